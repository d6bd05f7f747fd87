"""128-bit perceptual hashes: lanes, distance, bands, gradients.

A hash travels as 32 hex characters. For arithmetic it becomes two signed 64-bit lanes
(``hi``, ``lo``), so a distance is two XORs and two population counts inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adtrail.functions.cols import Col, as_col

HASH_BITS = 128


def lane(hex_hash: Col, which: int) -> Column:
    """64-bit lane 0 (high) or 1 (low) of a hex hash of at most 32 characters."""
    padded = F.lpad(as_col(hex_hash), 32, "0")
    return F.conv(F.substring(padded, 1 + 16 * which, 16), 16, -10).cast("bigint")


def hash_lanes(hex_hash: Col) -> Column:
    return F.array(lane(hex_hash, 0), lane(hex_hash, 1))


def hash_bits(hex_hash: Col) -> Column:
    """The 128 bits as a string of 0 and 1."""
    return F.concat(*[
        F.lpad(F.bin(F.conv(F.substring(F.lpad(as_col(hex_hash), 32, "0"), 1 + 8 * i, 8), 16, 10)
                     .cast("bigint")), 32, "0")
        for i in range(4)
    ])


def distance(hi_a: Col, lo_a: Col, hi_b: Col, lo_b: Col) -> Column:
    return (F.bit_count(as_col(hi_a).bitwiseXOR(as_col(hi_b)))
            + F.bit_count(as_col(lo_a).bitwiseXOR(as_col(lo_b))))


def hamming(a: Col, b: Col) -> Column:
    """Number of differing bits of two hex hashes."""
    return distance(lane(a, 0), lane(a, 1), lane(b, 0), lane(b, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def band_masks(n: int) -> list[tuple[int, int]]:
    """``n`` disjoint masks (high lane, low lane) that cover the 128 bits evenly."""
    masks = []
    for i in range(n):
        first, last = i * HASH_BITS // n, (i + 1) * HASH_BITS // n
        whole = ((1 << (last - first)) - 1) << (HASH_BITS - last)
        masks.append((_signed(whole >> 64), _signed(whole & ((1 << 64) - 1))))
    return masks


def band_of(hi: Col, lo: Col, mask: tuple[int, int]) -> tuple[Column, Column]:
    return (as_col(hi).bitwiseAND(F.lit(mask[0]).cast("bigint")),
            as_col(lo).bitwiseAND(F.lit(mask[1]).cast("bigint")))


def first_shared_band(hi_a, lo_a, hi_b, lo_b, masks) -> Column:
    """Number of the first band on which two hashes agree; NULL when there is none."""
    dh = as_col(hi_a).bitwiseXOR(as_col(hi_b))
    dl = as_col(lo_a).bitwiseXOR(as_col(lo_b))
    out = None
    for i, m in enumerate(masks):
        h, l = band_of(dh, dl, m)
        same = h.bitwiseOR(l) == 0
        out = F.when(same, i) if out is None else out.when(same, i)
    return out


def dhash(grid: Col, size: int = 8) -> Column:
    """Gradient hash of a ``(size+1)²`` grey grid given as a flat array.

    One bit per cell says whether it is darker than its right neighbour; a second set says the
    same for the cell below. With ``size=8`` this is 64 + 64 bits, printed as 32 hex digits.
    """
    g, width, n = as_col(grid), size + 1, size * size

    def packed(step: int) -> Column:
        # the grid against itself shifted by one cell or one row; the last column is left out
        core = size * width
        darker = F.zip_with(F.slice(g, 1, core), F.slice(g, 1 + step, core), lambda a, b: a < b)
        bits = F.filter(darker, lambda b, i: i % width < size)
        total = F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(
            acc, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("bigint")))
        return F.lower(F.lpad(F.hex(total), (n + 3) // 4, "0"))

    return F.concat(packed(1), packed(width))
