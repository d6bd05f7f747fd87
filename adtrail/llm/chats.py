"""Chat formatting from reply trees (DataFrame functions only).

Messages name the message they reply to. Jump tables, made by self-joins that double their reach in
each round, give every message its depth and the total score of the path to it; leaves are ranked by
that score, and the chosen leaves walk the same tables back to list their paths. A tree of any shape
needs as many rounds as its depth has binary digits. Each path becomes one conversation, whose text
can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail.plans.cut import materialise
from adtrail.plans.groups import ordered, top_per

#: Marks around the turn of a role, and around a turn of any other role (fixed values).
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")


@dataclass(frozen=True)
class Template:
    """Marks of the roles and the roles whose texts are trained on.

    A control string inside a text gets a backslash after its first character, one more if it has
    some already, so no mark is left in it and nothing else changes; taking one away restores it. No
    mark may begin inside another one, which ``pattern`` checks.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(MARKS))
    other: tuple[str, str, str] = OTHER
    trained: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other))

    def pattern(self) -> tuple[str, str]:
        """Regular expressions of a first character and of what follows it and the backslashes."""
        cs = self.controls
        if any(len(c) < 2 or "\\" in c for c in cs):
            raise ValueError("marks need two characters and no backslash")
        for a in cs:
            for b in cs:
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1 if a == b else 0, len(a))):
                    raise ValueError(f"{b!r} may begin inside {a!r}")
        first = "".join(sorted({re.escape(c[0]) for c in cs}))
        return f"([{first}])", "(" + "|".join(re.escape(c[1:]) for c in cs) + ")"

    def escape(self, text: Column) -> Column:
        first, rest = self.pattern()
        return F.regexp_replace(text, rf"{first}(\\*){rest}", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        first, rest = self.pattern()
        return F.regexp_replace(text, rf"{first}\\(\\*){rest}", "$1$2$3")

    def opening(self, role: Column) -> Column:
        a, b, _ = self.other
        out = F.concat(F.lit(a), self.escape(role), F.lit(b))
        for name, (mark, _) in self.marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, (_, mark) in self.marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def turns(self, formatted: Column) -> Column:
        """The turns of a formatted conversation: ``array<struct<role, text>>``."""
        pairs = [*self.marks.values(), (self.other[0], self.other[2])]
        turn = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in pairs)
        a, b, c = map(re.escape, self.other)
        whole = rf"(?s)^{a}(.*?){b}(.*){c}$"

        def read(t: Column) -> Column:
            role, text = (F.regexp_extract(t, whole, i) for i in (1, 2))
            for name, (start, end) in self.marks.items():
                here = t.startswith(start)
                role = F.when(here, F.lit(name)).otherwise(role)
                text = F.when(here, F.substring(
                    t, F.lit(len(start) + 1), F.length(t) - len(start) - len(end))).otherwise(text)
            return F.struct(self.unescape(role).alias("role"), self.unescape(text).alias("text"))

        return F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(0)), read)

    def trained_text(self, segments: Column) -> Column:
        """All text under the loss mask of ``segments``, as it was before it was escaped."""
        kept = F.filter(segments, lambda s: s["loss"])
        return F.array_join(F.transform(kept, lambda s: self.unescape(s["text"])), "")


def _reach(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``nodes(n, up, score)`` to (n, depth, total) of every node below a root, and the jump tables:
    the k-th holds each node's ancestor 2**k steps up, where there is one."""
    state = materialise(nodes.select(
        "n", F.col("up").alias("at"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    count, jumps = state.count(), []
    while True:
        active = state.where("at is not null")
        # with 2**k steps behind it, what is still on its way goes round in a cycle
        if active.isEmpty() or 1 << len(jumps) > count:
            return state.where("at is null").drop("at"), jumps
        jumps.append(active.select(F.col("n").alias("_m"), F.col("at").alias("_to")))
        far = state.select(F.col("n").alias("at"), F.col("at").alias("_at"),
                           F.col("depth").alias("_d"), F.col("total").alias("_t"))
        moved = active.join(far, "at").select(
            "n", F.col("_at").alias("at"), (F.col("depth") + F.col("_d")).alias("depth"),
            (F.col("total") + F.col("_t")).alias("total"))
        state = materialise(state.where("at is null").unionByName(moved))


def _paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``leaves(leaf, depth)`` to one row (leaf, n, pos) per node of each path, pos from 1 at the
    root: every row found so far leaps 2**k steps up, from the largest k down to 1."""
    rows = leaves.select("leaf", F.col("leaf").alias("n"), F.col("depth").alias("pos"))
    for k, jump in reversed(list(enumerate(jumps))):
        leapt = F.struct("leaf", F.col("_to").alias("n"), (F.col("pos") - (1 << k)).alias("pos"))
        here = F.struct("leaf", "n", "pos")
        rows = rows.join(jump, F.col("n") == F.col("_m"), "left").select(F.inline(
            F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, leapt))))
    return rows


def format_branches(messages: DataFrame, tree: str = "tree_id", id: str = "message_id", parent: str = "parent_id",
                    role: str = "role", text: str = "text", score: str | None = None, keep: int | None = 1,
                    template: Template = Template()) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of every tree (all, if None) as conversations.

    Returns ``tree, leaf`` (the last message's id), ``rank`` (from 1, by the sum of the scores along
    the path, ties to the smaller leaf id), ``score, n_turns, formatted, segments``
    (``array<struct<text, loss>>``, which joined give ``formatted``) and ``loss_spans``
    (``array<struct<start, length>>``, code points from 0).

    A message whose parent is NULL, not in its tree, or itself starts a path. NULL scores count 0,
    NULL texts and roles are empty. Of rows that repeat a tree and id, the first by role and text's md5
    counts; a message without id has no replies. Replies that go round in a cycle have no root, so no
    path. NULL trees are one tree. An empty table gives no rows; further columns are ignored.

    A path's text is put together in one row, as the result needs it; all else is split by message.
    """
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(
        F.col(tree).alias("_tree"), F.col(id).alias("_id"), F.col(parent).alias("_parent"), points.alias("_score"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = materialise(rows.withColumn("n", F.monotonically_increasing_id()))
    alone = F.when(F.col("_id").isNull(), F.col("n"))
    nodes = rows.groupBy("_tree", "_id", alone.alias("_alone")).agg(F.min(F.struct(
        "_role", F.md5("_text").alias("_hash"), "_parent", "_score", "n")).alias("_of")).select(
        F.col("_of.n").alias("n"), "_tree", "_id", F.col("_of._parent").alias("_parent"),
        F.col("_of._score").alias("score"))
    nodes = materialise(nodes)
    replies = nodes.where("_parent is not null and not (_parent <=> _id)").select(
        F.col("n").alias("_n"), F.col("_tree").alias("_of"), "_parent")
    ups = replies.join(nodes.select("n", "_tree", "_id"), F.col("_of").eqNullSafe(F.col("_tree"))
                       & (F.col("_parent") == F.col("_id"))).select("_n", F.col("n").alias("up"))
    linked = materialise(nodes.join(ups, F.col("n") == F.col("_n"), "left").select(
        "n", "_tree", "_id", "up", "score"))
    reached, jumps = _reach(linked)
    inner = linked.where("up is not null").select(F.col("up").alias("n")).distinct()
    leaves = reached.join(inner, "n", "left_anti").join(linked.select("n", "_tree", "_id"), "n").select(
        F.col("n").alias("leaf"), "depth", "total", "_tree", "_id", (-F.col("total")).alias("_worst"))
    if keep is None:
        leaves = ordered(leaves, ["_tree"], ["_worst", "_id", "leaf"]).running_sum(F.lit(1), "rank").result()
    else:
        leaves = top_per(leaves, ["_tree"], ["_worst", "_id", "leaf"], keep, rank="rank")
    leaves = materialise(leaves)
    turns = _paths(leaves, jumps).join(rows.select("n", "_role", "_text"), "n").select(
        "leaf", "pos", template.opening(F.col("_role")).alias("open"), template.escape(F.col("_text")).alias("text"),
        template.closing(F.col("_role")).alias("close"), F.col("_role").isin(*template.trained).alias("loss"))
    so_far = Window.partitionBy("leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("open") + F.length("text") + F.length("close")
    turns = turns.withColumn("end", F.sum(size).over(so_far) - F.length("close"))
    whole = turns.groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("pos", "open", "text", "close", "loss", "end"))).alias("_t"))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    span = lambda t: F.struct(
        (t["end"] - F.length(t["text"])).alias("start"), F.length(t["text"]).cast("long").alias("length"))
    whole = whole.select(
        "leaf", F.size("_t").cast("long").alias("n_turns"),
        F.array_join(F.transform("_t", lambda t: F.concat(t["open"], t["text"], t["close"])), "").alias("formatted"),
        F.flatten(F.transform("_t", lambda t: F.array(
            segment(t["open"], F.lit(False)), segment(t["text"], t["loss"]),
            segment(t["close"], F.lit(False))))).alias("segments"),
        F.transform(F.filter("_t", lambda t: t["loss"]), span).alias("loss_spans"))
    return whole.join(leaves, "leaf").select(
        F.col("_tree").alias(tree), F.col("_id").alias("leaf"), F.col("rank").cast("long").alias("rank"),
        F.col("total").alias("score"), "n_turns", "formatted", "segments", "loss_spans")
