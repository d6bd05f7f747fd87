"""License scans: TF-IDF cosine of lines and of windows of consecutive lines against statements and
headers, of whole licence files against full texts, then inheritance from the nearest directory with a
licence file (DataFrame functions only)."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from adtrail.plans.cut import materialise

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
          "promote products derived from this software without specific prior written permission. ")
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
    "by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License.")
_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} "
        "Public License as published by the Free Software Foundation, either version {v} of the License, or (at your "
        "option) any later version.")
_GNU_ALL = (_GNU + " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} "
            "Public License for more details. You should have received a copy of the GNU {kind} Public License along "
            "with this {what}. If not, see https://www.gnu.org/licenses/.")
_GNU_KINDS = (
    ("GPL-2.0", "General", "2", "program"), ("GPL-3.0", "General", "3", "program"),
    ("LGPL-2.1", "Lesser General", "2.1", "library"), ("LGPL-3.0", "Lesser General", "3", "library"),
    ("AGPL-3.0", "Affero General", "3", "program"))
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.")

#: Statements of common licences (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
                   "except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # titles and usual headers, wrapped over several lines
    ("Apache-2.0", "Apache License Version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *[(n, f"GNU {kind} Public License Version {v}") for n, kind, v, _ in _GNU_KINDS],
    *[(n, f"Licensed under the GNU {kind} Public License, version {v}.") for n, kind, v, _ in _GNU_KINDS],
    *[(n, form.format(kind=kind, v=v, what=what)) for n, kind, v, what in _GNU_KINDS for form in (_GNU, _GNU_ALL)],
    ("MIT", _MIT), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE),
    ("BSD-3-Clause", _BSD.format(_BSD_3)), ("BSD-2-Clause", _BSD.format("")),
)
#: Full texts kept as files beside this module (read by the driver).
TEXT_FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1",
              "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
THRESHOLD = 0.8
#: A licence file by name.
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"
#: An identifier or expression of identifiers, stated outright.
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*(?!NONE\b|NOASSERTION\b)({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
#: Windows have up to this many times the terms of the longest template that the text can reach.
WINDOW = 2
_TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


VOCABULARY = tuple(sorted({w for _, t in TEMPLATES for w in terms(t)}))


def _line_terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_TERM), F.lit(0))


#: Inverse document frequencies over the templates, not over the given files: a line gets the same
#: verdict in every table. A term outside the templates has a fixed weight (each as a term of its own).
OTHER = 1.5


def inverse_frequencies(templates) -> dict[str, float]:
    """Smoothed inverse document frequency of each term of the templates over the templates."""
    n = Counter(w for _, t in templates for w in set(terms(t)))
    return {w: math.log((1 + len(templates)) / (1 + c)) + 1.0 for w, c in n.items()}


def _vectors(templates, idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, t in templates:
        v = {w: n * idf[w] for w, n in Counter(terms(t)).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        out.append({w: x / norm for w, x in v.items()})
    return out


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Full texts by license. The AGPL is the GPL with its own name: no other text stands for it."""
    at = Path(__file__).with_name("license_texts")
    texts = {n: (at / f).read_text(encoding="utf-8") for n, f in TEXT_FILES.items()}
    texts["AGPL-3.0"] = re.sub(r"(?i)gnu(\s+)general", r"GNU Affero\1General", texts["GPL-3.0"])
    return tuple(texts.items())


def _literal(value, kind: str) -> Column:
    """A constant table, folded into one literal when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


#: Terms that prose holds often: other terms are asked for first.
_OFTEN = ("a above all along an and any are as at be but by can do either for form from general have however if in "
          "into is its law list may means more must name not of on one or other out public see shall so that this to "
          "under use version was will with within without work you your 1 2 3 it")


def anchors(templates, vectors: list[dict[str, float]], threshold: float) -> set[str]:
    """Terms of which a text holds at least one if it reaches the threshold for any template: the
    others' part of each unit vector is shorter than the threshold (Cauchy-Schwarz)."""
    often = {w: n for n, group in enumerate((_OFTEN, "mit", "the")) for w in group.split()}
    out: set[str] = set()
    for v in vectors:
        left = sum(x * x for w, x in v.items() if w not in out)
        for w in sorted(v, key=lambda w: (often.get(w, -1), -v[w], w)):
            if left < threshold ** 2 - 1e-6:
                break
            if w not in out:
                out.add(w)
                left -= v[w] ** 2
    return out


def scan_headers(files: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``_row`` (the input row), ``own`` (score, license, line number) of its best window of
    consecutive lines, NULL if none reaches the threshold. Ties go to the first template, then the
    first line, then the shortest window. An SPDX line states its identifier with a score of 1.

    Blank lines count for nothing. A window is one line of any length, or lines with up to ``WINDOW``
    times the terms of the longest template that the text's terms can reach. Terms that no template
    has count at a fixed weight, so that a statement must be most of its window."""
    idf = inverse_frequencies(TEMPLATES)
    vectors = _vectors(TEMPLATES, idf)
    marks = anchors(TEMPLATES, vectors, threshold)
    names = sorted(VOCABULARY, key=lambda w: (w not in marks, w))
    known = F.array(*[F.lit(w) for w in names])
    weight = _literal([idf[w] for w in names], "array<double>")
    unit = _literal([[v.get(w, 0.0) for v in vectors] for w in names], "array<array<double>>")
    length = _literal([len(terms(t)) for _, t in TEMPLATES], "array<int>")
    ids = lambda w: F.transform(w, lambda x: (F.array_position(known, x) - 1).cast("int"))
    none = F.array().cast("array<int>")
    df = files.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_has", F.array_intersect(_line_terms(F.col("_t")), known))
    df = df.withColumn("_has", F.when(F.arrays_overlap("_has", F.array(*[F.lit(w) for w in sorted(marks)])),
                                      ids(F.col("_has"))).otherwise(none))
    df = df.withColumn("_can", F.when(F.size("_has") > 0, F.filter(
        F.sequence(F.lit(0), F.lit(len(TEMPLATES) - 1)), lambda k: F.aggregate(
            "_has", F.lit(0.0), lambda a, d: a + F.pow(F.get(F.get(unit, d), k), F.lit(2.0)))
        >= threshold ** 2 - 1e-9)).otherwise(none))
    df = df.withColumn("_cap", WINDOW * F.aggregate("_can", F.lit(0), lambda a, k: F.greatest(a, F.get(length, k))))
    lines = F.transform(F.split("_t", "\n"), lambda x, i: F.struct(_line_terms(x).alias("w"), i.alias("i")))
    df = df.withColumn("_lines", F.when(F.size("_can") > 0, F.filter(lines, lambda x: F.size(x["w"]) > 0)).otherwise(
        F.array().cast("array<struct<w:array<string>,i:int>>")))
    df = df.withColumn("_lines", F.transform("_lines", lambda x: F.struct(
        x["i"].alias("i"), F.size(x["w"]).alias("n"),
        F.filter(ids(x["w"]), lambda d: d >= 0).alias("d"))))
    # how many lines from here fit into a window
    df = df.withColumn("_lines", F.transform("_lines", lambda x, s: F.struct(
        x["i"].alias("i"), x["n"].alias("n"), x["d"].alias("d"),
        F.coalesce(F.array_min(x["d"]) < len(marks), F.lit(False)).alias("mark"),
        F.greatest(F.lit(1), F.aggregate(
            F.slice("_lines", s + 1, F.greatest(F.col("_cap"), F.lit(1))),
            F.struct(F.lit(0).alias("t"), F.lit(0).alias("m")),
            lambda a, y: F.struct((a["t"] + y["n"]).alias("t"),
                                  (a["m"] + F.when(a["t"] + y["n"] <= F.col("_cap"), 1).otherwise(0)).alias("m")),
            lambda a: a["m"])).alias("m"))))

    def windows(x, s):
        part = lambda e: F.slice("_lines", s + 1, e - s + 1)
        ends = F.filter(F.sequence(s, s + x["m"] - 1), lambda e: (F.size(F.get("_lines", e)["d"]) > 0)
                        & F.exists(part(e), lambda y: y["mark"]))
        # a line without known terms at either end only lowers the score
        return F.when(F.size(x["d"]) > 0, F.transform(ends, lambda e: F.struct(
            x["i"].alias("i"), (e - s).alias("more"),
            F.aggregate(part(e), F.lit(0), lambda a, y: a + y["n"]).alias("n"),
            F.sort_array(F.flatten(F.transform(part(e), lambda y: y["d"]))).alias("d")))).otherwise(
                F.array().cast("array<struct<i:int,more:int,n:int,d:array<int>>>"))
    df = df.withColumn("_win", F.flatten(F.transform("_lines", windows)))
    # sum of (count x weight)^2 over equal neighbours: the c-th copy adds 2c - 1 squares of the weight
    squares = lambda d: F.aggregate(
        d, F.struct(F.lit(-1).alias("p"), F.lit(0).alias("c"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct(
            x.alias("p"), F.when(x == a["p"], a["c"] + 1).otherwise(1).alias("c"),
            (a["q"] + F.pow(F.get(weight, x), F.lit(2.0))
             * F.when(x == a["p"], 2 * a["c"] + 1).otherwise(1)).alias("q")),
        lambda a: a["q"])
    df = df.withColumn("_win", F.transform("_win", lambda x: F.struct(
        x["i"].alias("i"), x["more"].alias("more"), x["d"].alias("d"), squares(x["d"]).alias("q"),
        ((x["n"] - F.size(x["d"])) * F.lit(OTHER ** 2)).alias("o"))))
    # the exact bound on the share of known terms spares most windows
    df = df.withColumn("_win", F.filter("_win", lambda x: x["q"] * F.lit(1 / threshold ** 2 - 1) >= x["o"] - 1e-9))
    score = lambda x: F.transform("_can", lambda k: F.struct(
        F.round(F.aggregate(x["d"], F.lit(0.0), lambda a, d: a + F.get(weight, d) * F.get(F.get(unit, d), k))
                / F.sqrt(x["q"] + x["o"]), 9).alias("score"),
        (-k).alias("k"), (-x["i"]).alias("i"), (-x["more"]).alias("more")))
    df = df.withColumn("_best", F.array_max(F.flatten(F.transform("_win", score))))
    licenses = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    spdx = F.regexp_extract("_t", SPDX, 1)
    own = F.when(spdx != "", F.struct(
        F.lit(1.0).alias("score"), spdx.alias("license"),
        F.array_position(F.transform(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(SPDX))), True)
        .cast("int").alias("line"))).when(F.col("_best.score") >= threshold, F.struct(
            F.col("_best.score").alias("score"), F.get(licenses, -F.col("_best.k")).alias("license"),
            (-F.col("_best.i") + 1).alias("line")))
    return df.select("_row", own.alias("own"))


def _whole_text(df: DataFrame, text: Column, threshold: float) -> DataFrame:
    """``df`` with ``_whole``: score, license and line (1) of a text compared as a whole with the full
    texts; NULL for a NULL text."""
    texts = full_texts()
    idf = inverse_frequencies(texts)
    vectors = _vectors(texts, idf)
    names = sorted(idf)
    known = _literal(names, "array<string>")
    weight = _literal([idf[w] for w in names], "array<double>")
    unit = _literal([[round(v.get(w, 0.0), 9) for v in vectors] for w in names], "array<array<double>>")
    df = df.withColumn("_all", F.sort_array(_line_terms(F.coalesce(text, F.lit("")))))
    df = df.withColumn("_at", F.when(F.size("_all") > 0, F.filter(
        F.sequence(F.lit(0), F.size("_all") - 1),
        lambda i: F.coalesce(F.get("_all", i - 1) != F.get("_all", i), F.lit(True)))).otherwise(
            F.array().cast("array<int>")))
    df = df.withColumn("_v", F.transform("_at", lambda p, j: F.struct(
        (F.array_position(known, F.get("_all", p)) - 1).cast("int").alias("d"),
        (F.coalesce(F.get("_at", j + 1), F.size("_all")) - p).alias("c"))))
    df = df.withColumn("_x", F.transform(F.filter("_v", lambda e: e["d"] >= 0), lambda e: F.struct(
        e["d"].alias("d"), (e["c"] * F.get(weight, e["d"])).alias("x"))))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, e: a + e["x"] * e["x"]) + F.lit(OTHER ** 2) * F.aggregate(
        F.filter("_v", lambda e: e["d"] < 0), F.lit(0), lambda a, e: a + e["c"]))
    df = df.withColumn("_norm", norm)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(texts) - 1)), lambda k: F.struct(
        F.round(F.aggregate("_x", F.lit(0.0), lambda a, e: a + e["x"] * F.get(F.get(unit, e["d"]), k))
                / F.col("_norm"), 9).alias("score"), (-k).alias("k"))))
    df = df.withColumn("_best", F.when(F.col("_norm") > 0, best))
    licenses = F.array(*[F.lit(n) for n, _ in texts])
    return df.withColumn("_whole", F.when(F.col("_best.score") >= threshold, F.struct(
        F.col("_best.score").alias("score"), F.get(licenses, -F.col("_best.k")).alias("license"),
        F.lit(1).alias("line")))).drop("_all", "_at", "_v", "_x", "_norm", "_best")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", keep: tuple = (),
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the ``keep`` columns, ``path``, ``license``, ``score``, ``line`` and
    ``origin``: header (lines of the file state it, or a licence file is its full text), directory (the
    nearest folder at or above the file holds a licence file that states it) or NULL.

    Of several licence files in a folder the highest score counts, then the smaller license name.
    NULL and empty texts state nothing; a NULL path has no folder; repeated rows keep their rows; an
    empty table gives no rows, and further columns are ignored whatever their names.
    """
    named = F.coalesce(F.col("_row")[path].rlike(LICENSE_FILE), F.lit(False))
    scanned = _whole_text(scan_headers(files, text, threshold), F.when(named, F.col("_row")[text]), threshold)
    own = F.when(F.col("own").isNull() | (F.col("_whole.score") > F.col("own.score")),
                 F.col("_whole")).otherwise(F.col("own"))
    # stored once, without the texts unless they are kept
    scanned = materialise(scanned.select(
        *[F.col("_row")[c].alias(f"_k{i}") for i, c in enumerate(keep)],
        F.col("_row")[path].alias("_path"), own.alias("own")).withColumn("_dir", _folder(F.col("_path"))))
    stated = scanned.where(F.col("_path").rlike(LICENSE_FILE) & F.col("own").isNotNull())
    best = stated.groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct(
        (-F.col("own.score")).alias("minus"), F.col("own.license").alias("license"),
        F.col("own.score").alias("score"))).alias("_given"))
    # resolve each folder once, by its ancestors, nearest first
    folders = scanned.where("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    near = folders.select("_dir", F.explode(above).alias("a")).select("_dir", "a.depth", F.col("a.at").alias("_at"))
    given = near.join(best, "_at").groupBy("_dir").agg(F.max_by("_given", "depth").alias("_given"))
    out = scanned.join(given, "_dir", "left")
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_path").alias(path),
        F.coalesce("own.license", "_given.license").alias("license"),
        F.coalesce("own.score", "_given.score").alias("score"), F.col("own.line").alias("line"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("_given").isNotNull(), "directory").alias("origin"))
