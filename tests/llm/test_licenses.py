import math
import re
from collections import Counter

from adtrail.llm.licenses import (
    LICENSE_FILE, TEMPLATES, THRESHOLD, VOCABULARY, full_texts, scan_licenses, terms)
from adtrail.llm.q_licenses import op9_license_scan


def brute(rows):
    n = len(rows)
    df = Counter(w for _, t in rows for w in set(terms(t or "")))
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in VOCABULARY else 0))) + 1

    def vector(text):
        return {w: c * idf(w) for w, c in Counter(terms(text)).items()}

    def own(text):
        best = None
        for i, line in enumerate((text or "").split("\n")):
            words = Counter(terms(line))
            norm = math.sqrt(sum((c * idf(w)) ** 2 if w in VOCABULARY else c * idf(w) ** 2
                                 for w, c in words.items()))
            for k, (name, t) in enumerate(TEMPLATES):
                v = vector(t)
                dot = sum(words[w] * idf(w) * x for w, x in v.items())
                s = round(dot / norm / math.sqrt(sum(x * x for x in v.values())), 9) if norm else 0
                if s >= THRESHOLD and (best is None or (s, -k, -i) > best[:3]):
                    best = (s, -k, -i, name)
        return best
    found = [own(t) for _, t in rows]
    folders = {}
    for (p, _), f in zip(rows, found):
        if p is not None and f and re.search(LICENSE_FILE, p):
            d = p.rpartition("/")[0]
            if d not in folders or (-f[0], f[3]) < folders[d]:
                folders[d] = (-f[0], f[3])
    out = []
    for (p, _), f in zip(rows, found):
        if f:
            out.append((p, f[3], "header", -f[2] + 1))
            continue
        d, hit = p.rpartition("/")[0] if p is not None else None, None
        while d is not None:
            if d in folders:
                hit = folders[d][1]
                break
            d = d.rpartition("/")[0] if d else None
        out.append((p, hit, "directory" if hit else None, None))
    return out


def test_matches_brute_force(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.txt", "the words under the bridge"),
        ("a/b/c/y.txt", "nothing\nhere"), ("a/b/LICENSE.md", "intro\nLicensed under the Apache License, Version 2.0."),
        ("a/b/z.txt", "Some text.\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        ("a/b/cc.txt", "Licensed under CC BY-NC 4.0."), ("top.txt", None), ("", ""), (None, "MIT License text here"),
        ("d/COPYING", "a long story about the license of a poet, told in many words and never ended"),
        ("d/e.txt", "plain"), ("a/x.txt", "the words under the bridge"), ("f/g/h.txt", "word " * 50000),
        ("k/LICENSE", "Licensed under CC BY 4.0."), ("k/LICENSE.2", "Licensed under the MIT License."), ("k/l/m", "x"),
    ]
    df = spark.createDataFrame([(i, *r, "n", "n", "n") for i, r in enumerate(rows)],
                               "id long, path string, text string, _row string, own string, _dir string")
    got = scan_licenses(df, keep=("id",)).collect()
    assert [(r.path, r.license, r.origin, r.line) for r in sorted(got, key=lambda r: r.id)] == brute(rows)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_verdict_does_not_depend_on_the_table(spark):
    stated = {"Code licensed under the Apache License, Version 2.0.": "Apache-2.0",
              "Foo is released under the MIT License.": "MIT",
              "This work is licensed under the GNU General Public License, version 3, see COPYING.": "GPL-3.0",
              "a long story about the license of a poet": None, "unter mit der Last": None}
    few = spark.createDataFrame([(t, t) for t in stated], "path string, text string")
    fill = spark.range(20000).selectExpr("concat('f', id) path", "concat('the words under bridge ', id) text")
    for table in (few, few.union(fill)):
        got = scan_licenses(table).where("path not like 'f%'").collect()
        assert {r.path: r.license for r in got} == stated


GPL_HEADER = """/* Copyright 2020 A. Writer
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int x = 1;"""


def test_headers_wrapped_over_lines_and_whole_licence_files(spark):
    common = dict(full_texts())
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    narrow = "Copyright 2021 B\n\n" + re.sub(r"(.{30}\S*) ", r"\1\n", mit)
    rows = {
        "h/gpl.c": (GPL_HEADER, "GPL-3.0", 3), "h/mit.c": (narrow + "\n\nint y;", "MIT", 3),
        "h/two.txt": ("words before\nLicensed under the Apache License,\nVersion 2.0.\nwords after it", "Apache-2.0", 2),
        "h/spdx.c": ("// a\n// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\n",
                     "GPL-2.0-or-later WITH Classpath-exception-2.0", 2),
        "h/none.c": ("// SPDX-License-Identifier: NONE", None, None),
        "h/prose.txt": ("mit der Zeit\nthe terms of use\nversion 3 of it\nfree of charge, to any person", None, None),
        **{f"{n}/COPYING": (t[:t.find("END OF TERMS")] if "END OF TERMS" in t else t, n, None)
           for n, t in common.items()},
        "x/notes.txt": ("plain", None, None), "GPL-2.0/deep/down/a.txt": ("plain", "GPL-2.0", None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _, _) in rows.items()], "path string, text string")
    got = {r.path: r for r in scan_licenses(df).collect()}
    assert {p: r.license for p, r in got.items()} == {p: want for p, (_, want, _) in rows.items()}
    for p, (_, _, line) in rows.items():
        assert line is None or got[p].line == line


def test_query_inherits_from_several_depths(spark):
    got = op9_license_scan(spark, "/root/testdata/sf0.01")
    rows = got.collect()
    assert len(rows) == 1000
    headers = [r.path for r in rows if r.origin == "header"]
    assert {p.count("/") for p in headers} == {1, 2, 3} and all("/LICENSE." in p for p in headers)
    owned = {p.rpartition("/")[0] for p in headers}
    depths = set()
    for r in rows:
        d = r.path.rpartition("/")[0]
        above = [a for a in (d, d.rpartition("/")[0], d.split("/")[0]) if a in owned]
        assert (r.license is not None) == bool(above or r.origin == "header")
        if r.origin == "directory":
            depths.add(above[0].count("/"))
    assert depths == {0, 1, 2}
