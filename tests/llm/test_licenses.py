"""Licences of headers and files against a plain TF-IDF cosine, inheritance from the nearest directory, odd rows."""

import math
import re
from collections import Counter

from flowmill.llm import licenses

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."


def scanned(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "path string, text string, licence string")
    return {r.path: r for r in licenses.scan_licences(df).collect()}


def test_inheritance(spark):
    got = scanned(spark, [
        ("LICENSE", "x\n" + APACHE), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/x.txt", "plain"), ("a/b/c/d/y.txt", "plain"), ("a/b/z.txt", "text\n  " + MIT + "\nmore"), ("/a//b/w.txt", None), ("q.txt", ""),
        ("a/e/LICENSE", "nothing here"), ("a/e/f.txt", "This licence is a dog licence of our town."), ("a/LICENSES.txt", MIT)])
    assert {p: (r.licence, r.origin, r.directory) for p, r in got.items()} == {
        "LICENSE": ("Apache-2.0", "file", None), "a/b/COPYING.txt": ("GPL-3.0", "file", None),
        "a/x.txt": ("Apache-2.0", "inherited", ""), "a/b/c/d/y.txt": ("GPL-3.0", "inherited", "a/b"),
        "a/b/z.txt": ("MIT", "header", None), "/a//b/w.txt": ("GPL-3.0", "inherited", "a/b"), "q.txt": ("Apache-2.0", "inherited", ""),
        "a/e/LICENSE": ("Apache-2.0", "inherited", ""), "a/e/f.txt": ("Apache-2.0", "inherited", ""), "a/LICENSES.txt": ("MIT", "header", None)}
    assert got["LICENSE"].cosine == 1.0


def test_odd_rows(spark):
    rows = [(None, APACHE), ("", "x"), ("f", MIT), ("f", MIT), ("deep/" * 200 + "g", "n"), ("h", ("word " * 50 + "\n") * 2000 + MIT)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = licenses.scan_licences(df).collect()
    assert sorted((str(r.path)[:4], str(r.licence), r.origin) for r in got) == sorted([
        ("None", "Apache-2.0", "header"), ("", "None", "none"), ("f", "MIT", "header"), ("f", "MIT", "header"),
        ("deep", "None", "none"), ("h", "MIT", "header")])
    assert licenses.scan_licences(df.limit(0)).count() == 0


NOTICE = """/*
 * Copyright (C) 2020 A. Body
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version %s of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() { return 0; }
"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla
# Public License, v. 2.0. If a copy of the MPL was not distributed
# with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
import x
"""


def wording(name, at):
    return [w for n, _, ws in licenses.TEMPLATES if n == name for w in ws][at]


def wrapped(text, width=12):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


PROBES = [
    ("a.c", NOTICE % 3, "GPL-3.0"), ("b.c", NOTICE % 2, "GPL-2.0"), ("c.py", MPL, "MPL-2.0"),
    ("d/COPYING", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\n" + "Everyone is permitted to copy. " * 40, "GPL-2.0"),
    ("e/LICENSE", "Copyright 2020 B\n\n" + wrapped(wording("ISC", 2)), "ISC"),
    ("f/LICENSE", "Copyright 2020 C\n\n" + wrapped(wording("BSD-2-Clause", 1)), "BSD-2-Clause"),
    ("g/LICENSE", "Copyright 2020 D\n\n" + wrapped(wording("BSD-3-Clause", 1)), "BSD-3-Clause"),
    ("h.txt", "words\nGNU General Public License, version 2\nmore words", "GPL-2.0"),
    ("i/LICENSE.txt", "MIT License\n\nCopyright E\n\n" + wrapped(wording("MIT", 4), 9), "MIT"),
    ("j.txt", "Licensed under the Apache License, Version 1.1", None), ("k.txt", "GNU Lesser General Public License version 2.1", "LGPL-2.1"),
    ("l.txt", "prose\nLicensed under CC BY-NC 4.0.\nprose", "CC-BY-NC-4.0"), ("m.txt", "the software of the program is free", None),
    ("n.txt", "we use the version of any person, without limitation", None), ("o.txt", "", None)]


def plain_licences(rows, least=0.6):
    """Every run of lines from every line, without anchors, by a plain TF-IDF cosine."""
    terms = lambda t: re.findall(r"[^\W_]+", t.lower())
    wordings = [(n, m.split(), Counter(terms(w))) for n, m, ws in licenses.TEMPLATES for w in ws]
    df = Counter(t for _, text in rows for t in set(terms(text))) + Counter(t for _, _, c in wordings for t in c)
    idf = lambda t: math.log((len(rows) + len(wordings) + 1) / (df[t] + 1)) + 1
    weigh = lambda c: {t: (1 + math.log(n)) * idf(t) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, m, weigh(c)) for n, m, c in wordings]
    found = {}
    for path, text in rows:
        lines = [re.sub(r"\s+", " ", re.sub(licenses.COMMENT, "", x)).strip() for x in text.split("\n")]
        runs = {" ".join(lines[i : i + n]) for i in range(len(lines)) for n in licenses.RUNS}
        if re.search(licenses.LICENCE_FILE, path.split("/")[-1]):
            runs.add(text)
        best = []
        for run in runs:
            own = weigh(Counter(terms(run)))
            for name, must, v in known:
                dot = sum(x * own[t] for t, x in v.items() if t in own)
                if dot and set(must) <= set(own):
                    cosine = round(dot / norm(own) / norm(v), 9)
                    best.append((-cosine, name)) if cosine >= least else None
        found[path] = min(best, default=None)
    return found


def test_headers_and_files_against_a_plain_cosine(spark):
    rows = [(p, t) for p, t, _ in PROBES]
    want = plain_licences(rows)
    got = {r.path: r for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: r.own_licence for p, r in got.items()} == {p: x for p, _, x in PROBES}
    for path, best in want.items():
        assert (best and best[1]) == got[path].own_licence
        assert best is None or abs(-best[0] - got[path].cosine) < 2e-9


def test_terms_of_runs_are_shuffled_once_under_a_number(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []

    def kept(runs, known, idf, *, least, inner=licenses.run_licences):
        found = inner(runs, known, idf, least=least)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(licenses, "run_licences", kept)
    try:
        rows = [(p, t) for p, t, _ in PROBES]
        got = {r.path: r for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for path, best in plain_licences(rows).items():
        assert (best and best[1]) == got[path].own_licence
        assert best is None or abs(-best[0] - got[path].cosine) < 2e-9
    joins = [line for line in plans[0].splitlines() if " Join " in f" {line.strip(' :+-')} "]
    assert joins and not any("key#" in line for line in joins)
