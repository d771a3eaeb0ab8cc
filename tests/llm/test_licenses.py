"""The licence scan against a plain computation over all units."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import licenses
from tessera.llm.queries import op4_license_scan
from tests.against import TABLES

FILES = "doc_id long, path string, text string"


def words(text):
    return Counter(re.findall(licenses.TERM, text.lower()))


def paragraphs(text):
    """The lines and sentences of each paragraph."""
    return [[u for u in (x.strip(" ") for x in re.split(licenses.UNITS, p)) if u] for p in re.split(licenses.PARAGRAPHS, text or "")]


def brute(files):
    """(licence, cosine, evidence, licence_from) of each (path, text), by all pairs of units and templates."""
    count = Counter(w for _, t in files for w in words(t or "").keys())
    idf = {w: math.log((1 + len(files)) / (1 + count[w])) + 1 for w in {*count, *(w for _, t in licenses.TEMPLATES for w in words(t))}}
    weigh = lambda v: {w: n * idf[w] for w, n in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [weigh(words(t)) for _, t in licenses.TEMPLATES]
    of_unit = {}

    def nearest(u):
        """(-cosine, template, weight), or None."""
        if u not in of_unit:
            own, of_unit[u] = weigh(words(u)), None
            if own:
                best = min((-round(sum(x * t.get(w, 0) for w, x in own.items()) / norm(own) / norm(t), 9), i) for i, t in enumerate(known))
                if -best[0] >= licenses.LEAST:
                    of_unit[u] = *best, -best[0] * norm(own)
        return of_unit[u]

    own, folders = {}, {}
    for path, text in files:
        votes, highest, covered, total = Counter(), {}, 0, 0
        for lines in paragraphs(text):
            total += len(lines)
            joined = nearest(" ".join(lines)) if len(lines) > 1 else None
            each = [nearest(u) for u in lines]
            covered += len(lines) if joined else sum(x is not None for x in each)
            for order, template, weight in filter(None, [*each, joined]):
                for licence in licenses.TEMPLATES[template][0]:
                    votes[licence] += weight
                    highest[licence] = max(highest.get(licence, 0), -order)
        if votes:
            _, name = min((-round(v, 6), licence) for licence, v in votes.items())
            whole = bool(re.search(licenses.LICENCE_NAME, path or "")) or covered == total
            own[path, text] = -highest[name], name, whole
            if whole:
                folder = (path or "").rpartition("/")[0]
                folders[folder] = min(folders.get(folder, own[path, text][:2]), own[path, text][:2])
    result = []
    for path, text in files:
        if (path, text) in own:
            order, name, whole = own[path, text]
            result.append((name, -order, "file" if whole else "header", None))
            continue
        folder, near = (path or "").rpartition("/")[0], None
        while path:
            if folder in folders:
                near = folder
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        result.append((folders[near][1], -folders[near][0], "inherited", near) if near is not None else (None, None, "none", None))
    return result


ROWS = [
    ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("a/b/c.py", "print(1)"), ("a/b/d.py", "# Licensed under the Apache License, Version 2.0.\nx = 1"), ("a/b/LICENSE.txt", "Licensed under CC BY-SA 4.0. Thanks."),
    ("a/b/e/f/g.py", None), ("h/i.py", ""), ("j.py", "All rights reserved.\ncode"), ("k/COPYING", "nothing of that kind"), ("k/l.py", "see the licence of somebody else for the weather"),
    ("a/b/c.py", "print(1)"), (None, "text"), (None, "Released under the MIT License."), ("", "x"), ("m/n.py", "Released under the BSD 3-Clause License.  Released under the ISC License."),
    ("o/p.md", "Copyright 2020 Somebody\n" + "long " * 20_000), ("a//x", "y"), ("q/r.py", "Lizenziert unter CC BY-NC 4.0."), ("q/s.py", "GPL-3.0-only"),
    ("t/LICENSE", "Copyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies of the Software, and to\npermit persons to whom the Software is furnished to do so, subject to\nthe following conditions:\n \nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
    ("t/u.py", "v"), ("w/x.txt", "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n\nNeither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived\nfrom this software without specific prior written permission."),
    ("w/y.txt", "w"), ("/root/LICENSE", "This is free and unencumbered software released into the public domain."), ("/root/z", "q"),
]


def test_by_brute_force(spark):
    rows = [(i, p, t) for i, (p, t) in enumerate(ROWS)]
    found = {r["doc_id"]: (r["licence"], r["cosine"], r["evidence"], r["licence_from"]) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    expected = brute(ROWS)
    rounded = lambda x: (x[0], None if x[1] is None else round(x[1], 6), *x[2:])
    assert [rounded(found[i]) for i in range(len(rows))] == [rounded(e) for e in expected]
    by = {p: e for (p, _), e in zip(ROWS, expected, strict=True)}
    assert by["q/r.py"][0] == "CC-BY-NC-4.0" and by["q/s.py"][0] == "GPL-3.0" and by["t/u.py"][0] == "MIT" and by["w/y.txt"][0] == "BSD-3-Clause"


def test_documents_by_brute_force(spark):
    files = licenses.of_documents(spark.read.parquet(f"{TABLES}/documents.parquet")).collect()
    expected = defaultdict(set)
    for f, e in zip(files, brute([(f["path"], f["text"]) for f in files]), strict=True):
        expected[f["doc_id"]].add((e[0], e[2], e[3]))
    rows = op4_license_scan(spark, TABLES).collect()
    assert len(rows) == len(files) and any(r["licence"] for r in rows)
    assert all((r["licence"], r["evidence"], r["licence_from"]) in expected[r["doc_id"]] for r in rows)


def test_only_units_near_a_template_are_weighed(spark, monkeypatch):
    """A word of a template alone is no reason to shuffle the terms of a long paragraph; the licences are found as before."""
    weighed, weigh = [], licenses.matched_units
    monkeypatch.setattr(licenses, "matched_units", lambda units, *rest: weighed.append(units.count()) or weigh(units, *rest))
    prose = [(f"p/{i}.txt", " ".join(f"w{i}x{k}" for k in range(200)) + " or license\n" + " ".join(f"v{i}y{k}" for k in range(200)) + ".") for i in range(50)]
    rows = [*prose, ("q/a.txt", "Released under the MIT License.\nx"), ("r/b.txt", "under the license or not, some words")]
    found = licenses.scan(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], FILES)).orderBy("doc_id").collect()
    expected = brute(rows)
    assert [(r["licence"], r["evidence"]) for r in found] == [(e[0], e[2]) for e in expected] and found[50]["licence"] == "MIT"
    assert weighed[0] < 10


def test_no_python_in_the_plan(spark):
    plan = op4_license_scan(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    assert licenses.scan(spark.createDataFrame([], FILES)).count() == 0
    clashing = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(ROWS)], FILES).withColumns({n: F.lit("own") for n in ("row_key", "licence", "above", "whole", "folder", "own_folder", "kept", "units", "from_folder")})
    found = licenses.scan(clashing).collect()
    assert len(found) == len(ROWS) and all(r["whole"] == r["folder"] == r["kept"] == "own" for r in found)
