"""Large JSON arrays are read in splits."""

from __future__ import annotations

import json
import random

import pytest

from tessera.sources import records


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Files of any size are read in splits of some forty bytes."""
    monkeypatch.setattr(records, "WHOLE_BYTES", 0)
    own = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "40"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_arrays_in_splits(spark, tmp_path, small_splits):
    """Strings with brackets, commas, quotes and backslashes in them, nested records, several forms of white space."""
    rng = random.Random(4)
    words = ["a,b", "],[", '"', "\\", '\\",', "{", "é,ü", "", "x" * 90, "\n,"]
    rows = [{"id": i, "s": "".join(rng.choices(words, k=4)), "n": {"k": [1, {"t": rng.choice(words)}], "u": rng.choice(words)}} for i in range(12)]
    for name, text in (("compact", json.dumps(rows, separators=(",", ":"))), ("wide", "﻿ \n" + json.dumps(rows, indent=3, ensure_ascii=False) + " \n")):
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        found = records.read_records(spark, str(path)).selectExpr("id", "s", "n.u", "to_json(n.k) k").collect()
        assert sorted((r["id"], r["s"], r["u"]) for r in found) == [(r["id"], r["s"], r["n"]["u"]) for r in rows]


def test_arrays_of_many_kinds(spark, tmp_path, small_splits):
    """Elements that are no objects, arrays without elements, texts that are no JSON, and documents that are no arrays beside them."""
    texts = {"a": "[1, 2,\n 3]", "b": "[]", "c": " [ ] ", "d": '[{"x": 5}]', "e": "[7, 8", "f": "[9,,9]", "g": '[9, "]', "h": '{"data": [{"x": 6}]}', "i": "[10] 11", "j": "[12}", "k": '[{"x": 13}, {"x": 14}, 15, [16]]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = records.read_records(spark, str(tmp_path)).collect()
    assert sorted(r["x"] for r in found if r["x"] is not None) == [5, 6, 13, 14]
    assert sorted(str(r["value"]) for r in found if r["value"] is not None) == ["1", "15", "2", "3", "[16]"]
