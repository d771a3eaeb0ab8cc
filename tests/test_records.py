"""Nested records: flattening, names, casts, nulls, enrichers and the whole transformation."""

from __future__ import annotations

import json

import pytest

from tessera.operators import records
from tessera.sources.records import read_records


def test_flattening(spark):
    df = records.records_of_json(spark, [json.dumps({"a": {"b": 1, "c": {"d": "x"}}, "e": [1, 2], "f": [{"g": 1}]}), json.dumps({"a": {"b": 2}, "h": True})])
    flat = records.flatten(df)
    assert flat.columns == ["a.b", "a.c.d", "e", "f", "h"]
    assert [tuple(r) for r in flat.collect()] == [(1, "x", "[1,2]", '[{"g":1}]', None), (2, None, None, None, True)]
    assert records.flatten(df, 1).columns == ["a", "e", "f", "h"] and records.flatten(df, 2).columns[:2] == ["a.b", "a.c"]
    assert json.loads(records.flatten(df, 1).first()["a"]) == {"b": 1, "c": {"d": "x"}}


@pytest.mark.parametrize(
    ("document", "expected"),
    [
        ('[{"a":1},{"a":2}]', ['{"a":1}', '{"a":2}']), ('{"done":true,"records":[{"a":1}],"data":[{"a":2}]}', ['{"a":1}']), ('{"data":[]}', []),
        ('{"a":1}', ['{"a":1}']), ("7", ['{"value":7}']), ("no json", []), ('{"records":"none","items":[{"a":3}]}', ['{"a":3}']),
    ],
)
def test_detection(spark, document, expected):
    found = records.detect(spark.createDataFrame([(document,)], "json string"))
    assert [r[0] for r in found.selectExpr("to_json(record)").collect()] == expected


@pytest.mark.parametrize(
    ("document", "expected"),
    [
        ('{"foo":[{"a":1},{"a":2}]}', ['{"a":1}', '{"a":2}']), ('{"z":[{"a":1}],"b":[{"a":2}]}', ['{"a":1}']), ('{"n":[1],"e":[],"b":[{"a":2}]}', ['{"a":2}']),
        ('{"foo":[{"a":1}],"data":[{"a":2}]}', ['{"a":2}']), ('{"foo":[1,2]}', ['{"foo":[1,2]}']), ('{"o d\'d":[{"a":{"b":[1.50]}}]}', ['{"a":{"b":[1.5]}}']),
    ],
)
def test_detection_under_other_keys(spark, document, expected):
    found = records.detect(spark.createDataFrame([(document,)], "json string"))
    assert [r[0] for r in found.selectExpr("to_json(record)").collect()] == expected


def test_files_with_keys_of_their_own(spark, tmp_path):
    for name, text in {"a": '{"data":[{"x":1},{"x":2}]}', "b": '{"rows":[{"x":3}]}', "c": '[{"x":4}]', "d": '{"x":5}', "e": '{"items":[6]}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted((r["x"] or 0, r["value"] or 0) for r in read_records(spark, str(tmp_path)).collect()) == [(0, 6), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_wrappers():
    assert records.wrapper_of('{"odd":[{"a":1}]}') == ("odd", False) and records.wrapper_of('{"records":[]}') == ("records", False)
    assert records.wrapper_of("[]") == (None, True) and records.wrapper_of('{"a":[1]}') == (None, False)


@pytest.mark.parametrize(("name", "expected"), [("attributes.AccountName", "account_name"), ("properties.fields.X", "x"), ("HTTPServer-id", "http_server_id"), ("a..b__c ", "a_b_c"), ("BillingAddress.city", "billing_address_city")])
def test_names(name, expected):
    assert records.clean_name(name) == expected


def test_equal_names_are_told_apart():
    assert records.clean_names(["aB", "a_b", "a.b", "c"]) == {"aB": "a_b", "a_b": "a_b_2", "a.b": "a_b_3"}


def test_choosing(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, metadata_x int, `self` int, b int")
    assert records.include(df, ["b", "z", "a"]).columns == ["b", "a"] and records.include(df, ["z"]).columns == df.columns
    assert records.exclude(df, ["b"]).columns == ["a", "metadata_x", "self"] and records.drop_metadata(df).columns == ["a", "b"] or records.drop_metadata(df).columns == ["a", "metadata_x", "b"]


def test_casts(spark):
    df = spark.createDataFrame([("1", "1.5", " 2 ", "yes", "2024-01-02", None), ("x", "2", "3.0", "0", "bad", "a")], "i string, f string, w string, b string, d string, s string")
    cast, n = records.cast(df, {"i": "int", "f": "int", "w": "integer", "b": "bool", "d": "datetime", "s": "string", "none": "int"})
    rows = [tuple(r) for r in cast.select("i", "f", "w", "b", cast["d"].cast("string"), "s").collect()]
    assert rows == [(1, "1.5", 2, True, "2024-01-02 00:00:00", ""), (None, "2", 3, False, None, "a")] and n == 5
    unknown, n = records.cast(df, {"i": "colour"})
    assert unknown.columns == df.columns and n == 1


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a", None)], "n int, s string, e string")
    assert [tuple(r) for r in records.handle_nulls(df, "fill", "?", 9).collect()] == [(1, "?", "?"), (9, "a", "?")]
    assert records.handle_nulls(df, "drop_row").count() == 0 and records.handle_nulls(df, "drop_column").columns == ["n", "s"]
    assert records.handle_nulls(df, "other").collect() == df.collect() and tuple(records.null_counts(df).first()) == (1, 1, 2)


def test_enrichers(spark):
    df = spark.createDataFrame([("A@Gmail.com", "us"), ("x@corp.example", "United Kingdom "), ("", "nowhere"), (None, None)], "email string, country string")
    rows = [tuple(r)[2:] for r in records.domain_info(df).collect()]
    assert rows == [("gmail.com", "com", "true"), ("corp.example", "example", "false"), ("", "", "false"), ("", "", "false")]
    places = {r["country"]: (r["continent"], r["region"]) for r in records.geo_lookup(df.withColumn("region", df["email"])).collect()}
    assert places == {"us": ("North America", "Northern America"), "United Kingdom ": ("Europe", "Northern Europe"), "nowhere": ("", ""), None: ("", "")}
    people = spark.createDataFrame([("a@b.co", "555-0100-99 1", "x")] * 3, "mail string, phone string, other string")
    assert records.personal_data(people) == {"mail": "email", "phone": "phone"} or "mail" in records.personal_data(people)
    marked = records.data_classification(people)
    assert "_mail_is_pii" in marked.columns and json.loads(marked.first()["_pii_columns_detected"])["mail"] == "email"
    assert records.domain_info(people.select("other")).columns == ["other"] and records.geo_lookup(people).columns == people.columns


def test_whole_transformation(spark):
    texts = [json.dumps({"attributes": {"type": "t", "url": "u"}, "Id": i, "AccountName": f"n{i}", "Email": f"a{i}@corp.example" if i else None, "Tags": ["x"]}) for i in range(4)]
    made = records.transform(records.records_of_json(spark, texts), enrichers=["domain_info", "unknown"])
    assert made.frame.columns == ["account_name", "email", "id", "tags", "domain", "domain_tld", "is_free_email"]
    assert made.summary == {"records": 4, "fields_in": 6, "fields_out": 7, "renamed": 4, "cast": 0, "excluded": 2, "enriched": 3, "nulls_handled": 1}
    assert made.validation["status"] == "passed"
    config = records.Config.of({"field_mappings": {"Id": "key", "Gone": "gone"}, "type_casts": {"key": "string", "AccountName": "int"}, "include_only": ["Id", "AccountName"], "null_handling": {"strategy": "drop_row"}})
    made = records.transform(records.records_of_json(spark, texts), config)
    assert made.frame.columns == ["key", "AccountName"] and made.frame.count() == 0
    assert made.validation["warnings"][0] == "Missing expected columns: gone" and records.Config.of({}) is None


def test_ragged_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("a",)], "y string")
    assert sorted(map(tuple, records.union_ragged([a, b]).collect()), key=str) == [(1, None), (None, "a")]
