"""Queries on nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import personal_data_class
from tessera.operators import records
from tessera.plans.catalog import Given, query, table

NUMBERED = Given("SELECT n_nationkey, n_name, CONCAT('{{\"totalSize\":2,\"done\":true,\"records\":[{{\"id\":', CAST(n_nationkey AS STRING), ',\"name\":\"', n_name, '\"}},{{\"id\":', CAST(n_nationkey + 100 AS STRING), ',\"name\":\"x\"}}]}}') AS json FROM {nation}")
TEXTS = Given("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'maybe' WHEN o_orderkey % 4 = 1 THEN 'Yes' WHEN o_orderkey % 4 = 2 THEN '0' ELSE 'TRUE' END AS flag,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS whole,
  CASE WHEN o_orderkey % 10 = 1 THEN '1.2.3' ELSE CONCAT(CAST(o_orderkey AS STRING), '.5') END AS fraction,
  CASE WHEN o_orderkey % 10 = 2 THEN NULL ELSE o_orderpriority END AS label FROM {orders}""")
GAPS = Given("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CAST(NULL AS STRING) AS note FROM {orders}""")
PLACES = Given("""
SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'us' WHEN 1 THEN ' Germany ' WHEN 2 THEN 'JP' WHEN 3 THEN 'new zealand' WHEN 4 THEN 'Atlantis' ELSE NULL END AS country FROM {nation}""")
CONTACTS = Given("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN CONCAT('u', CAST(c_custkey AS STRING), '@GMail.com') WHEN 1 THEN CONCAT('u', CAST(c_custkey AS STRING), '@corp.example.org')
  WHEN 2 THEN 'https://www.Example.com/a?b=c' WHEN 3 THEN 'http://shop.example.net:8080/x' WHEN 4 THEN 'localhost' WHEN 5 THEN '  ' ELSE NULL END AS email FROM {customer}""")
PERSONAL = Given("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'a.b@example.com' WHEN 1 THEN '+1 555 010-9999' WHEN 2 THEN '123456789' WHEN 3 THEN '4111 1111 1111 1111' WHEN 4 THEN '1.2.3.4'
  WHEN 5 THEN CONCAT('4', LPAD(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-1111-1111-1111') WHEN 6 THEN 'plain text' ELSE NULL END AS value FROM {customer}""")


@query("""
SELECT event_id AS "id", event_type AS "event.type", user_id AS "event.user.id", value AS "event.user.value", to_json([event_id % 3, event_id % 5])::VARCHAR AS "tags" FROM events""")
def rec_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user = F.struct(F.col("user_id").alias("id"), "value")
    nested = events.select(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("type"), user.alias("user")).alias("event"), F.array(F.col("event_id") % 3, F.col("event_id") % 5).alias("tags"))
    return records.flatten(nested)


@query("""SELECT event_id AS id, '{"id":' || user_id || ',"deep":{"n":' || event_id % 3 || '}}' AS "event.user" FROM events""")
def rec_flatten_depth(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user = F.struct(F.col("user_id").alias("id"), F.struct((F.col("event_id") % 3).alias("n")).alias("deep"))
    return records.flatten(events.select(F.col("event_id").alias("id"), F.struct(user.alias("user")).alias("event")), max_depth=2)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def rec_flatten_props(spark, sf_dir):
    return records.flatten_ragged(table(spark, sf_dir, "events"), "props", {"k": "$.k"}).select("event_id", "k")


@query("SELECT n_nationkey, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 100, 'x' FROM nation")
def rec_detect_records(spark, sf_dir):
    found = records.detect(NUMBERED(spark, sf_dir).select("n_nationkey", "json"))
    return found.select("n_nationkey", F.variant_get("record", "$.id", "int").alias("id"), F.variant_get("record", "$.name", "string").alias("name"))


@query("SELECT c_name, c_custkey FROM customer")
def rec_field_filter(spark, sf_dir):
    return records.exclude(records.include(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal", "none", "c_custkey"]), ["c_acctbal"])


@query("SELECT c_custkey AS id, c_name AS account_name, c_acctbal AS total_balance_usd FROM customer")
def rec_rename_clean(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(F.col("c_custkey").alias("attributes.Id"), F.col("c_name").alias("AccountName"), F.col("c_acctbal").alias("totalBalanceUSD"), F.lit("x").alias("metadata"), F.lit("y").alias("nextPageToken"))
    kept = records.drop_metadata(raw)
    return records.rename(kept, records.clean_names(kept.columns))


@query("SELECT c_custkey AS key, c_mktsegment AS segment FROM customer")
def rec_rename_mapped(spark, sf_dir):
    return records.rename(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), {"c_custkey": "key", "c_mktsegment": "segment", "none": "x"})


@query(f"""
SELECT o_orderkey, CASE WHEN lower(flag) IN ('true', '1', 'yes') THEN true WHEN lower(flag) IN ('false', '0', 'no') THEN false END AS flag, try_cast(whole AS BIGINT) AS whole,
  CAST(round(try_cast(fraction AS DOUBLE) * 10) AS BIGINT) AS tenths, coalesce(label, '') AS label FROM ({TEXTS.sql})""")
def rec_type_casts(spark, sf_dir):
    made, _ = records.cast(TEXTS(spark, sf_dir), {"flag": "bool", "whole": "int", "fraction": "float", "label": "string", "o_orderkey": "unknown"})
    return made.select("o_orderkey", "flag", "whole", F.round(F.col("fraction") * 10).cast("long").alias("tenths"), "label")


@query(f"SELECT o_orderkey, coalesce(o_orderpriority, '?') AS o_orderpriority, coalesce(o_custkey, -1) AS o_custkey, '?' AS note FROM ({GAPS.sql})")
def rec_null_fill(spark, sf_dir):
    return records.handle_nulls(GAPS(spark, sf_dir), "fill", "?", -1)


@query(f"SELECT o_orderkey, o_orderpriority, o_custkey FROM ({GAPS.sql}) WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL")
def rec_drop_rows(spark, sf_dir):
    return records.handle_nulls(GAPS(spark, sf_dir).drop("note"), "drop_row")


@query(f"SELECT o_orderkey, o_orderpriority, o_custkey FROM ({GAPS.sql})")
def rec_drop_columns(spark, sf_dir):
    return records.handle_nulls(GAPS(spark, sf_dir), "drop_column")


@query(f"SELECT count(*) FILTER (o_orderkey IS NULL) AS o_orderkey, count(*) FILTER (o_orderpriority IS NULL) AS o_orderpriority, count(*) FILTER (o_custkey IS NULL) AS o_custkey, count(*) AS note FROM ({GAPS.sql})")
def rec_null_counts(spark, sf_dir):
    return records.null_counts(GAPS(spark, sf_dir))


HOST = "lower(split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/', 1))"


@query(f"WITH h AS (SELECT page_id, url, {HOST} AS domain FROM pages) SELECT page_id, url, domain, split_part(domain, '.', -1) AS domain_tld, 'false' AS is_free_email FROM h")
def rec_domain_info(spark, sf_dir):
    return records.domain_info(table(spark, sf_dir, "pages").select("page_id", "url"))


@query(f"""
WITH d AS (SELECT *, CASE c_custkey % 7 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'corp.example.org' WHEN 2 THEN 'example.com' WHEN 3 THEN 'shop.example.net:8080' WHEN 4 THEN 'localhost' ELSE '' END AS domain FROM ({CONTACTS.sql}))
SELECT c_custkey, email, domain, CASE c_custkey % 7 WHEN 0 THEN 'com' WHEN 1 THEN 'org' WHEN 2 THEN 'com' WHEN 3 THEN 'net:8080' ELSE '' END AS domain_tld, CASE WHEN c_custkey % 7 = 0 THEN 'true' ELSE 'false' END AS is_free_email FROM d""")
def rec_domain_of_mail(spark, sf_dir):
    return records.domain_info(CONTACTS(spark, sf_dir))


@query(f"""
SELECT n_nationkey, country, CASE n_nationkey % 6 WHEN 0 THEN 'North America' WHEN 1 THEN 'Europe' WHEN 2 THEN 'Asia' WHEN 3 THEN 'Oceania' ELSE '' END AS continent,
  CASE n_nationkey % 6 WHEN 0 THEN 'Northern America' WHEN 1 THEN 'Western Europe' WHEN 2 THEN 'Eastern Asia' WHEN 3 THEN 'Australia and New Zealand' ELSE '' END AS region FROM ({PLACES.sql})""")
def rec_geo_lookup(spark, sf_dir):
    return records.geo_lookup(PLACES(spark, sf_dir))


@query(f"SELECT c_custkey, value, CASE c_custkey % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'phone' WHEN 3 THEN 'phone' WHEN 4 THEN 'ip_address' WHEN 5 THEN 'phone' END AS class FROM ({PERSONAL.sql})")
def rec_pii_classes(spark, sf_dir):
    return PERSONAL(spark, sf_dir).withColumn("class", personal_data_class(F.col("value")))


@query("""SELECT c_custkey AS customer_id, concat('u', c_custkey, '@example.com') AS mail, '{"mail": "email"}' AS _pii_columns_detected, 'true' AS _mail_is_pii, 'email' AS _mail_pii_type FROM customer""")
def rec_data_classification(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("u"), "c_custkey", F.lit("@example.com")).alias("mail"))
    return records.data_classification(c)


@query(f"""
SELECT 'warnings' AS status, false AS expected_columns_present, false AS null_rate_acceptable, false AS type_consistency,
  'Missing expected columns: absent; Column ''note'' has high null rate: 100.0%; Column ''o_orderpriority'' expected type ''int'' but contains non-numeric values' AS warnings""")
def rec_schema_validate(spark, sf_dir):
    found = records.validate(GAPS(spark, sf_dir), ["o_orderkey", "absent"], {"o_orderpriority": "int", "o_orderkey": "int"})
    row = (found["status"], *found["checks"].values(), "; ".join(found["warnings"]))
    return spark.createDataFrame([row], "status string, expected_columns_present boolean, null_rate_acceptable boolean, type_consistency boolean, warnings string")


@query("""
SELECT event_id, event_type AS event_event_type, user_id AS event_user_id, 'https://www.' || event_type || '.example.com/x' AS website, event_type || '.example.com' AS domain, 'com' AS domain_tld, 'false' AS is_free_email
FROM events""")
def rec_transform(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    event = F.struct(F.col("event_type").alias("eventType"), F.col("user_id").alias("userId"))
    site = F.concat(F.lit("https://www."), "event_type", F.lit(".example.com/x"))
    return records.transform(events.select(F.col("event_id").alias("eventId"), event.alias("event"), site.alias("Website"), F.lit(1).alias("done")), enrichers=["domain_info"]).frame


@query("SELECT c_custkey AS key, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def rec_union_ragged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return records.union_ragged([c, s])


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS VARCHAR) AS price, o_orderkey AS whole, CAST(2 AS BIGINT) AS n_cast FROM orders""")
def rec_cast_dates(spark, sf_dir):
    """Dates in four forms of text; a column with fractions stays as it is and does not count."""
    forms = F.expr("case o_orderkey % 4 when 0 then 'M/d/yyyy' when 1 then 'yyyy-MM-dd' when 2 then 'MMM d, yyyy' else 'yyyy-MM-dd HH:mm:ss' end")
    text = F.coalesce(*[F.when(forms == f, F.date_format("o_orderdate", f)) for f in ("M/d/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss")])
    given = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderkey").cast("string").alias("whole"))
    found, n = records.cast(given, {"day": "datetime", "price": "int", "whole": "int"})
    return found.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("price").cast("double").cast("string").alias("price"), "whole", F.lit(n).cast("long").alias("n_cast"))


@query("""
SELECT 'null_rate_acceptable' AS "check", false AS passed UNION ALL SELECT 'expected_columns_present', false UNION ALL SELECT 'type_consistency', false""")
def rec_schema_faults(spark, sf_dir):
    """A table that fails each check."""
    given = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("balance"))
    found = records.validate(given, ["c_custkey", "missing"], {"c_name": "int"})
    return spark.createDataFrame(list(found["checks"].items()), "`check` string, passed boolean")


@query(r"""
WITH v AS (SELECT c_custkey AS place, 'segment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer
  UNION ALL SELECT c_custkey, 'mail', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'u' || c_custkey || '@example.com' END FROM customer)
, f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY place) <= 100)
SELECT "column", CAST(round(avg(CASE WHEN value LIKE '%_@_%._%' THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS email FROM f GROUP BY 1""")
def rec_personal_data_shares(spark, sf_dir):
    """Shares of mail addresses among the first hundred values of three columns, empty ones included, in one pass."""
    mail = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_place"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), mail.alias("mail"))
    return records.personal_data_shares(df.repartition(5), [F.col("_place")]).select("column", F.round(F.col("email") * 1000).cast("long").alias("email"))
