"""Queries on the quality of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import quoted
from tessera.operators import quality, quantiles
from tessera.plans.catalog import Given, query, table

GAPS = Given("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus FROM {lineitem}""")
REPEATED = Given("SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 10 = 0")
ODD = Given("""
SELECT p_partkey, p_name, p_brand, p_size, 1 AS same, CASE WHEN p_partkey % 10 = 0 THEN p_type END AS mostly_null FROM {part}""")
PEOPLE = Given("""
SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 10 = 3 THEN CONCAT('bad', CAST(c_custkey AS STRING)) WHEN c_custkey % 10 = 4 THEN NULL
    ELSE CONCAT('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 9 = 0 THEN 'n/a' WHEN c_custkey % 9 = 1 THEN CONCAT('1e', CAST(c_custkey % 5 AS STRING))
    WHEN c_custkey % 9 = 2 THEN CONCAT('-', CAST(c_custkey AS STRING), '.5') ELSE CAST(c_custkey AS STRING) END AS amount,
  CASE WHEN c_custkey % 6 = 0 THEN 'not a day' WHEN c_custkey % 6 = 1 THEN '1996-13-45' WHEN c_custkey % 6 = 2 THEN '03/15/1996'
    ELSE CONCAT('1996-0', CAST(1 + c_custkey % 9 AS STRING), '-1', CAST(c_custkey % 10 AS STRING)) END AS signup_date,
  CONCAT('555-01', LPAD(CAST(c_custkey % 100 AS STRING), 2, '0'), '-', LPAD(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS phone, c_mktsegment AS segment, c_acctbal AS balance
FROM {customer}""")


def each(columns: list[str], select: str, of: str) -> str:
    """A SELECT for each column, with $ for its name."""
    return " UNION ALL ".join("SELECT '$' AS \"column\", ".replace("$", c) + select.replace("$", c) + f" FROM ({of}) AS t" for c in columns)


GAP_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


@query(each(GAP_COLUMNS, "count(*) FILTER ($ IS NULL) AS missing, count(*) AS total", GAPS.sql))
def dq_missing_by_column(spark, sf_dir):
    return quality.missing(GAPS(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM ({REPEATED.sql})) AS n_rows, (SELECT count(*) FROM ({REPEATED.sql})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATED.sql}))) AS duplicates")
def dq_duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(REPEATED(spark, sf_dir))


@query("""
SELECT * FROM (SELECT 'event_id' AS "column", count(event_id) - count(DISTINCT event_id) AS duplicates FROM events
  UNION ALL SELECT 'user_id', count(user_id) - count(DISTINCT user_id) FROM events)
WHERE duplicates > 0 ORDER BY duplicates DESC, "column" LIMIT 1""")
def dq_duplicate_ids(spark, sf_dir):
    return quality.duplicate_ids(table(spark, sf_dir, "events"))


@query(each(GAP_COLUMNS, "count($) AS non_null, count(*) - count($) AS nulls, count(DISTINCT $) AS distinct_values", GAPS.sql))
def dq_column_profile(spark, sf_dir):
    return quality.distinct_counts(GAPS(spark, sf_dir), GAP_COLUMNS)


NUMBERS = ["l_quantity", "l_extendedprice"]
SCALED = "CAST(round({} * 10000) AS BIGINT)"


@query(each(NUMBERS, "count($) AS n, " + ", ".join(SCALED.format(e) + f" AS {n}" for e, n in (("min($)", "least"), ("max($)", "greatest"), ("quantile_cont($, 0.25)", "q1"), ("median($)", "median"), ("quantile_cont($, 0.75)", "q3"))), GAPS.sql))
def dq_distribution(spark, sf_dir):
    """Scaled by 10,000, so that both engines give the same integers."""
    found = quality.distribution(GAPS(spark, sf_dir), NUMBERS)
    return found.select("column", "n", *[F.round(quoted(c) * 10000).cast("long").alias(c) for c in ("least", "greatest", "q1", "median", "q3")])


@query("""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'value' AS "column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events, b""")
def dq_iqr_outliers(spark, sf_dir):
    return quality.outliers(table(spark, sf_dir, "events"), ["value"]).select("column", "outliers")


@query("""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
, o AS (SELECT event_id, value FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY event_id LIMIT 10)
SELECT 'value' AS "column", CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS nth, value FROM o""")
def dq_outlier_samples(spark, sf_dir):
    return quality.outlier_samples(table(spark, sf_dir, "events"), ["value"], ["event_id"])


ODD_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_size", "same", "mostly_null"]


@query(f"""
WITH s AS ({each(ODD_COLUMNS, "count($) AS f, count(*) - count($) AS n, count(DISTINCT $) AS d", ODD.sql)})
, r AS (SELECT "column", concat_ws('; ', CASE WHEN n > 0.8 * (f + n) THEN 'mostly missing' END, CASE WHEN d <= 1 AND f > 0 THEN 'constant' END,
  CASE WHEN d > 0.95 * f AND d > 50 THEN 'very high cardinality' END) AS reasons FROM s)
SELECT * FROM r WHERE reasons <> ''""")
def dq_suspicious_columns(spark, sf_dir):
    counts = quality.distinct_counts(ODD(spark, sf_dir), ODD_COLUMNS)
    return quality.suspicious(counts).select("column", F.array_join("reasons", "; ").alias("reasons"))


EMAIL_SQL = "regexp_matches(email, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}$')"
NUMBER_SQL = "regexp_matches({}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')"
DATE_SQL = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%m/%d/%Y'))"


@query(f"SELECT 'email' AS \"column\", count(*) FILTER (email IS NOT NULL AND NOT {EMAIL_SQL}) AS invalid FROM ({PEOPLE.sql})")
def dq_email_validation(spark, sf_dir):
    return quality.invalid_counts(PEOPLE(spark, sf_dir), {"email": quality.invalid_email(F.col("email"))})


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND NOT {NUMBER_SQL.format(c)}) AS invalid FROM ({PEOPLE.sql})" for c in ("amount", "segment")))
def dq_numeric_validation(spark, sf_dir):
    return quality.invalid_counts(PEOPLE(spark, sf_dir), {c: quality.invalid_number(F.col(c)) for c in ("amount", "segment")})


@query(f"SELECT 'signup_date' AS \"column\", count(*) FILTER ({DATE_SQL.format('signup_date')} IS NULL) AS invalid FROM ({PEOPLE.sql})")
def dq_date_validation(spark, sf_dir):
    return quality.invalid_counts(PEOPLE(spark, sf_dir), {"signup_date": quality.invalid_date(F.col("signup_date"))})


@query(f"""
WITH d AS (SELECT DISTINCT * FROM ({GAPS.sql}))
, m AS (SELECT median(l_quantity) AS q FROM d)
, c AS (SELECT l_returnflag AS flag FROM d WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, q) AS l_quantity, l_extendedprice, coalesce(l_returnflag, flag) AS l_returnflag, l_linestatus FROM d, m, c""")
def dq_clean_median_mode(spark, sf_dir):
    return quality.clean(GAPS(spark, sf_dir))


TOTALS = """
SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, count(*) - count(email) AS missing, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS duplicate_ids,
  count(*) FILTER (email IS NOT NULL AND NOT {email}) AS emails, count(*) FILTER ({date} IS NULL) AS dates,
  count(*) FILTER (NOT {amount}) + count(*) FILTER (NOT {day}) AS numbers
FROM ({people})"""


@query(TOTALS.format(email=EMAIL_SQL, date=DATE_SQL.format("signup_date"), amount=NUMBER_SQL.format("amount"), day=NUMBER_SQL.format("signup_date"), people=PEOPLE.sql))
def dq_quality_totals(spark, sf_dir):
    """The faults that the score of PEOPLE is made of."""
    t = quality.profile(PEOPLE(spark, sf_dir)).totals
    names = ["rows", "columns", "missing", "duplicate_rows", "duplicate_ids", "emails", "dates", "numbers"]
    out = ["n_rows", "n_columns", *names[2:]]
    return spark.createDataFrame([tuple(int(getattr(t, n)) for n in names)], ", ".join(f"{n} long" for n in out))


@query(f"""
WITH p AS ({PEOPLE.sql})
, t AS (SELECT 1 AS nth, 'Column ''email'' has ' || count(*) FILTER (email IS NULL) || ' missing values (10.0%). Consider imputation or removal.' AS text FROM p
  UNION ALL SELECT 2, 'Column ''email'' contains ' || count(*) FILTER (email IS NOT NULL AND NOT {EMAIL_SQL}) || ' invalid email addresses. Validate and correct email formats.' FROM p
  UNION ALL SELECT 3, 'Column ''signup_date'' contains ' || count(*) FILTER ({DATE_SQL.format('signup_date')} IS NULL) || ' invalid or unparseable dates. Standardise date formats.' FROM p)
SELECT CAST(nth AS BIGINT) AS nth, text FROM t""")
def dq_recommendations(spark, sf_dir):
    said = [s for s in quality.profile(PEOPLE(spark, sf_dir)).recommendations if "missing values" in s or "invalid" in s]
    return spark.createDataFrame(list(enumerate(said, 1)), "nth long, text string")


@query(f"""
SELECT "column", CASE WHEN "column" IN ('customer_id') THEN 'integer' WHEN "column" = 'balance' THEN 'float' WHEN "column" = 'email' THEN 'email'
  WHEN "column" = 'signup_date' THEN 'datetime (string)' WHEN "column" = 'phone' THEN 'phone' WHEN d < 0.05 * f THEN 'categorical' ELSE 'text' END AS kind
FROM ({each(["customer_id", "email", "amount", "signup_date", "phone", "segment", "balance"], "count($) AS f, count(DISTINCT $) AS d", PEOPLE.sql)})""")
def dq_column_kinds(spark, sf_dir):
    found = quality.profile(PEOPLE(spark, sf_dir)).columns
    return spark.createDataFrame([(c, x["kind"]) for c, x in found.items()], "`column` string, kind string")


@query(f"""
WITH p AS ({PEOPLE.sql}), t AS ({TOTALS.format(email=EMAIL_SQL, date=DATE_SQL.format("signup_date"), amount=NUMBER_SQL.format("amount"), day=NUMBER_SQL.format("signup_date"), people=PEOPLE.sql)})
, b AS (SELECT quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3, quantile_cont(customer_id, 0.25) AS i1, quantile_cont(customer_id, 0.75) AS i3 FROM p)
, o AS (SELECT count(*) FILTER (balance < q1 - 1.5 * (q3 - q1) OR balance > q3 + 1.5 * (q3 - q1)) + count(*) FILTER (customer_id < i1 - 1.5 * (i3 - i1) OR customer_id > i3 + 1.5 * (i3 - i1)) AS outliers FROM p, b)
, c AS (SELECT count(*) AS suspicious FROM ({each(["customer_id", "email", "amount", "signup_date", "phone", "segment", "balance"], "count($) AS f, count(*) - count($) AS n, count(DISTINCT $) AS d", PEOPLE.sql)})
    WHERE n > 0.8 * (f + n) OR d <= 1 AND f > 0 OR d > 0.95 * f AND d > 50)
, s AS (SELECT 100.0 - least(25, 100.0 * missing / (n_rows * n_columns)) - least(10, 200.0 * emails / (n_rows * n_columns)) - least(10, 200.0 * dates / (n_rows * n_columns))
    - least(10, 200.0 * numbers / (n_rows * n_columns)) - least(10, 100.0 * outliers / (n_rows * n_columns)) - least(10, 30.0 * suspicious / n_columns) AS score, outliers, suspicious FROM t, o, c)
SELECT CAST(round(greatest(0, score) * 100) AS BIGINT) AS score, outliers, suspicious FROM s""")
def dq_quality_score(spark, sf_dir):
    """The score of PEOPLE in hundredths, and the two faults that dq_quality_totals leaves out."""
    found = quality.profile(PEOPLE(spark, sf_dir))
    return spark.createDataFrame([(round(found.score * 100), found.totals.outliers, found.totals.suspicious)], "score long, outliers long, suspicious long")


@query(each(NUMBERS, "CAST(floor(avg($) * 1000) AS BIGINT) AS mean, CAST(floor(stddev_samp($) * 1000) AS BIGINT) AS std", GAPS.sql))
def dq_distribution_moments(spark, sf_dir):
    found = quality.distribution(GAPS(spark, sf_dir), NUMBERS)
    return found.select("column", *[F.floor(F.col(c) * 1000).cast("long").alias(c) for c in ("mean", "std")])


def firsts(columns: dict[str, str], of: str, order: str, k: int) -> str:
    """The first k values of each column that meet a condition, by ``order``, as text."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {order} AS place FROM ({of}) AS t WHERE {bad}" for c, bad in columns.items())
    return f"SELECT \"column\", CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY place, value) - 1 AS INTEGER) AS nth, value FROM ({each}) QUALIFY nth < {k}"


BAD = {"email": f"email IS NOT NULL AND NOT {EMAIL_SQL}", "amount": f"NOT {NUMBER_SQL.format('amount')}", "signup_date": f"{DATE_SQL.format('signup_date')} IS NULL"}


@query(firsts(BAD, PEOPLE.sql, "customer_id", 10))
def dq_fault_samples(spark, sf_dir):
    """The first ten bad values of three columns, in one pass; the table is dealt anew first, which changes nothing."""
    checks = {"email": quality.invalid_email(F.col("email")), "amount": quality.invalid_number(F.col("amount")), "signup_date": quality.invalid_date(F.col("signup_date"))}
    return quality.fault_samples(PEOPLE(spark, sf_dir).repartition(7), checks, [F.col("customer_id")])


#: Mail addresses come first in one column, and last in another.
CONTACTS = Given("""
SELECT c_custkey AS place, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey < 90 OR c_custkey % 5 = 0 THEN CONCAT('u', CAST(c_custkey AS STRING), '@example.com') ELSE c_name END AS contact,
  CASE WHEN c_custkey < 90 THEN c_name ELSE CONCAT('u', CAST(c_custkey AS STRING), '@example.com') END AS reply, c_name AS name
FROM {customer}""")


@query(f"""
SELECT "column", count(*) AS looked_at, CAST(count(*) FILTER (regexp_matches(value, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}$')) AS DOUBLE) / count(*) AS share
FROM ({firsts({c: f"{c} IS NOT NULL" for c in ("contact", "reply", "name")}, CONTACTS.sql, "place", 100)}) GROUP BY 1""")
def dq_first_values(spark, sf_dir):
    """What the first hundred values of each column look like, in one pass, in the order of the table."""
    return quality.email_shares(CONTACTS(spark, sf_dir).repartition(5), ["contact", "reply", "name"], [F.col("place")])


@query(f"""
SELECT 'contact' AS "column", CASE WHEN (SELECT count(*) FILTER (value LIKE '%@%') FROM ({firsts({"contact": "contact IS NOT NULL"}, CONTACTS.sql, "place", 100)})) > 50 THEN 'email' ELSE 'text' END AS kind
UNION ALL SELECT 'name', 'text' UNION ALL SELECT 'reply', CASE WHEN (SELECT count(*) FILTER (value LIKE '%@%') FROM ({firsts({"reply": "reply IS NOT NULL"}, CONTACTS.sql, "place", 100)})) > 50 THEN 'email' ELSE 'text' END""")
def dq_kinds_by_first_values(spark, sf_dir):
    """Kinds that a profile gives by the first hundred values in the order of the table."""
    found = quality.profile(CONTACTS(spark, sf_dir), place="place").columns
    return spark.createDataFrame([(c, x["kind"]) for c, x in found.items()], "`column` string, kind string")


#: Many columns, few and many distinct values, with gaps.
MEASURES = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TENTHS = [0.0, 0.01, 0.1, 0.5, 0.9, 0.999, 1.0]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS fraction, {SCALED.format(f'quantile_cont({c}, {p})')} AS value FROM lineitem WHERE l_orderkey % 11 <> 0" for c in MEASURES for p in TENTHS))
def dq_exact_quantiles(spark, sf_dir):
    """Seven quantiles of five columns by one selection, in ten-thousandths."""
    rows = table(spark, sf_dir, "lineitem").filter("l_orderkey % 11 <> 0")
    found = quantiles.quantiles(rows, {c: F.col(c).cast("double") for c in MEASURES}, TENTHS)
    made = spark.createDataFrame([(c, p, v) for c, x in found.items() for p, v in zip(TENTHS, x["quantiles"], strict=True)], "`column` string, fraction double, value double")
    return made.withColumn("value", F.round(F.col("value") * 10000).cast("long"))


#: Copies of rows with nulls at other places, which plain hashes of rows don't tell apart.
COPIES = Given("""
SELECT o_orderkey % 50 AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS b, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END AS c FROM {orders}""")


@query(f"SELECT a, b, c, count(*) - 1 AS copies FROM ({COPIES.sql}) GROUP BY a, b, c")
def dq_distinct_rows(spark, sf_dir):
    """Each distinct row once, by fingerprints, with the copies that it had."""
    df = COPIES(spark, sf_dir)
    counts = df.groupBy("a", "b", "c").agg((F.count("*") - 1).alias("copies"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in "abc"]
    return quality.distinct_rows(df).alias("d").join(counts.alias("n"), same).select("d.a", "d.b", "d.c", "copies")


ISSUES = " UNION ALL ".join([
    "SELECT 'missing' AS kind, 'email' AS \"column\", count(*) FILTER (email IS NULL) AS count, '' AS first FROM p",
    *[f"SELECT '{kind}', '{c}', count(*) FILTER ({bad}), min_by({c}, customer_id) FILTER ({bad}) FROM p" for kind, c, bad in (("emails", "email", BAD["email"]), ("dates", "signup_date", BAD["signup_date"]), ("numbers", "amount", BAD["amount"]), ("numbers", "signup_date", f"NOT {NUMBER_SQL.format('signup_date')}"))],
])


@query(f"WITH p AS ({PEOPLE.sql}) SELECT * FROM ({ISSUES}) WHERE count > 0")
def dq_report_issues(spark, sf_dir):
    """The faults of the stored report (missing values, mail addresses, dates, numbers) with the first sample of each."""
    people = PEOPLE(spark, sf_dir).withColumn("place", F.col("customer_id"))
    found = quality.issue_frame(spark, quality.profile(people, place="place")).filter("kind <> 'outliers'")
    return found.select("kind", "column", "count", F.coalesce(F.get("samples", F.lit(0)), F.lit("")).alias("first"))
