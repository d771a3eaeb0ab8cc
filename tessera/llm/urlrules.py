"""URL filter by association rules: FP-growth mines combinations of URL tokens from labelled URLs.

Tokens are the scheme, host labels, top domain, path segments, extension and query keys of a URL; numbers become one
token. Rules "tokens -> block" with enough support and confidence are kept unless a shorter rule is at least as sure.
They match through an inverted index: token to rules, counted on the distinct token sets of the URLs. Written rules of
hosts and path prefixes come before mined ones. All work is DataFrame and MLlib work in the JVM.

Equal labelled URLs count once, as bad if any label says so. Tokens that occur in the same labelled URLs, as the segments of
a long path that all its URLs share, are one class, and rules are mined over classes: a second token of a class makes a rule
no surer, so a rule that is kept has one token of each of its classes, and any token of the class will do. That finds the
rules that mining over tokens finds, without the exponentially many equal ones between. A null URL, or one without ``://``, has an empty host and path and is allowed unless a mined rule says otherwise. Equal
URLs get equal verdicts; of several mined rules that match the surest one is named, then the longer, then the greater in
order. Long URLs are read whole. Extra columns of pages and labels are not read, whatever their names. Without labels there
are no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, lookup, written

#: A rule needs this share of the labelled URLs, and this number of them.
MIN_SUPPORT, MIN_URLS = 0.002, 10
MIN_CONFIDENCE = 0.7
BLOCK, ALLOW = "=block", "=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Written rules: verdict, host and path prefix.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def rest(url: str) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(F.col(url), "://")
    return F.coalesce(F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")), F.lit(""))


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]], host: str, path: str) -> Column:
    """struct(size, rule, verdict) of the longest written rule that fits, or null."""
    hosts: dict[str, list[Column]] = {}
    for verdict, rule in rules:
        at = rule.index("/")
        one = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule[at:]).alias("prefix"))
        hosts.setdefault(rule[:at], []).append(one)
    known = F.create_map(*[x for h, rs in hosts.items() for x in (F.lit(h), F.array(*rs))])
    labels = F.split(F.col(host), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(above, lambda h: F.try_element_at(known, h)), lambda x: x.isNotNull())), lambda r: F.startswith(F.col(path), r["prefix"]))
    return F.array_max(fitting)


def tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens of a URL; runs of digits count as one sign."""
    signed = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(F.lower(x), r"[0-9]+", "0")))
    query = F.regexp_extract(F.col(url), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = F.concat(
        signed("s:", F.array(F.substring_index(F.substring_index(F.col(url), "://", 1), "/", -1))),
        signed("h:", F.split(F.col(host), r"\.")),
        signed("d:", F.array(F.col(host))),
        signed("p:", F.split(F.col(path), "/")),
        signed("x:", F.array(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]{1,5})$", 1))),
        signed("q:", keys),
    )
    return F.array_sort(F.array_distinct(F.coalesce(parts, F.array().cast("array<string>"))))


def classes(rows: DataFrame) -> DataFrame:
    """token and first (the least token that occurs in the same rows) of ``rows`` (row, tokens)."""
    each = rows.select(F.xxhash64("row").alias("a"), F.xxhash64("row", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    places = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    firsts = places.groupBy("n", "a", "b").agg(F.min("token").alias("first"))
    return places.join(firsts, ["n", "a", "b"]).select("token", "first")


def mine_classes(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that block (tokens, confidence and support; the first token of a class stands for it) and the classes (token, first)."""
    rows = cut_lineage(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"))
    members = written(classes(rows))
    firsts = rows.select("row", F.explode("tokens").alias("token")).join(members, "token").groupBy("row").agg(F.array_sort(F.collect_set("first")).alias("tokens"))
    kept = rows.select("row", "bad").join(firsts, "row")
    marked = kept.select(F.concat("tokens", F.array(F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))).alias("items"))
    total = marked.count()
    if not total:
        return labelled.select("tokens", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0), members
    support = min(1.0, max(MIN_SUPPORT, MIN_URLS / total))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=MIN_CONFIDENCE).fit(marked)
    sure = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).filter(~F.array_contains("antecedent", ALLOW))
    sure = sure.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    # A rule with one token more than another that is as sure says nothing new.
    shorter = sure.select(F.col("tokens"), "confidence", F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("less"))
    known = sure.select(F.col("tokens").alias("less"), F.col("confidence").alias("as_sure"))
    idle = shorter.join(known, "less").filter(F.col("as_sure") >= F.col("confidence")).select("tokens").distinct()
    return sure.join(idle, "tokens", "left_anti"), members


def mine(labelled: DataFrame) -> DataFrame:
    """tokens, confidence and support of the rules that block, from ``labelled`` (tokens, bad): a rule for each choice of tokens."""
    rules, known = mine_classes(labelled)
    members = known.groupBy("first").agg(F.collect_list("token").alias("members"))
    each = numbered(rules).select("rule_id", "confidence", "support", F.explode("mined").alias("first")).join(members, "first")
    choices = F.aggregate(F.collect_list("members"), F.array(F.array().cast("array<string>")), lambda made, ms: F.flatten(F.transform(made, lambda m: F.transform(ms, lambda t: F.concat(m, F.array(t))))))
    return each.groupBy("rule_id", "confidence", "support").agg(choices.alias("choices")).select(F.explode("choices").alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def numbered(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("tokens").alias("mined"), "confidence", "support", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("rule_id"))


def matched(token_sets: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """tokens, n, confidence and mined rule of the sets of ``token_sets`` (tokens, distinct, and n) that a rule matches.

    ``rules`` and ``known`` are those of ``mine_classes``. A rule fits if the set has a token of each of its classes; the
    greatest of each is named.
    """
    index = numbered(rules).select("rule_id", "n", "confidence", F.explode("mined").alias("first")).join(known, "first")
    hits = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "rule_id", "n", "confidence", "first").agg(F.max("token").alias("token"))
    fitting = hits.groupBy("tokens", "rule_id", "n", "confidence").agg(F.array_sort(F.collect_list("token")).alias("mined")).filter(F.size("mined") == F.col("n"))
    best = F.max(F.struct("confidence", "n", "mined")).alias("best")
    found = fitting.groupBy("tokens").agg(best).select("tokens", "best.confidence", "best.mined")
    return found.join(token_sets, "tokens")


def prepared(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url").withColumn("host", host("url")).withColumn("path", path("url")).withColumn("tokens", tokens("url", "host", "path"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined rule of each page (page_id, url); ``labels`` has url and bad."""
    known = labels.filter(F.col("bad").isNotNull()).groupBy("url").agg(F.max("bad").alias("bad")).withColumn("host", host("url")).withColumn("path", path("url"))
    mined, members = mine_classes(known.select(tokens("url", "host", "path").alias("tokens"), "bad"))
    own = prepared(pages)
    counted = written(own.groupBy("tokens").agg(F.count("*").alias("n")))
    both = lookup(own, matched(counted, mined, members), ["tokens"], counted=counted).withColumn("written", rule_of(rules, "host", "path"))
    verdict = F.coalesce(F.col("written.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", F.col("written.rule").alias("rule"), verdict.alias("verdict"), F.array_join("mined", " ").alias("mined"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad: a page shows the document whose number its path has, and is bad if that document's quality is 0."""
    number = F.regexp_extract(path("url"), r"/([0-9]{1,18})(?:[/.]|$)", 1)
    named = pages.select("url", F.when(number != "", number.cast("bigint")).alias("doc_id"))
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return named.join(known, "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
