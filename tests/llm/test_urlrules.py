"""URL rules: written ones by brute force, mined ones on labelled URLs with a pattern."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.llm import urlrules
from tessera.llm.queries import op3_url_filter
from tests.against import TABLES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host.translate({i: i + 32 for i in range(65, 91)}), path[:stop]


def written(host, path):
    fitting = []
    for verdict, rule in urlrules.RULES:
        domain, prefix = rule.split("/", 1)
        if (host == domain or host.endswith(f".{domain}")) and path.startswith(f"/{prefix}"):
            fitting.append((len(rule), rule, verdict))
    return max(fitting)[1:] if fitting else (None, None)


ODD_URLS = [
    None, "", "nothing", "://", "http://", "http:///x", "http://EXAMPLE.com/en/1", "http://www.example.com/en/2?x", "http://notexample.com/en/", "http://a.b.example.com/EN/", "https://x.net/es/#f",
    "https://net/fr/a", "http://x.NET?/es/", "http://example.com/en", "a://b://c.net/es/", "http://ÄÖ.com/en/", "http://x.org/a.b/c.HTML?k=v&k2", "http://u:p@h.net:80/fr/", "x" * 5000, "http://a..com/en/", "http://.com/", "http://com",
]


def pages_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_written_rules_by_brute_force(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    rng = random.Random(19)
    urls = [*ODD_URLS, *[f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.', 'X.'])}{rng.choice(['example', 'a'])}.{rng.choice(['com', 'net', 'org', 'COM'])}{rng.choice(['', '/', '/en/', '/es/', '/en/a', '/fr/?q'])}{rng.choice(['', '#x', '?y=/es/'])}" for _ in range(300)]]
    for r in urlrules.judge(pages_of(spark, urls), none).collect():
        host, path = split(urls[r["page_id"]])
        rule, verdict = written(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), urls[r["page_id"]]


def brute_rules(sets, support, confidence):
    """All rules of up to two tokens, by counting."""
    from itertools import combinations

    found = {}
    for size in (1, 2):
        for pair in {c for s, _ in sets for c in combinations(sorted(s), size)}:
            fitting = [bad for s, bad in sets if set(pair) <= set(s)]
            if sum(fitting) >= support * len(sets) and sum(fitting) >= confidence * len(fitting):
                found[pair] = sum(fitting) / len(fitting)
    return found


def test_mined_rules(spark):
    rng = random.Random(20)
    urls = [(f"http://{rng.choice(['a', 'b', 'c'])}.org/{rng.choice(['casino', 'news', 'pills', 'music', 'maps'])}/{i}{rng.choice(['', '.html'])}", None) for i in range(400)]
    labelled = [(u, "casino" in u or ("pills" in u and "//a." in u)) for u, _ in urls]
    frame = spark.createDataFrame(labelled, "url string, bad boolean")
    known = frame.withColumn("host", urlrules.host("url")).withColumn("path", urlrules.path("url")).select(urlrules.tokens("url", "host", "path").alias("tokens"), "bad")
    mined = {tuple(r["tokens"]): r["confidence"] for r in urlrules.mine(known).collect()}
    every = brute_rules([(r["tokens"], r["bad"]) for r in known.collect()], 10 / 400, urlrules.MIN_CONFIDENCE)
    shortest = {p: c for p, c in every.items() if not any(set(q) < set(p) and every[q] >= c for q in every)}
    assert {p: round(c, 9) for p, c in mined.items() if len(p) <= 2} == {p: round(c, 9) for p, c in shortest.items()}
    judged = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages_of(spark, [u for u, _ in urls]), frame).collect()}
    assert all(judged[i] == ("block" if bad else "allow") for i, (_, bad) in enumerate(labelled))


def test_verdicts_by_brute_force(spark):
    """Labels with a signal and some noise: every rule by counting all token sets, then every page against every rule."""
    from itertools import combinations

    rng = random.Random(22)
    spam = lambda host, path: "pills" in path or (host.startswith("m.") and "win" in path)
    urls = sorted({f"http://{rng.choice(['m.', 'www.', ''])}{rng.choice('abc')}.org/{rng.choice(['win', 'pills', 'news', 'maps'])}/{rng.choice(['x', 'y'])}{i}" for i in range(600)})
    labelled = [(u, spam(*split(u)) != (rng.random() < 0.04)) for u in urls[::2]]
    frame = spark.createDataFrame([*labelled, *labelled[:50]], "url string, bad boolean")
    token_sets = lambda us: [frozenset(r["tokens"]) for r in urlrules.prepared(pages_of(spark, us)).orderBy("page_id").collect()]
    known = list(zip(token_sets([u for u, _ in labelled]), [b for _, b in labelled], strict=True))
    found = {}
    for subset in {frozenset(c) for s, bad in known if bad for n in range(1, len(s) + 1) for c in combinations(sorted(s), n)}:
        fitting = [bad for s, bad in known if subset <= s]
        if sum(fitting) >= 10 and sum(fitting) >= urlrules.MIN_CONFIDENCE * len(fitting):
            found[subset] = sum(fitting) / len(fitting)
    kept = [r for r, c in found.items() if not any(r - {t} in found and found[r - {t}] >= c for t in r)]
    judged = {r["page_id"]: (r["verdict"], r["mined"]) for r in urlrules.judge(pages_of(spark, urls), frame).collect()}
    for i, tokens in enumerate(token_sets(urls)):
        fitting = [r for r in kept if r <= tokens]
        best = max(fitting, key=lambda r: (found[r], len(r), sorted(r)), default=())
        assert judged[i] == ("block" if fitting else "allow", " ".join(sorted(best)) if fitting else None)
    unseen = [(judged[i][0] == "block", spam(*split(u))) for i, u in enumerate(urls) if i % 2]
    assert sum(a and b for a, b in unseen) / sum(a for a, _ in unseen) > 0.95 and sum(a and b for a, b in unseen) > 0.95 * sum(b for _, b in unseen)


def test_long_equal_urls_end(spark):
    """Many labelled URLs with a long path in common, and repeats of one, make few rules."""
    deep = "/".join(f"part{chr(97 + i)}" for i in range(24))
    urls = [f"http://spam.org/{deep}/{chr(97 + i)}" for i in range(20)] + [f"http://spam.org/{deep}/x"] * 50
    labelled = spark.createDataFrame([(u, True) for u in urls] + [(f"http://fine.org/{i}/a", False) for i in range(20)], "url string, bad boolean")
    rows = urlrules.judge(pages_of(spark, [urls[0], "http://fine.org/3/a", f"http://spam.org/{deep}/new"]), labelled).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {0: "block", 1: "allow", 2: "block"}


def test_any_token_of_a_class(spark):
    """Bad URLs share k path segments; a page with any one of these is blocked by a rule of its own, at every k."""
    for k in (3, 5, 9):
        parts = [f"seg{chr(97 + i)}" for i in range(k)]
        bad = [(f"http://a{chr(97 + i)}.org/{'/'.join(parts)}/{chr(97 + i)}x", True) for i in range(20)]
        good = [(f"http://a{chr(97 + i)}.org/fine/{chr(97 + i)}y", False) for i in range(20)]
        labelled = spark.createDataFrame(bad + good, "url string, bad boolean")
        pages = [*[f"http://new.org/{p}" for p in parts], "http://new.org/fine", f"http://new.org/{parts[1]}/{parts[0]}"]
        found = {r["page_id"]: (r["verdict"], r["mined"]) for r in urlrules.judge(pages_of(spark, pages), labelled).collect()}
        assert found == {**{i: ("block", f"p:{p}") for i, p in enumerate(parts)}, k: ("allow", None), k + 1: ("block", f"p:{parts[1]}")}


def test_frequent_keys_without_a_match(spark):
    """All keys that many rows have are looked up by a broadcast, whether found or not; no row is lost or doubled."""
    from tessera.llm.common import lookup

    rows = spark.range(3000).selectExpr("if(id < 1000, 'lost', if(id < 2000, 'hot', 'k' || id)) AS key", "id")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    found = counted.filter("key = 'hot' or key like 'k%5'").withColumn("value", F.length("key"))
    got = {r["id"]: (r["key"], r["value"]) for r in lookup(rows, found, ["key"], counted=counted).collect()}
    key = lambda i: "lost" if i < 1000 else "hot" if i < 2000 else f"k{i}"
    assert got == {i: (key(i), len(key(i)) if key(i) == "hot" or (key(i)[0] == "k" and key(i)[-1] == "5") else None) for i in range(3000)}


def test_a_frequent_token_set(spark):
    """A third of all pages have equal tokens; every page still gets its row."""
    labelled = spark.createDataFrame([(f"http://{'bad' if i % 2 else 'good'}.org/{i}", i % 2 == 1) for i in range(60)], "url string, bad boolean")
    urls = ["http://bad.org/7"] * 500 + [f"http://h{i}.org/{i}" for i in range(1000)]
    rows = urlrules.judge(pages_of(spark, urls), labelled).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(1500)) and sum(r["verdict"] == "block" for r in rows) == 500


def test_query_keeps_every_page(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{TABLES}/pages.parquet").select("page_id", "url").collect()}
    rows = op3_url_filter(spark, TABLES).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = split(pages[r["page_id"]])
        rule, verdict = written(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["mined"] else "allow"))


def test_no_python_in_the_plan(spark):
    plan = op3_url_filter(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([("http://x.org/a", True), (None, False), ("http://x.org/b", None)], "url string, bad boolean")
    assert urlrules.judge(none, labels).count() == 0
    twice = spark.createDataFrame([(1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, None)], "page_id long, url string").withColumns({"host": F.lit(1), "mined": F.lit(2), "tokens": F.lit(3)})
    found = urlrules.judge(twice, labels.withColumns({"host": F.lit(1), "tokens": F.lit(2)})).collect()
    assert sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in found) == [(0, "", "allow"), (1, "net/es/", "block"), (1, "net/es/", "block")]
