"""Queries of this subpackage for ``__spark_entry__``: (session, folder of tables) -> DataFrame."""

from __future__ import annotations

import public_tokenizers

from tessera.llm import bpe, html, jaccard, licenses, linededup, media, merkle, packing, quality, toxicity, urlrules, wavelet, whitening
from tessera.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


def op2_html_extraction(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, urlrules.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(licenses.of_documents(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_media_columns(spark, sf_dir):
    return media.digest(media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.check_documents(table(spark, sf_dir, "documents"))


def op12_wavelet_shards(spark, sf_dir):
    return wavelet.store_and_read(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op13_whitening(spark, sf_dir):
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_byte_bpe, op2_html_extraction, op3_url_filter, op4_license_scan, op5_line_dedup, op6_quality_rules, op7_ngram_jaccard, op8_toxicity, op9_packing, op10_media_columns, op11_merkle_manifest, op12_wavelet_shards, op13_whitening)


def queries():
    return {f.__name__: f for f in QUERIES}


#: Words as the quality rules count them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents
), l AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) AS nth
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines FROM l GROUP BY r
), windows AS (
  SELECT r, i, w[i:i + 4] AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, five) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS n_shouts
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), c AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars) FROM m)
, f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_shouts > 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept,
  n_lines, n_shouts, failures FROM f
"""
OP5 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
, n AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d)
, worded AS (
  SELECT doc_id, i, l[i + 1] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place
  FROM n WHERE regexp_matches(l[i + 1], '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, place, [line, lead(line, 1) OVER o, lead(line, 2) OVER o] AS three, lead(place, 2) OVER o AS last
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), later AS (
  SELECT doc_id, place FROM w WHERE last IS NOT NULL QUALIFY row_number() OVER (PARTITION BY three ORDER BY doc_id, place) > 1
), gone AS (SELECT DISTINCT doc_id, place + k AS place FROM later, (SELECT unnest(range(0, 3)) AS k))
, removed AS (SELECT doc_id, i FROM gone JOIN worded USING (doc_id, place))
, counts AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id)
, cut AS (SELECT doc_id, count(*) AS n_removed FROM removed GROUP BY doc_id)
, rest AS (
  SELECT n.doc_id, string_agg(n.l[n.i + 1], chr(10) ORDER BY n.i) AS rest
  FROM n JOIN cut USING (doc_id) ANTI JOIN removed USING (doc_id, i) GROUP BY n.doc_id
)
SELECT doc_id, CASE WHEN n_removed IS NULL THEN text ELSE coalesce(rest, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
, links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c))
, both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)
, reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, other FROM reach JOIN both_ways ON doc_id = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
#: The CRC of a decimal number is even; bit by bit, with the polynomial 0xEDB88320.
EVEN_CRC = r"""
list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce(list_concat([xor(r, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) & 1 = 1
"""
#: Every level of all trees, the tree over the sources (-1) included, by recursion; then each row's path up through both.
OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, CASE WHEN {EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents
), e AS (
  SELECT r, doc_id, source, {" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS fields,
    coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(tampered) || ':' || tampered, '-') AS changed FROM d
), l AS (
  SELECT r, doc_id, sha256(fields || own) AS leaf, sha256(fields || changed) AS other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, source FROM e
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
), lower(tree, level, i, h, n) AS (
  SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM p
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM lower WHERE n > 1 GROUP BY tree, level, i // 3
), upper(tree, level, i, h, n) AS (
  SELECT -1, 0, tree, h, count(*) OVER () FROM lower WHERE n = 1
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM upper WHERE n > 1 GROUP BY tree, level, i // 3
), nodes AS (SELECT * FROM lower UNION ALL SELECT * FROM upper)
, runs AS (SELECT tree, level, i // 3 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM nodes GROUP BY tree, level, i // 3)
, path(r, own, tree, level, i, h, proof) AS (
  SELECT r, tree, tree, 0, i, other, '' FROM p
  UNION ALL
  SELECT r, own, CASE WHEN n > 1 THEN tree ELSE -1 END, CASE WHEN n > 1 THEN level + 1 ELSE 0 END, CASE WHEN n > 1 THEN i // 3 ELSE own END,
    CASE WHEN n > 1 THEN sha256(array_to_string(hs[:i % 3], '') || h || array_to_string(hs[i % 3 + 2:], '')) ELSE h END,
    CASE WHEN n > 1 THEN proof || array_to_string(hs[:i % 3], '') || array_to_string(hs[i % 3 + 2:], '') ELSE proof END
  FROM path JOIN runs USING (tree, level) WHERE run = i // 3 AND (n > 1 OR tree >= 0)
), ends AS (SELECT path.* FROM path JOIN upper USING (tree, level) WHERE n = 1)
SELECT doc_id, leaf, (SELECT h FROM lower AS s WHERE s.tree = p.tree AND s.n = 1) AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
  sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = (SELECT h FROM upper WHERE n = 1) AS verified
FROM p JOIN ends USING (r)
"""


def oracle_sql():
    return {"op5_line_dedup": OP5, "op6_quality_rules": OP6, "op7_ngram_jaccard": OP7, "op11_merkle_manifest": OP11}
