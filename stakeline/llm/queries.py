"""The text operators as queries ``(spark, sf_dir) -> DataFrame`` over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeline.llm import (
    decontaminate,
    embeddings,
    langid,
    licenses,
    negatives,
    packing,
    quality,
    search,
    simhash,
    suffix,
    token_files,
    toxicity,
    warc,
)
from stakeline.llm.tokens import public_tokenizer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query
def op1_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLE["op1_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""


@query
def op2_benchmark_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items, min_match=5, coverage=0.8)


@query
def op9_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_suffix_array_dedup(spark, sf_dir):
    return suffix.repeated_bytes(table(spark, sf_dir, "documents"), length=200)


@query
def op3_token_id_output(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizer("word_bpe_49k.json"), end=2).drop("ids")


@query
def op7_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), capacity=1024, end=2)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_warc_dictionary_writer(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False, revisit_bytes=1000).drop("payload")


ORACLE["op8_warc_dictionary_writer"] = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY n, h) AS latest FROM q)
SELECT page_id, url, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM r
"""


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_quality_classifier(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"))


@query
def op12_license_scan(spark, sf_dir):
    return licenses.label_documents(table(spark, sf_dir, "documents"))


_QUOTED = ", ".join(
    "({}, '{}', {}, '{}')".format(i, t.label, 1 if t.phrase else 2, t.text.replace("'", "''"))
    for i, t in enumerate(licenses.TEMPLATES)
)
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op12_license_scan"] = f"""
WITH t AS (
  SELECT template, label, kind, {_WORDS.format("text")} AS w FROM (VALUES {_QUOTED}) AS v(template, label, kind, text)
), tg AS (
  SELECT template, label, kind, len(w) AS length, least(len(w), 3) AS size, w,
    unnest(range(0, len(w) - least(len(w), 3) + 1)) AS o FROM t
), known AS (
  SELECT template, label, kind, length, size, o, array_to_string(w[o + 1 : o + size], ' ') AS gram FROM tg
), d AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS pos FROM d
), g AS (
  SELECT *, w0 || ' ' || lead(w0) OVER x AS w01, w0 || ' ' || lead(w0) OVER x || ' ' || lead(w0, 2) OVER x AS w012
  FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY pos)
), hits AS (
  SELECT doc_id, template, label, kind, length, size, o, pos - o AS diagonal
  FROM g JOIN known k ON k.size = 2 AND k.gram = g.w01
  UNION ALL
  SELECT doc_id, template, label, kind, length, size, o, pos - o FROM g JOIN known k ON k.size = 3 AND k.gram = g.w012
), places AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS place FROM (
    SELECT doc_id, template, diagonal,
      CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 3
        THEN 0 ELSE 1 END AS apart
    FROM (SELECT DISTINCT doc_id, template, diagonal FROM hits))
), both_of AS (
  SELECT h.*, 'diagonal' AS kind_of, h.diagonal AS spot FROM hits h
  UNION ALL
  SELECT h.*, 'place', p.place FROM hits h JOIN places p
    ON h.doc_id = p.doc_id AND h.template = p.template AND h.diagonal = p.diagonal WHERE h.kind = 2
), covering AS (
  SELECT *, unnest(range(o, o + size)) AS word FROM both_of
), spans AS (
  SELECT doc_id, template, kind_of, spot, any_value(label) AS label, any_value(kind) AS kind, any_value(length) AS length,
    min(diagonal + o) AS first, max(diagonal + o + size - 1) AS last, count(DISTINCT word) AS covered
  FROM covering GROUP BY ALL
), scored AS (
  SELECT *, 2 * least(covered, last - first + 1) / (length + last - first + 1)::DOUBLE AS score FROM spans
), good AS (
  SELECT * FROM scored WHERE score >= CASE WHEN kind = 1 THEN 1 ELSE 0.8 END
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY first, last, template, kind_of, spot
    ROWS UNBOUNDED PRECEDING) AS island
  FROM (
    SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY doc_id, kind ORDER BY first, last, template, kind_of, spot
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM good)
), best AS (
  SELECT DISTINCT doc_id, kind, label, first, last, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, kind, island ORDER BY score DESC, length DESC, label, first) AS r
    FROM islands)
  WHERE kind = 1 OR r = 1
)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words,
  count(b.doc_id) FILTER (b.kind = 1) AS n_base,
  min(b.first) FILTER (b.kind = 1) AS first_word, max(b.first) FILTER (b.kind = 1) AS last_word,
  coalesce(string_agg(DISTINCT b.label, ',' ORDER BY b.label) FILTER (b.kind = 1), '') AS base_labels,
  coalesce(string_agg(DISTINCT b.label, ',' ORDER BY b.label), '') AS labels,
  coalesce(max(b.score), 0) AS score
FROM d LEFT JOIN best b ON b.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op13_ranked_search(spark, sf_dir):
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE["op13_ranked_search"] = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), size AS (
  SELECT count(*) AS n, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(size.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, size GROUP BY term
), items AS (
  SELECT DISTINCT item_id, unnest({_WORDS.format("coalesce(text, '')")}) AS term FROM benchmark
), scores AS (
  SELECT i.item_id, f.doc_id,
    sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * f.n * size.n) // size.total))))::BIGINT AS score
  FROM items i JOIN tf f ON i.term = f.term JOIN weights w ON i.term = w.term, size
  GROUP BY i.item_id, f.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), every=100, positives=5, negatives=5, floor=80)


ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)::INTEGER AS rank,
  n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
