"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import decontaminate, html_extract, huffman, knn, langid, sentencepiece_sampling, simhash, suffix_dedup, token_counts, toxicity
from lexigraph.runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows, among all, of each row whose id is divisible by 50: the set of queries that searches ask."""
    vectors = _table(spark, sf_dir, "embeddings")
    return knn.knn_join(vectors.where("vec_id % 50 = 0"), vectors, exclude_self=True).withColumn("distance", F.round("distance", 6))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.encode_corpus(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_knn_join, op2_toxicity, op3_token_counts, op4_simhash_near_dedup, op5_decontamination, op6_sentencepiece, op7_language_id, op8_token_binary, op9_html_extraction, op10_suffix_dedup)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_knn_join": OP1, "op5_decontamination": OP5, "op10_suffix_dedup": OP10}


OP1 = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, neighbor_id, rank::INTEGER AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""

#: Phrase runs of 8 words by their first word; then windows for the pairs of document and item that share enough distinct words.
OP5 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
r AS (SELECT DISTINCT item_id, len(w) AS size, least(8, len(w)) AS n, list_slice(w, q, q + least(8, len(w)) - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS q FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
h AS (SELECT doc_id, item_id, size, n, pos FROM p JOIN r ON p.w[p.pos] = r.g[1] WHERE list_slice(p.w, pos, pos + n - 1) = r.g),
f AS (SELECT doc_id, item_id, least(count(DISTINCT pos + k), any_value(size)) AS n_words, any_value(size) AS size FROM (SELECT *, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id, item_id),
t AS (SELECT item_id, ceil(0.8 * len(list_distinct(w))) AS need, len(list_distinct(w)) AS many, ceil(1.25 * len(w)) AS width, unnest(list_distinct(w)) AS term FROM i WHERE len(list_distinct(w)) >= 8),
o AS (SELECT doc_id, item_id, need, many, width, term, pos FROM p JOIN t ON p.w[p.pos] = t.term ANTI JOIN f USING (doc_id, item_id)),
c AS (SELECT o.* FROM o SEMI JOIN (SELECT doc_id, item_id FROM o GROUP BY ALL HAVING count(DISTINCT term) >= any_value(need)) e USING (doc_id, item_id)),
x AS (SELECT a.doc_id, a.item_id, a.pos, any_value(a.need) AS need, any_value(a.many) AS many, count(DISTINCT b.term) AS found FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + a.width GROUP BY a.doc_id, a.item_id, a.pos)
SELECT doc_id, item_id, 'phrase' AS kind, n_words::BIGINT AS n_words, round(n_words / size, 6) AS coverage FROM f
UNION ALL
SELECT doc_id, item_id, 'proximity', max(found)::BIGINT, round(max(found) / any_value(many), 6) FROM x WHERE found >= need GROUP BY doc_id, item_id
"""

#: Every window of 50 words as text; those that two documents share; their unions by document.
OP10 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\f\\r\\x0b]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p + 1, p + 50), ' ')) AS h FROM s),
r AS (SELECT h FROM k GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 50 THEN 0 ELSE 1 END AS head FROM k SEMI JOIN r USING (h) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM m)
SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word, max(p) + 50 - min(p) AS n_words FROM g GROUP BY doc_id, n
"""
