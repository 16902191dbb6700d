"""Search: fuzzy language names, ranked term prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import normalize_name

ARITY, WARP, LEAST, RESULTS = 4, 2, 0.4, 20


def lang_index(items: DataFrame, langs: DataFrame) -> DataFrame:
    """(norm, lang_id, name, n_items): languages with real items by normalised name; of those that share one, the language of the first item."""
    real = items.where("not is_imputed").join(F.broadcast(langs.select("lang_id", "name")), "lang_id")
    return real.groupBy(normalize_name(F.col("name")).alias("norm")).agg(F.min_by("lang_id", "item_id").alias("lang_id"), F.min_by("name", "item_id").alias("name"), F.count("*").alias("n_items"))


def term_index(items: DataFrame) -> DataFrame:
    """(lang_id, lowered, item_id, term, ety_num), to be written partitioned by lang_id and sorted by lowered, which a prefix then prunes."""
    return items.where("not is_imputed").select("lang_id", F.lower("term").alias("lowered"), "item_id", "term", "ety_num")


def write_term_index(index: DataFrame, path: str) -> None:
    index.repartition("lang_id").sortWithinPartitions("lang_id", "lowered").write.mode("overwrite").partitionBy("lang_id").parquet(path)


def ngrams(text: Column, arity: int = ARITY) -> Column:
    """The n-grams of a text padded with arity - 1 spaces on both sides."""
    padded = F.concat(F.lit(" " * (arity - 1)), text, F.lit(" " * (arity - 1)))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - arity + 1), lambda k: F.substring(padded, k, F.lit(arity)))


def ngram_scores(index: DataFrame, query: str, least: float = LEAST) -> DataFrame:
    """index with similarity, where it is at least `least`: shared n-grams (as multisets) of all, bent by WARP."""
    text = normalize_name(F.lit(query))
    asked = index.sparkSession.range(1).select(F.explode(ngrams(text)).alias("g")).groupBy("g").agg(F.count("*").alias("asked"))
    size = F.size(ngrams(F.col("norm")))
    grams = index.select("norm", F.explode(ngrams(F.col("norm"))).alias("g")).groupBy("norm", "g").agg(F.count("*").alias("own"))
    shared = grams.join(F.broadcast(asked), "g").groupBy("norm").agg(F.sum(F.least("own", "asked")).alias("shared"))
    total = size + F.size(ngrams(text)) - F.col("shared")
    score = (F.pow(total, F.lit(WARP)) - F.pow(total - F.col("shared"), F.lit(WARP))) / F.pow(total, F.lit(WARP))
    return index.join(shared, "norm").withColumn("similarity", score).drop("shared").where(F.col("similarity") >= least)


def search_langs(index: DataFrame, query: str) -> DataFrame:
    """Languages by similarity in steps of a tenth, within a step those with most items first; a total order, where comparing pairs within a tenth gives none."""
    return ngram_scores(index, query).orderBy(F.floor(F.col("similarity") / 0.1).desc(), F.col("n_items").desc(), F.col("similarity").desc(), "name")


def search_terms(index: DataFrame, lang_id: int, prefix: str, limit: int = RESULTS) -> DataFrame:
    """Items of a language whose lowered term begins with the prefix.

    Terms are taken in byte order until they have `limit` items; those are
    sorted by length, then term (descending), then etymology number.  Only the
    first `limit` terms are numbered in one place: a term has an item at least.
    """
    hits = index.where((F.col("lang_id") == lang_id) & F.startswith(F.col("lowered"), F.lit(prefix.lower())))
    first = hits.groupBy("lowered").agg(F.count("*").alias("n")).orderBy("lowered").limit(limit)
    before = F.sum("n").over(Window.orderBy("lowered").rowsBetween(Window.unboundedPreceding, -1))
    taken = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit).select("lowered")
    return hits.join(F.broadcast(taken), "lowered", "left_semi").orderBy(F.char_length("term"), F.col("term").desc(), "ety_num", "item_id").limit(limit)
