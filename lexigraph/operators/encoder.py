"""Text vectors: assembling texts, encoding in Arrow batches, and a cache by text hash."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.runtime import materialize
from lexigraph.sources.dump import field, strict_string

BATCH = 800


def etymology_text(v: str, lang_name: Column, term: Column) -> Column:
    text = F.nullif(strict_string(field(v, "etymology_text")), F.lit(""))
    return F.concat(lang_name, F.lit(" "), term, F.lit(". "), text)


def gloss_text(v: str) -> Column:
    """The first gloss of each sense, a space behind each; null without any."""
    senses = field(v, "senses", "array<struct<glosses:array<variant>>>")
    found = F.filter(F.transform(senses, lambda s: strict_string(F.get(s["glosses"], 0))), lambda g: g.isNotNull())
    return F.nullif(F.concat_ws("", F.transform(found, lambda g: F.concat(g, F.lit(" ")))), F.lit(""))


def hashing_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """A model-free stand-in: hashed character trigrams, normalised. Each text's vector depends on that text alone."""
    import zlib

    out = np.zeros((len(texts), size), dtype=np.float32)
    for k, text in enumerate(texts):
        padded = f"  {text.lower()} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            out[k, h % size] += 1.0 if h & 0x80000000 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, batch: int = BATCH) -> DataFrame:
    """(hash, vec) of texts (hash, text), encoded `batch` at a time in Arrow batches."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = np.asarray(encoder(part.column(1).to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["hash", "vec"])

    return texts.select("hash", "text").mapInArrow(run, "hash long, vec array<float>")


def vectors_of(texts: DataFrame, cache_path: str | None = None, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, batch: int = BATCH) -> DataFrame:
    """(item_id, ety, gloss) of texts (item_id, ety_text, gloss_text): only texts that the cache lacks are encoded, each once, and appended to it."""
    spark = texts.sparkSession
    long = materialize(
        texts.select("item_id", F.explode(F.array(F.struct(F.lit("ety").alias("kind"), F.col("ety_text").alias("text")), F.struct(F.lit("gloss").alias("kind"), F.col("gloss_text").alias("text")))).alias("x"))
        .select("item_id", "x.kind", "x.text")
        .where("text is not null")
        .withColumn("hash", F.xxhash64("text"))
    )
    wanted = long.groupBy("hash").agg(F.min("text").alias("text"))
    known = None
    if cache_path:
        try:
            known = spark.read.schema("hash long, vec array<float>").parquet(cache_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    missing = wanted if known is None else wanted.join(known.select("hash"), "hash", "left_anti")
    new = materialize(encode(missing, encoder, batch))
    every = new if known is None else new.unionByName(known.join(wanted.select("hash"), "hash", "left_semi"))
    every = materialize(every)
    if cache_path:
        new.write.mode("append").parquet(cache_path)
    rows = long.join(every, "hash").groupBy("item_id").agg(F.max(F.when(F.col("kind") == "ety", F.col("vec"))).alias("ety"), F.max(F.when(F.col("kind") == "gloss", F.col("vec"))).alias("gloss"))
    return rows


def needs_vectors(terms: DataFrame, owners: DataFrame) -> DataFrame:
    """(item_id), distinct: what has to be encoded before linking.

    terms has (owner, ids): the candidates of each claimed term.  All candidates
    of a term count, since each gives its claim a confidence, and owners (item_id)
    of claims are what they are compared with.
    """
    return terms.select(F.explode("ids").alias("item_id")).unionByName(owners.select("item_id")).distinct()
