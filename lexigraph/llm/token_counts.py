"""Token counts by a two-tier lookup of pre-token lengths, without shuffling a pre-token.

Tier one is a table of the corpus's frequent pre-tokens with their token counts.
It comes from mergeable summaries: each task keeps counters of bounded number
over all of its rows, summaries are merged in a tree of fixed fan-in, and the
table is broadcast as two flat arrays.  Tier two is a cache in each worker
process, which encodes what it doesn't know.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm import bpe
from lexigraph.llm.textops import slices, written

FREQUENT, CACHE, FAN_IN = 20_000, 300_000, 16
_SUMMARY = "part int, words array<string>, counts array<long>"


def _top(counts: Counter, n: int) -> list[tuple[str, int]]:
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def frequent_pretokens(docs: DataFrame, size: int = FREQUENT, text_col: str = "text") -> list[str]:
    """The size most frequent pre-tokens, most frequent first, by summaries of 4 * size counters; counts of rare ones are lower bounds."""

    def batch_of(part: int, top: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["part", "words", "counts"])

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                words, at, _ = bpe.pretoken_codes(texts)
                for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                    counts[w] += n
                if len(counts) > 16 * size:
                    counts = Counter(dict(_top(counts, 4 * size)))
        yield batch_of(TaskContext.get().partitionId(), [(w.decode(), n) for w, n in _top(counts, 4 * size)])

    def merge(key, table):
        counts: Counter = Counter()
        for words, n in zip(table.column("words"), table.column("counts")):  # one summary at a time becomes Python's
            for w, k in zip(words.as_py(), n.as_py()):
                counts[w] += k
            if len(counts) > 16 * size:
                counts = Counter(dict(_top(counts, 4 * size)))
        return pa.Table.from_batches([batch_of(key[0].as_py(), _top(counts, 4 * size))])

    summaries = written(docs.select(F.col(text_col)).mapInArrow(summarise, _SUMMARY))
    parts = (summaries.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        summaries = summaries.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(merge, _SUMMARY)
        if parts <= 1:
            break
    row = summaries.select(F.slice("words", 1, size).alias("words")).first()
    return row["words"] if row else []


class Lengths(dict):
    """Token counts of pre-tokens: the frequent ones for good, others as they come, forgotten when there are too many."""

    def __init__(self, blob: bytes, frequent: dict[bytes, int], limit: int):
        super().__init__(frequent)
        self.encode, self.frequent, self.limit = bpe.encoding(blob).encode_ordinary, frequent, limit

    def __missing__(self, word: bytes) -> int:
        n = len(self.encode(word.decode()))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        self[word] = n
        return n


_lengths: dict[int, Lengths] = {}


def token_counts(docs: DataFrame, ranks: str = bpe.RANKS, frequent: int = FREQUENT, cache: int = CACHE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row of docs; a null or empty text has none of either, and any id is passed on."""
    spark = docs.sparkSession
    blob = bpe.read_ranks(spark, ranks)
    encode = bpe.encoding(blob.value).encode_ordinary
    words = frequent_pretokens(docs, frequent, text_col) if frequent else []
    ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
    table = spark.sparkContext.broadcast(("".join(words).encode(), ends, np.array([len(encode(w)) for w in words], dtype=np.uint32)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        key = hash((table.value[0], blob.value, cache))
        if key not in _lengths:
            text, ends, sizes = table.value
            _lengths.clear()
            _lengths[key] = Lengths(blob.value, {text[a:b]: n for a, b, n in zip([0, *ends.tolist()], ends.tolist(), sizes.tolist())}, max(cache, 2 * len(ends)))
        size = _lengths[key].__getitem__
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                words, at, first = bpe.pretoken_codes(texts)
                tokens = np.append(0, np.cumsum(np.array([size(w) for w in words], dtype=np.int64)[at]))[first]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(tokens)), pa.array(np.diff(first))], names=["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
