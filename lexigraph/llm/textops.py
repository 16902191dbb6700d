"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on whole Arrow batches: texts are viewed as one byte
array with document offsets, words are found with byte tables, and hashes of
arbitrary substrings come from prefix polynomials modulo 2**64.  No function
loops over rows or words in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from lexigraph.runtime import materialize as written

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A little below a power of two, which is how far tables of powers are filled.
SLICE_BYTES = (1 << 21) - 1024

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes: ASCII letters and digits and every byte of a non-ASCII character.
_ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _ALNUM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = U64(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class RollingHash:
    """Hashes of any [start, end) of a sequence, equal for equal content."""

    def __init__(self, values: np.ndarray):
        p, self.inverse = powers(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum((values.astype(U64) + U64(1)) * p[:-1], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U64))


class Texts:
    """Some consecutive texts of a batch as bytes; offsets has one entry more than there are texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray = _ALNUM) -> Words:
        return Words(self, kind)


class Words:
    """The maximal runs of word bytes: byte ranges start/end, and first[i] the number of words before text i."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        n, data = len(texts.data), texts.data
        is_word = kind[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[texts.offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = is_word[:-1]
        opens = is_word & (~before | edge[:-1])
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = is_word[1:]
        closes = is_word & (~after | edge[1:])
        self.texts, self.start, self.end = texts, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, texts.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, ASCII letters in lower case."""
        return RollingHash(_LOWER[self.texts.data])(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))


def whitespace_words(texts: Texts) -> Words:
    return texts.words(~_WS)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(lo, hi, texts) for consecutive rows of about limit bytes; a text longer than that comes alone. Null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_utf8()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, Texts(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column as int64 and where it is not null."""
    column = column.cast(pa.int64())
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def binaries(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], type=pa.binary())


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths, laid end to end: each element's row and its place in the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Lookup:
    """An open-addressing map from 64-bit keys to places 0..n-1, probed in bulk; it pickles as its key array."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=U64)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * U64(0xD1342543DE82EF95)) >> self.shift).astype(np.int64)

    def __reduce__(self):
        return Lookup, (self.keys,)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is absent."""
        out = np.full(len(h), -1, dtype=np.int32)
        if not len(self.keys) or not len(h):
            return out
        at = self._home(h)
        got = self.slots[at]
        hit = (got >= 0) & (self.keys[got] == h)
        out[hit] = got[hit]
        left = np.flatnonzero((got >= 0) & ~hit)
        while len(left):
            at_left = (at[left] + 1) & self.mask
            at[left] = at_left
            got = self.slots[at_left]
            hit = (got >= 0) & (self.keys[got] == h[left])
            out[left[hit]] = got[hit]
            left = left[(got >= 0) & ~hit]
        return out


def buckets(spark: SparkSession) -> int:
    """How many buckets to split keyed work into: a few for each shuffle partition, so it grows as the job is sized."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are broadcast at most; a longer list is joined by shuffling.
BROADCAST_IDS = 2_000_000


def with_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join of df with ids (one column, already written): broadcast where they are counted to be few enough, shuffled otherwise."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, column, how)


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(df with its ids as longs in the ids' order, a function that puts the ids back into columns of such longs).

    Integers are taken as they are; ids of another type are numbered in a table
    of their own and joined, both ways, by shuffling.  Null stays null.
    """
    kind = df.schema[id_col].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return df.withColumn(id_col, F.col(id_col).cast("long")), lambda found, *columns: found.withColumns({c: F.col(c).cast(kind) for c in columns})
    own, nth = unused("own_id", df.columns), unused("nth_id", df.columns)
    numbers = written(df.select(F.col(id_col).alias(own)).where(F.col(own).isNotNull()).distinct().orderBy(own).withColumn(nth, F.monotonically_increasing_id()))
    rows = df.join(numbers, F.col(id_col) == F.col(own), "left").withColumn(id_col, F.col(nth)).select(*df.columns)

    def back(found: DataFrame, *columns: str) -> DataFrame:
        names = found.columns
        for c in columns:
            found = found.join(numbers.select(F.col(own).alias("_own"), F.col(nth).alias("_nth")), F.col(c) == F.col("_nth"), "left").withColumn(c, F.col("_own")).select(*names)
        return found

    return rows, back


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, Callable[..., DataFrame]]:
    """(docs with a long key for each document, the key's name, a function that turns keys in columns into ids).

    A document is an id with a text: rows that repeat both are one (the least
    of their other columns that have an order), and texts that share an id are
    several, keyed in the order of ids.  Rows without an id have no key.
    Shuffles only rows whose id repeats, unless some do: then keys are numbered.
    """
    key = unused("row_key", docs.columns)
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if again.isEmpty():
        rows, back = numbered(docs.withColumn(key, F.col(id_col)), key)
        return rows, key, back
    ordered = [F.col(f.name) for f in docs.schema if f.name not in (text_col, id_col) and not any(x in f.dataType.simpleString() for x in ("map<", "variant", "void", "interval"))]
    once = with_ids(docs, again, id_col, "left_semi").groupBy(id_col, text_col).agg(F.min_by(F.struct(*docs.columns), F.struct(F.lit(0), *ordered)).alias("row")).select("row.*")
    mark = lambda df, digest: df.withColumn(key, F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), digest.alias("digest"))))
    rows = mark(with_ids(docs, again, id_col, "left_anti").select(*docs.columns), F.lit("")).unionByName(mark(once.select(*docs.columns), F.coalesce(F.sha2(text_col, 256), F.lit(""))))
    rows, back = numbered(rows, key)
    return rows, key, lambda found, *columns: back(found, *columns).withColumns({c: F.col(c)["id"] for c in columns})


def within(rows: DataFrame, text_col: str, limit: int) -> DataFrame:
    """The shortest of some rows, whose number is bounded, as long as they have at most limit characters together."""
    so_far = F.sum(F.length(text_col)).over(Window.orderBy(F.length(text_col), *[c for c in rows.columns]).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= limit).drop("so_far")


def key_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit key space each key lies in."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def split_by(bucket: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[np.ndarray]]]:
    """The buckets that occur, and for each column its values by bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    heads = b[np.concatenate([[0], cuts])] if len(b) else b
    return heads.tolist(), [np.split(c[order], cuts) if len(b) else [] for c in columns]


def unused(name: str, columns: list[str]) -> str:
    """name, made longer until none of the columns has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
