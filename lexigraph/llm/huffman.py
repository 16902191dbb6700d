"""Token ids as binary: canonical, length-limited Huffman coding with block checkpoints.

Ids are counted over the whole corpus, code lengths come from package-merge
(optimal under the limit), and codes are canonical, so the lengths alone
describe them.  A row's payload is a bit string, the most significant bit
first, with the bit offset of each block of BLOCK tokens beside it: any block
decodes by itself, with one table lookup a token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import bpe
from lexigraph.llm.textops import list_array, ragged, slices, written

LIMIT, BLOCK = 18, 1024
#: Bits of a code that the writer of four bytes can shift into place.
LONGEST = 25
SLICE_TOKENS = 1 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits for these counts; 0 where a count is 0. More symbols than limit bits can tell apart get the bits they need."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    level, leaves = weight, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < n)
    depth, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        of_leaves = int(leaf[:take].sum())
        depth[:of_leaves] += 1
        take = 2 * (take - of_leaves)
    lengths[used] = depth
    return lengths


class Code:
    """A canonical code, from the lengths of its ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        self.limit = max(1, int(self.lengths.max(initial=0)))
        if self.limit > LONGEST:
            raise ValueError(f"codes of {self.limit} bits are longer than {LONGEST}")
        width = np.uint64(1) << (self.limit - self.lengths[used]).astype(np.uint64)
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[used] = first >> (self.limit - self.lengths[used]).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, dtype=np.int32)
        self.size = np.ones(1 << self.limit, dtype=np.uint8)
        filled = int(width.sum())
        self.symbol[:filled] = np.repeat(used, width.astype(np.int64))
        self.size[:filled] = np.repeat(self.lengths[used], width.astype(np.int64))

    def __reduce__(self):
        return Code, (self.lengths,)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The code book (id, length, code); as many rows as distinct ids."""
        used = np.flatnonzero(self.lengths)
        return spark.createDataFrame(pa.table({"id": pa.array(used), "length": pa.array(self.lengths[used].astype(np.int32)), "code": pa.array(self.codes[used].astype(np.int64))}))

    def encode(self, ids: np.ndarray, count: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(payloads, bits, checkpoints, checkpoints a row) of rows of these many ids, end to end."""
        size = self.lengths[ids].astype(np.int64)
        row, place = ragged(count)
        before = np.cumsum(size) - size
        heads = np.cumsum(count) - count
        bits = np.zeros(len(count), dtype=np.int64)
        full = count > 0
        bits[full] = np.add.reduceat(size, heads[full])
        octets = (bits + 7) // 8
        base = np.cumsum(octets) - octets
        offset = before - np.repeat(np.cumsum(bits) - bits, count)  # within the row
        at = offset + 8 * base[row]
        value = self.codes[ids] << (32 - size - (at & 7)).astype(np.uint64)
        total = int(octets.sum())
        data = np.zeros(total + 4)
        for k in range(4):
            part = (value >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.float64)
            data += np.bincount((at >> 3) + k, weights=part, minlength=total + 4)[: total + 4]
        raw = data.astype(np.uint8).tobytes()
        marks = place % block == 0
        return [raw[b : b + o] for b, o in zip(base.tolist(), octets.tolist())], bits, offset[marks], -(-count // block)

    def decode_many(self, payloads: list[bytes], starts: np.ndarray, many: np.ndarray, count: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The ids of rows of these many checkpoints and ids, end to end; all blocks at once, each from its own checkpoint."""
        data = np.frombuffer(b"".join(payloads) + bytes(8), dtype=np.uint8)
        sizes = np.array([len(p) for p in payloads], dtype=np.int64)
        row, nth = ragged(many)
        at = starts.astype(np.int64) + 8 * (np.cumsum(sizes) - sizes)[row]
        left = np.minimum(count[row] - nth * block, block)
        to = (np.cumsum(count) - count)[row] + nth * block
        order = np.argsort(-left, kind="stable")
        at, left, to = at[order], left[order], to[order]
        out = np.zeros(int(count.sum()), dtype=np.int32)
        open_ = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")  # blocks with more than k ids
        shift = 32 - self.limit
        for k, n in enumerate(open_.tolist()):
            spot = at[:n]
            byte = spot >> 3
            word = data[byte].astype(np.uint32) << 24 | data[byte + 1].astype(np.uint32) << 16 | data[byte + 2].astype(np.uint32) << 8 | data[byte + 3]
            peek = (word << (spot & 7).astype(np.uint32)) >> shift
            out[to[:n] + k] = self.symbol[peek]
            spot += self.size[peek]
        return out

    def decode(self, payload: bytes, starts: np.ndarray, count: int, block: int = BLOCK) -> np.ndarray:
        """The count ids of a payload."""
        return self.decode_many([payload], starts, np.array([len(starts)]), np.array([count]), block)


class Ids:
    """Pre-tokens' ids in one growing array, reached by number; forgotten when there are too many."""

    def __init__(self, blob: bytes, limit: int):
        self.encode, self.limit = bpe.encoding(blob).encode_ordinary, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.ends: list[int] = [0]
        self.seen, self.flat, self.offsets = 0, np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def __call__(self, words: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens that stand at these places of words, end to end, and how many each has."""
        if len(self.number) > self.limit:
            self.clear()
        numbers = list(map(self.number.get, words))
        if None in numbers:
            for k, n in enumerate(numbers):
                if n is None:
                    numbers[k] = self.number[words[k]] = len(self.ends) - 1
                    self.ids += self.encode(words[k].decode())
                    self.ends.append(len(self.ids))
        if self.seen != len(self.ids) or len(self.offsets) != len(self.ends):
            self.flat = np.concatenate([self.flat, np.array(self.ids[self.seen :], dtype=np.int64)])
            self.offsets = np.concatenate([self.offsets, np.array(self.ends[len(self.offsets) :], dtype=np.int64)])
            self.seen = len(self.ids)
        number = np.array(numbers, dtype=np.int64)[at]
        size = self.offsets[number + 1] - self.offsets[number]
        row, place = ragged(size)
        return self.flat[self.offsets[number][row] + place], size


_ids: dict[int, Ids] = {}


def token_ids(docs: DataFrame, ranks: str = bpe.RANKS, id_col: str = "doc_id", text_col: str = "text", cache: int = 300_000) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of docs, ids as little-endian unsigned integers of 2 bytes (4, if the vocabulary needs them)."""
    blob = bpe.read_ranks(docs.sparkSession, ranks)
    width = id_width(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        key = hash(blob.value)
        if key not in _ids:
            _ids[key] = Ids(blob.value, cache)
        ids = _ids[key]
        w = np.dtype(width).itemsize
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                words, at, first = bpe.pretoken_codes(texts)
                flat, size = ids(words, at)
                ends = np.append(0, np.cumsum(size))[first]
                raw = flat.astype(width).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array([raw[a * w : b * w] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def id_width(ranks: str) -> str:
    with open(ranks, "rb") as f:
        return "<u2" if max(bpe.parse(f.read()).values()) < 1 << 16 else "<u4"


def build_code(tokens: DataFrame, width: str = "<u2", limit: int = LIMIT) -> Code:
    """The code for the ids (binary column ids) of all rows; what reaches the driver is one count for each distinct id."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).drop_null().to_pylist()), dtype=width)
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return Code(code_lengths(counts, limit))


def encode_rows(tokens: DataFrame, code: Code, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, n_bits, payload, checkpoints, code_lengths) for each row of tokens; null ids are as none. The first row of each task has the code's lengths, so each file that is written has them."""
    shared = tokens.sparkSession.sparkContext.broadcast(code)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        code = shared.value
        book = [code.lengths.tobytes()]
        for batch in batches:
            rows = [np.frombuffer(x or b"", dtype=width) for x in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(rows):
                hi, size = lo, 0
                while hi < len(rows) and (hi == lo or size + len(rows[hi]) <= SLICE_TOKENS):
                    size += len(rows[hi])
                    hi += 1
                count = np.array([len(r) for r in rows[lo:hi]], dtype=np.int64)
                payloads, bits, marks, many = code.encode(np.concatenate(rows[lo:hi]), count, block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(bits), pa.array(payloads, pa.binary()), list_array(pa.array(marks), many), pa.array(book + [None] * (hi - lo - len(book)), pa.binary())], names=["doc_id", "n_tokens", "n_bits", "payload", "checkpoints", "code_lengths"])
                book, lo = [], hi

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_bits long, payload binary, checkpoints array<long>, code_lengths binary")


def decode_rows(encoded: DataFrame, code: Code, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) with the ids of each encoded row as an array."""
    shared = encoded.sparkSession.sparkContext.broadcast(code)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        code = shared.value
        for batch in batches:
            marks = batch.column(3)
            count, many = batch.column(1).to_numpy(), pa.compute.list_value_length(marks).to_numpy()
            ids = code.decode_many(batch.column(2).to_pylist(), marks.flatten().to_numpy(), many.astype(np.int64), count, block)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(pa.array(ids), count)], names=["doc_id", "ids"])

    return encoded.select("doc_id", "n_tokens", "payload", "checkpoints").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def encode_corpus(docs: DataFrame, ranks: str = bpe.RANKS, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The token ids of each row's text as a Huffman payload, under the code of all rows' ids, and the code itself.

    (doc_id, n_tokens, n_bits, payload, checkpoints, code_lengths), a row for
    each of docs.  The code book, one byte of length for each id from 0 on (0
    where an id isn't used), stands in code_lengths of the first row that each
    task writes and is null elsewhere; it is all that `decode_corpus` needs.  A
    null or empty text has no token, no bit and an empty payload.  Texts are
    tokenised once: the ids are written to the shared folder between counting
    and coding.
    """
    width = id_width(ranks)
    tokens = written(token_ids(docs, ranks, id_col, text_col))
    return encode_rows(tokens, build_code(tokens, width, limit), width)


def decode_corpus(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids) of what encode_corpus returned, from that alone; encoded must be written, as its code book is read first."""
    book = encoded.where(F.col("code_lengths").isNotNull()).first()
    return decode_rows(encoded, Code(np.frombuffer(book["code_lengths"] if book else b"", dtype=np.uint8)))
