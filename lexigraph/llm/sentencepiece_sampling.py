"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is written with a meta symbol for each space and one more in front, as
the piece model expects.  No piece has the meta symbol behind another
character, so the lattice of all segmentations falls apart into units (a run of
meta symbols and what follows it), and sampling unit by unit samples the whole
text exactly.

Forward filtering runs once for each distinct unit of a slice: the probability
mass of all segmentations of each prefix.  Backward sampling runs for every
occurrence, from its end to its start, all occurrences at once; its random
numbers are a hash of seed, row key, occurrence and step, so a row's
segmentation depends on nothing else.

The vocabulary orders its pieces by frequency and has no usable log
probabilities (its scores are merge ranks), so a piece of rank r has the
probability of Zipf's law, 1 / (r + 2.7) normalised; theta is its exponent, and
the smaller it is, the more segmentations have a say.  A character without a
piece of its own becomes byte pieces, and so does a meta symbol that stands in
the text itself, which keeps decoding lossless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.textops import U64, Lookup, RollingHash, list_array, mix, ragged, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA, SEED = 0.3, 0
META = 0x2581
_LITERAL_META = 0x110000
SLICE_BYTES = 1 << 20
#: The least probability of a byte-spelled character, so that products of a few stay above zero.
LEAST = 1e-15


class Pieces:
    """A piece model's vocabulary as a trie in arrays, and its bytes for decoding."""

    def __init__(self, blob: bytes, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
        assert (self.byte_id >= 0).all(), "the model needs byte pieces"
        assert not any("▁" in names[i].lstrip("▁") for i in normal), "a meta symbol stands inside a piece"
        weight = 1.0 / (np.arange(n) + 2.7)
        weight /= weight.sum()
        self.probability = np.append(weight**theta, weight[-1] ** theta).astype(np.float64)  # the last is a fallback byte's
        self.longest = max(len(names[i]) for i in normal)
        usual = frozenset(normal)
        state, edges, ends = {"": 0}, [], {0: -1}
        for i in normal:
            at = 0
            for k in range(1, len(names[i]) + 1):
                prefix = names[i][:k]
                if (to := state.get(prefix)) is None:
                    to = state[prefix] = len(state)
                    edges.append((at, ord(prefix[-1]), to))
                    ends[to] = -1
                at = to
            ends[at] = i
        self.piece_at = np.array([ends[s] for s in range(len(state))], dtype=np.int32)
        e = np.array(edges, dtype=np.uint64)
        self.next, self.to = Lookup(e[:, 0] << U64(22) | e[:, 1]), e[:, 2].astype(np.int64)
        raw = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace("▁", " ").encode() if i in usual else b"" for i in range(n)]
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def lattice(self, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
        """For each length (0: one character) and position the piece that ends there, -1 for none, and its probability."""
        ids = np.full((self.longest, len(grid.chars)), -1, dtype=np.int16 if len(self.size) < 1 << 15 else np.int32)
        p = np.zeros((self.longest, len(grid.chars)), dtype=np.float32)
        unit, place = grid.unit, grid.place
        state = np.zeros(len(unit), dtype=np.int64)
        for k in range(self.longest):
            ok = place + k < grid.size[unit]
            unit, place, state = unit[ok], place[ok], state[ok]
            if not len(unit):
                break
            at = grid.base[place + k] + unit
            found = self.next(state.astype(U64) << U64(22) | grid.chars[at])
            ok = found >= 0
            unit, place, at, state = unit[ok], place[ok], at[ok], self.to[found[ok]]
            piece = self.piece_at[state]
            has = piece >= 0
            ids[k, at[has]] = piece[has]
            p[k, at[has]] = self.probability[piece[has]]
        lone = np.flatnonzero(ids[0] < 0)
        if len(lone):
            p[0, lone] = np.maximum(self.probability[-1] ** utf8_size(grid.chars[lone]), LEAST)
            ids[0, lone] = -2  # spelled in bytes later
        return ids, p

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and each row's size; the space in front of a row is taken off."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        size = self.size[ids]
        owner, place = ragged(size)
        data = self.raw[self.first[ids][owner] + place]
        total = np.bincount(row, weights=size, minlength=len(lengths)).astype(np.int64)
        heads = (np.cumsum(total) - total)[total > 0]
        heads = heads[data[heads] == 32]
        keep = np.ones(len(data), dtype=bool)
        keep[heads] = False
        cut = np.bincount(row[owner[heads]], minlength=len(lengths)) if len(heads) else 0
        return data[keep], total - cut


def utf8_size(chars: np.ndarray) -> np.ndarray:
    c = np.where(chars == _LITERAL_META, META, chars)
    return 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)


def _units(chars: np.ndarray, text_first: np.ndarray) -> np.ndarray:
    """Where units begin: at texts, at meta symbols behind another character, and around line feeds, which no piece holds with others."""
    meta, line = chars == META, chars == 10
    begin = np.zeros(len(chars) + 1, dtype=bool)
    begin[text_first] = True
    begin[1:-1] |= (meta[1:] & ~meta[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(begin[:-1])


class Grid:
    """Units of characters, the longest first, laid out by place: all first characters, then all second ones."""

    def __init__(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        begin, self.size = begin[self.order], size[self.order]
        longest = int(self.size.max(initial=0))
        self.longer = np.searchsorted(-self.size, -np.arange(longest), side="left")  # units longer than a place
        self.base = np.cumsum(self.longer) - self.longer
        self.place, self.unit = ragged(self.longer)
        self.chars = chars[begin[self.unit] + self.place]


def _filter(p: np.ndarray, grid: Grid, chunk: int = 8192) -> None:
    """Turns p[k, i] into the share of the mass of segmentations that end with position i whose last piece has at most k + 1 characters."""
    longest = p.shape[0]
    for lo in range(0, len(grid.size), chunk):
        units = min(chunk, len(grid.size) - lo)
        mass = np.zeros((longest + 1, units))  # of the latest prefixes, by place modulo longest + 1
        mass[0] = 1.0
        upto = np.empty((longest, units))
        for i in range(int(grid.size[lo])):
            n = min(units, int(grid.longer[i]) - lo)
            block = slice(int(grid.base[i]) + lo, int(grid.base[i]) + lo + n)
            total = np.zeros(n)
            for k in range(min(i + 1, longest)):
                total += mass[(i - k) % (longest + 1), :n] * p[k, block]
                upto[k, :n] = total
            for k in range(longest):
                p[k, block] = upto[k, :n] / total if k <= i else 1
            mass[(i + 1) % (longest + 1), :n] = total
            if i % 8 == 7:  # only shares matter: keep the last masses away from zero
                mass[:, :n] /= mass[:, :n].max(axis=0)


def sample(pieces: Pieces, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and how many each has."""
    n = len(texts)
    # an empty text has no unit and so no piece
    chars = np.frombuffer("".join(["▁" + t if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), dtype=np.int64, count=n)
    text_first = np.cumsum(sizes) - sizes
    literal = chars == META
    literal[text_first[sizes > 0]] = False
    chars[literal] = _LITERAL_META
    chars[chars == 32] = META
    if not len(chars):
        return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
    begin = _units(chars, text_first[sizes > 0])
    end = np.append(begin[1:], len(chars))
    _, head, which = np.unique(RollingHash(chars)(begin, end), return_index=True, return_inverse=True)
    grid = Grid(chars, begin[head], (end - begin)[head])
    ids, share = pieces.lattice(grid)
    _filter(share, grid)
    ids, share = np.ascontiguousarray(ids.T), np.ascontiguousarray(share.T)
    wide = -pieces.longest % 8
    rank = np.empty(len(head), dtype=np.int64)
    rank[grid.order] = np.arange(len(head))
    which = rank[which]
    text = np.searchsorted(np.cumsum(sizes), begin, side="right")
    nth = np.arange(len(begin)) - np.searchsorted(text, np.arange(n))[text]
    key = mix(mix(keys.view(U64) ^ U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[text] + nth.astype(U64))
    unit, place = which, grid.size[which] - 1
    live, step = np.arange(len(begin)), 0
    picked, owner = [], []
    while len(live):
        u = (mix(key[live] + U64((step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
        at = grid.base[place] + unit
        below = share[at] <= u[:, None]
        if wide:
            below = np.pad(below, ((0, 0), (0, wide)))
        k = np.minimum(np.bitwise_count(below.view(U64)).sum(axis=1, dtype=np.int64), pieces.longest - 1)
        piece = ids[at, k].astype(np.int64)
        piece[piece == -2] = -2 - grid.chars[at[piece == -2]].astype(np.int64)
        picked.append(piece)
        owner.append(live)
        more = place > k
        live, unit, place = live[more], unit[more], (place - k - 1)[more]
        step += 1
    count = np.zeros(len(begin), dtype=np.int64)
    for o in owner:
        count[o] += 1
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), dtype=np.int64)
    for k, (o, x) in enumerate(zip(owner, picked)):
        out[last[o] - k] = x
    total = np.bincount(text, weights=count, minlength=n).astype(np.int64)
    spelled = np.flatnonzero(out < -1)
    if len(spelled):
        c = (-2 - out[spelled]).astype(np.int64)
        data = [chr(META if x == _LITERAL_META else x).encode("utf-8", "surrogatepass") for x in c.tolist()]
        many = np.ones(len(out), dtype=np.int64)
        many[spelled] = [len(d) for d in data]
        belongs = np.repeat(np.arange(n), total)
        total = np.bincount(belongs, weights=many, minlength=n).astype(np.int64)
        wide = np.repeat(out, many)
        wide[wide < -1] = pieces.byte_id[np.frombuffer(b"".join(data), dtype=np.uint8)]
        out = wide
    return out.astype(np.int32), total


_loaded: dict[tuple[int, float], Pieces] = {}


def load(blob: bytes, theta: float) -> Pieces:
    """The vocabulary, built once in each worker process."""
    key = (hash(blob), theta)
    if key not in _loaded:
        _loaded[key] = Pieces(blob, theta)
    return _loaded[key]


def read_model(spark: SparkSession, path: str):
    """The model file, read once by the driver and broadcast; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, n_bytes, lossless) for each row of docs.

    ids is a sampled segmentation of the whole text that depends on the text,
    the row's id and the seed alone: rows that repeat an id and a text get the
    same ids.  lossless says that decoding gave the text back, byte for byte.
    A null or empty text has no ids and is lossless; a null id counts as 0.
    """
    blob = read_model(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = load(blob.value, theta)
        for batch in batches:
            keys = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, raw in slices(batch.column(2), SLICE_BYTES):
                part = batch.column(2).slice(lo, hi - lo).fill_null("").to_pylist()
                ids, count = sample(pieces, part, keys[lo:hi], seed)
                data, sizes = pieces.decode(ids, count)
                want = np.diff(raw.offsets)
                same = sizes == want
                if not (same.all() and np.array_equal(data, raw.data)):
                    ends = np.cumsum(sizes)
                    same = np.array([np.array_equal(data[e - s : e], raw.data[a:b]) for e, s, a, b in zip(ends, sizes, raw.offsets[:-1], raw.offsets[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), list_array(pa.array(ids), count), pa.array(count), pa.array(want), pa.array(same)], names=["doc_id", "ids", "n_pieces", "n_bytes", "lossless"])

    return docs.select(F.col(id_col), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("row_key"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, n_bytes long, lossless boolean")


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with text_col, the text that the piece ids spell; null ids give null, and bytes that aren't UTF-8 a replacement character."""
    blob = read_model(rows.sparkSession, model)

    @F.pandas_udf("string")
    def spell(column):
        import pandas as pd

        pieces = load(blob.value, THETA)
        out = []
        for ids in column:
            if ids is None:
                out.append(None)
                continue
            ids = np.asarray(ids, dtype=np.int64)
            data, _ = pieces.decode(ids, np.array([len(ids)]))
            out.append(data.tobytes().decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return rows.withColumn(text_col, spell(F.col(ids_col)))
