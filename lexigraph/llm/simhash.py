"""SimHash near-duplicate search with vantage-point trees.

A document's fingerprint has 128 bits over its distinct words: 64 to search by
and 64 more to confirm.  Two fingerprints are near when the search halves are
within RADIUS and all 128 bits within TOTAL.

The search is exact.  A vantage-point tree on a whole 64-bit half would hardly
prune: distances to any vantage point lie within a few bits of 32.  So the half
is cut into blocks, fewer and wider ones for more rows; two near fingerprints
lie within RADIUS // blocks of each other in at least one block, and the Hamming
distance within a block obeys the triangle inequality too.  Each block has a
vantage-point tree over its value space, as deep as the rows need for shards of
a bounded size.  A fingerprint is stored in its home shard and sent as a query
to each shard that the triangle bound cannot exclude; more queries than a task
should hold go in several parts.  Within a shard the fingerprints whose block is
in reach are compared.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.textops import U64, keyed, longs, mix, numbered, slices, with_ids, written

RADIUS, TOTAL = 11, 22
#: Block widths from so many rows on: fewer and wider blocks leave fewer fingerprints to compare, and more values in reach to look up.
LAYOUTS = ((0, (11, 11, 11, 11, 10, 10)), (1 << 18, (16, 16, 16, 16)), (1 << 22, (22, 21, 21)))
#: Fingerprints that a shard stores, and queries that one of its parts holds, at most or so.
SHARD_ROWS = 1 << 18


def layout(rows: int) -> tuple[tuple[int, ...], int]:
    """(widths of the blocks, reach within a block) for so many fingerprints; the pairs found are the same for all."""
    bits = [bits for least, bits in LAYOUTS if rows >= least][-1]
    return bits, RADIUS // len(bits)


def _sums(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Column sums of the rows between consecutive entries of first."""
    total = np.zeros((len(first) - 1, bits.shape[1]), dtype=np.int32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full] = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    return total


def fingerprints(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search half, confirming half, distinct words) of n texts with these word hashes."""
    # one sort of a combined key makes a text's words distinct
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    first = np.searchsorted(t, np.arange(n + 1))
    count = np.diff(first)
    halves = []
    for salt in (0, 0xA24BAED4963EE407):
        bits = np.unpackbits(mix(h ^ U64(salt)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        up = _sums(bits, first) * 2 > count[:, None]
        halves.append(np.packbits(up, axis=1, bitorder="little").reshape(-1).view(U64))
    return halves[0], halves[1], count


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f1, f2, n_words) for each document with an id and at least one word; null, empty and wordless texts have no fingerprint."""

    def run(batches):
        for batch in batches:
            ids, there = longs(batch.column(0))
            for lo, hi, texts in slices(batch.column(1)):
                words = texts.words()
                f1, f2, n = fingerprints(words.hashes(), words.text_of(), hi - lo)
                ok = (n > 0) & there[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (ids[lo:hi], f1.view(np.int64), f2.view(np.int64), n.astype(np.int64))], names=["doc_id", "f1", "f2", "n_words"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, f1 long, f2 long, n_words long")


class VantageTree:
    """A vantage-point tree of this depth over all values of a block; its leaves are the shards, numbered from 0."""

    def __init__(self, bits: int, depth: int):
        self.nodes: list[tuple[int, int, int, int] | int] = []  # (vantage point, threshold, inner node, outer node), or a shard's number
        self.shards = 0
        self._grow(np.arange(1 << bits, dtype=np.int32), depth)

    def _grow(self, values: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(self.shards)
        if not depth or len(values) < 2:
            self.shards += 1
            return at
        vantage = int(values[0])
        d = np.bitwise_count(values ^ vantage)
        # the distance that splits most evenly
        upto = np.cumsum(np.bincount(d))[:-1]
        threshold = int(np.abs(2 * upto - len(values)).argmin())
        inner = d <= threshold
        self.nodes[at] = (vantage, threshold, self._grow(values[inner], depth - 1), self._grow(values[~inner], depth - 1))
        return at

    def visit(self, values: np.ndarray, reach: int, node: int = 0, rows: np.ndarray | None = None):
        """(shard, rows) for each shard that the triangle bound leaves for the balls of this reach around the values of some rows."""
        rows = np.arange(len(values)) if rows is None else rows
        if not len(rows):
            return
        here = self.nodes[node]
        if isinstance(here, int):
            yield here, rows
            return
        vantage, threshold, inner, outer = here
        d = np.bitwise_count(values[rows] ^ vantage).astype(np.int64)
        yield from self.visit(values, reach, inner, rows[d - reach <= threshold])
        yield from self.visit(values, reach, outer, rows[d + reach > threshold])


@cache
def tree(bits: int, depth: int) -> VantageTree:
    return VantageTree(bits, depth)


@cache
def ball(bits: int, reach: int) -> np.ndarray:
    """The differences of at most `reach` bits: a value's neighbours are its exclusive ors with them."""
    return np.array([sum(1 << k for k in some) for n in range(reach + 1) for some in combinations(range(bits), n)], dtype=np.int64)


def _block(f: np.ndarray, bits: tuple[int, ...], b: int) -> np.ndarray:
    return ((f >> U64(sum(bits[:b]))) & U64((1 << bits[b]) - 1)).astype(np.int64)


def _search(bits: tuple[int, ...], reach: int, b: int, stored: np.ndarray, asked: np.ndarray):
    """Near pairs (asked row, stored row) of the shard, each found in the first block where it is in reach; rows are (id, f1, f2)."""
    sv, av = _block(stored[:, 1], bits, b), _block(asked[:, 1], bits, b)
    so, ao = np.argsort(sv, kind="stable"), np.argsort(av, kind="stable")
    stored, asked, sv, av = stored[so], asked[ao], sv[so], av[ao]
    first = np.searchsorted(sv, np.arange((1 << bits[b]) + 1))
    apart = ball(bits[b], reach)
    values, begin = np.unique(av, return_index=True)
    ends = np.append(begin[1:], len(av))
    ids, prints = stored[:, 0].view(np.int64), stored[:, 1]
    for v, lo, hi in zip(values.tolist(), begin.tolist(), ends.tolist()):
        near = apart ^ v
        low = first[near]
        many = first[near + 1] - low
        some = np.flatnonzero(many)
        if not len(some):
            continue
        low, many = low[some], many[some]
        rows = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
        s1 = prints[rows]
        step = max(1, (1 << 20) // len(rows))
        for at in range(lo, hi, step):
            a = asked[at : min(hi, at + step)]
            q, r = np.nonzero(np.bitwise_count(a[:, 1][:, None] ^ s1) <= RADIUS)
            r = rows[r]
            ok = a[q, 0].view(np.int64) < ids[r]
            if not ok.any():
                continue
            x, y = a[q[ok]], stored[r[ok]]
            ok = np.bitwise_count(x[:, 1] ^ y[:, 1]) + np.bitwise_count(x[:, 2] ^ y[:, 2]) <= TOTAL
            for earlier in range(b):
                ok &= np.bitwise_count(_block(x[:, 1], bits, earlier) ^ _block(y[:, 1], bits, earlier)) > reach
            if ok.any():
                yield x[ok, 0].view(np.int64), y[ok, 0].view(np.int64), (np.bitwise_count(x[ok, 1] ^ y[ok, 1])).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[int]:
    """Which of these pairs join two trees of the forest in parent."""
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        while (p := parent.setdefault(y, y)) != y:
            parent[y] = parent[p]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def near_pairs(prints: DataFrame, forest: bool = False) -> DataFrame:
    """All near pairs (a, b, distance), a < b, of the fingerprints (id, f1, f2), which are read twice; ids must be distinct.

    With forest=True each shard returns only pairs that join two of its groups,
    so a group of thousands gives thousands of rows and not millions; the
    connected components are the same.
    """
    many = prints.count()
    bits, reach = layout(many)
    depth = max(2, (many // SHARD_ROWS).bit_length())
    rng = np.random.default_rng(0)
    # the share of all fingerprints that asks a shard decides into how many parts its queries go; what a shard stores goes to each part
    share = sum(len(rows) for _, rows in tree(bits[0], depth).visit(rng.integers(0, 1 << bits[0], 4096, dtype=np.int64), reach)) / 4096 / 2**depth
    parts = max(1, -(-int(many * share) // SHARD_ROWS))

    def route(batches):
        pending, size = [], 0

        def flush():
            rows = np.concatenate(pending)
            part = (mix(rows[:, 0]) % U64(parts)).astype(np.int64)
            for b, width in enumerate(bits):
                v = _block(rows[:, 1], bits, b)
                out = []
                for role, far in ((0, 0), (1, reach)):
                    for shard, some in tree(width, depth).visit(v, far):
                        for k in range(parts):
                            mine = some if role == 0 else some[part[some] == k]
                            if len(mine):
                                out.append((b, shard, k, role, rows[mine].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "shard", "part", "role", "rows"])

        for batch in batches:
            pending.append(np.stack([longs(c)[0].view(U64) for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= 100_000:
                yield from flush()
                pending, size = [], 0
        if size:
            yield from flush()

    def solve(key, table):
        rows = [np.frombuffer(x, dtype=U64).reshape(-1, 3) for x in table.column("rows").to_pylist()]
        role = table.column("role").to_pylist()
        stored, asked = (np.concatenate([r for r, k in zip(rows, role) if k == want] or [np.zeros((0, 3), dtype=U64)]) for want in (0, 1))
        parent: dict[int, int] = {}
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b, d in _search(bits, reach, key[0].as_py(), stored, asked):
            if forest:
                keep = _forest(a, b, parent)
                a, b, d = a[keep], b[keep], d[keep]
            out.append((a, b, d))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "distance"])

    routed = prints.select("id", "f1", "f2").mapInArrow(route, "block int, shard int, part int, role int, rows binary")
    return routed.groupBy("block", "shard", "part").applyInArrow(solve, "a long, b long, distance long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of the edges (a, b): root is the least id of its connected component.

    Alternates large-star and small-star steps; each halves chains, so rounds
    grow with the logarithm of a component's diameter.
    """
    edges = written(edges.select("a", "b").where("a <> b"))
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == state:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id").unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, group_id) of near_duplicate_groups, for ids that are longs."""
    prints = written(simhash(docs, id_col, text_col))
    distinct = written(prints.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # one document may carry two fingerprints if its id repeats; pairs are then between the fingerprints' own numbers
    roots = components(near_pairs(distinct, forest=True))
    labelled = distinct.join(roots, "id", "left").select("f1", "f2", F.coalesce("root", "id").alias("group_id"), "copies", F.col("root").isNotNull().alias("linked"))
    grouped = labelled.where("linked or copies > 1").select("f1", "f2", "group_id")
    return prints.join(grouped, ["f1", "f2"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, keep) for each document that has a near copy.

    group_id is the least doc_id of the group of documents linked by near
    pairs, and the document that carries it is the one to keep.  Documents
    without a copy, without an id or without a word are in no group.  A doc_id
    that occurs in several rows counts once for each distinct fingerprint.  Ids
    of any orderable type will do.
    """
    rows, own = numbered(docs.select(id_col, text_col), id_col)
    return own(_groups(rows, id_col, text_col), "doc_id", "group_id").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group (the least id).

    A document is an id with a text: rows that repeat both are one, and texts
    that share an id are several.  Rows without an id or a word stay.
    """
    rows, key, _ = keyed(docs, id_col, text_col)
    gone = written(_groups(rows.select(key, text_col), key, text_col).where("doc_id <> group_id").select(F.col("doc_id").alias(key)))
    return with_ids(rows, gone, key, "left_anti").select(*docs.columns)
