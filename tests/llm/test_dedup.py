from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from texts import prose

from lexigraph.llm import simhash, suffix_dedup
from lexigraph.llm.textops import Lookup, RollingHash, Texts, key_buckets, slices


def texts_of(strings):
    return next(slices(pa.array(strings)))[2]


def test_words_and_hashes():
    t = texts_of(["One two", "", None, "two ONE,two", "é e"])
    w = t.words()
    assert np.diff(w.first).tolist() == [2, 0, 0, 3, 2]
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[5] != h[6]
    assert len(next(slices(pa.array([], pa.string())), ((0, 0, Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64)))))[2]) == 0


def test_rolling_hash_equals_by_content():
    r = RollingHash(np.array([1, 2, 3, 1, 2, 3, 1], dtype=np.uint64))
    s, e = np.array([0, 3, 1, 4]), np.array([3, 6, 4, 7])
    h = r(s, e)
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    look = Lookup(keys)
    assert (look(keys) == np.arange(len(keys))).all() and (look(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


@pytest.mark.parametrize("bits, depth, reach", [(5, 3, 1), (8, 3, 1), (9, 5, 2), (10, 4, 3)])
def test_vantage_tree_prunes_only_what_is_out_of_reach(bits, depth, reach):
    assert sorted(simhash.ball(bits, reach)) == [x for x in range(1 << bits) if x.bit_count() <= reach]
    values = np.arange(1 << bits)
    t = simhash.VantageTree(bits, depth)
    home, asked = np.full(len(values), -1), np.zeros((len(values), t.shards), dtype=bool)
    for shard, rows in t.visit(values, 0):
        assert (home[rows] == -1).all()
        home[rows] = shard
    for shard, rows in t.visit(values, reach):
        asked[rows, shard] = True
    assert set(home) == set(range(t.shards)) and t.shards == 1 << depth
    for v in values:
        assert asked[v, home[v ^ simhash.ball(bits, reach)]].all()


def near_prints(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, (n, 2))
    rows = [tuple(map(int, b)) for b in base]
    for b in base[: n // 2]:
        for flips in (1, 5, 10, 11, 12, 14):
            x = [int(b[0]), int(b[1])]
            for bit in rng.choice(64, flips, replace=False):
                x[0] ^= int(np.int64(np.uint64(1) << np.uint64(bit)))
            rows.append(tuple(x))
    return [(i, *r) for i, r in enumerate(dict.fromkeys(rows))]


@pytest.mark.parametrize("rows_from, shard_rows", [((0, 1 << 40, 1 << 40), 1 << 18), ((0, 0, 1 << 40), 40), ((0, 0, 1 << 40), 1 << 18)])
def test_near_pairs_are_all_pairs(spark, monkeypatch, rows_from, shard_rows):
    """Whatever the layout of blocks and the size of shards."""
    monkeypatch.setattr(simhash, "LAYOUTS", tuple((n, bits) for n, (_, bits) in zip(rows_from, simhash.LAYOUTS)))
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rows = near_prints(1, 60)
    want = {(a, b) for a, x1, x2 in rows for b, y1, y2 in rows if a < b and (x1 ^ y1).bit_count() <= simhash.RADIUS and (x1 & (2**64 - 1) ^ y1 & (2**64 - 1)).bit_count() <= simhash.RADIUS}
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    want = {(a, b) for a, x1, x2 in rows for b, y1, y2 in rows if a < b and bits(x1, y1) <= simhash.RADIUS and bits(x1, y1) + bits(x2, y2) <= simhash.TOTAL}
    got = simhash.near_pairs(spark.createDataFrame(rows, "id long, f1 long, f2 long")).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]) for r in got} == want and len(want) > 100


@pytest.mark.parametrize("bits", [bits for _, bits in simhash.LAYOUTS])
def test_search_of_each_layout(bits):
    rows = np.array(near_prints(2, 80), dtype=np.int64).view(np.uint64)
    reach, found = simhash.RADIUS // len(bits), []
    for b in range(len(bits)):
        for x, y, d in simhash._search(bits, reach, b, rows, rows):
            found += list(zip(x.tolist(), y.tolist(), d.tolist()))
    near = np.bitwise_count(rows[:, 1][:, None] ^ rows[:, 1])
    both = near + np.bitwise_count(rows[:, 2][:, None] ^ rows[:, 2])
    want = {(int(i), int(j), int(near[i, j])) for i, j in zip(*np.nonzero((near <= simhash.RADIUS) & (both <= simhash.TOTAL))) if i < j}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100 and sum(bits) == 64


def groups_by_brute_force(rows):
    """Connected components over all pairs of fingerprints."""
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    m = 2**64 - 1
    for a, x1, x2 in rows:
        for b, y1, y2 in rows:
            d = ((x1 ^ y1) & m).bit_count()
            if a < b and d <= simhash.RADIUS and d + ((x2 ^ y2) & m).bit_count() <= simhash.TOTAL:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = defaultdict(list)
    for i in parent:
        out[find(i)].append(i)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def corpus(spark, rng):
    rows = []
    for k in range(40):
        text = prose(rng, rng.choice([30, 80, 200]))
        rows.append((len(rows), text))
        words = text.split()
        if k % 4 == 0:
            for _ in range(3):
                w = list(words)
                w[rng.randrange(len(w))] = "changed"
                rows.append((len(rows), " ".join(w)))
        if k % 5 == 0:
            rows += [(len(rows) + j, text) for j in range(2)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicate_groups(spark, rng):
    docs = corpus(spark, rng)
    prints = [(r["doc_id"], r["f1"], r["f2"]) for r in simhash.simhash(docs).collect()]
    want = groups_by_brute_force(prints)
    got = defaultdict(set)
    rows = simhash.near_duplicate_groups(docs).collect()
    for r in rows:
        got[r["group_id"]].add(r["doc_id"])
        assert r["keep"] == (r["doc_id"] == r["group_id"])
    assert {frozenset(v) for v in got.values()} == want and all(min(v) == k for k, v in got.items()) and len(want) >= 10
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {r[0] for r in prints} - {r["doc_id"] for r in rows if not r["keep"]}


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 100)]
    got = {r["id"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 200: 100}


def test_simhash_edge_cases(nasty, nothing, spark):
    rows = {r["doc_id"]: r for r in simhash.near_duplicate_groups(nasty).collect()}
    assert set(rows) == {6, 7, 8} and rows[8]["group_id"] == 7 and rows[6]["keep"]
    kept = simhash.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", *map(str, (1, 2, 3, 4, 5, 6, 7, 9, 10))])
    assert simhash.near_duplicate_groups(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def repeats_by_brute_force(rows, n):
    where = defaultdict(set)
    words = {i: t.lower().split() for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - n + 1):
            where[tuple(w[p : p + n])].add((i, p))
    out = set()
    for i, w in words.items():
        hit = [p for p in range(len(w) - n + 1) if len({d for d, _ in where[tuple(w[p : p + n])]}) > 1]
        start = None
        for k, p in enumerate(hit):
            if start is None:
                start = p
            if k + 1 == len(hit) or hit[k + 1] - p > n:
                out.add((i, start, p + n))
                start = None
    return out


@pytest.mark.parametrize("n", [4, 12, 50])
def test_repeated_passages(spark, rng, n):
    shared = [prose(rng, n + k) for k in (0, 1, 30)]
    rows = []
    for i in range(30):
        parts = [prose(rng, rng.randrange(2 * n))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(1, 2 * n))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, shared[0].upper()), (102, " ".join(shared[0].split()[:-1])), (103, (prose(rng, n) + " ") * 3)]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=n).collect()}
    assert got == repeats_by_brute_force(rows, n) and got and 103 not in {d for d, _, _ in got}


def test_covers_have_every_difference():
    for v, members in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))


def test_cutting_leaves_one_occurrence(spark, rng):
    p, q = prose(rng, 60), prose(rng, 55)
    rows = [(1, f"alpha one\n{p} omega"), (2, f"beta {p}\nend {q}"), (3, f"{q}"), (4, "clean and short"), (5, p)]
    docs = spark.createDataFrame([(*r, "x", len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in suffix_dedup.drop_repeated_passages(docs).collect()}
    assert set(got) == {1, 2, 4} and got[1]["text"] == rows[0][1] and got[4]["text"] == rows[3][1]
    assert got[2]["text"] == f"beta end {q}" and got[2]["n_chars"] == len(got[2]["text"])
    assert not suffix_dedup.repeated_passages(suffix_dedup.drop_repeated_passages(docs)).count()


def test_suffix_edge_cases(nasty, nothing):
    assert suffix_dedup.repeated_passages(nasty).count() == 0
    kept = suffix_dedup.drop_repeated_passages(nasty)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 1
    doubled = nasty.unionByName(nasty.where("doc_id = 5").withColumn("doc_id", nasty["doc_id"] + 100))
    rows = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(doubled).collect()}
    assert set(rows) == {5, 105} and rows[5]["n_words"] == 30_000
    assert {r["doc_id"] for r in suffix_dedup.drop_repeated_passages(doubled).where("doc_id > 4").select("doc_id").collect()} == {5, 6, 7, 8, 9, 10}
    assert suffix_dedup.repeated_passages(nothing).count() == 0 and suffix_dedup.drop_repeated_passages(nothing).count() == 0


def test_key_buckets_cover_their_range():
    k = np.array([0, 2**64 - 1, 2**63], dtype=np.uint64)
    assert key_buckets(k, 10).tolist() == [0, 9, 5]


def test_a_passage_of_many_documents_sends_one_suffix_a_task():
    rng = np.random.default_rng(1)
    key = np.concatenate([np.full(500, 77, dtype=np.uint64), rng.integers(1000, 2**63, 300).astype(np.uint64), np.full(9, 5, dtype=np.uint64)])
    doc = np.concatenate([rng.permutation(500), np.arange(300), np.full(9, 3)]).astype(np.int64)
    pos = np.arange(len(key)).astype(np.int64)
    batch = suffix_dedup._emit(4, [(key, doc, pos)]).to_pydict()
    keys = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in batch["keys"]])
    sure = np.concatenate([np.frombuffer(m, dtype=bool) for b, m in zip(batch["bucket"], batch["sure"]) if b < 4])
    assert (keys == 77).sum() == 1 and (keys == 5).sum() == 9 and len(keys) == 310 and sure.sum() == 1
    passed = sum(len(p) // 4 for b, p in zip(batch["bucket"], batch["places"]) if b >= 4)
    assert passed == 499


@pytest.mark.parametrize("flush", [1, 40])
def test_repeats_over_many_tasks_and_flushes(spark, rng, monkeypatch, flush):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "BLOCK", flush)
    hot = prose(rng, 15)
    rows = [(i, f"{prose(rng, rng.randrange(9))} {hot if i % 3 else ''} {prose(rng, rng.randrange(9))}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(docs, min_words=12).collect()}
    assert got == repeats_by_brute_force(rows, 12) and len(got) == 40
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeated_passages(docs, min_words=12).collect()}
    assert [i for i, t in kept.items() if hot in t] == [1]


def suffixes_by_brute_force(texts, depth):
    words = [t.lower().split() for t in texts]
    return sorted(tuple(x.encode() for x in w[p : p + depth]) for w in words for p in range(len(w) - depth + 1))


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("depth", [1, 3, 4, 9, 12, 25, 50])
def test_suffix_sort_is_lexicographic(rng, monkeypatch, depth, collide):
    if collide:  # nearly all hashes are equal
        real = RollingHash.__call__
        monkeypatch.setattr(RollingHash, "__call__", lambda self, s, e: real(self, s, e) % np.uint64(3))
    for vocabulary in (1, 2, 5, 40):
        texts = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(150))) for _ in range(10)]
        texts += texts[:3]
        at, new = suffix_dedup.suffix_sort(texts_of(texts).words(~suffix_dedup._WS), depth)
        flat = [w.encode() for t in texts for w in t.lower().split()]
        got = [tuple(flat[a : a + depth]) for a in at]
        assert got == suffixes_by_brute_force(texts, depth) and [bool(x) for x in new] == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_equal_hashes_make_no_repeat(spark, rng, monkeypatch):
    """Blocks and buckets compare words, so hashes that all collide change nothing."""
    real = RollingHash.__call__
    rows = [(i, prose(rng, 30)) for i in range(20)] + [(50, "a b c d e f g h"), (51, "x a b c d e f g y")]
    pieces = [(i, 0, np.frombuffer(t.encode(), dtype=np.uint8)) for i, t in rows]
    monkeypatch.setattr(RollingHash, "__call__", lambda self, s, e: real(self, s, e) % np.uint64(1))
    batch = pa.Table.from_batches([suffix_dedup._block(3, pieces, 5)])
    found = set()
    for b in set(batch["bucket"].to_pylist()):
        d, p, _ = suffix_dedup._bucket(batch.filter(pa.compute.equal(batch["bucket"], b)), 5)
        found |= set(zip(d.tolist(), p.tolist()))
    assert found == {(50, 0), (50, 1), (50, 2), (51, 1), (51, 2), (51, 3)}


def test_blocks_are_bounded_whatever_the_stretches(spark, rng, monkeypatch):
    """A suffix may bring all its words along, so words and bytes are what bounds a block; its pieces hold no more of their texts."""
    real = suffix_dedup._block

    def bounded(n, pieces, depth, *parts):
        texts = [bytes(x[2]) for x in pieces]
        assert all(x[2].base is None for x in pieces)
        assert sum(len(x.split()) for x in texts) < 2 * 400 and sum(map(len, texts)) <= 16 * 400 + max(map(len, texts))
        return real(n, pieces, depth, *parts)

    monkeypatch.setattr(suffix_dedup, "BLOCK", 400)
    monkeypatch.setattr(suffix_dedup, "_block", bounded)
    shared = [prose(rng, 50) for _ in range(60)] + [" ".join(f"{rng.random()}" * 9 for _ in range(50)) for _ in range(5)] + [prose(rng, 2000)]
    rows = [(i, t) for i, t in enumerate(shared + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == repeats_by_brute_force(rows, 50) and len(got) == 132


def test_parts_of_buckets(spark, rng, monkeypatch):
    """A part is sorted at a time, and what is found is the same however many there are."""
    pool = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(100 + i, f"x {t} y") for i, t in rows[::3]]
    pieces = [(i, 0, np.frombuffer(t.encode(), dtype=np.uint8)) for i, t in rows if len(t.split()) >= 3]
    sizes, real = [], suffix_dedup._part
    monkeypatch.setattr(suffix_dedup, "_part", lambda table, depth: sizes.append(len(table)) or real(table, depth))
    found = {}
    for parts in (1, 7):
        batch = pa.Table.from_batches([suffix_dedup._block(2, pieces[i::4], 3, parts) for i in range(4)])
        found[parts] = set()
        for b in set(batch["bucket"].to_pylist()):
            for d, p, least in zip(*suffix_dedup._bucket(batch.filter(pa.compute.equal(batch["bucket"], b)), 3)):
                found[parts].add((int(d), int(p), bool(least)))
    assert found[1] == found[7] and found[1] and len(sizes) > 10 and max(sizes) <= 4
    monkeypatch.setattr(suffix_dedup, "_part", real)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(docs, min_words=12).collect()}
    assert got == repeats_by_brute_force(rows, 12) and got


def cut_by_brute_force(rows, n):
    """Texts after cutting each window that isn't the least of its words, but for the words of windows that are."""
    where, words = defaultdict(list), {i: t.split() for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - n + 1):
            where[tuple(x.lower() for x in w[p : p + n])].append((i, p))
    cut, kept = defaultdict(set), defaultdict(set)
    for at in where.values():
        if len({i for i, _ in at}) > 1:
            for i, p in at:
                (kept if (i, p) == min(at) else cut)[i].update(range(p, p + n))
    out = {i: [x for k, x in enumerate(w) if k not in cut[i] or k in kept[i]] for i, w in words.items()}
    return {i: " ".join(w) for i, w in out.items() if w}, [k for k, at in where.items() if len({i for i, _ in at}) > 1]


def test_a_window_between_two_cut_ones_stays(spark):
    rows = [(1, "x1 a b c d x2"), (2, "y1 c d e f y2"), (5, "q1 a b c d e f q2"), (9, "z1 b c d e z2")]
    want, _ = cut_by_brute_force(rows, 4)
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=4).collect()}
    assert got == want and want[5] == "q1 b c d e q2" and want[9] == "z1 z2"


def test_cutting_equals_brute_force_and_keeps_each_window(spark, rng):
    pool = [f"w{k}" for k in range(12)]
    shared = [[rng.choice(pool) for _ in range(rng.randrange(6, 25))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = [f"own{i}"]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 3)
            w += s[a : a + rng.randrange(4, 20)] + [f"own{i}x{len(w)}"]
        rows.append((i, " ".join(w)))
    want, windows = cut_by_brute_force(rows, 6)
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=6).collect()}
    assert got == want and len(windows) > 50
    for w in windows:
        assert any(f" {' '.join(w)} " in f" {t} " for t in got.values())


def test_ids_of_any_type_and_texts_that_share_an_id(spark, rng):
    rows = [(f"doc-{i}", prose(rng, 60)) for i in range(6)]
    rows += [("doc-8", rows[1][1]), ("doc-9", f"start {rows[2][1]} end"), ("doc-0", prose(rng, 60)), ("doc-0", rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id string, text string, more map<string,int>")
    assert {(r["doc_id"], r["group_id"], r["keep"]) for r in simhash.near_duplicate_groups(docs).collect()} >= {("doc-1", "doc-1", True), ("doc-8", "doc-1", False)}
    near = simhash.drop_near_duplicates(docs)
    assert near.columns == docs.columns and sorted(str(r["doc_id"]) for r in near.collect()) == ["None", "doc-0", "doc-0", *[f"doc-{i}" for i in (1, 2, 3, 4, 5)]] + (["doc-9"] if near.where("doc_id = 'doc-9'").count() else [])
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(docs).collect()} == {("doc-1", 0, 60), ("doc-8", 0, 60), ("doc-2", 0, 60), ("doc-9", 1, 61)}
    kept = suffix_dedup.drop_repeated_passages(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.where("doc_id in ('doc-9', 'doc-8')").collect()} == {"doc-9": "start end"} and kept.where("doc_id = 'doc-0'").count() == 2
