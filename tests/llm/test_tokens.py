import heapq
from collections import Counter
from itertools import product

import numpy as np
import pytest

from lexigraph.llm import bpe, huffman, token_counts


@pytest.fixture(scope="module")
def encode():
    with open(bpe.RANKS, "rb") as f:
        return bpe.encoding(f.read()).encode_ordinary


def by_text(df, *columns):
    """Rows by (id, text), as a bag."""
    return Counter((r["doc_id"], *[r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("frequent, cache", [(0, 300_000), (20, 5), (20_000, 300_000)])
def test_token_counts(spark, nasty, encode, frequent, cache):
    want = Counter((r["doc_id"], len(encode(r["text"] or "")), len(bpe._exact(r["text"] or ""))) for r in nasty.collect())
    assert by_text(token_counts.token_counts(nasty.repartition(3), frequent=frequent, cache=cache), "n_tokens", "n_pretokens") == want


def test_frequent_pretokens_are_the_frequent_ones(spark):
    docs = spark.createDataFrame([(i, "common " * 30 + " often" * 20 + f" rare{i}x") for i in range(50)], "doc_id long, text string").repartition(7)
    assert token_counts.frequent_pretokens(docs, 2) == [" common", " often"]


def test_fast_pattern_equals_the_exact_one():
    parts = ["don't", " we'll", "A1", "_x", " é", "ÿ", "  ", "\n\n", "\t", "12", " !?", "×", "ª"]
    for words in product(parts, repeat=3):
        assert bpe.pretokens("".join(words)) == bpe._exact("".join(words))


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def limited_cost(counts, limit):
    """The least cost over all lengths up to limit that satisfy Kraft's inequality."""
    return min(sum(c * n for c, n in zip(counts, lengths)) for lengths in product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-n for n in lengths) <= 1)


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, 1000, 60) ** 2
        lengths = huffman.code_lengths(counts, 40)
        assert (counts * lengths).sum() == huffman_cost(counts.tolist()) and ((lengths > 0) == (counts > 0)).all()
    for limit in (3, 4):
        for _ in range(10):
            counts = rng.integers(1, 200, 6) ** 2
            lengths = huffman.code_lengths(counts, limit)
            assert lengths.max() <= limit and (counts * lengths).sum() == limited_cost(counts.tolist(), limit)
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1] and len(huffman.code_lengths(np.zeros(0, np.int64))) == 0


def test_codes_are_canonical_and_prefix_free():
    lengths = huffman.code_lengths(np.array([50, 1, 0, 20, 20, 3, 9]), 5)
    code = huffman.Code(lengths)
    words = [format(int(code.codes[i]), f"0{n}b") for i, n in enumerate(lengths) if n]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    in_order = sorted((int(n), i) for i, n in enumerate(lengths) if n)
    assert [w for _, w in sorted((int(lengths[i]), format(int(code.codes[i]), f"0{lengths[i]}b")) for _, i in in_order)] == [format(int(code.codes[i]), f"0{n}b") for n, i in in_order]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_any_block_decodes_by_itself(block):
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.05, 5000), 400).astype(np.int64)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids), 12))
    count = np.array([0, 1, 3000, 0, 1999])
    payloads, bits, marks, many = code.encode(ids, count, block)
    assert bits.sum() == code.lengths[ids].astype(int).sum()
    marks, rows = np.split(marks, np.cumsum(many)[:-1]), np.split(ids, np.cumsum(count)[:-1])
    for payload, starts, row in zip(payloads, marks, rows):
        assert (code.decode(payload, starts, len(row), block) == row).all()
        for k in range(len(starts)):
            part = row[k * block : (k + 1) * block]
            assert (code.decode(payload, starts[k : k + 1], len(part), block) == part).all()


def test_corpus_round_trip(spark, nasty, nothing, encode):
    tokens = huffman.token_ids(nasty)
    code = huffman.build_code(tokens)
    coded = huffman.encode_rows(tokens, code)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in huffman.decode_rows(coded, code).collect())
    assert got == Counter((r["doc_id"], tuple(encode(r["text"] or ""))) for r in nasty.collect())
    want = Counter((r["doc_id"], r["n_bits"], bytes(r["payload"])) for r in coded.collect())
    assert want == Counter((r["doc_id"], r["n_bits"], bytes(r["payload"])) for r in huffman.encode_corpus(nasty).collect())
    book = {r["id"]: r["length"] for r in code.frame(spark).collect()}
    assert sum(2.0**-n for n in book.values()) <= 1 and len(book) == len({i for r in nasty.collect() for i in encode(r["text"] or "")})
    assert huffman.encode_corpus(nothing).count() == 0 and token_counts.token_counts(nothing).count() == 0


def test_the_written_result_decodes_by_itself(spark, nasty, nothing, encode, tmp_path):
    """The query's own result, read back: every row's ids, by nothing but what was written."""
    from lexigraph.llm import queries

    tables = {"sf": spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "nasty": nasty, "nothing": nothing}
    for name, docs in tables.items():
        coded = queries.op8_token_binary(spark, "/root/testdata/sf0.001") if name == "sf" else huffman.encode_corpus(docs)
        coded.write.parquet(f"{tmp_path}/{name}")
        got = Counter((r["doc_id"], tuple(r["ids"])) for r in huffman.decode_corpus(spark.read.parquet(f"{tmp_path}/{name}")).collect())
        assert got == Counter((r["doc_id"], tuple(encode(r["text"] or ""))) for r in docs.collect())


def test_limits():
    assert huffman.code_lengths(np.ones(300, dtype=np.int64), 4).max() == 9  # 300 symbols need nine bits
    with pytest.raises(ValueError):
        huffman.Code(np.array([1, 26, 26], dtype=np.uint8))
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 20, 3000)
    lengths = np.zeros(1 << 20, dtype=np.uint8)
    lengths[np.unique(ids)] = huffman.code_lengths(np.bincount(ids)[np.unique(ids)], 25)
    code = huffman.Code(lengths)
    payloads, _, marks, _ = code.encode(ids, np.array([3000]), 100)
    assert (code.decode(payloads[0], marks, 3000, 100) == ids).all()


def test_pretokens_without_a_regular_expression(rng):
    import pyarrow as pa

    from lexigraph.llm.textops import slices

    parts = ["don't", " we'll", "'s", "'ve", "'", "'l", " '", "A1", "_x", " é", "ÿ", "  ", " ", "\n\n", "\t", "12", " !?", "ª", "日本", "𝒳", "\u3000", "\x1c", "\x00", ""]
    texts = ["".join(x) for x in product(parts, repeat=3)] + ["".join(rng.choice("a's tlver\n 1é.'") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for some in (texts, [""], ["", ""], ["'"], ["x'", "s"], ["'", "s"]):
        part = next(slices(pa.array(some), 1 << 40))[2]
        offsets, first = bpe.pretoken_offsets(part)
        words, at, same = bpe.pretoken_codes(part)
        assert [words[k].decode() for k in at] == [w for t in some for w in bpe._exact(t)] and (first == same).all()
        assert np.diff(first).tolist() == [len(bpe._exact(t)) for t in some] and offsets[-1] == len(part.data)
