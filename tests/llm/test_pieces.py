from collections import Counter

import numpy as np
import pytest

from lexigraph.llm import sentencepiece_sampling as sp


@pytest.fixture(scope="module")
def pieces():
    with open(sp.MODEL, "rb") as f:
        return sp.load(f.read(), 1.0)


def segmentations(pieces, vocabulary, text):
    """Every segmentation of a text and its probability."""
    done = {(): (0, 1.0)}
    out = {}
    while done:
        (ids, (at, p)), *_ = done.items()
        del done[ids]
        if at == len(text):
            out[ids] = p
            continue
        for k in range(1, pieces.longest + 1):
            if at + k <= len(text) and (i := vocabulary.get(text[at : at + k])) is not None:
                done[(*ids, i)] = (at + k, p * pieces.probability[i])
    total = sum(out.values())
    return {ids: p / total for ids, p in out.items()}


def test_samples_follow_the_lattice(pieces):
    import sentencepiece

    with open(sp.MODEL, "rb") as f:
        model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    vocabulary = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    text, n = "the cat", 20_000
    want = segmentations(pieces, vocabulary, "▁the▁cat")
    ids, count = sp.sample(pieces, [text] * n, np.arange(n), 3)
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1]))
    assert set(got) <= set(want) and len(want) > 20
    worst = max(abs(got[s] / n - p) for s, p in want.items())
    assert worst < 4 * np.sqrt(0.25 / n)


def test_a_row_depends_on_its_text_key_and_seed_alone(spark):
    rows = [(i, f"some text {i % 5} to be cut into pieces") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["ids"] for r in sp.encode(df.coalesce(1)).collect()}
    assert one == {r["doc_id"]: r["ids"] for r in sp.encode(df.repartition(7)).collect()}
    assert len({tuple(x) for x in one.values()}) > 30
    other = {r["doc_id"]: r["ids"] for r in sp.encode(df, seed=1).collect()}
    assert sum(one[k] != other[k] for k in one) > 20


def test_round_trip(nasty, nothing):
    coded = sp.encode(nasty)
    rows = coded.collect()
    assert len(rows) == nasty.count() and all(r["lossless"] and len(r["ids"]) == r["n_pieces"] for r in rows)
    back = Counter((r["doc_id"], r["text"]) for r in sp.decode(coded).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in nasty.collect())
    assert sp.encode(nothing).count() == 0 and sp.decode(sp.encode(nothing)).count() == 0


def test_signs_the_vocabulary_lacks(spark):
    texts = ["▁", " ▁ ▁▁", "  two  spaces  ", "\ttab\nline\r\n", "𝔘𝔫𝔦 👩‍👩‍👧 ☃", "\x00\x7f", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 3000, "ᄒ" * 500]
    rows = sp.decode(sp.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(texts)) and all(r["lossless"] for r in rows)


def test_decode_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sp.decode(df).collect()} == {1: None, 2: ""}
