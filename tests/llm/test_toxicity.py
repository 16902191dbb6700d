import random
from itertools import combinations

import numpy as np
import pytest
from texts import prose

from lexigraph.llm import toxicity

INSULTS = ["snarfblat", "gribnok", "zumple", "wretchit", "plonkard", "dwoozle"]
#: Clean words that hold a part of an insult.
NEAR = ["grib", "nok", "zum", "wretch", "plonk", "snarf", "doozle"]


def kernel_by_enumeration(s, t):
    total = 0.0
    for n in toxicity.ORDERS:
        for i in combinations(range(len(s)), n):
            for j in combinations(range(len(t)), n):
                if all(s[a] == t[b] for a, b in zip(i, j)):
                    total += toxicity.DECAY ** ((i[-1] - i[0] + 1 - n) + (j[-1] - j[0] + 1 - n))
    return total


def test_kernel():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    got = toxicity.subsequence_kernel(toxicity.pad_strings(words), toxicity.pad_strings(words[::-1]))
    assert np.allclose(got, [kernel_by_enumeration(a, b) for a, b in zip(words, words[::-1])], rtol=1e-4)


def labelled(rng, n):
    texts, toxic = [], []
    for k in range(n):
        words = prose(rng, rng.choice([15, 60])).split()
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        elif k % 4 == 1:
            words.insert(rng.randrange(len(words)), rng.choice(NEAR))
        texts.append(" ".join(words))
        toxic.append(k % 4 == 0)
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model():
    return toxicity.train_on(*labelled(random.Random(2), 600))


def found(spark, model, texts):
    rows = toxicity.toxic_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return {r["doc_id"] for r in rows}


def test_held_out(spark, model):
    texts, toxic = labelled(random.Random(3), 400)
    got = found(spark, model, texts)
    assert got == set(np.flatnonzero(toxic).tolist())


def test_gaps_and_inserted_characters(spark, model):
    rng = random.Random(4)
    forms = {
        "upper": str.upper,
        "dots": ".".join,
        "spaces": " ".join,
        "dash": lambda w: w[:3] + "-" + w[3:],
        "inserted": lambda w: w[: (k := rng.randrange(1, len(w)))] + rng.choice("qxkj") + w[k:],
        "doubled": lambda w: w[: (k := rng.randrange(1, len(w)))] + w[k] + w[k:],
    }
    for name, change in forms.items():
        texts = []
        for k in range(48):
            words = prose(rng, 30).split()
            words.insert(rng.randrange(len(words)), change(INSULTS[k % 6]))
            texts.append(" ".join(words))
        assert len(found(spark, model, texts)) >= 46, name
    assert not found(spark, model, [f"the {w} of it" for w in NEAR])


def test_insults_cut_by_spaces(spark, model):
    """Two to four pieces of any length are one word; pieces of two sentences, and clean neighbours, are not."""
    rng = random.Random(6)
    for pieces in (2, 3, 4):
        texts = []
        for k in range(48):
            word, words = INSULTS[k % 6], prose(rng, 30).split()
            cuts = [0, *sorted(rng.sample(range(1, len(word)), pieces - 1)), len(word)]
            words.insert(rng.randrange(len(words)), " ".join(word[a:b] for a, b in zip(cuts, cuts[1:])))
            texts.append(" ".join(words))
        assert len(found(spark, model, texts)) == 48, pieces
    assert found(spark, model, ["You zum! Ple is here.", "a grib\nnok of it", "the zu mple of it", "so GRIB. nok", "the gr ib no k"]) == {2, 4}
    assert not found(spark, model, [prose(rng, 2000)])


@pytest.mark.parametrize("insult", ["vog", "zq"])
def test_short_insults(spark, insult):
    rng = random.Random(7)
    texts = [prose(rng, 30).split() for _ in range(400)]
    for words in texts[::4]:
        words.insert(rng.randrange(len(words)), insult)
    taught = toxicity.train_on([" ".join(w) for w in texts], np.arange(400) % 4 == 0)
    assert found(spark, taught, [f"you {insult} of it", f"you {insult.upper()}!", "you dog of it", "all is well"]) == {0, 1}


def test_sentences_are_counted(spark, model):
    df = spark.createDataFrame([(1, "All is well. You zumple! Indeed."), (2, "All is well.")], "doc_id long, text string")
    rows = toxicity.toxic_documents(df, model).collect()
    assert [(r["doc_id"], r["n_toxic"], r["n_sentences"]) for r in rows] == [(1, 1, 3)] and rows[0]["score"] > 0


def test_edge_cases(spark, model, nasty, nothing):
    assert toxicity.toxic_documents(nasty, model).count() == 0
    assert toxicity.toxic_documents(nothing, model).count() == 0
    labels = spark.createDataFrame([(6, 1, "e"), (7, 0, "e"), (None, 1, "e"), (8, None, "e")], "doc_id long, toxic int, words string")
    for docs, lab in ((nasty, labels), (nothing, labels), (nasty, labels.limit(0))):
        untaught = toxicity.train(docs, lab)
        assert toxicity.toxic_documents(nasty, untaught).count() == 0
    long = spark.createDataFrame([(None, prose(random.Random(5), 20_000) + " gribnok")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.toxic_documents(long, model).collect()] == [None]
