import random

import numpy as np
import pyarrow as pa
import pytest
from texts import prose

from lexigraph.llm import langid
from lexigraph.llm.textops import slices

SYLLABLES = {"en": "th ing er ed ou wh ly ble".split(), "de": "sch ung lich keit ein ä ö ß".split(), "nl": "sch ij oe aar lijk een heid zou".split(), "fr": "eau oi que ment é è ch eux".split(), "es": "ción ado mente ñ ll os rr ía".split()}


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.choice([8, 40, 200]))), lang))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1, 600)
    return langid.train_on([r[1] for r in rows], [r[2] for r in rows])


def test_levels(model):
    assert {(k, a, b) for k, a, b in model.machines} == {("family", "germanic", "romance"), ("lang", "de", "en"), ("lang", "de", "nl"), ("lang", "en", "nl"), ("lang", "es", "fr")}


def test_held_out_accuracy(spark, model):
    rows = corpus(2, 400)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i]["predicted"] == lang for i, _, lang in rows]) > 0.98
    assert all(langid.family(r["predicted"]) == r["family"] for r in got.values())


def test_scores_equal_the_weights_of_the_features(model):
    _, _, texts = next(slices(pa.array([corpus(3, 1)[0][1], "Ab", "", "x1y", "déjà vu"])))
    scores, some = model.scores(texts)
    assert np.allclose(scores, langid.features(texts) @ model.table + model.offset, atol=1e-3) and some.tolist() == [True, True, False, True, True]


def test_training_rows_are_bounded(spark):
    df = spark.createDataFrame(corpus(4, 300), "doc_id long, text string, lang string")
    small, again = langid.train(df, per_lang=20), langid.train(df.repartition(5), per_lang=20)
    assert small.langs == sorted(SYLLABLES) and np.array_equal(small.table, again.table)


def test_edge_cases(spark, model, nasty, nothing):
    rows = langid.identify(nasty, model).collect()
    assert len(rows) == nasty.count()
    got = {r["doc_id"]: r["predicted"] for r in rows if r["doc_id"] is not None}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and "und" not in [got[i] for i in (5, 6, 9, 10)]
    kept = langid.keep_identified(nasty, model)
    assert kept.schema == nasty.schema and kept.count() == nasty.count() - 5
    assert langid.identify(nothing, model).count() == 0 and langid.keep_identified(nothing, model).count() == 0
    untaught = langid.train(nothing)
    assert {r["predicted"] for r in langid.identify(nasty, untaught).collect()} == {"und"}
    one = langid.train_on([prose(random.Random(1), 50)] * 3, ["en"] * 3)
    assert {r["predicted"] for r in langid.identify(nasty.where("doc_id = 6"), one).collect()} == {"en"}
    assert langid.train(nasty).langs == ["de", "en", "fr"]


def test_languages_that_were_not_learned(spark, model):
    """Texts of other scripts are rejected if long enough to tell; no text of a learned language is, however short."""
    rng = random.Random(8)
    other = [" ".join("".join(rng.choices(letters, k=5)) for _ in range(20)) for letters in ("абвгдежзиклмнопрстуя", "今天天气很好我们去公园散步然后回家吃饭", "αβγδεζηθικλμνοπρστυω")]
    own = [r[1] for r in corpus(9, 100)] + [r[1][:12] for r in corpus(10, 100)]
    df = spark.createDataFrame(list(enumerate(other + own)), "doc_id long, text string")
    assert {r["doc_id"] for r in langid.identify(df, model).where("predicted = 'und' and family is null and margin = 0").collect()} == {0, 1, 2}
    assert {r["doc_id"] for r in langid.keep_identified(df, model).collect()} == set(range(3, 203))


def votes_by_brute_force(model, text):
    """The language by one loop over n-grams, machines and votes."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    letter = [97 <= b <= 122 or b >= 128 for b in data]
    data = bytes(b if ok else 32 for b, ok in zip(data, letter))
    if not any(letter):
        return None, 0.0
    total, count = [0.0] * len(model.machines), 0
    for n in langid.ORDERS:
        for i in range(len(data) - n + 1):
            if letter[i] or (i + 1 < len(data) and letter[i + 1]):
                code = int.from_bytes(data[i : i + n], "big")
                bucket = ((code + (n << 40)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - langid.BITS
                count += 1
                for m in range(len(model.machines)):
                    total[m] += float(model.table[bucket, m])
    scores = [t / max(count, 1) + o for t, o in zip(total, model.offset)]

    def vote(level, names):
        won, least = {x: 0 for x in names}, {x: float("inf") for x in names}
        for (kind, a, b), s in zip(model.machines, scores):
            if kind == level and a in names and b in names:
                won[a if s > 0 else b] += s != 0
                least[a], least[b] = min(least[a], s), min(least[b], -s)
        best = max(names, key=lambda x: (won[x], 0 if least[x] == float("inf") else least[x]))
        return best, least[best]

    fam, first = vote("family", model.families)
    lang, second = vote("lang", [x for x in model.langs if langid.family(x) == fam])
    margin = min(first, second)
    return lang, 0.0 if margin == float("inf") else margin


def test_votes_equal_brute_force(spark, model):
    rows = [r[1] for r in corpus(12, 60)] + [r[1][:15] for r in corpus(13, 40)] + ["", "12 34", "Aé x", "THE end"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(rows):
        lang, margin = votes_by_brute_force(model, text)
        assert got[i]["predicted"] == (lang or "und") and abs(got[i]["margin"] - margin) < 1e-4, (text, got[i], lang, margin)
