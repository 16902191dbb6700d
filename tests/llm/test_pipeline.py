import random
from collections import Counter

import pytest
from texts import prose

import corpus_pipeline
from lexigraph.llm import sentencepiece_sampling


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("corpus"))
    item, passage, base = prose(rng, 30), prose(rng, 70), prose(rng, 200)
    rows = {i: prose(rng, 120) for i in range(60)}
    words = base.split()
    words[50] = "changed"
    rows |= {100: base, 101: base, 102: " ".join(words)}  # copies
    rows |= {110: f"{prose(rng, 80)} {passage} {prose(rng, 80)}", 111: f"{prose(rng, 90)} {passage}"}  # a passage that repeats
    rows |= {120: f"{prose(rng, 60)} {item} {prose(rng, 60)}"}  # a leak
    rows |= {130: "123 ... !!!", 131: ""}  # no language
    spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, passage


def test_each_stage_takes_effect(spark, folder, tmp_path):
    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, gone = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        gone[name] = set(before) - set(after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "passage_dedup":
            assert passage in after[110]["text"] and passage not in after[111]["text"] and after[111]["n_chars"] == len(after[111]["text"])
            assert {i for i in after if after[i]["text"] != before[i]["text"]} == {111}
    assert gone == {"language_id": {130, 131}, "near_dedup": {101, 102}, "passage_dedup": set(), "decontaminate": {120}, "encode": set()}
    assert all(r["lossless"] for r in docs.collect())


def test_run_equals_its_stages(spark, folder):
    d, rows, _ = folder
    got = corpus_pipeline.run(spark, d)
    assert len({r["doc_id"] for r in got.collect()}) == len(rows) - 5 == got.count()
    text = {r["doc_id"]: r["text"] for r in sentencepiece_sampling.decode(got).collect()}
    assert all(text[i] == rows[i] for i in text if i != 111)


def test_edge_cases(spark, nasty, tmp_path):
    plain = nasty.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter([None, 5, 6, 7, 9, 10])
    plain.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def runs(words, n):
    return {tuple(words[p : p + n]) for p in range(len(words) - n + 1)}


def test_run_equals_brute_force(spark, tmp_path):
    """All stages over a random corpus against loops over all pairs of documents, windows and items."""
    from test_dedup import cut_by_brute_force, groups_by_brute_force

    from lexigraph.llm import langid, simhash

    rng = random.Random(21)
    items = [prose(rng, 20) for _ in range(4)]
    passages = [prose(rng, 70) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = [prose(rng, rng.randrange(40, 120))]
        if i % 4 == 0:
            parts += [rng.choice(passages), prose(rng, 30)]
        if i % 11 == 0:
            parts += [rng.choice(items), prose(rng, 20)]
        rows.append((3 * i, " ".join(parts)))
    for i in range(0, 90, 7):  # copies and near copies
        words = rows[i][1].split()
        words[5] = "changed"
        rows += [(3 * i + 1, rows[i][1]), (3 * i + 2, " ".join(words))]
    rows += [(1000, "123 !"), (1001, "Съешь ещё этих мягких французских булок да выпей чаю " * 6), (1002, "")]
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, ("en", "de")[i % 2] if i < 1000 else None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    model = langid.train(docs)
    known = {r["doc_id"] for r in langid.identify(docs, model).where("predicted <> 'und'").collect()}
    left = [(i, t) for i, t in rows if i in known]
    prints = [(r["doc_id"], r["f1"], r["f2"]) for r in simhash.simhash(docs).collect() if r["doc_id"] in known]
    gone = {i for group in groups_by_brute_force(prints) for i in group if i != min(group)}
    left, _ = cut_by_brute_force([(i, t) for i, t in left if i not in gone], 50)
    leaks = [runs(x.lower().split(), 8) for x in items]
    want = {i: t.split() for i, t in left.items() if not any(runs(t.lower().split(), 8) & x for x in leaks)}
    got = corpus_pipeline.run(spark, d)
    text = {r["doc_id"]: r["text"].split() for r in sentencepiece_sampling.decode(got).collect()}
    assert text == want and all(r["lossless"] for r in got.collect())
    assert known == {i for i, _ in rows} - {1000, 1001, 1002} and len(gone) >= 20 and 10 < len(want) < len(rows) - len(gone) - 5
