import gzip
import json

import pytest
from mini import LANGUAGES, RECORDS, write
from pyspark.sql import functions as F

from lexigraph.operators import graph, ingest, trees
from lexigraph.plans.build import build
from lexigraph.plans.server import Reader, distinct_terms, item_ids
from lexigraph.sources import dump, sinks
from lexigraph.sources.langs import language_tables


@pytest.fixture(scope="module")
def langs(spark):
    return language_tables(spark, LANGUAGES)


@pytest.fixture(scope="module")
def snapshot(spark, langs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    return build(spark, write(folder / "mini.jsonl"), langs, cache_path=str(folder / "cache"))


@pytest.fixture(scope="module")
def named(snapshot, langs):
    rows = snapshot.items.join(langs.langs.select("lang_id", "code"), "lang_id").collect()
    return {r["item_id"]: (r["code"], r["term"], r["ety_num"]) for r in rows}


@pytest.fixture(scope="module")
def edges(snapshot, named):
    return {(named[r["child"]], named[r["parent"]], r["mode"], r["ord"], r["head"]) for r in snapshot.edges.collect()}


def test_language_ids_follow_sorted_codes(langs):
    codes = {r["code"]: r["lang_id"] for r in langs.codes.collect()}
    assert codes["ang"] == 0 and codes["eng"] == codes["en"]
    rows = {r["code"]: r for r in langs.langs.collect()}
    assert rows["la-vul"]["non_ety_id"] == codes["la"] and rows["en"]["ancestors"][-1] == codes["en"]
    assert rows["gmw-pro"]["url_name"] == "Proto-West_Germanic"


def test_items(named, snapshot):
    real = [r for r in snapshot.items.collect() if not r["is_imputed"]]
    assert sorted(r["item_id"] for r in snapshot.items.collect()) == list(range(snapshot.items.count()))
    by = {(named[r["item_id"]]): r for r in real}
    assert by["en", "land", 1]["pos"] == ["noun", "verb"] and ("en", "land", 2) in by
    # two root entries of one number stay apart
    assert ("ine-pro", "dʰeh₁-", 1) in by and ("ine-pro", "dʰeh₁-", 2) in by
    assert by["la", "rōmānicus", 1]["page_term"] == "romanicus" and by["la", "rōmānicus", 1]["romanization"] == "rr"
    assert not {t for _, t, _ in by} & {"a,b", "set phrase", "nothing"}


def test_edges(edges):
    plain = {(c[:2], p[:2], m) for c, p, m, _, _ in edges}
    assert (("en", "father"), ("enm", "fader"), "inherited") in plain
    assert (("enm", "fader"), ("ang", "fæder"), "inherited") in plain
    assert (("gem-pro", "fadēr"), ("ine-pro", "ph₂tḗr"), "inherited") in plain
    assert (("la", "pater"), ("ine-pro", "ph₂tḗr"), "borrowed") in plain
    assert (("en", "redo"), ("en", "re-"), "prefix") in plain and (("en", "redo"), ("en", "do"), "prefix") in plain
    assert (("en", "paternal"), ("la", "pater"), "suffix") in plain
    assert (("en", "happenin'"), ("en", "happening"), "form") in plain
    # the etymology-only language and the page term lead to the Latin entry, the redirect to Old French color
    assert (("en", "romanic"), ("la", "rōmānicus"), "derived") in plain
    assert (("en", "colour"), ("fro", "color"), "derived") in plain
    assert any(c == ("en", "do") and p == ("ine-pro", "dʰeh₁-") and m == "root" for c, p, m in plain)
    assert not any(c == ("en", "number") for c, _, _ in plain)  # a numeric argument is no term
    heads = {(c[1], p[1]) for c, p, _, _, h in edges if h}
    assert ("redo", "do") in heads and ("redo", "re-") not in heads and ("paternal", "pater") in heads
    assert not any(c[1] == "fatherland" and h for c, _, _, _, h in edges)


def test_imputed(named, snapshot, edges):
    imputed = [r for r in snapshot.items.collect() if r["is_imputed"]]
    assert {named[r["item_id"]][:2] for r in imputed} >= {("gmw-pro", "fader")}
    assert all(r["item_id"] > max(x["item_id"] for x in snapshot.items.where("not is_imputed").collect()) for r in imputed)
    # the chain through the imputed West Germanic word holds
    assert any(c[:2] == ("gmw-pro", "fader") and p[:2] == ("gem-pro", "fadēr") for c, p, _, _, _ in edges)


def test_no_cycle(snapshot, edges):
    loops = {c[1] for c, _, _, _, _ in edges} & {"loop", "luuppi"}
    assert len(loops) == 1
    assert graph.cyclic_core(snapshot.edges).isEmpty()


def test_reader(snapshot, spark, langs):
    reader = Reader(snapshot.tables())
    code = {r["code"]: r["lang_id"] for r in langs.codes.collect()}
    assert reader.answer("/search/lang?name=englsh")[0]["name"] == "English"
    hits = reader.answer(f"/search/item/{code['en']}?term=FATHER")
    assert [h["term"] for h in hits] == ["father", "fatherland"]
    tree = reader.answer(f"/etymology/{hits[0]['id']}")
    assert tree["item"]["term"] == "father" and tree["langDistance"] == 0 and tree["parents"][0]["item"]["term"] == "fader"
    top = tree
    while top["parents"]:
        top = top["parents"][0]
    assert top["item"]["term"] == "ph₂tḗr" and top["langDistance"] == 5 and top["item"]["reconstructed"]
    down = reader.answer(f"/descendants/{top['item']['id']}?descLang={code['en']}")
    found = json.dumps(down, ensure_ascii=False)
    assert '"father"' in found and '"faðir"' not in found and down["otherParents"] == []
    forest = reader.answer(f"/cognates/{hits[0]['id']}?descLang={code['non']}&descLang={code['la']}")
    assert len(forest) == 1 and '"faðir"' in json.dumps(forest, ensure_ascii=False)
    assert reader.answer(f"/search/item/999?term=a") == [] and reader.answer("/etymology/100000") is None
    assert item_ids(snapshot.items, langs.langs, "land", "English").count() == 2
    assert distinct_terms(snapshot.items, langs.langs).where("term = 'land'").count() == 2


def test_sinks(snapshot, spark, tmp_path):
    sinks.write_snapshot(snapshot.tables(), str(tmp_path / "s"))
    again = sinks.read_snapshot(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, again["edges"].collect())) == sorted(map(tuple, snapshot.edges.collect()))
    sinks.write_snapshot(snapshot.tables(), str(tmp_path / "j"), "json")
    loaded = sinks.read_snapshot(spark, str(tmp_path / "j"), {k: v.schema for k, v in snapshot.tables().items()})
    assert loaded["items"].count() == snapshot.items.count()
    records = trees.item_records(snapshot.items, snapshot.langs)
    blocks = sinks.turtle_blocks(records, snapshot.items.select("item_id", "page_term"), graph.immediate_ety(snapshot.edges), snapshot.progenitors)
    sinks.write_turtle(blocks, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.startswith("@prefix k:") and '  p:term "father" ;' in text and "p:isImputed true ;" in text


def test_dump_sources(spark, tmp_path, langs):
    path = tmp_path / "x.jsonl.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in RECORDS)
    lines = dump.read_lines(spark, str(path))
    rows = {r["line_no"]: json.loads(r["raw"]) for r in lines.collect()}
    assert [rows[k] for k in range(len(RECORDS))] == RECORDS
    (tmp_path / "req.csv").write_text("en,land\nla,pater\n")
    wanted = dump.requested_lines(lines, dump.read_requests(spark, str(tmp_path / "req.csv")))
    assert sorted(json.loads(r["raw"])["word"] for r in wanted.collect()) == ["land", "land", "land", "pater"]
    recon, plain = ingest.read_redirects(dump.parse(lines), langs)
    assert [(r["term"], r["to_term"]) for r in plain.collect()] == [("colur", "color")]
    assert [(r["term"], r["to_term"]) for r in recon.collect()] == [("old", "fadēr")]


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text("{no json\n")
    with pytest.raises(Exception):
        dump.parse(dump.read_lines(spark, str(tmp_path / "bad.jsonl"))).collect()


def test_stream(spark, langs, tmp_path):
    from lexigraph.streaming.ingest import append_entries

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl")
    run = lambda: append_entries(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), langs).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first > 20
    write(tmp_path / "in" / "b.jsonl")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * first
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("term") == "father").count() == 2
