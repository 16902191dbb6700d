import math
import re

import numpy as np
import pytest
from texts import prose

from lexigraph.llm import decontaminate


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, phrase=8, share=0.8, slack=1.25):
    out = {}
    for i, text in docs:
        w = words_of(text)
        for j, item in items:
            q = words_of(item)
            n = min(phrase, len(q))
            if i is None or j is None or not n:
                continue
            runs = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
            hit = {p + k for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in runs for k in range(n)}
            if hit:
                found = ("phrase", min(len(hit), len(q)), round(min(len(hit), len(q)) / len(q), 6))
            else:
                d = set(q)
                width = math.ceil(slack * len(q))
                best = max((len(d & set(w[p : p + width])) for p in range(len(w))), default=0)
                if len(d) < decontaminate.LEAST or best < math.ceil(share * len(d)):
                    continue
                found = ("proximity", best, round(best / len(d), 6))
            out[i, j] = max(out.get((i, j), ("", 0, 0)), found, key=lambda x: (x[0] == "phrase", x[1], x[2]))
    return out


def result(df):
    return {(r["doc_id"], r["item_id"]): (r["kind"], r["n_words"], r["coverage"]) for r in df.collect()}


def planted(rng):
    items = [(j, prose(rng, rng.choice([3, 8, 15, 40]))) for j in range(25)]
    docs = []
    for i in range(120):
        before, after = prose(rng, rng.randrange(60)), prose(rng, rng.randrange(60))
        words = items[rng.randrange(25)][1].split()
        kind = i % 6
        if kind == 0:  # whole
            pass
        elif kind == 1:  # part
            words = words[: max(1, len(words) // 2)]
        elif kind == 2:  # in another order
            rng.shuffle(words)
        elif kind == 3:  # with words between
            words = [x for w in words for x in ([w, "between"] if rng.random() < 0.2 else [w])]
        elif kind == 4:  # with words left out
            words = [w for w in words if rng.random() < 0.9]
        else:
            words = []
        docs.append((i, f"{before} {' '.join(words).upper()}! {after}"))
    return docs, items


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_phrases_and_windows(spark, rng, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "TERMS_LIMIT", limit)  # postings of all words, then of the items' words only
    docs, items = planted(rng)
    docs += [(200, items[0][1]), (200, items[1][1])]
    got = result(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    want = brute_force(docs, items)
    assert got == want and {k for k, *_ in want.values()} == {"phrase", "proximity"}


def test_segments_keep_documents_apart(spark):
    item = " ".join(f"w{k}" for k in range(20))
    halves = [(1, " ".join(item.split()[:4])), (2, " ".join(item.split()[4:]))]
    got = result(decontaminate.contaminated(spark.createDataFrame(halves, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert got == brute_force(halves, [(1, item)]) and (1, 1) not in got


def test_drop(spark, rng):
    docs, items = planted(rng)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, item_id string")
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, _ in brute_force(docs, items)}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - bad and bad


def test_edge_cases(spark, nasty, nothing):
    items = [(1, None), (2, ""), (3, "!!!"), (None, "a short text"), (4, "a short text"), (4, "ties ties"), (5, "no such words here at all"), (6, "日本語")]
    bench = spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    assert result(decontaminate.contaminated(nasty, bench)) == brute_force(rows, items)
    kept = decontaminate.drop_contaminated(nasty, bench)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 5
    for docs, b in ((nothing, bench), (nasty, bench.limit(0)), (nothing, bench.limit(0))):
        assert decontaminate.contaminated(docs, b).count() == 0 and decontaminate.drop_contaminated(docs, b).count() == docs.count()


def test_postings_are_complete(spark, nasty):
    index = decontaminate.build_index(nasty).collect()
    got = sum(int(np.frombuffer(r["sizes"], dtype=np.uint32).sum()) for r in index)
    assert got == sum(len(words_of(r["text"])) for r in nasty.collect() if r["doc_id"] is not None)


def test_ids_of_any_type(spark, rng):
    item = prose(rng, 20)
    docs = spark.createDataFrame([("doc-1", f"{prose(rng, 30)} {item}"), ("doc-2", prose(rng, 40)), (None, item)], "doc_id string, text string")
    tests = spark.createDataFrame([("b", item), ("a", prose(rng, 15)), (None, item)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"], r["kind"], r["n_words"]) for r in decontaminate.contaminated(docs, tests).collect()] == [("doc-1", "b", "phrase", 20)]
    kept = decontaminate.drop_contaminated(docs, tests)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {"doc-2", None}
