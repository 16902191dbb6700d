import random

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import graph, trees

EDGES = "child long, parent long, ord int, head boolean, mode string, confidence double"


def made(spark, seed, n=60, second=0.2):
    """A random forest in which some items have a second parent."""
    rng = random.Random(seed)
    rows = []
    for k in range(4, n):
        for o in range(1 + (rng.random() < second)):
            rows.append((k, rng.randrange(max(0, k - 25), k), o, o == 0, "derived", 1.0))
    rows = list({(a, b): (a, b, *c) for a, b, *c in rows}.values())
    items = spark.createDataFrame([(k, rng.randrange(4), rng.choice("ab")) for k in range(n)], "item_id long, lang_id int, term string")
    return spark.createDataFrame(rows, EDGES), items, rows


@pytest.mark.parametrize("seed, second", [(1, 0.1), (2, 0.3)])
def test_sizes_of_cognates_equal_the_laid_out_forests(spark, seed, second):
    edges, items, _ = made(spark, seed, second=second)
    none = spark.createDataFrame([], "id long")
    admissible = trees.admissible_edges(edges, items, graph.descendant_langs(edges, items), [1, 3], none)
    starts = items.select(F.col("item_id").alias("id"))
    opened = graph.ancestors_in_langs(edges, items, starts, [1, 3])
    laid = trees.cognates_tree(edges, admissible, starts, opened).groupBy("of").agg(F.count("*").alias("n_nodes"), F.countDistinct("item_id").alias("n_items"), F.max("depth").alias("depth"))
    sizes = trees.cognates_sizes(edges, admissible, starts, items.where("lang_id in (1, 3)").select(F.col("item_id").alias("id")))
    want = sorted(map(tuple, laid.select("of", "n_nodes", "n_items", "depth").collect()))
    assert sorted(map(tuple, sizes.select("of", "n_nodes", "n_items", "depth").collect())) == want and len(want) > 10
    some = starts.where("id % 3 = 0")
    got = trees.cognates_sizes(edges, admissible, some, items.where("lang_id in (1, 3)").select(F.col("item_id").alias("id"))).select("of", "n_nodes", "n_items", "depth").collect()
    assert sorted(map(tuple, got)) == [w for w in want if w[0] % 3 == 0]


def test_places_equal_brute_force(spark):
    """Of all trees, laid out and measured node by node; the same from one tree and its edges."""
    edges, items, rows = made(spark, 3, n=40)
    term = {r["item_id"]: r["term"] for r in items.collect()}
    down = {}
    for a, b, o, *_ in rows:
        down.setdefault(b, []).append((a, o))

    def lay(root, path, item, place=1):
        kids = [(lay_size(a), a, o) for a, o in down.get(item, [])]
        kids.sort(key=lambda k: (k[0][2], k[0][0], k[0][1], [-ord(c) for c in term[k[1]]], f"{k[1]}:{k[2]}"))
        height, leaves, _ = lay_size(item)
        yield root, "/".join(path), item, height, leaves, place
        for nth, (_, a, o) in enumerate(kids, 1):
            yield from lay(root, [*path, f"{a}:{o}"], a, nth)

    def lay_size(item):
        kids = [lay_size(a) for a, _ in down.get(item, [])]
        return max((k[0] + 1 for k in kids), default=0), sum(k[1] for k in kids) or 1, item == 20 or any(k[2] for k in kids)

    want = sorted(x for k in range(40) for x in lay(k, [str(k)], k))
    starts = items.select(F.col("item_id").alias("id"))
    shown = lambda df: sorted(map(tuple, df.select("root", F.concat_ws("/", "path"), "item_id", "height", "leaves", "place").collect()))
    assert shown(trees.sorted_descendants_tree(edges, starts, items, 20)) == want
    one = starts.where("id = 2")
    assert shown(trees.sort_descendants(trees.descendants_tree(edges, one), items, 20, edges)) == [w for w in want if w[0] == 2]


def test_rounds_send_no_graph_through_the_driver(spark, monkeypatch):
    """A step is joined by shuffling, whatever its size; only few rows of a round are broadcast."""
    plans = []
    write = type(spark.range(1).write).parquet

    def spy(self, path, *args, **kw):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, path, *args, **kw)

    edges, items, _ = made(spark, 4)
    monkeypatch.setattr(type(spark.range(1).write), "parquet", spy)
    starts = items.select(F.col("item_id").alias("id"))
    for few in (0, 10_000):
        monkeypatch.setattr(graph, "FEW", few)
        plans.clear()
        n = graph.ancestor_edges(edges, starts).count()
        joins = [line for p in plans for line in p.splitlines() if "Join" in line]
        assert n > 60 and joins and all("strategy=merge" in j if not few else "leftHint" in j and "rightHint" not in j for j in joins)
