import random

from lexigraph.operators import graph


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "m", 0, True, 0.5) for a, b in pairs], "child long, parent long, mode string, ord int, head boolean, confidence double")


def kept(spark, pairs):
    return {(r["child"], r["parent"]) for r in graph.remove_cycles(edges_of(spark, pairs)).collect()}


def reachable(pairs):
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    found = {}
    for x in up:
        seen, todo = set(), [x]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        found[x] = seen
    return found


def test_cycles_are_cut_alike_at_every_size(spark, monkeypatch):
    """Two knots, a path between them with side branches, a loop and random cycles: only nodes on a cycle lose edges, and the core's limit changes nothing."""
    rng = random.Random(5)
    pairs = {(1, 2), (2, 3), (3, 1), (2, 1), (3, 20), (20, 30), (3, 21), (21, 30), (3, 22), (22, 30), (30, 31), (31, 32), (32, 30), (40, 40), (41, 40), (31, 50)}
    pairs |= {(100 + rng.randrange(12), 100 + rng.randrange(12)) for _ in range(16)}
    whole = kept(spark, sorted(pairs))
    above = reachable(pairs)
    left = reachable(whole)
    assert not any(x in ups for x, ups in left.items())
    assert {a for a, _ in pairs - whole} <= {x for x, ups in above.items() if x in ups}
    assert {(3, 20), (20, 30), (21, 30), (22, 30), (41, 40)} - whole <= {(3, 20)}
    monkeypatch.setattr(graph, "CORE_LIMIT", 1)
    assert kept(spark, sorted(pairs)) == whole
