import numpy as np
import pytest

from lexigraph.llm import knn

SHAPE = "vec_id long, embedding array<float>, label int, cell string, id long, v string"


def brute_force(queries, data, k, own):
    out = set()
    for i, q in queries.items():
        near = sorted((float(np.sqrt(np.square(np.array(q, dtype=np.float64) - np.array(x, dtype=np.float64)).sum())), j) for j, x in data.items() if not own or i != j)
        out |= {(i, j, n + 1, round(d, 6)) for n, (d, j) in enumerate(near[:k])}
    return out


def rows_of(vectors):
    return [(i, v, 1, "x", -1, "y") for i, v in vectors.items()]


def result(df):
    return {(r["query_id"], r["neighbor_id"], r["rank"], round(r["distance"], 6)) for r in df.collect()}


def clustered(seed, n, dim=6):
    """Clusters on a coarse grid, so that distances tie and vectors repeat."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-20, 20, (6, dim))
    return {i: [float(x) for x in centres[i % 6] + rng.integers(-1, 2, dim)] for i in range(n)}


@pytest.mark.parametrize("pivots, group_rows", [(256, 4096), (7, 30), (1, 4096)])
def test_self_join_is_exact(spark, pivots, group_rows):
    v = clustered(1, 240)
    df = spark.createDataFrame(rows_of(v), SHAPE)
    assert result(knn.knn_join(df, k=5, pivots=pivots, group_rows=group_rows)) == brute_force(v, v, 5, True)


def test_join_of_two_tables(spark):
    q, d = clustered(2, 50), {i + 1000: x for i, x in clustered(3, 200).items()}
    got = result(knn.knn_join(spark.createDataFrame(rows_of(q), SHAPE), spark.createDataFrame(rows_of(d), SHAPE), k=4, group_rows=16))
    assert got == brute_force(q, d, 4, False)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [3.0, 0.0]), (3, None), (None, [0.0, 0.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [1.0]), (7, []), (8, [None, 1.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SHAPE)
    v = {1: [0, 0], 2: [1, 0], 9: [0, 0]}
    assert result(knn.knn_join(df, k=10)) == brute_force(v, v, 10, True)
    assert knn.knn_join(df.limit(0)).count() == 0
    one = df.where("vec_id = 1")
    assert knn.knn_join(one).count() == 0 and knn.knn_join(one, df.limit(0)).count() == 0 and knn.knn_join(df.limit(0), df).count() == 0
    same = spark.createDataFrame(rows_of({i: [2.0, 2.0] for i in range(40)}), SHAPE)
    got = knn.knn_join(same, k=3).collect()
    assert {(r["query_id"], r["neighbor_id"]) for r in got} == {(i, j) for i in range(40) for j in [j for j in range(4) if j != i][:3]}


def test_queries_that_are_data_rows_too(spark):
    v = clustered(4, 300)
    df = spark.createDataFrame(rows_of(v), SHAPE)
    asked = {i: x for i, x in v.items() if i % 50 == 0}
    for group_rows, chunk_rows in ((4096, 32768), (2, 16)):
        got = result(knn.knn_join(df.where("vec_id % 50 = 0"), df, k=6, exclude_self=True, group_rows=group_rows, chunk_rows=chunk_rows))
        assert got == brute_force(asked, v, 6, True)


def test_one_long_vector_loses_no_row(spark):
    v = clustered(5, 50)
    df = spark.createDataFrame(rows_of(v | {99: [1.0] * 7}), SHAPE)
    got = result(knn.knn_join(df, k=3))
    assert got == brute_force(v, v, 3, True) and len(got) == 150
    assert knn.knn_join(df, k=3, dim=7).count() == 0 and knn.knn_join(df, df, k=3, dim=7).count() == 1


def test_ids_of_any_type(spark):
    v = clustered(6, 60)
    df = spark.createDataFrame([(f"v{i:03}", x) for i, x in v.items()], "vec_id string, embedding array<double>")
    want = {(f"v{i:03}", f"v{j:03}", n, d) for i, j, n, d in brute_force(v, v, 4, True)}
    assert result(knn.knn_join(df, k=4)) == want
    assert result(knn.knn_join(df.where("vec_id < 'v010'"), df, k=4, exclude_self=True)) == {x for x in want if x[0] < "v010"}


def test_a_common_offset_changes_no_neighbour():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8)) * 0.01 + 1e6
    ids = np.arange(600)
    zero = np.zeros(600, dtype=np.int64)
    far = np.full(600, 1e9)
    got = {}
    for q, s, d in knn._solve(ids, x, zero, far, far, ids, x, zero, far, 5, np.zeros((1, 1)), True):
        for a, b in zip(q.tolist(), s.tolist()):
            got.setdefault(a, []).append(b)
    for i in range(600):
        d = np.sqrt(np.square(x[i] - x).sum(axis=1))
        assert got[i] == [j for j in np.lexsort((ids, d)) if j != i][:5]


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    v = {i: ([1.0, 2.0] if i % 3 == 0 else [float(i % 17), float(i % 23)]) for i in range(300)}
    df = spark.createDataFrame(rows_of(v), SHAPE)
    assert result(knn.knn_join(df, k=4, group_rows=64, chunk_rows=50)) == brute_force(v, v, 4, True)
