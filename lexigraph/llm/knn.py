"""Exact k-nearest-neighbour join over a Voronoi partition.

1. A bounded sample of the data gives the pivots; every row belongs to the cell
   of its nearest pivot.
2. Summaries: for each cell of queries the greatest distance to its pivot and
   the greatest of their distances to the k-th nearest pivot (pivots are data
   rows too), and for each cell of data its rows, the greatest and the k least
   distances.  They are as large as the pivots are many, whatever the data.
3. Bounds: for a cell of queries, the k-th least upper bound (its radius + the
   distance of the pivots + a data row's distance to its own), or that to the
   k-th pivot if it is less, is a radius that surely holds k neighbours of each
   of its queries.
4. Neighbouring cells of queries form an area, and a large cell is one by
   itself, in several parts.  A data row goes to an area only if for one of its
   cells the triangle inequality lets it be within the bound; the rows of an
   area are dealt into chunks of a bounded size.
5. Each part meets each chunk by itself, exactly; the k best of all chunks of a
   query are its neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lexigraph.llm.textops import U64, binaries, mix, numbered, with_ids, written

K = 10
#: Pivots are as many as the root of the data's rows, up to this: distances between them and areas' bounds are held by the driver.
PIVOTS = 2048
#: Queries of a part and data rows of a chunk: more of either makes more tasks.
GROUP_ROWS, CHUNK_ROWS = 4096, 32768
_BLOCK, _ROWS = 4096, 1024


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += np.einsum("ij,ij->i", a, a)[:, None]
    d += np.einsum("ij,ij->i", b, b)
    return d


def _apart(p: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows, a row at a time."""
    return np.stack([np.sqrt(np.square(p - x).sum(axis=1)) for x in p])


def _slack(p: np.ndarray) -> float:
    """More than rounding can take from a distance of vectors like these."""
    return 1e-9 + 1e-12 * float(np.sqrt(np.square(p).sum(axis=1).max(initial=0)))


def pivots_of(vectors: DataFrame, m: int, dim: int) -> np.ndarray:
    """The different vectors of m rows at most, chosen by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(m).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, dim), axis=0)


def _assign(vectors: DataFrame, pivots, dim: int, want: int) -> DataFrame:
    """(cell, id, d, near, v): each row with its cell and its distances to the pivot and to the want-th nearest one (infinite if there are fewer, or for want 0)."""
    kind = vectors.schema["v"].dataType.elementType

    def run(batches):
        p = pivots.value
        centre = p.mean(axis=0)
        slack = _slack(p)
        for batch in batches:
            v = _vectors(batch.column(1), dim)
            for lo in range(0, len(v), 4096):
                part = v[lo : lo + 4096]
                square = _squares(part - centre, p - centre)
                cell = square.argmin(axis=1)
                d = np.sqrt(np.square(part - p[cell]).sum(axis=1))
                near = np.full(len(part), np.inf)
                if 0 < want <= len(p):
                    at = np.argpartition(square, want - 1, axis=1)[:, :want]
                    near = np.sqrt(np.square(part[:, None] - p[at]).sum(axis=2).max(axis=1)) + slack
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).slice(lo, len(part)), pa.array(d), pa.array(near), batch.column(1).slice(lo, len(part))], names=["cell", "id", "d", "near", "v"])

    return vectors.select("id", "v").mapInArrow(run, f"cell int, id long, d double, near double, v array<{kind.simpleString()}>")


def bounds(between: np.ndarray, query_far: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """For each cell of queries a distance that holds k data rows of any of its queries: infinite if there are fewer than k. near has a row for each cell of data: its k least distances, then infinities."""
    out = np.full(len(between), np.inf)
    for i in np.flatnonzero(query_far >= 0):
        out[i] = query_far[i] + np.partition((between[i][:, None] + near).reshape(-1), k - 1)[k - 1]
    return out


def areas_of(between: np.ndarray, sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(area of each cell of queries, how many parts it has): neighbouring cells share an area of rows queries, a cell of more is one in several parts; -1 and 0 for empty cells."""
    area, parts = np.full(len(sizes), -1), -(-sizes // rows)
    n = 0
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if area[seed] >= 0 or not sizes[seed]:
            continue
        total = 0
        for c in np.argsort(between[seed], kind="stable").tolist():
            if area[c] < 0 and sizes[c] and (total == 0 or total + sizes[c] <= rows):
                area[c] = n
                total += int(sizes[c])
            if total >= rows:
                break
        n += 1
    return area, parts


def _once(s_id: np.ndarray, s: np.ndarray, want: int) -> np.ndarray:
    """The rows left if of each vector only the want least ids stay: no others of them can be among anyone's nearest."""
    key = (np.ascontiguousarray(s).view(U64) * mix(np.arange(1, s.shape[1] + 1).astype(U64))).sum(axis=1, dtype=U64)
    if len(np.unique(key)) == len(key):
        return np.arange(len(s))
    order = np.lexsort((s_id, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (s[order][1:] != s[order][:-1]).any(axis=1)
    first = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[nth < want])


def _solve(q_id, q, q_cell, q_d, q_near, s_id, s, s_cell, s_d, k: int, between: np.ndarray, exclude_self: bool):
    """(query, neighbour, distance) of a part and a chunk: the k nearest of each query that are within its `near`, ties in distance by the neighbour's id."""
    left = _once(s_id, s, k + 1)
    left = left[np.argsort(s_cell[left], kind="stable")]
    s_id, s, s_cell, s_d = s_id[left], s[left], s_cell[left], s_d[left]
    if not len(s) or not len(q):
        return
    # products are of vectors about their middle; what rounding may take from a square is allowed for, and squares that pass are measured exactly
    centre = q.mean(axis=0)
    qc, sc = q - centre, s - centre
    largest = max(np.abs(q).max(), np.abs(s).max())
    slack = 1e-9 + 8 * np.finfo(float).eps * largest * q.shape[1]
    loose = 16 * q.shape[1] * np.finfo(float).eps * (np.square(qc).sum(axis=1).max() + np.square(sc).sum(axis=1).max())
    blocks = []
    for lo in range(0, len(s), _BLOCK):
        cells, first = np.unique(s_cell[lo : lo + _BLOCK], return_index=True)
        blocks.append((lo, cells, np.maximum.reduceat(s_d[lo : lo + _BLOCK], first)))
    of_cell, q_at = np.unique(q_cell, return_inverse=True)
    floor = np.stack([(between[np.ix_(of_cell, cells)] - far).min(axis=1) for _, cells, far in blocks])  # (block, cell of queries)
    for qlo in range(0, len(q), _ROWS):
        mine = np.arange(qlo, min(len(q), qlo + _ROWS))
        limit = q_near[mine].copy()
        row, at, dist = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        lower = floor[:, q_at[mine]] - q_d[mine]
        for b in np.argsort(lower.mean(axis=1), kind="stable"):
            active = np.flatnonzero(lower[b] <= limit + slack)
            if not len(active):
                continue
            lo = blocks[b][0]
            square = _squares(qc[mine[active]], sc[lo : lo + _BLOCK])
            r, a = np.nonzero(square <= (np.square(limit[active] + slack) + loose)[:, None])
            r, a = active[r], a + lo
            if exclude_self:
                other = q_id[mine[r]] != s_id[a]
                r, a = r[other], a[other]
            exact = np.concatenate([np.sqrt(np.square(q[mine[r[x : x + 65536]]] - s[a[x : x + 65536]]).sum(axis=1)) for x in range(0, len(r), 65536)] or [np.zeros(0)])
            row, at, dist = np.append(row, r), np.append(at, a), np.append(dist, exact)
            o = np.lexsort((s_id[at], dist, row))
            row, at, dist = row[o], at[o], dist[o]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = nth < k
            row, at, dist, nth = row[keep], at[keep], dist[keep], nth[keep]
            full = nth == k - 1
            limit[row[full]] = np.minimum(limit[row[full]], dist[full])
        yield q_id[mine[row]], s_id[at], dist


def knn_join(
    queries: DataFrame,
    data: DataFrame | None = None,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    group_rows: int = GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    dim: int | None = None,
    exclude_self: bool | None = None,
) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the k nearest data rows of each query by Euclidean distance, ties by the lower id.

    Without data, queries are joined with themselves.  With exclude_self (if not
    said, then just without data) no row is the neighbour of its own id.  A
    query with fewer than k others gets them all.  Rows with a null id or
    vector, a null or non-finite component, or another length than dim (if not
    said, the most frequent one among the data's vectors, the lesser of two),
    neither ask nor answer; of rows that repeat an id, the least vector counts.
    Ids of any orderable type will do.
    """
    spark = queries.sparkSession
    own = data is None
    exclude_self = own if exclude_self is None else exclude_self
    if dim is None:
        sizes = (queries if own else data).where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).groupBy(F.size(vector_col).alias("n")).count()
        dim = (sizes.orderBy(F.desc("count"), "n").first() or [0])[0]
    kinds = {df.schema[vector_col].dataType.elementType for df in (queries, queries if own else data)}
    kind = "float" if kinds == {FloatType()} else "double"

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        ok = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(ok)

    if own:
        every, back = numbered(clean(queries), "id")
        asked = every
    else:
        both, back = numbered(clean(queries).withColumn("asks", F.lit(True)).unionByName(clean(data).withColumn("asks", F.lit(False))), "id")
        asked, every = (both.where(F.col("asks") == x).select("id", "v") for x in (True, False))

    def apart(df: DataFrame) -> DataFrame:
        again = written(df.groupBy("id").count().where("count > 1").select("id"))
        if again.isEmpty():
            return df
        return with_ids(df, again, "id", "left_anti").unionByName(with_ids(df, again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))

    empty = back(spark.createDataFrame([], "query_id long, neighbor_id long, rank int, distance double"), "query_id", "neighbor_id")
    if dim < 1:
        return empty
    every = apart(every)
    want = k + exclude_self
    p = pivots_of(every, max(1, min(pivots, int(np.sqrt(every.count())))), dim)
    if not len(p):
        return empty
    shared = spark.sparkContext.broadcast(p)
    s_rows = written(_assign(every, shared, dim, want if own else 0))
    q_rows = s_rows if own else written(_assign(apart(asked), shared, dim, want))

    between, slack = _apart(p), _slack(p)
    m = len(p)
    far, reach, sizes = np.full(m, -1.0), np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    for c, n, d, r in q_rows.groupBy("cell").agg(F.count("*"), F.max("d"), F.max("near")).collect():
        far[c], sizes[c], reach[c] = d, n, r
    s_far, s_sizes = np.full(m, -1.0), np.zeros(m, dtype=np.int64)
    for c, n, d in s_rows.groupBy("cell").agg(F.count("*"), F.max("d")).collect():
        s_far[c], s_sizes[c] = d, n
    near = np.full((m, want), np.inf)
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    for c, d, n in s_rows.select("cell", "d").withColumn("nth", nth).where(F.col("nth") <= want).collect():
        near[c, n - 1] = d
    theta = np.minimum(bounds(between, far, near, want), reach) + slack
    area, parts = areas_of(between, sizes, group_rows)
    n_areas = int(area.max(initial=-1)) + 1
    area_parts = np.ones(n_areas, dtype=np.int64)
    # a data row of cell j at distance d may serve an area only from this distance on
    floor = np.full((n_areas, m), np.inf)
    for c in np.flatnonzero(area >= 0):
        floor[area[c]] = np.minimum(floor[area[c]], between[c] - far[c] - theta[c] - slack)
        area_parts[area[c]] = max(area_parts[area[c]], parts[c])
    chunks = np.maximum(1, -(-(np.where(s_far >= floor, s_sizes, 0).sum(axis=1)) // chunk_rows))
    plan = spark.sparkContext.broadcast((area, area_parts, chunks, floor, between))
    item = np.float32 if kind == "float" else np.float64

    def route(role: int):
        def run(batches):
            area, area_parts, chunks, floor, _ = plan.value
            for batch in batches:
                cell = batch.column(0).to_numpy().astype(np.int64)
                columns = [batch.column(1).to_numpy(), cell, batch.column(2).to_numpy(), batch.column(3).to_numpy(), _vectors(batch.column(4), dim).astype(item)]
                spread = mix(columns[0].astype(np.int64).view(U64))
                for g in range(len(floor)) if role else np.unique(area[cell]):
                    rows = np.flatnonzero(columns[2] >= floor[g, cell] if role else area[cell] == g)
                    if not len(rows):
                        continue
                    # queries are dealt into parts and go to every chunk, data the other way round
                    dealt, copies = (chunks[g], area_parts[g]) if role else (area_parts[g], chunks[g])
                    place = (spread[rows] % U64(dealt)).astype(np.int64)
                    for x in np.unique(place):
                        blob = [binaries([c[rows[place == x]]])[0] for c in columns]
                        for y in range(copies):
                            part, chunk = (y, x) if role else (x, y)
                            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (g, part, chunk, role)] + [pa.array([b], pa.binary()) for b in blob], names=["area", "part", "chunk", "role", "ids", "cells", "d", "near", "v"])

        return run

    def solve(_, table):
        between = plan.value[-1]
        sides = []
        for role in (0, 1):
            mine = table.filter(pa.compute.equal(table.column("role"), role))
            sides.append([np.frombuffer(b"".join(mine.column(name).to_pylist()), dtype=t) for name, t in (("ids", np.int64), ("v", item), ("cells", np.int64), ("d", np.float64), ("near", np.float64))])
            sides[-1][1] = sides[-1][1].reshape(-1, dim).astype(np.float64)
        found = list(_solve(*sides[0], *sides[1][:-1], k, between, exclude_self))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "neighbor_id", "distance"])

    blob = "area int, part int, chunk int, role int, ids binary, cells binary, d binary, near binary, v binary"
    routed = q_rows.mapInArrow(route(0), blob).unionByName(s_rows.mapInArrow(route(1), blob))
    found = routed.groupBy("area", "part", "chunk").applyInArrow(solve, "query_id long, neighbor_id long, distance double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return back(best.select("query_id", "neighbor_id", "rank", "distance"), "query_id", "neighbor_id")
