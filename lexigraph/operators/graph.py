"""Graph operators over edges (child, parent, mode, ord, head, confidence).

Closures of all items are iterative frontiers: each round is a join and an
aggregation, written to the shared folder, so plans stay short and a lost
executor repeats one round at most.  Bounded ones (from given items) are too.
Tables of the graph's size are joined by sorting: rounds that broadcast them
would send each of them through the driver again and again.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.runtime import materialize, shared_dir


def child_edges(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges to children of these items (column id)."""
    return edges.join(parents.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select(*edges.columns)


def parent_edges(edges: DataFrame, children: DataFrame) -> DataFrame:
    """The edges to parents of these items (column id)."""
    return edges.join(children.select(F.col("id").alias("child")).distinct(), "child", "left_semi").select(*edges.columns)


def with_ends(edges: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """edges with these columns of the items at both ends, as child_ and parent_."""
    for end in ("child", "parent"):
        edges = edges.join(items.select(F.col("item_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


#: Rows of a round that are sent to all executors at most; more are joined by shuffling them, so what passes the driver doesn't follow the input.
FEW = 10_000


def in_rounds(first: DataFrame, following: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first and what `following` makes of each round's rows until there are none; each round is written to the shared folder, and all are read as one table."""
    spark, base, rows, written = first.sparkSession, shared_dir(first.sparkSession), first, []
    kinds = [(f.name, f.dataType.simpleString()) for f in first.schema.fields]
    while True:
        written.append(f"{base}/{len(written)}")
        rows.write.parquet(written[-1])
        found = spark.read.schema(first.schema).parquet(written[-1])
        n = found.count()
        if not n:
            return spark.read.schema(first.schema).parquet(*written)
        rows = following(F.broadcast(found) if n <= FEW else found.hint("merge")).select(*[F.col(name).cast(kind) for name, kind in kinds])


def recurse(anchor: DataFrame, step: DataFrame, on: str, carried: list[str]) -> DataFrame:
    """anchor and all rows that follow from it: `carried` are SQL expressions over t (a row so far) and e (a step row), one for each column of anchor.

    Each round is written and joined with step, which is written once and never
    broadcast: as a recursive query it was, in every round, all of it through
    the driver.  Steps must have no cycle.
    """
    step = materialize(step)
    columns = [F.expr(c).alias(name) for c, name in zip(carried, anchor.columns, strict=True)]
    return in_rounds(anchor, lambda rows: rows.alias("t").join(step.alias("e"), F.expr(on)).select(*columns))


def _walk(edges: DataFrame, starts: DataFrame, near: str, far: str) -> DataFrame:
    """(root, depth, edge columns): the edges reached from each start, a node that is reached k times giving its edges k times."""
    step = materialize(edges)
    first = starts.select(F.col("id").alias("root")).hint("merge").join(step, F.col("root") == step[near]).select("root", F.lit(1).alias("depth"), *step.columns)
    return recurse(first, step, f"t.{far} = e.{near}", ["t.root", "t.depth + 1", *[f"e.{c}" for c in step.columns]])


def ancestor_edges(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges above each start (column id); one for each path, as a walk without memory meets them."""
    return _walk(edges, starts, "child", "parent")


def descendant_edges(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges below each start (column id); one for each path."""
    return _walk(edges, starts, "parent", "child")


def ancestors_in_langs(edges: DataFrame, items: DataFrame, starts: DataFrame, langs: list[int]) -> DataFrame:
    """(root, id): ancestors of each start that are in one of the languages, once for each path, the start itself left out."""
    up = ancestor_edges(edges, starts)
    inside = items.where(F.col("lang_id").isin(langs)).select(F.col("item_id").alias("parent"))
    return up.select("root", "parent").join(inside, "parent").select("root", F.col("parent").alias("id"))


def immediate_ety(edges: DataFrame) -> DataFrame:
    """(item_id, parents in order, head place, mode) of each item with parents."""
    grouped = edges.groupBy(F.col("child").alias("item_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "parent"))).alias("p"), F.max(F.when(F.col("head"), F.col("ord"))).alias("head"), F.max_by("mode", "ord").alias("mode"))
    return grouped.select("item_id", F.transform("p", lambda x: x["parent"]).alias("parents"), "head", "mode")


def head_chains(edges: DataFrame) -> DataFrame:
    """(item_id, head): where following head parents ends, for each item with one. Pointers double, so rounds follow the logarithm of the depth; edges must have no cycle."""
    hops = materialize(edges.where("head").groupBy(F.col("child").alias("item_id")).agg(F.max("parent").alias("head")))
    while True:
        ahead = hops.select(F.col("item_id").alias("head"), F.col("head").alias("beyond"))
        jumped = materialize(hops.join(ahead.hint("merge"), "head", "left").select("item_id", F.coalesce("beyond", "head").alias("head"), F.col("beyond").isNotNull().alias("moved")))
        hops = jumped.select("item_id", "head")
        if jumped.where("moved").isEmpty():
            return hops


def progenitors(edges: DataFrame, starts: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """(item_id, items, head): the ancestors without parents of each item (or each start), and where its head chain ends.

    An item some ancestor of which is reached twice has none, as when two
    parents share a root; with dedupe it has its distinct ones.

    Two ways to an ancestor are two ways to whatever it comes from, so it is
    enough to count ways to the ends.  Items with one parent have what the end
    of their chain has, found by doubling pointers; only forks, which have
    several, are walked, from fork to fork.
    """
    step = materialize(edges.select("child", "parent"))
    ways = step.groupBy("child").agg(F.count("*").alias("ways"), F.max("parent").alias("parent"))
    hops = materialize(ways.where("ways = 1").select(F.col("child").alias("item_id"), F.col("parent").alias("at")))
    while True:
        ahead = hops.select(F.col("item_id").alias("at"), F.col("at").alias("beyond"))
        jumped = materialize(hops.join(ahead.hint("merge"), "at", "left").select("item_id", F.coalesce("beyond", "at").alias("at"), F.col("beyond").isNotNull().alias("moved")))
        hops = jumped.select("item_id", "at")
        if jumped.where("moved").isEmpty():
            break
    split = materialize(ways.where("ways > 1").select(F.col("child").alias("fork")))
    forks = materialize(step.join(split.hint("merge"), step["child"] == split["fork"]).join(hops.hint("merge"), step["parent"] == hops["item_id"], "left").select("fork", F.coalesce("at", "parent").alias("to")))
    seeds = step.select(F.col("child").alias("root")).distinct()
    if starts is not None:
        seeds = starts.select(F.col("id").alias("root")).distinct().join(seeds, "root", "left_semi")
    is_fork = split.select(F.col("fork").alias("at"), F.lit(True).alias("inner")).hint("merge")
    own = materialize(seeds.join(hops.hint("merge"), seeds["root"] == hops["item_id"], "left").select(F.col("root").alias("own_id"), F.coalesce("at", "root").alias("at")).join(is_fork, "at", "left"))
    frontier = own.where("inner").select(F.col("at").alias("root"), "at", F.lit(1).cast("long").alias("n")).distinct()
    levels: list[DataFrame] = []
    while True:
        found = frontier.join(forks.hint("merge"), frontier["at"] == forks["fork"]).groupBy("root", F.col("to").alias("at")).agg(F.lit(1).cast("long").alias("n") if dedupe else F.least(F.sum("n"), F.lit(2)).alias("n"))
        found = materialize(found.join(is_fork, "at", "left").select("root", "at", "n", F.col("inner").isNotNull().alias("inner")))
        if found.isEmpty():
            break
        levels.append(found)
        frontier = found.where("inner").join(found.where("n > 1").select("root").distinct(), "root", "left_anti").select("root", "at", "n")
    plain = own.where("inner is null").select(F.col("own_id").alias("item_id"), F.array("at").alias("items"))
    if levels:
        every = levels[0]
        for level in levels[1:]:
            every = every.unionByName(level)
        ends = every.where("not inner").groupBy("root", "at").agg(F.sum("n").alias("n"))
        twice = F.lit(False) if dedupe else F.max("n") > 1
        bad = every.where("n > 1").select("root").distinct()
        sets = ends.groupBy("root").agg(F.sort_array(F.collect_set("at")).alias("items"), twice.alias("twice")).where("not twice")
        if not dedupe:
            sets = sets.join(bad, "root", "left_anti")
        plain = plain.unionByName(own.where("inner").join(sets.hint("merge"), own["at"] == sets["root"]).select(F.col("own_id").alias("item_id"), "items"))
    return plain.join(head_chains(edges).hint("merge"), "item_id", "left").select("item_id", "items", "head")


def descendant_langs(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, lang_id), distinct: the languages of all items below each item; each round adds only pairs that are new."""
    lang = items.select(F.col("item_id").alias("child"), "lang_id")
    step = materialize(edges.select("child", "parent").distinct())
    new = materialize(step.join(lang.hint("merge"), "child").select(F.col("parent").alias("item_id"), "lang_id").distinct())
    seen = new  # a union of the rounds' files: none is written twice
    while not new.isEmpty():
        up = new.join(step.hint("merge"), new["item_id"] == step["child"]).select(F.col("parent").alias("item_id"), "lang_id").distinct()
        new = materialize(up.join(seen.hint("merge"), ["item_id", "lang_id"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(child, parent), distinct: what is left when nodes without an edge in or out are taken away again and again; all cycles lie in it."""
    core = materialize(edges.select("child", "parent").distinct())
    n = core.count()
    while n:
        core = materialize(core.join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
        n, before = core.count(), n
        if n == before:
            break
    return core


def feedback_arcs(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Arcs (child, parent) that a greedy vertex order (Eades, Lin, Smyth) leaves pointing back, ties by the lower id; without them there is no cycle."""
    out: dict[int, set[int]] = {}
    into: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            into.setdefault(b, set()).add(a)
    left = {x for p in pairs for x in p}
    front, back = [], []
    # sweeps by rising id take sinks and sources; one that appears behind the sweep waits for the next
    sweep = sorted(x for x in left if not out.get(x) or not into.get(x))
    queued, later = set(sweep), []
    best = [(len(into.get(x, ())) - len(out.get(x, ())), x) for x in left]
    heapq.heapify(best)

    def take(x: int) -> None:
        left.discard(x)
        above, below = out.pop(x, set()), into.pop(x, set())
        for y in above:
            into[y].discard(x)
        for y in below:
            out[y].discard(x)
        for y in above | below:
            o, i = len(out.get(y, ())), len(into.get(y, ()))
            heapq.heappush(best, (i - o, y))
            if (not o or not i) and y not in queued:
                queued.add(y)
                heapq.heappush(sweep if y > x else later, y)

    while left:
        while sweep or later:
            if not sweep:
                sweep, later = later, sweep
            x = heapq.heappop(sweep)
            (front if out.get(x) else back).append(x)
            take(x)
        while left:
            value, x = heapq.heappop(best)
            if x in left and value == len(into.get(x, ())) - len(out.get(x, ())):
                front.append(x)
                take(x)
                sweep, later = sorted(sweep + later), []  # sweeps begin anew
                break
    place = {x: k for k, x in enumerate(front + back[::-1])}
    return sorted({(a, b) for a, b in pairs if place[a] >= place[b]})


def strong_components(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The arcs within each strongly connected component; arcs between two components lie on no cycle and are left out."""
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    home: dict[int, int] = {}
    stack: list[int] = []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        walk = [(start, iter(out[start]))]
        while walk:
            x, ahead = walk[-1]
            for y in ahead:
                if y not in index:
                    index[y] = low[y] = len(index)
                    stack.append(y)
                    walk.append((y, iter(out.get(y, ()))))
                    break
                if y not in home:
                    low[x] = min(low[x], index[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[x])
                if low[x] == index[x]:
                    while True:
                        home[y := stack.pop()] = x
                        if y == x:
                            break
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in pairs:
        if home[a] == home[b]:
            found.setdefault(home[a], []).append((a, b))
    return list(found.values())


def _spread(step: DataFrame, values: DataFrame) -> DataFrame:
    """values (id, v) with each v raised to the greatest of any node that a path of step (near, far) leads from."""
    fresh = values
    while not fresh.isEmpty():
        sent = fresh.join(step, fresh["id"] == step["near"]).groupBy(F.col("far").alias("id")).agg(F.max("v").alias("got"))
        raised = materialize(values.join(sent, "id", "left").select("id", F.greatest("v", "got").alias("v"), (F.col("got") > F.col("v")).alias("up")))
        values, fresh = raised.select("id", "v"), raised.where("up").select("id", "v")
    return values


def _cut_components(core: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of (child, parent, component) of whole strongly connected components, the rest of the core with at most limit arcs, which no component of these tables touches).

    Each round colours nodes by the greatest id that reaches them; the nodes of
    a colour that reach the node it is named after are a component.  A round
    takes as many joins as the longest of the shortest paths has arcs.
    """
    done: list[DataFrame] = []
    while core.count() > limit:
        nodes = core.select(F.col("child").alias("id")).union(core.select("parent")).distinct()
        colour = _spread(core.select(F.col("child").alias("near"), F.col("parent").alias("far")), materialize(nodes.withColumn("v", F.col("id"))))
        inside = core.join(colour.select(F.col("id").alias("child"), F.col("v").alias("component")), "child").join(colour.select(F.col("id").alias("parent"), F.col("v").alias("c")), "parent")
        inside = materialize(inside.where("component = c").select("child", "parent", "component"))
        reach = _spread(inside.select(F.col("parent").alias("near"), F.col("child").alias("far")), materialize(colour.select("id", F.when(F.col("id") == F.col("v"), 1).otherwise(0).alias("v"))))
        taken = materialize(reach.where("v = 1").select("id"))
        both = inside.join(taken.select(F.col("id").alias("child")), "child", "left_semi").join(taken.select(F.col("id").alias("parent")), "parent", "left_semi")
        done.append(materialize(both))
        rest = inside.join(taken.select(F.col("id").alias("child")), "child", "left_anti").join(taken.select(F.col("id").alias("parent")), "parent", "left_anti")
        core = cyclic_core(rest.select("child", "parent"))
    return done, core


#: Arcs of the cyclic core whose components the driver finds at most; those of a larger one are found in Spark, and are the same.
CORE_LIMIT = 1_000_000


def remove_cycles(edges: DataFrame) -> DataFrame:
    """edges without a cycle: of each item that a feedback arc starts from, all edges to parents go; an acyclic graph stays as it is.

    Peeling is distributed.  Each strongly connected component of the core is
    solved on its own, so an item in no cycle keeps its edges and the result
    doesn't depend on CORE_LIMIT.  Components that are found in Spark are solved
    there, each in one task, whose memory it must fit.
    """
    edges = materialize(edges)
    done, core = _cut_components(cyclic_core(edges), CORE_LIMIT)
    arcs = [a for part in strong_components([tuple(r) for r in core.collect()]) for a in feedback_arcs(part)]
    sources = edges.sparkSession.createDataFrame([(a,) for a, _ in arcs], "child long")

    def solve(pdf):
        back = feedback_arcs(list(zip(pdf["child"].tolist(), pdf["parent"].tolist())))
        return pd.DataFrame({"child": pd.Series([a for a, _ in back], dtype="int64")})

    for part in done:
        sources = sources.union(part.groupBy("component").applyInPandas(solve, "child long"))
    if done:
        sources = materialize(sources)
    return edges.join(sources.distinct(), "child", "left_anti").select(edges.columns)
