"""The batch build: from a dump of entries to items, edges and closures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import claims, encoder, graph, ingest, link
from lexigraph.functions.vectors import IMPUTED_DISCOUNT, item_similarity
from lexigraph.runtime import materialize, ship
from lexigraph.sources.dump import parse, read_lines
from lexigraph.sources.langs import Langs

_EDGES = "child long, parent long, mode string, ord int, head boolean, confidence double"


@dataclass
class Snapshot:
    langs: DataFrame
    items: DataFrame
    edges: DataFrame
    progenitors: DataFrame
    descendant_langs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return self.__dict__


def build(spark: SparkSession, dump: str, langs: Langs, cache_path: str | None = None, encode: Callable = encoder.hashing_encoder, batch: int = encoder.BATCH, legacy_desc_merge: bool = False) -> Snapshot:
    """Everything that queries need, from the lines of a dump.

    legacy_desc_merge drops the descendants of an item as soon as a second
    entry with descendants joins it; by default they are put together.
    """
    ship(spark)
    parsed = materialize(parse(read_lines(spark, dump)))
    entries = materialize(ingest.entries(parsed, langs))
    real = materialize(ingest.number_items(ingest.merge_entries(entries)))
    recon, plain = map(materialize, ingest.read_redirects(parsed, langs))

    main = F.broadcast(langs.langs.select("lang_id", "code", "name"))
    # claims and vectors come from the entry that made the item; descendants from every entry with some
    first = materialize(entries.select("line_no", "v").join(real.select("item_id", "line_no", "lang_id", "term"), "line_no").join(main, "lang_id"))
    ety = materialize(claims.etymologies(first, langs))
    root = materialize(claims.roots(first, langs))
    merged = real.select("item_id", F.explode("lines").alias("line_no"), F.col("line_no").alias("first"))
    listed = materialize(entries.select("line_no", "v").join(merged, "line_no").where(claims.descendant_lines("v").isNotNull()))
    if legacy_desc_merge:
        twice = listed.where("line_no > first").join(listed.select("item_id").where("line_no = first"), "item_id", "left_semi").select("item_id").distinct()
        listed = listed.join(twice, "item_id", "left_anti")
    desc = materialize(claims.descendants(listed, langs))

    items = materialize(real.drop("lines", "line_no").withColumn("is_imputed", F.lit(False)).withColumn("from_item", F.lit(None).cast("long")))
    found = materialize(link.candidates(link.claim_terms(ety, desc, root), items, langs, recon, plain))
    owners = ety.select("item_id").unionByName(desc.select("item_id")).unionByName(root.select("item_id"))
    needed = encoder.needs_vectors(found, owners)
    texts = first.join(needed, "item_id", "left_semi").select("item_id", encoder.etymology_text("v", F.col("name"), F.col("term")).alias("ety_text"), encoder.gloss_text("v").alias("gloss_text"))
    vectors = materialize(encoder.vectors_of(texts, cache_path, encode, batch))
    shown = materialize(link.with_vectors(found, vectors))

    edges = spark.createDataFrame([], _EDGES)
    for links in (link.descendant_links(items, desc, shown, vectors, langs), link.etymology_links(items, ety, found, vectors, langs)):
        items, new = link.impute(items, links)
        edges = materialize(graph.remove_cycles(link.add_claims(edges, new)))
    items, new = link.impute(items, link.root_links(items, root, found, vectors, langs))
    edges = materialize(graph.remove_cycles(add_roots(edges, items, new, vectors, langs)))
    items = materialize(items)
    return Snapshot(materialize(langs.langs), items, edges, materialize(graph.progenitors(edges)), graph.descendant_langs(edges, items))


def add_roots(edges: DataFrame, items: DataFrame, proposals: DataFrame, vectors: DataFrame, langs: Langs) -> DataFrame:
    """edges with the roots of items, as if taken one after another in the order of ids.

    An item without progenitors gets the root itself, if its language strictly
    descends from the root's; otherwise the item's head progenitor does, if the
    root isn't a progenitor and languages allow it.  A root changes the
    progenitors of whoever descends from the item it is added to, so each round
    takes the first proposal for each target and asks the others again.
    """
    ancestors = F.broadcast(langs.langs.select("lang_id", "ancestors"))
    lang = materialize(items.select("item_id", "lang_id", "is_imputed", F.coalesce("from_item", "item_id").alias("source")).join(ancestors, "lang_id").join(vectors.withColumnRenamed("item_id", "source"), "source", "left").withColumn("discount", F.when(F.col("is_imputed"), IMPUTED_DISCOUNT).otherwise(1.0)))
    side = lambda p, key: lang.select(F.col("item_id").alias(key), *[F.col(c).alias(p + c) for c in ("lang_id", "is_imputed", "ancestors", "ety", "gloss", "discount")])
    todo = materialize(proposals.select("item_id", F.get("parents", 0)["id"].alias("root"), F.get("parents", 0)["confidence"].alias("confidence")))
    while not todo.isEmpty():
        tops = graph.progenitors(edges, todo.select(F.col("item_id").alias("id")))
        rows = todo.join(tops, "item_id", "left")
        own = F.col("items").isNull()
        rows = rows.withColumn("target", F.when(own, F.col("item_id")).when(~F.array_contains("items", F.col("root")), F.col("head"))).where("target is not null")
        rows = rows.join(side("t_", "target"), "target").join(side("r_", "root"), "root")
        descends = F.array_contains("t_ancestors", F.col("r_lang_id")) & ((F.col("t_lang_id") != F.col("r_lang_id")) | F.col("t_is_imputed"))
        near = item_similarity(F.col("t_ety"), F.col("t_gloss"), F.col("t_discount"), F.col("r_ety"), F.col("r_gloss"), F.col("r_discount"))
        rows = rows.where(descends).withColumn("level", F.when(own, F.col("confidence")).otherwise(near)).where("level >= 0 and not isnan(level)")
        taken = materialize(rows.groupBy("target").agg(F.min_by(F.struct("item_id", "root", "level"), "item_id").alias("w"), F.collect_list("item_id").alias("asked")))
        if taken.isEmpty():
            break
        new = taken.select(F.col("w.item_id").alias("item_id"), F.lit(0).alias("seq"), F.col("target").alias("child"), F.lit("root").alias("mode"), F.lit(0).alias("head"), F.array(F.struct(F.lit(0).alias("ord"), F.col("w.root").alias("id"), F.col("w.level").alias("confidence"))).alias("parents"))
        edges = materialize(link.add_claims(edges, new))
        again = taken.select("w.item_id", F.explode("asked").alias("other")).where("other <> item_id").select(F.col("other").alias("item_id")).distinct()
        todo = materialize(todo.join(again, "item_id", "left_semi"))
    return edges
