"""Snapshots as Parquet or JSON, and Turtle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.text import turtle_string

TABLES = ("langs", "items", "edges", "progenitors", "descendant_langs")
PREFIXES = (("k:", "https://en.wiktionary.org/wiki/"), ("r:", "https://en.wiktionary.org/wiki/Reconstruction:"), ("p:", "p:"), ("w:", "w:"))


def write_snapshot(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table under path; form 'json' writes lines compressed by gzip."""
    for name in TABLES:
        writer = tables[name].write.mode("overwrite")
        if form == "json":
            writer.option("ignoreNullFields", "false").json(f"{path}/{name}", compression="gzip")
        else:
            writer.parquet(f"{path}/{name}", compression="zstd")


def read_snapshot(spark: SparkSession, path: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a Parquet snapshot; with schemas by table, of a JSON one."""
    return {name: spark.read.schema(schemas[name]).json(f"{path}/{name}") if schemas else spark.read.parquet(f"{path}/{name}") for name in TABLES}


def turtle_blocks(records: DataFrame, page_terms: DataFrame, immediate: DataFrame, progenitors: DataFrame) -> DataFrame:
    """(id, block): the Turtle text of each item, from item records, (item_id, page_term), immediate etymologies and progenitors."""
    rows = (
        records.join(page_terms.withColumnRenamed("item_id", "id"), "id", "left")
        .join(immediate.select(F.col("item_id").alias("id"), "parents", F.col("head").alias("head_place"), "mode"), "id", "left")
        .join(progenitors.select(F.col("item_id").alias("id"), F.col("items").alias("tops"), F.col("head").alias("top_head")), "id", "left")
    )

    def line(predicate: str, value: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"  {predicate} "), value, F.lit(" ;\n"))).otherwise("")

    def text(predicate: str, c: str) -> Column:
        return line(predicate, turtle_string(F.col(c)), F.col(c).isNotNull())

    def each(predicate: str, values: Column, there: Column) -> Column:
        return line(predicate, F.concat_ws(", ", values), there)

    node = lambda c: F.concat(F.lit("w:"), c.cast("string"))
    sources = F.transform("parents", lambda p, k: F.concat(F.lit("[ p:item "), node(p), F.lit("; p:order "), k.cast("string"), F.lit(" ]")))
    block = F.concat(
        node(F.col("id")),
        F.lit("\n"),
        line("p:lang", turtle_string(F.col("lang.name")), F.lit(True)),
        text("p:term", "term"),
        text("p:pageTerm", "page_term"),
        text("p:romanization", "romanization"),
        line("p:etyNum", F.col("etyNum").cast("string"), F.lit(True)),
        each("p:pos", F.transform("pos", turtle_string), F.size("pos") > 0),
        each("p:gloss", F.transform("gloss", turtle_string), F.size("gloss") > 0),
        text("p:url", "url"),
        line("p:isImputed", F.lit("true"), F.col("imputed")),
        line("p:isReconstructed", F.lit("true"), F.col("reconstructed")),
        text("p:mode", "mode"),
        line("p:head", F.col("head_place").cast("string"), F.col("head_place").isNotNull()),
        each("p:source", sources, F.size("parents") > 0),
        line("p:headProgenitor", node(F.col("top_head")), F.col("top_head").isNotNull()),
        each("p:progenitor", F.transform("tops", node), F.size("tops") > 0),
        F.lit("."),
    )
    return rows.select("id", block.alias("block"))


def write_turtle(blocks: DataFrame, path: str) -> None:
    """The blocks as text files in the order of ids, the first one's head holding the prefixes."""
    head = "\n".join(f"@prefix {p} <{iri}> ." for p, iri in PREFIXES)
    first = blocks.sparkSession.createDataFrame([(-1, head)], "id long, block string")
    first.unionByName(blocks).repartitionByRange("id").sortWithinPartitions("id").select("block").write.mode("overwrite").text(path)
