"""python -m lexigraph.plans.cli: builds a snapshot from a dump."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-d", "--dump", default="data/dump.jsonl.gz", help="lines of JSON entries, plain or gzip")
    p.add_argument("-l", "--languages", default="data/languages.json")
    p.add_argument("-s", "--snapshot", default="data/snapshot", help="folder of the tables")
    p.add_argument("-f", "--format", choices=("parquet", "json"), default="parquet")
    p.add_argument("-t", "--turtle", help="folder of Turtle text, if wanted")
    p.add_argument("-c", "--cache", default="data/vectors", help="folder of vectors by text hash")
    p.add_argument("-b", "--batch", type=int, default=800, help="texts encoded at a time")
    p.add_argument("-m", "--model", help="the encoder of texts, as module:function from a list of strings to an array of vectors; by default hashed trigrams, which need no model")
    a = p.parse_args(argv)

    from importlib import import_module

    from lexigraph.operators.encoder import hashing_encoder
    from lexigraph.operators.graph import immediate_ety
    from lexigraph.operators.trees import item_records
    from lexigraph.plans.build import build
    from lexigraph.runtime import clear
    from lexigraph.sources import sinks
    from lexigraph.sources.langs import read_languages

    spark = SparkSession.builder.appName("lexigraph").getOrCreate()
    module, _, function = (a.model or "").partition(":")
    encode = getattr(import_module(module), function) if module else hashing_encoder
    snapshot = build(spark, a.dump, read_languages(spark, a.languages), a.cache, encode=encode, batch=a.batch)
    sinks.write_snapshot(snapshot.tables(), a.snapshot, a.format)
    if a.turtle:
        records = item_records(snapshot.items, snapshot.langs)
        sinks.write_turtle(sinks.turtle_blocks(records, snapshot.items.select("item_id", "page_term"), immediate_ety(snapshot.edges), snapshot.progenitors), a.turtle)
    clear(spark)


if __name__ == "__main__":
    main()
