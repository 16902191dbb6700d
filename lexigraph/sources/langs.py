"""The language dimension: a table of fixed size, built from a map of code to record."""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Langs:
    #: (lang_id, code, name, url_name, kind, non_ety_id, ancestors), ancestors oldest first and ending with the language itself.
    langs: DataFrame
    #: (code, lang_id) of every code, aliases too.
    codes: DataFrame
    #: (name, lang_id); of languages that share a name, the last code's.
    names: DataFrame


def language_tables(spark: SparkSession, records: dict[str, dict]) -> Langs:
    """Ids follow the sorted codes: a main code takes the next one where it first appears, with the attributes found there."""
    ids: dict[str, int] = {}
    first: dict[str, dict] = {}
    codes, names = {}, {}
    for code in sorted(records):
        record = records[code]
        main = record["mainCode"]
        if main not in ids:
            ids[main] = len(ids)
            first[main] = record
        codes[code] = names[record["canonicalName"]] = ids[main]
    rows = []
    for main, n in ids.items():
        record = first[main]
        name = record["canonicalName"]
        ancestors = [codes[a] for a in record.get("ancestors") or [] if a in codes]
        rows.append((n, main, name, quote(name.replace(" ", "_"), safe="~"), record.get("kind"), codes.get(record.get("nonEtymologyOnly") or main, n), [*ancestors, n]))
    return Langs(
        spark.createDataFrame(rows, "lang_id int, code string, name string, url_name string, kind string, non_ety_id int, ancestors array<int>"),
        spark.createDataFrame(sorted(codes.items()), "code string, lang_id int"),
        spark.createDataFrame(sorted(names.items()), "name string, lang_id int"),
    )


def read_languages(spark: SparkSession, path: str) -> Langs:
    return language_tables(spark, json.loads(spark.read.text(path, wholetext=True).first()[0]))


def with_lang(df: DataFrame, langs: Langs, code: str, prefix: str) -> DataFrame:
    """df with prefix + lang_id of the language of a code column, null if it is unknown."""
    table = langs.codes.select(F.col("code").alias(f"_{prefix}code"), F.col("lang_id").alias(f"{prefix}lang_id"))
    return df.join(F.broadcast(table), F.col(code) == F.col(f"_{prefix}code"), "left").drop(f"_{prefix}code")


def descends_from(ancestors: Column, other: Column) -> Column:
    """Whether a language, by its ancestors, is or comes from another."""
    return F.array_contains(ancestors, other)


def strictly_descends_from(lang_id: Column, ancestors: Column, other: Column) -> Column:
    return descends_from(ancestors, other) & (lang_id != other)
