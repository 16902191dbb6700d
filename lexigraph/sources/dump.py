"""Dictionary dumps: lines of JSON, items and redirects, request lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.runtime import dense_ids, materialize, small


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): the lines of .jsonl or .jsonl.gz files, numbered from 0 in the order of path and offset.

    Written once, since line numbers are item ids' origin and must not change
    when a lost executor makes a task run again.
    """
    lines = materialize(
        spark.read.text(path).select(
            F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")
        )
    )
    # a row for each block of a file: numbered in one place, and sent to all only if they are few
    nth = F.row_number().over(Window.orderBy("file", "block"))
    order = materialize(lines.select("file", "block").distinct().withColumn("nth", nth.cast("long")))
    placed = lines.join(small(order), ["file", "block"]).select("raw", "nth", "seq")
    return materialize(dense_ids(placed, "line_no", ["seq"], F.col("nth")).select("line_no", "raw"))


def field(v: str | Column, key: str, kind: str = "variant") -> Column:
    """A key of a VARIANT; null if it is absent or of another type."""
    return F.try_variant_get(v, f"$['{key}']", kind)


def strict_string(v: Column) -> Column:
    """The value of a VARIANT if it is a JSON string, else null: numbers and booleans aren't coerced."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def strict_byte(v: Column) -> Column:
    """The value of a VARIANT if it is an integer from 0 to 255, else null."""
    n = F.try_variant_get(v, "$", "long")
    return F.when(F.schema_of_variant(v).isin("BIGINT", "TINYINT", "SMALLINT", "INT") & n.between(0, 255), n.cast("int"))


def parse(lines: DataFrame) -> DataFrame:
    """(line_no, v, is_redirect): each line as a VARIANT; a line that isn't JSON fails the job. A record is a redirect if it has the key, whatever its value."""
    v = F.parse_json("raw")
    return lines.select("line_no", v.alias("v")).withColumn("is_redirect", F.try_variant_get("v", "$.redirect", "variant").isNotNull())


def count_records(lines: DataFrame) -> DataFrame:
    """(n_lines, n_records): lines, and those of them that are JSON."""
    return lines.agg(F.count("*").alias("n_lines"), F.count(F.try_parse_json("raw")).alias("n_records"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(lang, term) of a CSV file without a header."""
    return spark.read.csv(path, header=False, schema="lang string, term string")


def requested_lines(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """The lines, unchanged, whose language code and word are asked for."""
    keys = parse(lines).select("line_no", strict_string(field("v", "lang_code")).alias("lang"), strict_string(field("v", "word")).alias("term"))
    wanted = keys.join(small(requests.distinct()), ["lang", "term"], "left_semi").select("line_no")
    return lines.join(wanted, "line_no", "left_semi")
