"""Dump shards as a stream: each new file's admissible entries are appended to a table of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigraph.operators.ingest import entries
from lexigraph.sources.langs import Langs

COLUMNS = ("batch_no", "line_no", "lang_id", "term", "page_term", "pos", "gloss", "ety_num", "romanization", "is_reconstructed")


def append_entries(spark: SparkSession, folder: str, out: str, checkpoint: str, langs: Langs) -> StreamingQuery:
    """Reads the shards that have come since the last run and ends; a shard is taken once, its batch written to a folder of its own so that a repeated batch replaces itself."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("raw"))

    def write(batch: DataFrame, number: int) -> None:
        v = F.parse_json("raw")
        parsed = batch.select(F.monotonically_increasing_id().alias("line_no"), v.alias("v")).withColumn("is_redirect", F.try_variant_get("v", "$.redirect", "variant").isNotNull())
        rows = entries(parsed, langs).drop("v")
        rows.withColumn("batch_no", F.lit(number)).select(*COLUMNS).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
