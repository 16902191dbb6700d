"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Folders made for each application, which `clear` removes.
_made: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python functions import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    path = f"{shared_dir(spark)}/lexigraph_ship.zip"
    _made[app].pop()  # stays as long as the application
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(buffer.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one the cluster shares, spark.checkpoint.dir. Where that is unset, as in tests, a temporary one, but on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lexigraph-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; to be called when no DataFrame made so far is needed any more."""
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    for path in _made.pop(app, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage ends there, and lost executors cost nothing that is written."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Estimated bytes of a side that joins broadcast at most; larger ones shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate of it is below the limit; as it is otherwise."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by the columns into as many parts as keep all cores busy, for costly work on rows that are few bytes: a small file is one task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *columns)


def dense_ids(df: DataFrame, column: str, order: list[str], bucket: Column, start: int = 0) -> DataFrame:
    """df with a gapless id from start on, in the order of the columns.

    bucket is a non-decreasing function of that order.  Rows are numbered within
    buckets, so no window spans the table; one spans a count for each bucket.
    df is read twice and must be materialized.
    """
    numbered = df.withColumn("_bucket", bucket)
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = numbered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = materialize(counts.select("_bucket", (F.coalesce(before, F.lit(0)) + start).alias("_offset")))
    row = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return numbered.join(small(offsets), "_bucket").withColumn(column, F.col("_offset") + row - 1).drop("_bucket", "_offset")
