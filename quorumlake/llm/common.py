"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run in this process.

    On a cluster without that setting it is an error: executors don't see each other's local folders.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _roots[app] = f"{base or 'file://' + tempfile.mkdtemp(prefix='quorumlake-')}/quorumlake-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM has already gone at exit; the folder then stays
        pass


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave, when all that was made of them is stored itself: nothing can be made anew from them after that."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def numbered_copies(df: DataFrame, *keys: str) -> DataFrame:
    """One row per row of ``df`` with a ``copy`` number among equal rows.

    Equal rows are counted first, so that a hash over the keys and ``copy``
    spreads a row that is repeated very often.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .drop("copies")
    )


def running(rows: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """``rows`` with before, the sum of ``value`` over the rows of their ``group`` that come before them in ``order``.

    Rows lie in sorted ranges; what stands before a range is a sum over ranges, not over rows. ``order`` has no ties.
    """
    laid = written(rows.repartitionByRange(F.col(group), *order).withColumn("range", F.spark_partition_id()))
    per = laid.groupBy("range", group).agg(F.sum(value).alias("in_range"))
    earlier = F.sum("in_range").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("range", group, F.coalesce(earlier, F.lit(0)).alias("in_earlier"))
    within = F.sum(value).over(Window.partitionBy("range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = laid.withColumn("in_own", F.coalesce(within, F.lit(0))).join(per, ["range", group])
    return out.withColumn("before", F.col("in_own") + F.col("in_earlier")).drop("range", "in_own", "in_earlier")


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, math.ceil(rows / per_shard))
