"""Session settings and lineage cuts.

Iterative operators cut their lineage by writing a table into the cluster's shared
checkpoint folder, so a lost executor costs one step and not the whole loop.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # distance joins do much work on few bytes: do not squeeze them into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # top-k per group keeps only k rows per map task before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = spark.conf.get("placekit.local.checkpoint", None)
    if not made:
        made = tempfile.mkdtemp(prefix="spark-placekit-")
        spark.conf.set("placekit.local.checkpoint", made)
    return made


_cuts: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    The stored table has true sizes, so later joins choose broadcast or shuffle on facts. A job that has stored its
    results calls ``release`` to delete what it cut on the way.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _cuts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table this driver has cut so far; frames still built on them can no longer be read."""
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), len(_cuts)
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(conf).delete(path, True)
    return gone


def spread(df: DataFrame) -> DataFrame:
    """Give a table that reads as fewer splits than there are cores a split per core.

    Tables of any size that matters already have more splits than that and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_empty(df: DataFrame) -> bool:
    return len(df.select(F.lit(1)).take(1)) == 0


def number_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Dense 1..N over a total order, without sending every row to one task.

    Rows are range partitioned and cut once; each partition is then numbered on its own
    and shifted by the sizes of the partitions before it (one row per partition).
    """
    from pyspark.sql import Window as W

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part").orderBy(*order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the running total is over at most `parts` rows
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        ranged.join(starts, "_part")
        .withColumn(name, F.row_number().over(within) + F.col("_start"))
        .drop("_part", "_start")
    )


def number_within(df: DataFrame, group: list[str], order: list, name: str = "nth") -> DataFrame:
    """1..n inside each group, in order, however large a group is.

    Rows get a global number over (group, order); a group's numbers are consecutive, so its
    smallest one (a partial minimum) turns them into 1..n.
    """
    rows = cut(number_rows(df, [*[F.col(g) for g in group], *order], "_all"))
    first = rows.groupBy(*group).agg(F.min("_all").alias("_first"))
    return rows.join(first, group).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_first")
