"""Tables that a job writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a written table is broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session has none: a folder made for it under a local master, whose
    one process is driver and executor; on a cluster its warehouse, unless that is a folder of each machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if re.match(r"file:|/", warehouse):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; the warehouse {warehouse} may be one of each machine")
        folder = f"{warehouse}/shared"
    return folder.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back, for plans that need it several times."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table may be broadcast, by a count of its rows."""
    return df.limit(most + 1).count() <= most


def small_or_merged(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with the hint for its join: broadcast behind a count of its rows, else merge."""
    return df.hint("broadcast" if small(df, most) else "merge")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """The distinct values of ``key`` with their rank from 1: ranks inside ranges, and the sizes of the ranges before, of
    which there are as many as tasks."""
    dealt = kept(df.select(key).distinct().repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ahead = dealt.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    rank = F.row_number().over(W.partitionBy("__range").orderBy(key))
    return dealt.withColumn("__rank", rank).join(ahead.hint("broadcast"), "__range").select(key, (F.col("__rank") + F.col("__ahead")).cast("int").alias(out))
