"""What the operators of this subpackage share: input tables and tables written in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, gives the planner true
    sizes, and survives the loss of executors. ``by``: columns by which the files are laid out. The folder belongs to
    whoever runs the cluster and is cleared with its checkpoints."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    (df.repartition(*by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, tag: str, key: str) -> Iterator[DataFrame]:
    """``df`` written in the shared folder in buckets by ``key``, so that joins by it leave it where it is. Its name is in
    the catalog only inside the ``with``."""
    spark, name = df.sparkSession, f"llm_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(2 * tasks(spark), key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows; sizes shards and partitions, never results."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0]


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def streamed_sha(parts: DataFrame, separator: str) -> DataFrame:
    """``key, sha``: the SHA-256 of each key's parts ``(key, seg, part)`` in order, joined by the separator. A running hash over sorted rows, never
    a whole text. A null part is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, None, False
        for batch in batches:
            done = []
            for k, part in zip(batch.key, batch.part, strict=True):
                if k != key:
                    done += [(key, state.hexdigest())] if state else []
                    key, state, begun = k, hashlib.sha256(), False
                if part is not None:
                    state.update(((separator if begun else "") + part).encode())
                    begun = True
            if done:
                yield pd.DataFrame(done, columns=["key", "sha"])
        if state:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "sha"])

    return parts.repartition("key").sortWithinPartitions("key", "seg").select("key", "part").mapInPandas(run, "key string, sha string")
