"""What the corpus operators share: reading tables, cutting lineage, ranking rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a local master
    gets a temporary one; on a cluster, whose executors could not share it, that is an
    error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, *order, name: str) -> DataFrame:
    """``df`` with its 0-based place in a global order, without gathering it in one task.

    Rows are range-partitioned and sorted, each partition counts its own, and the running
    sums of those counts (a row for each partition) shift the places within partitions.
    The sorted rows are checkpointed, so that a retry sees the same partitions.
    """
    part, first = f"{name}__part", f"{name}__first"
    rows = checkpointed(df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id() - (F.col(part).cast("long") * F.lit(1 << 33))))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(first))
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(first)).drop(part, first)


def string_column(batch, name: str) -> list:
    """A column of an Arrow batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
