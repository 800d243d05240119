"""The folder that driver and executors share, and tables settled there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, an error on a cluster, whose machines share no local folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='wardline-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def settle(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder, their lineage cut: read as often as needed and computed once."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder as Parquet, and their reader.

    Unlike settle() the reader has no partitioning or order of its own, and is planned by the size of its files: a checkpoint keeps the estimate of its plan,
    which knows nothing of explode(), so that millions of exploded rows may pass for some kB and be broadcast through the driver.
    """
    at = f"{shared_dir(rows.sparkSession)}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
