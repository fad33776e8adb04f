"""Tables that a run writes once and reads several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is named, a local one of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(spark, "_lumenstrata_tables", None) is None:
        spark._lumenstrata_tables = tempfile.mkdtemp(prefix="lumenstrata-")
    return spark._lumenstrata_tables


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a table below the scratch folder, and its path."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
