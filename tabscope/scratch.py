"""Written tables in the cluster's shared folder: cut lineage, survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tabscope-")
    return _local_root


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/tabscope/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table (no inference job)."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Like ``materialize``, with the path, for a table that is removed when it has been used."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, on whatever file system it is."""
    if "/tabscope/" not in path:
        raise ValueError(f"not a scratch table: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
