"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of our own, on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/storyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._storyloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`cut` that nothing reads any more."""
    path = getattr(df, "_storyloom_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
