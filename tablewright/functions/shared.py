"""Tables written to the folder that driver and executors share, to cut lineage or to read a costly result twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tablewright.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
        spark.conf.set("tablewright.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/tablewright-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
