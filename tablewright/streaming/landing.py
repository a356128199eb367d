"""A table that streaming batches land in exactly once: data first, then a manifest entry that makes it count.

A batch writes its rows to a folder of its own and then renames a finished entry into the manifest. Only folders that an
entry names are read, so a batch that dies on the way leaves nothing behind that counts, and a batch that is played again
finds its entry and does nothing. An entry may say that it replaces all before it: a table in complete mode, or one that
has been compacted. What it replaces is deleted after it counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANIFEST = "_entries"


class LandingTable:
    """Rows of batches under a path of any file system that Spark writes to; `batch` is added to each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        root = self.hadoop.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def entry_path(self, batch: int, temporary: bool = False):
        return self.hadoop.Path(f"{self.path}/{MANIFEST}/{'.' if temporary else ''}{batch:012d}{'-' + uuid.uuid4().hex if temporary else ''}")

    def landed(self, batch: int) -> bool:
        return self.fs.exists(self.entry_path(batch))

    def entries(self) -> list[dict]:
        """The entries that count, oldest first: the newest that replaces others, and those after it. One for each batch since."""
        folder = self.hadoop.Path(f"{self.path}/{MANIFEST}")
        if not self.fs.exists(folder):
            return []
        found = []
        for status in self.fs.listStatus(folder):
            if not status.getPath().getName().startswith("."):
                stream = self.fs.open(status.getPath())
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
                stream.close()
        found.sort(key=lambda e: e["batch"])
        newest = max((i for i, e in enumerate(found) if e["replaces"]), default=0)
        return found[newest:]

    def land(self, rows: DataFrame, batch: int, replaces: bool = False) -> bool:
        """Write a batch, unless it has landed before; whether it was written."""
        if self.landed(batch):
            return False
        data = f"{self.path}/data-{batch:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(data)
        before = self.entries() if replaces else []
        self.commit({"batch": batch, "data": data, "schema": rows.schema.json(), "replaces": replaces})
        for old in before:
            self.fs.delete(self.hadoop.Path(old["data"]), True)
            self.fs.delete(self.entry_path(old["batch"]), False)
        return True

    def commit(self, entry: dict) -> None:
        temporary = self.entry_path(entry["batch"], temporary=True)
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if not self.fs.rename(temporary, self.entry_path(entry["batch"])):
            self.fs.delete(temporary, False)
            raise RuntimeError(f"batch {entry['batch']} has landed meanwhile")

    def read(self) -> DataFrame | None:
        """All rows that count, with their batch; None before the first."""
        out = None
        for entry in self.entries():
            rows = self.spark.read.parquet(entry["data"]).withColumn("batch", F.lit(entry["batch"]).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def latest(self, *key: str) -> DataFrame | None:
        """Of each key the row of its newest batch: the table that updates by key add up to."""
        rows = self.read()
        if rows is None:
            return None
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
        return rows.withColumn("__n", nth).filter("__n = 1").drop("__n", "batch")

    def compact(self, *key: str) -> None:
        """Bring all batches up to the newest together as one entry, each key's newest row only; readers see the same before and after."""
        entries = self.entries()
        if len(entries) < 2:
            return
        rows = self.latest(*key)
        newest = entries[-1]
        data = f"{self.path}/data-{newest['batch']:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(data)
        entry = self.entry_path(newest["batch"])
        temporary = self.entry_path(newest["batch"], temporary=True)
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"batch": newest["batch"], "data": data, "schema": rows.schema.json(), "replaces": True}).encode()))
        stream.close()
        context = self.hadoop.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(temporary, entry, options)
        for old in entries:
            self.fs.delete(self.hadoop.Path(old["data"]), True)
            if old["batch"] != newest["batch"]:
                self.fs.delete(self.entry_path(old["batch"]), False)
