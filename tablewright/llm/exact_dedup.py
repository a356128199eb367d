"""Stateful streaming exact deduplication: keyed state on disk without expiry, full bytes compared on every hit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import hot_keys, materialise, new_path, salted_join

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def with_locator(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, n (code points of the original text), digest, and the place of the row: its file's hash and its row there."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n"),
        digest(normalised(F.col(text_col))).alias("digest"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )


def build_state(
    spark: SparkSession, source: str, id_col: str, text_col: str, checkpoint: str, bytes_per_batch: int, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Run the stream over what `source` holds now, and return the state: one row for each digest.

    State is kept by digest in RocksDB under `checkpoint` and never expires: the number of rows, and of the row to keep
    its length, id and locator. A later run with the same checkpoint goes on where this one ended.
    """
    schema = spark.read.parquet(source).schema
    rows = with_locator(spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source), id_col, text_col, digest)
    # the greatest of (n, -doc_id): most code points, then smallest id; a null id comes after all others
    rank = F.struct("n", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg"), (-F.col("file")).alias("f"), (-F.col("at")).alias("a"))
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.max(rank).alias("best"))
    out = f"{checkpoint}/changes"
    # without fallocate a partition's store takes only the disk that its rows need, however many partitions there are
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{checkpoint}/stream")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch={k}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.parquet(out) if query.lastProgress else None
    if changes is None:
        return spark.createDataFrame([], "digest binary, size long, best struct<n:int,has:boolean,neg:long,f:long,a:long>")
    latest = changes.groupBy("digest").agg(F.max_by(F.struct("size", "best"), "batch").alias("s"))
    return latest.select("digest", "s.size", "s.best")


def exact_dedup(
    spark: SparkSession,
    source: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    checkpoint: str | None = None,
    bytes_per_batch: int = 64 << 30,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row for each row of the Parquet files at `source` (a path or a pattern), with the row of its group that stays.

    Texts are equal when they are without white space. Of equal texts the row with the most code points stays, then
    the smallest id, then the first place in the files. Returns doc_id, keep_id, group_size, kept, text_sha256.

    The stream takes `bytes_per_batch` of files in a batch; with a `checkpoint` of an earlier run it reads only files that
    run hasn't seen, and the result is of all files. Every hit, a row whose digest another holds, is compared with the full
    bytes of that other, found by its locator; rows that differ though their digests agree are grouped by their text
    itself. A null text counts as empty, all blank texts are one group. Repeated rows are rows of their own: one is
    kept. A null id loses ties. A table without rows gives none. Other columns are not read, whatever they are called.

    A digest with a large part of all rows is split in every join; its state is one row.
    """
    checkpoint = checkpoint or new_path(spark, "dedup")
    state = build_state(spark, source, id_col, text_col, checkpoint, bytes_per_batch, digest)
    keepers = materialise(
        state.select("digest", "size", F.when(F.col("best.has"), -F.col("best.neg")).alias("keep_id"), (-F.col("best.f")).alias("keep_file"), (-F.col("best.a")).alias("keep_at")),
        "dedup-state",
    )
    hot = materialise(hot_keys(keepers, "digest", "size", keepers.agg(F.sum("size")).first()[0] or 0), "dedup-hot")
    docs = spark.read.parquet(source)
    rows = salted_join(with_locator(docs, id_col, text_col, digest), keepers, "digest", hot, ["file", "at"])
    rows = materialise(rows.withColumn("is_keeper", (F.col("file") == F.col("keep_file")) & (F.col("at") == F.col("keep_at"))), "dedup-rows")
    place = docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), normalised(F.col(text_col)).alias("norm"))
    hits = rows.filter("size > 1").select("file", "at", "digest", "is_keeper")
    texts = place.join(hits, ["file", "at"])
    held = texts.filter("is_keeper").select("digest", F.col("norm").alias("kept_norm"))
    others = texts.filter("NOT is_keeper").select("digest", "file", "at", "norm")
    compared = salted_join(others, held, "digest", hot, ["file", "at"]).filter(F.encode("norm", "utf-8") != F.encode("kept_norm", "utf-8"))
    differ = materialise(compared.select("file", "at", "norm"), "dedup-differ")
    plain = rows.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), F.col("is_keeper").alias("kept"), "digest", "file", "at", F.lower(F.hex("digest")).alias("text_sha256")
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if digest is not sha256:  # the state's key is another digest: the column is made from the texts
        own = place.select("file", "at", F.sha2("norm", 256).alias("text_sha256"))
        plain = plain.drop("text_sha256").join(own, ["file", "at"])
    if differ.isEmpty():
        return plain.select(*columns)
    # two texts share a digest: the rows unlike the keeper are grouped by text, and leave the keeper's group
    lost = differ.join(plain, ["file", "at"])
    best = lost.join(with_locator(docs, id_col, text_col, digest).select("file", "at", "n"), ["file", "at"])
    order = F.struct("n", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("d"), (-F.col("file")).alias("f"), (-F.col("at")).alias("a"))
    best = best.groupBy("norm").agg(F.count(F.lit(1)).alias("g"), F.max_by(F.struct("doc_id", "file", "at"), order).alias("b"))
    again = lost.join(best, "norm").select(
        "doc_id", F.col("b.doc_id").alias("keep_id"), F.col("g").alias("group_size"),
        ((F.col("file") == F.col("b.file")) & (F.col("at") == F.col("b.at"))).alias("kept"), "text_sha256",
    )
    fewer = lost.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    rest = plain.join(differ.select("file", "at"), ["file", "at"], "left_anti").join(fewer, "digest", "left")
    return rest.withColumn("group_size", F.col("group_size") - F.coalesce("less", F.lit(0))).select(*columns).unionByName(again)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(coalesce(text, '')) DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
