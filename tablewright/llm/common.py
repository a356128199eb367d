"""What several operators of this subpackage share: the shared folder, cut lineage, ranks without one large window, joins on hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A key with more than a row in so many is hot: there are fewer hot keys than this, whatever the table.
HOT_SHARE = 200


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tablewright.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
        spark.conf.set("tablewright.shared.dir", folder)
    return folder.rstrip("/")


def small_batches(df: DataFrame) -> None:
    """Bound what goes to Python at a time, for texts may be long: few rows, and few bytes but for a single long text.

    Spark has these bounds for a session only; every operator here sets the same, so that none depends on another.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/tablewright-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read again. A lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote and that no plan still to run reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(n_rows: int) -> int:
    """As many buckets as there are rows in each: both levels of a rank grow as the square root of the rows."""
    return max(1, math.isqrt(max(0, n_rows - 1)) + 1)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    amount: Column,
    name: str,
    n_rows: int,
    spread: Sequence[str],
) -> DataFrame:
    """Sum of `amount` over the rows of the same keys up to and with each row, in an order of (hash bucket, `order`).

    No window holds all rows of a key: rows are dealt to buckets by a hash of the columns `spread`, summed inside a
    bucket, and the sums of the buckets before it are added. `order` must make rows distinct for a result that reruns
    repeat; rows equal in all of it are interchangeable. `n_rows`: about how many rows df has.
    """
    keys = list(keys)
    bucket, before = f"__b_{name}", f"__o_{name}"
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*spread, F.lit(name)), F.lit(buckets_for(n_rows))).cast("int"))
    sums = dealt.groupBy(*keys, bucket).agg(F.sum(amount).cast("long").alias("__s"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.withColumn(
        before, F.sum("__s").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")
    ).drop("__s")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn(name, F.sum(amount).over(inside).cast("long"))
    a, b = dealt.alias("a"), sums.alias("b")
    on = F.col(f"a.{bucket}") == F.col(f"b.{bucket}")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    kept = [F.col(f"a.{c}") for c in dealt.columns if c not in (name, bucket)]
    return a.join(b, on).select(*kept, (F.col(f"a.{name}") + F.col(f"b.{before}")).alias(name))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, n_rows: int, spread: Sequence[str]) -> DataFrame:
    """Rank from 1, without gaps, among the rows of the same keys; see `running`."""
    return running(df, keys, order, F.lit(1), name, n_rows, spread)


def hot_keys(counts: DataFrame, key: str, count: str, n_rows: int) -> DataFrame:
    """(key, salts): keys that hold more than one of HOT_SHARE rows, under HOT_SHARE of them, and parts to split each into."""
    share = max(1.0, n_rows / HOT_SHARE)
    return counts.filter(F.col(count) > share).select(key, F.ceil(F.col(count) / F.lit(share)).alias("__salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """left.join(right, key): a hot key's rows of left are dealt over its parts by a hash of `spread`, right's row goes to each part.

    `hot` is what `hot_keys` returns, so it may be broadcast; right has few rows of a key.
    """
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    own = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), salts)).drop("__salts")
    other = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__salts")
    return own.join(other, [key, "__salt"], how).drop("__salt")
