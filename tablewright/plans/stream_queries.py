"""Queries that run the streams: tables are laid down as files that arrive one after the other, some rows late or twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.shared import new_path
from tablewright.plans.document_queries import FIELDS, GRADED
from tablewright.sources.derived import statement_lines, table
from tablewright.streaming import jobs
from tablewright.streaming.landing import LandingTable


def arriving(parts: list[DataFrame], at: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Parts arrive one after the other, each in as many files as tasks write; the stream stops after each and goes on from its checkpoint."""
    spark = parts[0].sparkSession
    for k, part in enumerate(parts):
        part.write.parquet(f"{at}/in/part={k}")
        start(spark.readStream.schema(parts[0].schema).parquet(f"{at}/in/part=*")).awaitTermination()


def landed(parts: list[DataFrame], at: str, job: Callable[[DataFrame], DataFrame], mode: str = "append") -> LandingTable:
    arriving(parts, at, lambda stream: jobs.run_to_table(job(stream), f"{at}/out", f"{at}/ck", mode))
    return LandingTable(parts[0].sparkSession, f"{at}/out")


def events(spark, sf):
    """Three parts in order of time; with the last come some of the first events again, far too late."""
    own = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    lo, hi = own.agg(F.min("ts"), F.max("ts")).first()
    cut = [lo + (hi - lo) * k / 3 for k in (1, 2)]
    ts = F.col("ts")
    late = own.filter(ts < F.lit(lo + (hi - lo) / 50))
    return [own.filter(ts < F.lit(cut[0])), own.filter((ts >= F.lit(cut[0])) & (ts < F.lit(cut[1]))), own.filter(ts >= F.lit(cut[1])).unionByName(late)]


def progress(spark, sf):
    return plain_times(landed(events(spark, sf), new_path(spark, "progress"), jobs.progress).read().drop("batch"))


def plain_times(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def sessions(spark, sf):
    return plain_times(landed(events(spark, sf), new_path(spark, "sessions"), jobs.idle_sessions, "update").read().drop("batch"))


def scoreboard(spark, sf):
    """Updates of each batch; the last of each user holds, before and after they are brought together."""
    out = landed(events(spark, sf), new_path(spark, "scoreboard"), jobs.scoreboard, "update")
    out.compact("user_id")
    return out.latest("user_id")


def incremental(spark, sf):
    """Totals kept whole: each batch replaces the table of the one before."""
    totals = lambda s: s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return landed(events(spark, sf), new_path(spark, "rows"), totals, "complete").read().drop("batch")


def search(spark, sf):
    """Statements arriving as pages, a third of them twice."""
    at = new_path(spark, "search")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = statement_lines(spark, sf).groupBy("doc_id", "page").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    pages = pages.withColumn("ts", F.timestamp_seconds(F.col("doc_id") % 3600 + 1))
    parts = [pages.filter("doc_id % 3 < 2"), pages.filter("doc_id % 3 > 0")]
    arriving(parts, at, lambda stream: jobs.field_search(stream, FIELDS, f"{at}/out", f"{at}/ck"))
    return LandingTable(spark, f"{at}/out").read().drop("batch")


def retention(spark, sf):
    parts = [p.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("busy")) for p in events(spark, sf)]
    return jobs.kept(landed(parts, new_path(spark, "retention"), lambda s: jobs.retention(s, 10), "update"), 10)


QUERIES = {
    "stream_progress": progress,
    "stream_scoreboard": scoreboard,
    "stream_idle_sessions": sessions,
    "stream_rows": incremental,
    "stream_field_search": search,
    "stream_retention": retention,
}

# what the streams get: all events, and those of the first fiftieth of the time once more
TWICE = "b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), e AS (SELECT * FROM events UNION ALL SELECT events.* FROM events, b WHERE epoch_us(ts) < epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) / 50)"
ORACLES = {
    "stream_progress": """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(value::DECIMAL(18,2)) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1, 2)
      SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_scoreboard": f"WITH {TWICE} SELECT user_id, count(*) AS applied, count(*) FILTER (value > 50) AS reconciled FROM e GROUP BY 1",
    "stream_idle_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a),
      s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM b GROUP BY user_id, k) SELECT * FROM s WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_rows": f"WITH {TWICE} SELECT event_type, count(*) AS n, CAST(sum(value::DECIMAL(18,2)) AS DECIMAL(28,2)) AS total FROM e GROUP BY 1",
    "stream_field_search": f"{GRADED} SELECT * FROM g",
    "stream_retention": """WITH n AS (SELECT user_id AS entity, max(event_id) AS seq, arg_max(event_type, event_id) = 'error' AS busy FROM events GROUP BY 1) SELECT * FROM n QUALIFY busy OR row_number() OVER (ORDER BY seq DESC, entity) <= 10""",
}
