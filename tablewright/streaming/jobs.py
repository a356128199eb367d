"""Structured Streaming jobs: progress, scoreboards, sessions, retention and field search, kept up to date as files arrive."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tablewright.operators import labels
from tablewright.streaming.landing import LandingTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def progress(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """M3: events by kind and tumbling window; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def scoreboard(events: DataFrame) -> DataFrame:
    """M2: per user how many events came and how many of them had a value above the middle. Updates by key `user_id`."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("applied"), F.count_if(F.col("value") > 50).alias("reconciled"))


class SessionCloser(StatefulProcessor):
    """Keeps a user's open sessions and closes each once no event can come any more that would prolong it. A user has one timer, for the
    session that ends first; when it expires, all that the watermark has passed are closed and it is set for the next."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", StructType([StructField(c, LongType()) for c in ("start", "last", "n")]))

    def ends(self, last: int) -> int:
        return math.ceil((last + self.gap_us) / 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t.value // 1000) for part in rows for t in part["ts"])
        spans = sorted([tuple(s) for s in self.open.get()] + [(t, t, 1) for t in times])
        merged: list[tuple[int, int, int]] = []
        for start, last, n in spans:
            if merged and start - merged[-1][1] < self.gap_us:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]), n + merged[-1][2])
            else:
                merged.append((start, last, n))
        self.open.put(merged)
        first, timers = min(self.ends(last) for _, last, _ in merged), set(self.handle.listTimers())
        for at in timers - {first}:
            self.handle.deleteTimer(at)
        if first not in timers:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = [tuple(s) for s in self.open.get()]
        done, left = [s for s in spans if self.ends(s[1]) <= now], [s for s in spans if self.ends(s[1]) > now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(self.ends(last) for _, last, _ in left))
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "start": [s[0] for s in done], "end": [s[1] + self.gap_us for s in done], "n": [s[2] for s in done]})

    def close(self) -> None:
        pass


def idle_sessions(events: DataFrame, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """M4: a user's events until an idle gap, as a session (user_id, start, end, n). It comes when its timer expires, by the watermark of
    all users' events: no later event of that user is needed. State holds a user's open sessions only. Needs `rocksdb`."""
    out = (
        events.filter("user_id IS NOT NULL AND ts IS NOT NULL")
        .select("user_id", "ts")
        .withWatermark("ts", late)
        .groupBy("user_id")
        .transformWithStateInPandas(SessionCloser(gap_seconds * 1_000_000), "user_id long, start long, end long, n long", outputMode="Update", timeMode="EventTime")
    )
    return out.select("user_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")


class Retainer(StatefulProcessor):
    """Keeps the newest entities of its share and all busy ones; says what came or changed and what it evicted."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = lambda name, kind: StructType([StructField(name, kind)])
        self.known = handle.getMapState("known", one("entity", LongType()), StructType([StructField("seq", LongType()), StructField("busy", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}  # bounded: `keep` and the busy ones
        changed = set()
        for part in rows:
            for entity, seq, busy in zip(part["entity"].tolist(), part["seq"].tolist(), part["busy"].tolist(), strict=True):
                if entity not in known or seq > known[entity][0]:
                    known[entity] = (seq, bool(busy))
                    changed.add(entity)
        newest = sorted(known, key=lambda e: (-known[e][0], e))
        evicted = [e for e in newest[self.keep :] if not known[e][1]]
        for entity in changed - set(evicted):
            self.known.updateValue((entity,), known[entity])
        for entity in evicted:
            if self.known.containsKey((entity,)):
                self.known.removeKey((entity,))
        out = [(e, *known[e], False) for e in changed - set(evicted)] + [(e, *known[e], True) for e in evicted]
        if out:
            yield pd.DataFrame(out, columns=["entity", "seq", "busy", "evicted"])

    def close(self) -> None:
        pass


def retention(events: DataFrame, keep: int, shares: int = 16) -> DataFrame:
    """M5: of a stream (entity, seq, busy) the newest `keep` entities are kept, older ones evicted, busy ones spared, each as its newest
    row says. Entities are dealt to `shares`, each of which keeps `keep` at most and its busy ones, so that no task sees all; updates by
    key `entity`, which `kept` brings down to the newest of all shares. Needs `rocksdb`."""
    share = F.pmod(F.xxhash64("entity"), F.lit(shares)).alias("share")
    own = events.filter("entity IS NOT NULL AND seq IS NOT NULL").select(share, "entity", "seq", F.coalesce("busy", F.lit(False)).alias("busy"))
    return own.groupBy("share").transformWithStateInPandas(Retainer(keep), "entity long, seq long, busy boolean, evicted boolean", outputMode="Update", timeMode="None")


def kept(table: LandingTable, keep: int) -> DataFrame | None:
    """M5: the entities that stay: the newest `keep` of what the shares kept, and busy ones."""
    rows = table.latest("entity")
    if rows is None:
        return None
    rows = rows.filter("NOT evicted").drop("evicted")
    return rows.orderBy(F.desc("seq"), "entity").limit(keep).unionByName(rows.filter("busy")).distinct()


def rocksdb(start: Callable[[], StreamingQuery], spark) -> StreamingQuery:
    """Start a stream with its state in RocksDB; the session's own setting is put back, for a stream takes its settings along."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_to_table(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Every finished batch lands exactly once in the `LandingTable` at path, and a restart goes on from the checkpoint. In complete
    mode a batch replaces what was there, in update mode the newest row of a key counts (`latest`)."""
    spark = out.sparkSession
    land = lambda batch, k: LandingTable(batch.sparkSession, path).land(batch, k, replaces=mode == "complete")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land)
    return rocksdb(writer.start, spark)


def field_search(pages: DataFrame, fields: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """M1: label search on pages (doc_id, page, text, ts) as they arrive; the same text of a document's page counts once, within the
    watermark. Each batch's graded fields land in the table at path."""
    own = pages.withColumn("hash", F.sha1("text")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["doc_id", "page", "hash"])

    def search(batch: DataFrame, k: int) -> None:
        table = LandingTable(batch.sparkSession, path)
        if not table.landed(k):
            rows = batch.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
            table.land(labels.graded_fields(rows, fields), k)

    writer = own.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(search)
    return rocksdb(writer.start, pages.sparkSession)
