"""Streams: sessions closed by timers, retention within its bound, restarts, late rows, and batches that land once."""

import pytest
from pyspark.sql import functions as F

from tablewright.streaming import jobs
from tablewright.streaming.landing import LandingTable


def run(spark, at, parts, start):
    """Each part arrives in two files; the stream stops after it and goes on from its checkpoint."""
    for k, part in enumerate(parts):
        part.repartition(2).write.parquet(f"{at}/in/part={k}")
        start(spark.readStream.schema(parts[0].schema).parquet(f"{at}/in/part=*")).awaitTermination()


def times(spark, rows):
    return spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))


def sessions_of(spark, at, parts):
    run(spark, at, [times(spark, p) for p in parts], lambda s: jobs.run_to_table(jobs.idle_sessions(s, 100, "50 seconds"), f"{at}/out", f"{at}/ck", "update"))
    table = LandingTable(spark, f"{at}/out")
    rows = [] if table.read() is None else table.read().select("batch", "user_id", F.unix_timestamp("start").alias("a"), F.unix_timestamp("end").alias("b"), "n").collect()
    return {(r.user_id, r.a, r.b, r.n) for r in rows}


def test_a_session_closes_by_its_timer_without_a_later_event_of_its_user(spark, tmp_path):
    got = sessions_of(spark, f"file://{tmp_path}", [[(1, 1000), (1, 1090)], [(2, 1300)]])
    assert got == {(1, 1000, 1190, 2)}  # user 1 has no event in the second part; user 2's session is still open


def test_sessions_go_on_over_a_restart_and_late_events_join_or_are_dropped(spark, tmp_path):
    parts = [[(1, 1000), (1, 1300), (2, 1010)], [(1, 1260), (1, 1390), (1, 900)], [(3, 3000)]]
    got = sessions_of(spark, f"file://{tmp_path}", parts)
    # 1260 is before the watermark of 1250 no more and joins 1300 and 1390; 900 is too late
    assert got == {(1, 1000, 1100, 1), (2, 1010, 1110, 1), (1, 1260, 1490, 3)}


def test_sessions_that_meet_become_one(spark, tmp_path):
    got = sessions_of(spark, f"file://{tmp_path}", [[(1, 1000), (1, 1140)], [(1, 1095), (1, 1130)], [(2, 5000)]])
    assert got == {(1, 1000, 1240, 4)}


def test_an_event_at_the_gap_opens_a_new_session(spark, tmp_path):
    assert sessions_of(spark, f"file://{tmp_path}", [[(1, 1000), (1, 1100)], [(2, 5000)]]) == {(1, 1000, 1100, 1), (1, 1100, 1200, 1)}


@pytest.mark.parametrize("shares", [1, 4])
def test_retention_against_plain_loops(spark, tmp_path, shares):
    parts = [[(e, 10 * p + e, (e + p) % 5 == 0) for e in range(30) if e % (p + 2)] for p in range(3)]
    at = f"file://{tmp_path}"
    frames = [spark.createDataFrame([*p, (None, 1, True)], "entity long, seq long, busy boolean") for p in parts]
    run(spark, at, frames, lambda s: jobs.run_to_table(jobs.retention(s, 6, shares), f"{at}/out", f"{at}/ck", "update"))
    known, kept = {}, {}
    for part in parts:
        known.update({e: (q, b) for e, q, b in part if e not in known or q > known[e][0]})
    newest = sorted(known, key=lambda e: (-known[e][0], e))
    kept = {e: known[e] for i, e in enumerate(newest) if i < 6 or known[e][1]}
    table = LandingTable(spark, f"{at}/out")
    got = {r.entity: (r.seq, r.busy) for r in jobs.kept(table, 6).collect()}
    assert {e: v for e, v in got.items() if not v[1]} == {e: v for e, v in kept.items() if not v[1]} and set(got) >= set(kept)
    per_share = table.latest("entity").filter("NOT evicted AND NOT busy").groupBy(F.pmod(F.xxhash64("entity"), F.lit(shares))).count().collect()
    assert all(r["count"] <= 6 for r in per_share)


def test_a_replayed_batch_lands_once(spark, tmp_path):
    table = LandingTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    assert table.read() is None and table.land(rows, 0) and not table.land(rows, 0)
    assert table.land(rows, 1) and table.read().count() == 2


def test_a_batch_that_dies_before_its_entry_counts_for_nothing(spark, tmp_path, monkeypatch):
    table = LandingTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    table.land(rows, 0)

    def dies(entry):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "commit", dies)
        with pytest.raises(OSError, match="lost"):
            table.land(rows, 1)
        with pytest.raises(OSError, match="lost"):
            table.land(rows.withColumn("v", F.lit("new")), 2, replaces=True)
    assert [r.v for r in table.read().collect()] == ["a"]  # what would have been replaced is still there
    assert table.land(rows, 1) and table.read().count() == 2


def test_a_stream_that_dies_in_the_middle_leaves_each_row_once(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}"
    parts = [spark.range(10 * k, 10 * k + 10) for k in range(3)]
    land, calls = LandingTable.land, []

    def dies_after(self, rows, batch, replaces=False):
        out = land(self, rows, batch, replaces)
        calls.append(batch)
        if len(calls) == 2:
            raise OSError("lost after landing")
        return out

    monkeypatch.setattr(LandingTable, "land", dies_after)
    with pytest.raises(Exception, match="lost after landing"):
        run(spark, at, parts[:2], lambda s: jobs.run_to_table(s.select("id"), f"{at}/out", f"{at}/ck"))
    run_again = spark.readStream.schema(parts[0].schema).parquet(f"{at}/in/part=*")
    parts[2].write.parquet(f"{at}/in/part=2")
    jobs.run_to_table(run_again.select("id"), f"{at}/out", f"{at}/ck").awaitTermination()
    assert sorted(r.id for r in LandingTable(spark, f"{at}/out").read().collect()) == list(range(30))
    assert calls.count(1) == 2  # the second batch was played again and found its entry


def test_complete_mode_replaces_and_updates_compact(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(i, i % 3, "a", float(i), 60 * i) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    parts = [events.filter("event_id < 20"), events.filter("event_id BETWEEN 20 AND 40"), events.filter("event_id > 40")]
    want = {(r.user_id, r.applied, r.reconciled) for r in jobs.scoreboard(events).collect()}
    read = lambda df: {(r.user_id, r.applied, r.reconciled) for r in df.collect()}
    run(spark, at, parts, lambda s: jobs.run_to_table(jobs.scoreboard(s), f"{at}/out", f"{at}/ck", "complete"))
    table = LandingTable(spark, f"{at}/out")
    assert read(table.read()) == want and len(table.entries()) == 1
    run(spark, f"{at}/u", parts, lambda s: jobs.run_to_table(jobs.scoreboard(s), f"{at}/u/out", f"{at}/u/ck", "update"))
    table = LandingTable(spark, f"{at}/u/out")
    assert len(table.entries()) == 3 and read(table.latest("user_id")) == want
    table.compact("user_id")
    table.compact("user_id")
    assert len(table.entries()) == 1 and read(table.latest("user_id")) == want and not table.land(events, 2)
    folders = [p.name for p in (tmp_path / "u" / "out").iterdir() if p.name.startswith("data-")]
    assert len(folders) == 1


def test_the_sessions_own_state_store_is_put_back(spark, tmp_path):
    before = spark.conf.get(jobs.PROVIDER, None)
    sessions_of(spark, f"file://{tmp_path}", [[(1, 1)]])
    assert spark.conf.get(jobs.PROVIDER, None) == before
