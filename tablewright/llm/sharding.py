"""Balanced label propagation: links between equal texts pull documents into few shards while the row counts stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import discard, hot_keys, materialise, ranked, running, salted_join


def pair_quotas(want: dict[tuple[int, int], int], load: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may move from shard a to shard b: as many as want back, and the room that b has left.

    Works on a shards x shards matrix, never on documents. Swaps keep every count; further moves take free room.
    """
    quota = {}
    for (a, b), w in want.items():
        quota[a, b] = min(w, want.get((b, a), 0))
    free = [room[s] - load[s] for s in range(len(room))]
    for a, b in sorted(want, key=lambda p: (-want[p], p)):
        more = max(0, min(want[a, b] - quota[a, b], free[b]))
        quota[a, b] += more
        free[b] -= more
        free[a] += more
    return quota


def shard_documents(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put every row of docs into one of `n_shards` shards whose row counts differ by one at most (law `rows`).

    Documents of equal text are linked. Linked documents start dealt evenly; in each round those of a group that lie
    outside its leading shards (as many as the group needs at least, those first that have room for the rest of it) ask to move there, and move as far as the quotas
    of the pair of shards allow. The state is the number of a group's documents in each shard, so a group of any size
    is a few rows. Rounds go on as long as they lessen the cut edges, the pairs of linked documents in different shards,
    whose number only falls; the round that doesn't is undone. Unlinked documents then fill what room is left.

    Returns doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law, shard, slot (from 0 in the shard, without
    gaps), grown_shard (null: only a law by key defines it), group_size (rows of that text).

    A null text counts as empty, and all empty texts are one group. Repeated rows are each placed; a null id is
    placed as any other. An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("g"),
        ),
        "shard-base",
    )
    n = base.count()
    room = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialise(sizes.filter("group_size > 1"), "shard-groups")
    hot = materialise(hot_keys(groups, "g", "group_size", n), "shard-hot")
    linked = salted_join(base, groups, "g", hot, ["doc_id"])
    linked = ranked(linked, ["g"], ["doc_id"], "in_group", n, ["doc_id"])
    linked = materialise(
        ranked(linked, [], ["g", "in_group"], "among", n, ["g", "in_group"]).withColumn("shard", ((F.col("among") - 1) % n_shards).cast("int")),
        "shard-linked",
    )
    n_linked = linked.count()
    held = materialise(linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")), "shard-held")
    load = [0] * n_shards
    squared = F.col("c").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")
    together = 0  # sum of the squares of a group's rows in a shard: the more, the fewer edges are cut
    for row in held.groupBy("shard").agg(F.sum("c").alias("c"), F.sum(squared).alias("t")).collect():  # a row for each shard
        load[row.shard], together = row.c, together + row.t

    by_group = Window.partitionBy("g")  # of a group there are at most n_shards rows
    while n_linked:
        free = F.create_map(*[x for s in range(n_shards) for x in (F.lit(s), F.lit(room[s] - load[s]))])
        fits = (F.col("k") > 1) | (F.col("all") - F.col("c") <= free[F.col("shard")])  # the rest of the group has room there
        order = by_group.orderBy(F.desc("fits"), F.desc("c"), F.xxhash64("g", "shard"))
        seen = (
            held.withColumn("all", F.sum("c").over(by_group))
            .withColumn("k", F.ceil(F.col("all") / F.lit(float(max(1, n // n_shards)))).cast("int"))
            .withColumn("fits", fits)
            .withColumn("r", F.row_number().over(order))
            .withColumn("tops", F.collect_list(F.when(F.col("r") <= F.col("k"), F.col("shard"))).over(by_group))
        )
        asks = (
            seen.filter("r > k")
            .select("g", F.col("shard").alias("a"), "c", F.size("tops").alias("k"), F.posexplode("tops").alias("j", "b"))
            .withColumn("want", (F.floor(F.col("c") / F.col("k")) + F.when(F.col("j") < F.col("c") % F.col("k"), 1).otherwise(0)).cast("long"))
            .filter("want > 0")
            .select("g", "a", "b", "want")
        )
        want = {(r.a, r.b): r.want for r in asks.groupBy("a", "b").agg(F.sum("want").alias("want")).collect()}  # shards squared
        quota = {p: q for p, q in pair_quotas(want, load, room).items() if q > 0}
        if not quota:
            break
        values = ", ".join(f"({a}, {b}, {q}L)" for (a, b), q in quota.items())
        quotas = spark.sql(f"SELECT * FROM VALUES {values} AS t(a, b, quota)")
        asks = asks.join(F.broadcast(quotas), ["a", "b"])  # at most shards squared rows
        asks = running(asks, ["a", "b"], ["g"], F.col("want"), "upto", n_linked, ["g"])
        moves = asks.withColumn(
            "c", F.greatest(F.lit(0), F.least(F.col("want"), F.col("quota") - F.col("upto") + F.col("want")))
        ).filter("c > 0")
        after = (
            held.unionByName(moves.select("g", F.col("b").alias("shard"), "c"))
            .unionByName(moves.select("g", F.col("a").alias("shard"), (-F.col("c")).alias("c")))
            .groupBy("g", "shard")
            .agg(F.sum("c").alias("c"))
            .filter("c > 0")
        )
        after = materialise(after, "shard-held")
        now = after.agg(F.sum(squared)).first()[0]
        if now <= together:
            discard(after)
            break
        discard(held)
        held, together = after, now
        for (a, b), q in quota.items():
            load[a] -= q
            load[b] += q

    spans = held.withColumn("upto", F.sum("c").over(by_group.orderBy("shard")))
    spans = spans.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("spans"))
    placed = salted_join(linked.drop("shard", "among"), spans, "g", hot, ["doc_id", "in_group"])
    placed = placed.withColumn("shard", F.expr("filter(spans, x -> in_group <= x.upto)[0].shard"))
    alone = salted_join(base, groups.select("g"), "g", hot, ["doc_id"], "left_anti")
    alone = ranked(alone, [], ["doc_id", "g"], "among", n, ["doc_id", "g"])
    shard, end = F.lit(n_shards - 1), n - n_linked
    for s in reversed(range(n_shards)):
        shard = F.when(F.col("among") <= end, F.lit(s)).otherwise(shard)
        end -= room[s] - load[s]
    alone = alone.withColumn("shard", shard).withColumn("group_size", F.lit(1).cast("long"))
    columns = ["doc_id", "size", "text_crc32", "group_size", "shard"]
    out = placed.select(*columns).unionByName(alone.select(*columns))
    out = ranked(out, ["shard"], ["doc_id", "text_crc32", "size"], "slot", n, ["doc_id", "text_crc32"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "group_size",
    )
