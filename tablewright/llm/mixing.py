"""Mixing sources to target weights by pivotal dependent rounding of each document's copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import materialise

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Documents or residuals that are paired in one go. Bounds the array that a task holds.
FAN_IN = 64


def ordered_numbers(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows, one for each value of `column`, with the value's place in code point order from 1, null last.

    Ranges of values are sorted apart; the driver gets the number of rows of each range.
    """
    at = F.monotonically_increasing_id()
    rows = materialise(rows.orderBy(F.col(column).asc_nulls_last()).withColumn("__at", at), "mix-order")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = {}, 0
    for r in sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.p):
        before[r.p], total = total, total + r.n
    start = F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p])[part] if before else F.lit(0)
    return rows.withColumn(name, inside + start + 1).drop("__at")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words for each row of sizes (source, source_size, one row a source): by weight, at most `most` times its size.

    Sources in code point order, null last, take the weights in turn. What a source can't take goes to the rest by
    weight until none is above its limit: in each round the level is what is left for the sources that aren't full, over
    their weights, and those whose limit lies below it become full; rounds end when none does. The driver sees sums.
    """
    t = ordered_numbers(sizes, "source", "i")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int"))
    t = materialise(t.withColumn("weight", w).withColumn("limit", F.lit(float(most)) * F.col("source_size")).drop("i"), "mix-weights")
    goal = float(share) * (t.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        ends = F.col("limit") <= F.lit(level) * F.col("weight")
        n, taken, rest = t.agg(F.count_if(ends), F.sum(F.when(ends, F.col("limit"))), F.sum(F.when(~ends, F.col("weight")))).first()
        if not rest or n == full:
            break
        full, level = n, max(level, (goal - (taken or 0.0)) / rest)
    return t.select("source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"))


def pivot_fold(items: Column, seed: int) -> Column:
    """Fold an array of struct(o, size, x), x in (0, 1), by pivotal steps; returns struct(carry, done).

    carry is the document that is still fractional, done holds (o, size, x) with x 0 or 1. In a step the carry and the
    next document exchange words: one gains what the other gives, either way, until one of them reaches 0 or 1. The
    way is drawn with the odds that keep both expectations; the draw is a hash of both keys, so reruns agree.
    """
    empty = F.array().cast("array<struct<o:binary,size:bigint,x:double>>")
    none = F.lit(None).cast("struct<o:binary,size:bigint,x:double>")
    made = lambda o, size, x: F.struct(o.alias("o"), size.alias("size"), x.alias("x"))

    def step(state: Column, b: Column) -> Column:
        a = state["carry"]
        up = F.least((1.0 - a["x"]) * a["size"], b["x"] * b["size"])  # words that can go from b to a
        down = F.least(a["x"] * a["size"], (1.0 - b["x"]) * b["size"])  # and from a to b
        u = F.pmod(F.xxhash64(a["o"], b["o"], F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        to_a = u * (up + down) < down
        a_ends = F.when(to_a, (1.0 - a["x"]) * a["size"] <= b["x"] * b["size"]).otherwise(
            a["x"] * a["size"] <= (1.0 - b["x"]) * b["size"]
        )
        ended = F.when(a_ends, to_a.cast("double")).otherwise((~to_a).cast("double"))  # where the one that ends does
        shift = F.when(to_a, up).otherwise(-down)
        a_left = made(a["o"], a["size"], a["x"] + shift / a["size"])
        b_left = made(b["o"], b["size"], b["x"] - shift / b["size"])
        one = F.when(a_ends, made(a["o"], a["size"], ended)).otherwise(made(b["o"], b["size"], ended))
        carry = F.when(a_ends, b_left).otherwise(a_left)
        # both may end at once: the carry is then 0 or 1 too and the next step leaves it so
        return F.when(a.isNull(), F.struct(b.alias("carry"), state["done"].alias("done"))).otherwise(
            F.struct(carry.alias("carry"), F.concat(state["done"], F.array(one)).alias("done"))
        )

    return F.aggregate(items, F.struct(none.alias("carry"), empty.alias("done")), step)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of each row of docs a mix takes, so that every source comes to its target.

    A document's size is its number of words. Each source's rate is target / its size; every document gets the whole
    part as copies, and the fraction is rounded to 0 or 1 copy more by pivotal steps that keep the source's words: in
    arrays of FAN_IN documents first, then among the one document that each array leaves fractional, and so on, a tree
    that ends with one per source. That last one is taken in part, to the nearest word.

    Returns doc_id, source, size, source_size, target, taken (words, repeats counted) and the columns `keep`, but for
    those that bear one of these names.
    A null or blank text has size 0 and takes 0. A null source is a source of its own, ordered last. Repeated rows are
    rows of their own; which of two equal rows is taken more often is open, their sum is not. If all sizes are 0,
    targets and takes are 0. An empty table gives no rows.

    Only sizes and keys go through the tree; texts are shuffled once, to meet their number of copies.
    """
    keep = [c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    kept = [F.col(f"`{c}`").alias(f"keep_{n}") for n, c in enumerate(keep)]
    names = [f"keep_{n}" for n in range(len(keep))]
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *kept,
    )
    full, base = base, materialise(base.select("doc_id", "source", "size"), "mix-sizes")
    full = full if keep else base  # what is kept, whole texts perhaps, is read again at the end and not written here
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sizes = materialise(sizes, "mix-sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    rates = targets.alias("t").join(sizes.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select(
        F.col("t.source").alias("rate_source"), F.col("t.source_size"), "target", "docs",
        F.when(F.col("t.source_size") > 0, F.col("target") / F.col("t.source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    rates = materialise(rates, "mix-rates")
    most_docs = sizes.agg(F.max("docs")).first()[0] or 0

    def rated(sized: DataFrame) -> DataFrame:
        """With rates, whole copies and the fraction x; o orders and names a document, source and all."""
        rows = sized.join(rates, F.col("source").eqNullSafe(F.col("rate_source"))).drop("rate_source")
        x = F.col("rate") - F.floor("rate")
        rows = rows.withColumn("whole", F.floor("rate")).withColumn("x", F.when(F.col("size") > 0, x).otherwise(F.lit(0.0)))
        return rows.withColumn("o", F.unhex(F.md5(F.to_json(F.struct("doc_id", "size", "source", F.lit(seed))))))

    fractional = rated(base).filter("x > 1e-9 AND x < 1 - 1e-9")
    live = fractional.groupBy("source", "o", "size", "x", "docs").agg(F.count(F.lit(1)).alias("n"))
    live = live.select("source", "docs", "size", "x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "o")
    live = live.withColumn("o", F.concat(F.col("o"), F.encode(F.col("copy").cast("string"), "utf-8"))).drop("copy")
    done, level, left = [], 0, int(most_docs)
    while True:
        several = F.ceil(F.col("docs") / F.lit(float(FAN_IN) ** (level + 1)))
        dealt = live.withColumn("node", F.pmod(F.xxhash64("o", F.lit(level)), several))
        folded = (
            dealt.groupBy("source", "docs", "node")
            .agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("o", F.lit(seed)).alias("h"), "o", "size", "x"))).alias("all"))
            .select("source", "docs", pivot_fold(F.transform("all", lambda e: F.struct(e["o"].alias("o"), e["size"].alias("size"), e["x"].alias("x"))), seed).alias("f"))
        )
        folded = materialise(folded, f"mix-level{level}")
        done.append(folded.select(F.explode("f.done").alias("d")).select("d.o", "d.x"))
        live = folded.select("source", "docs", "f.carry.o", "f.carry.size", "f.carry.x")
        left, level = -(-left // FAN_IN), level + 1
        if left <= 1:
            break
    ended = live.select("o", "x")
    for d in done:
        ended = ended.unionByName(d)
    # of equal rows so many take one copy more, and one at most a part of it
    part = (F.col("x") > 0) & (F.col("x") < 1)
    ended = ended.groupBy(F.substring("o", 1, 16).alias("key")).agg(F.count_if(F.col("x") == 1).alias("ones"), F.max(F.when(part, F.col("x"))).alias("part"))
    joined = rated(full).join(ended, F.col("o") == F.col("key"), "left")
    nth = F.row_number().over(Window.partitionBy("o").orderBy("doc_id", F.xxhash64("size", *names)))
    more = F.when(nth <= F.col("ones"), 1.0).when(nth == F.col("ones") + 1, F.coalesce("part", F.lit(0.0))).otherwise(0.0)
    copies = F.col("whole") + F.when(F.col("key").isNull(), F.round("x")).otherwise(more)
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target",
        F.least(F.round(F.col("copies") * F.col("size")), F.lit(float(most)) * F.col("size")).cast("long").alias("taken"),
        *[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)],
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    rest = F.element_at(F.split(F.concat(text, F.lit(" ")), SPACE, n + F.when(F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")), 2).otherwise(1)), -1)
    return F.rtrim(F.left(text, F.length(text) - F.length(rest) + 1))
