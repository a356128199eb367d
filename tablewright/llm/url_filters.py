"""Operator 13, URL filters through a cascade of Bloom filters: exact membership of host and path keys, without joins.

A rule is a key, its host followed by its path. The keys of a url are its host's ends at label borders, each followed by
a beginning of its path, for the numbers of labels and lengths of path that rules have. The first level of the cascade
encodes the listed keys; the second the keys of the corpus that pass it and aren't listed; the third the listed keys
that pass the second; and so on until a level lets nothing wrong pass. As the levels are built over all keys that the
corpus has, a key's first level that says no tells exactly whether it's listed. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Keys of one cascade: its first level has 10 bits for each, so a filter is at most 2.5 MB. More rules go in several cascades, one pass each.
KEYS_A_CASCADE = 1 << 21
FIRST_BITS, LATER_BITS = 10, 4
MOST_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it's null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: Column, path: Column, depths: Sequence[int], lengths: Sequence[int]) -> Column:
    """Keys of a url, longest first, for rule hosts of so many labels and rule paths of so many characters."""
    labels = F.split(host, r"\.")
    ends = [F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), ".")) for d in depths]
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.array_compact(F.array(*[F.concat(e, s) for e in ends for s in starts]))
    # of keys of one length, the longer host's first: a host holds no slash, so that is the key whose slash comes later
    ranked = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), (-F.locate("/", k)).alias("h"), k.alias("key")))
    return F.transform(F.array_sort(ranked), lambda r: r["key"])


class Level:
    """One Bloom filter: its words of 64 bits, as text of decimals, so that the plan holds one literal."""

    def __init__(self, words: str, n_bits: int, hashes: int, seed: int):
        self.words, self.n_bits, self.hashes, self.seed = words, n_bits, hashes, seed

    def says_yes(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to a constant array before the plan runs
        yes = F.lit(True)
        for at in bit_positions(key, self.n_bits, self.hashes, self.seed):
            yes = yes & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return yes


def bit_positions(key: Column, n_bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 101 + i)), F.lit(n_bits)) for i in range(hashes)]


def build_level(keys: DataFrame, n_keys: int, bits_a_key: int, seed: int) -> Level:
    """The filter of `n_keys` rows (key): its bits are gathered by word before the driver takes the words, a number bounded by KEYS_A_CASCADE."""
    n_bits = 64 * max(1, math.ceil(n_keys * bits_a_key / 64))
    hashes = max(1, round(bits_a_key * math.log(2)))
    at = keys.select(F.explode(F.array(*bit_positions(F.col("key"), n_bits, hashes, seed))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    held = {r["w"]: r["bits"] for r in words.toLocalIterator()}
    return Level(",".join(str(held.get(w, 0)) for w in range(n_bits // 64)), n_bits, hashes, seed)


class Cascade:
    """Levels over a universe of keys; `contains` is exact for keys of that universe."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    def contains(self, key: Column) -> Column:
        """True if the first level that says no is one of false positives; if all say yes, what the last level encodes."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            inside = F.when(self.levels[i].says_yes(key), inside).otherwise(F.lit(i % 2 == 1))
        return inside


def build_cascade(universe: DataFrame, first_bits: int = FIRST_BITS, later_bits: int = LATER_BITS) -> Cascade:
    """Cascade of a written table (key, listed) with each key once. Levels stop when none of the other side's keys passes the last."""
    levels: list[Level] = []
    encoded, others = universe.filter("listed").select("key"), universe.filter("NOT listed").select("key")
    n_keys = encoded.count()
    while n_keys:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"no end after {MOST_LEVELS} levels: the universe holds a key on both sides")
        levels.append(build_level(encoded, n_keys, first_bits if not levels else later_bits, len(levels)))
        # what passes wrongly is the next level's to encode, against the keys that this level encodes
        encoded, others = materialise(others.filter(levels[-1].says_yes(F.col("key"))), "cascade"), encoded
        n_keys = encoded.count()
    return Cascade(levels)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    default: str = "allow",
    keys_a_cascade: int = KEYS_A_CASCADE,
    first_bits: int = FIRST_BITS,
    later_bits: int = LATER_BITS,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    rules: (verdict, host, path) rows or DataFrame. Of the rules that fit, the one with the longest key wins, then the
    longest host; a url that none fits is `default`, for it isn't listed. A key listed to be both allowed and blocked is
    blocked. Rows with a null url or one without `://` have an empty host and path, which only a rule of that host and
    path fits. Repeated rows are judged each; other columns are dropped; an empty table or list gives no rows or no rules.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    listed = rules.groupBy(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("depth"), F.length("path").alias("length"))
    listed = materialise(listed.agg(F.max(F.col("verdict") == "block").alias("block")), "rules")
    shape = listed.agg(F.sort_array(F.collect_set("depth")).alias("d"), F.sort_array(F.collect_set("length")).alias("l"), F.count("*").alias("n")).first()
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", F.lit(None).cast("string")).withColumn("block", F.lit(False))
    if not shape["n"]:
        return judged.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"))

    parts = -(-shape["n"] // keys_a_cascade)
    keys = url_keys(F.col("host"), F.col("path"), shape["d"], shape["l"])
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    seen = judged.select(F.explode(keys).alias("key")).distinct().withColumns({"listed": F.lit(False), "block": F.lit(False)})
    both = seen.unionByName(listed.select("key", F.lit(True).alias("listed"), "block"))
    universe = materialise(both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("block").alias("block")), "universe")
    for p in range(parts):
        own = universe.filter(part_of(F.col("key")) == p)
        inside = build_cascade(own.select("key", "listed"), first_bits, later_bits)
        blocked = build_cascade(own.filter("listed").select("key", F.col("block").alias("listed")), first_bits, later_bits)
        found = F.get(F.filter(keys, lambda k: (part_of(k) == p) & inside.contains(k)), F.lit(0))  # noqa: B023
        judged = judged.withColumn("__found", found)
        longer = F.col("rule").isNull() | (F.length("__found") > F.length("rule")) | ((F.length("__found") == F.length("rule")) & (F.locate("/", "__found") > F.locate("/", "rule")))
        better = F.col("__found").isNotNull() & longer
        judged = judged.withColumns({"block": F.when(better, blocked.contains(F.col("__found"))).otherwise(F.col("block")), "rule": F.when(better, F.col("__found")).otherwise(F.col("rule"))})
        judged = judged.drop("__found")
        if p + 1 < parts:
            judged = materialise(judged, "judged")  # so that no plan holds more than one part's filters
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(F.col("block"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


ORACLE_SQL = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h0 FROM rest),
parts AS (SELECT page_id, row_number() OVER () AS row, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM hosts)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) WHERE k = 1
"""
