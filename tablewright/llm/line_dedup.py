"""Site-relative line deduplication: lines that a large part of a host's pages carry are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import hot_keys, materialise, salted_join

#: Up to so many boilerplate lines in all (about 30 bytes each) they are broadcast; more are joined by host, hot hosts in parts.
BROADCAST_LINES = 100_000


def drop_boilerplate_lines(
    docs: DataFrame, ratio: float = 0.05, min_pages: int = 2, host_col: str = "source", text_col: str = "text", distinct_pages: bool = True
) -> DataFrame:
    """docs with the lines dropped that over `ratio` of their host's pages carry; the host is column `source` of documents.

    A line is what lies between line feeds, compared without spaces at its ends; a page counts once for each line.
    Blank lines never count and always stay. A line that fewer than `min_pages` pages carry stays whatever the ratio: one
    that only a single page carries repeats nothing, though it may be a large part of a small host. Rows of one host with
    the same text are one page, so that no number of copies makes a page's own lines boilerplate; each copy still loses the
    lines that are. With `distinct_pages` false every row is a page.

    Adds n_lines and n_dropped (long), in place of columns of that name. All rows stay, a text may become empty; a null
    text stays null with 0 lines and counts as a page. Rows of null host are one host. Other columns pass through,
    whatever they are called. An empty table gives no rows.

    Lines are counted by digest with partial sums before the shuffle, so a hot host or line is a sum; the boilerplate
    of a host has at most (its lines / ratio / its pages) members. Where it is joined by host, a large host is split.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"), F.col(f"`{host_col}`").alias("h"), F.col(f"`{text_col}`").alias("t"))
    lines = F.split("t", "\n", -1)
    digest = lambda x: F.unhex(F.md5(F.trim(x)))
    distinct = F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), digest))
    paged = own.select("h", distinct.alias("lines"), F.unhex(F.md5("t")).alias("page"))
    rows = paged.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("pages"))
    if distinct_pages:
        paged = paged.groupBy("h", "page").agg(F.first("lines").alias("lines"))
        rows = own.groupBy("h", F.unhex(F.md5("t")).alias("page")).agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pages"))
    counts = paged.select("h", F.explode("lines").alias("line")).groupBy("h", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    hosts = rows.select(F.col("h").alias("host"), "rows", "pages")
    common = (
        counts.join(hosts, F.col("h").eqNullSafe(F.col("host")))
        .filter(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set("line").alias("bad"), F.max("rows").alias("rows"))
    )
    common = materialise(common, "boilerplate")
    total = common.agg(F.sum(F.size("bad"))).first()[0] or 0
    if total <= BROADCAST_LINES:
        joined = own.join(F.broadcast(common), own.h.eqNullSafe(F.col("host")), "left")
    else:
        named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("k")
        common = common.select(named("host"), "bad", "rows")
        n = own.count()
        spread = [f"row.`{c}`" for c, kind in docs.dtypes if c in names and c != text_col and "map<" not in kind and kind != "variant"]
        joined = salted_join(own.select("*", named("h")), common, "k", hot_keys(common, "k", "rows", n), [*spread, "t"], "left")
    here = F.array_intersect(distinct, F.col("bad"))  # by hash; what is left to look through is short
    joined = joined.withColumn("here", F.when(F.col("bad").isNotNull(), here))
    stays = lambda x: ~F.array_contains(F.col("here"), digest(x))
    joined = joined.withColumn("kept", F.when(F.coalesce(F.size("here"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, stays)))
    n_lines, n_kept = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)), F.when(F.col("t").isNull(), 0).otherwise(F.size("kept"))
    return joined.select(
        *[F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names],
        n_lines.cast("long").alias("n_lines"),
        (n_lines - n_kept).cast("long").alias("n_dropped"),
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT DISTINCT source, text FROM d),
p AS (SELECT source, count(*) AS pages FROM u GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line FROM u),
c AS (SELECT l.source, l.line FROM l JOIN p USING (source) GROUP BY l.source, l.line, p.pages
      HAVING count(*) >= 2 AND count(*) > CAST(0.05 AS DOUBLE) * p.pages),
b AS (SELECT source, list(line) AS bad FROM c GROUP BY source)
SELECT d.doc_id, d.source,
       array_to_string(CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x))) END, chr(10)) AS text,
       CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - CASE WHEN bad IS NULL THEN len(lines) ELSE len(list_filter(lines, lambda x: NOT list_contains(bad, trim(x)))) END AS BIGINT) AS n_dropped
FROM d LEFT JOIN b USING (source)
"""
