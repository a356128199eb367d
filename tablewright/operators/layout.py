"""Layout: rows, columns and bands rebuilt from positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.vocabulary import value_kind


def visual_rows_chain(tokens: DataFrame, tol: float = 2.0) -> DataFrame:
    """T1, chain form: a new row when a token lies more than tol below the one before it."""
    w = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    gap = F.col("top") - F.lag("top").over(w)
    starts = F.when(gap.isNull() | (gap > tol), 1).otherwise(0)
    return tokens.withColumn("starts", starts).withColumn("row_id", F.sum("starts").over(w)).drop("starts")


def visual_rows(tokens: DataFrame, tol: float = 2.0) -> DataFrame:
    """A new row when a token lies more than tol below the row's first token."""
    return anchored(tokens, "top", ["x0"], tol, "row_id")


def anchored(rows: DataFrame, value: str, ties: list[str], tol: float, name: str) -> DataFrame:
    """Number the groups of a page whose values lie within tol of the group's first, ascending, from 1.

    Each group depends on where the one before it began, so no window expresses it. The distinct values of a page are
    brought together in order and folded to the values at which groups begin; a row's group is how many of these it reaches.
    """
    own = rows.repartition("doc_id", "page")  # both sides below read the one exchange
    none = F.array().cast("array<double>")
    fold = lambda s, v: F.when((F.size(s) == 0) | (v - F.element_at(s, -1) > tol), F.concat(s, F.array(v.cast("double")))).otherwise(s)
    begun = own.groupBy("doc_id", "page").agg(F.aggregate(F.sort_array(F.collect_set(value)), none, fold).alias("begun"))
    return own.join(begun, ["doc_id", "page"]).withColumn(name, F.size(F.filter("begun", lambda b: b <= F.col(value))).cast("long")).drop("begun")


def row_texts(tokens: DataFrame) -> DataFrame:
    """The words of each row from left to right, with the row's top."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"])
    return tokens.groupBy("doc_id", "page", "row_id").agg(F.min("top").alias("top"), F.array_join(words, " ").alias("text"))


def value_columns(tokens: DataFrame, tol: float = 6.0, min_rows: int = 3) -> DataFrame:
    """Right edges of value tokens, chained by gaps up to tol; clusters of at least min_rows with mean, n, lo, hi; by page, or
    by band where tokens have one."""
    return edge_clusters(tokens.filter(value_kind(F.col("text")) != "text"), "x1", tol, min_rows)


def edge_clusters(own: DataFrame, edge: str, tol: float, min_rows: int) -> DataFrame:
    keys = [c for c in ("doc_id", "page", "band") if c in own.columns]
    w = Window.partitionBy(*keys).orderBy(edge)
    own = own.withColumn("new", F.when(F.col(edge) - F.lag(edge).over(w) <= tol, 0).otherwise(1))
    own = own.withColumn("island", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    found = own.groupBy(*keys, "island").agg(F.avg(edge).alias(edge), F.count(F.lit(1)).alias("n"), F.min(edge).alias("lo"), F.max(edge).alias("hi"))
    return found.filter(F.col("n") >= min_rows).withColumn("col", F.row_number().over(w) - 1).select(*keys, "col", edge, "n", "lo", "hi")


def text_columns(tokens: DataFrame, tol: float = 4.0, min_rows: int = 3, exclude: DataFrame | None = None) -> DataFrame:
    """Left edges of text tokens, as value columns; those within tol of an excluded edge (doc_id, page, x0), such as the
    label's own, are left out."""
    found = edge_clusters(tokens.filter(value_kind(F.col("text")) == "text"), "x0", tol, min_rows)
    if exclude is None:
        return found
    out = exclude.groupBy("doc_id", "page").agg(F.collect_set("x0").alias("out"))
    own = found.join(out, ["doc_id", "page"], "left").filter(~F.coalesce(F.exists("out", lambda e: F.abs(F.col("x0") - e) <= tol), F.lit(False))).drop("out")
    keys = [c for c in ("doc_id", "page", "band") if c in own.columns]
    return own.withColumn("col", F.row_number().over(Window.partitionBy(*keys).orderBy("x0")) - 1)


def bin_text(tokens: DataFrame, columns: DataFrame, tol: float = 4.0) -> DataFrame:
    """Text tokens of a row to the first text column within tol of their left edge, which the first of them fills; the rest
    (col null) stay in the label."""
    model = columns.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("col", F.col("x0").alias("cx")))).alias("model"))
    own = tokens.filter(value_kind(F.col("text")) == "text").join(model, ["doc_id", "page"], "left")
    own = own.withColumn("near", F.get(F.filter("model", lambda m: F.abs(F.col("x0") - m["cx"]) <= tol), F.lit(0))["col"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "row_id", "near").orderBy("x0", "text"))
    return own.select("doc_id", "page", "row_id", "x0", "text", F.when(nth == 1, F.col("near")).alias("col"))


def stable_column_count(edges: DataFrame) -> DataFrame:
    """T4: cluster a page's right edges (x1, width) at 4, 6, 8, ... points, below 8 % of its width but 4 to 8 at least; the column
    count that most of these tolerances give, two columns or more if any does, ties to the smallest tolerance; confidence is
    their share. A page with fewer than four edges has none.

    A gap begins a column at every tolerance below it, so each page is clustered once: its gaps are counted by tolerance.
    """
    own = edges.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x1")).alias("xs"), F.max("width").alias("width")).filter(F.size("xs") >= 4)
    gaps = F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get("xs", i) - F.get("xs", i - 1))
    tols = F.sequence(F.lit(4), F.greatest(F.lit(10), F.floor(F.col("width") * 0.08).cast("int")) - 1, F.lit(2))
    own = own.select("doc_id", "page", gaps.alias("gaps"), tols.alias("tols"))
    own = own.select("doc_id", "page", F.size("tols").alias("tried"), F.explode(F.transform("tols", lambda t: F.struct(t.alias("tol"), (F.size(F.filter("gaps", lambda g: g > t)) + 1).alias("columns")))).alias("c"))
    held = own.groupBy("doc_id", "page", "tried", "c.columns").agg(F.count(F.lit(1)).alias("n"), F.min("c.tol").alias("first"))
    best = F.max_by(F.struct("columns", "n"), F.struct((F.col("columns") >= 2).alias("several"), "n", (-F.col("first")).alias("f")))
    out = held.groupBy("doc_id", "page", "tried").agg(best.alias("b"))
    return out.select("doc_id", "page", F.col("b.columns").alias("columns"), F.col("b.n").alias("most"), "tried", F.round(F.col("b.n") / F.col("tried"), 6).alias("confidence"))


def column_models(columns: DataFrame) -> DataFrame:
    """The columns of each page (or band) in one array, by x1."""
    keys = [c for c in ("doc_id", "page", "band") if c in columns.columns]
    return columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", F.col("x1").alias("cx"), "lo"))).alias("model"))


def bin_values(tokens: DataFrame, columns: DataFrame, tol: float = 6.0, zoned: bool = False) -> DataFrame:
    """T5: each value token to the first column within tol of its right edge; a second one in a filled cell, or one in no
    column, is unbinned. tokens carry row_id; a page's columns are joined as one array, so tokens stay single rows. `zoned`:
    tokens that end more than 5 left of every column belong to the label and are left out."""
    keys = [c for c in ("doc_id", "page", "band") if c in columns.columns]
    own = tokens.filter(value_kind(F.col("text")) != "text").join(column_models(columns), keys, "left")
    if zoned:
        own = own.filter(F.col("x1") >= F.coalesce(F.array_min(F.transform("model", lambda m: m["lo"])), F.lit(0.0)) - 5.0)
    near = F.get(F.filter("model", lambda m: F.abs(F.col("x1") - m["cx"]) <= tol), F.lit(0))["col"]
    own = own.withColumn("near", near)
    w = Window.partitionBy(*keys, "row_id", "near").orderBy("x0", "text")
    cell = F.when(F.col("near").isNotNull() & (F.row_number().over(w) == 1), F.col("near"))
    return own.select(*keys, "row_id", "x0", "x1", "text", cell.alias("col"))


def rows_with_values(binned: DataFrame, n_columns: int) -> DataFrame:
    """Per row an array of the values by column, null where empty, and the unbinned texts from left to right."""
    values = F.array(*[F.max(F.when(F.col("col") == c, F.col("text"))) for c in range(n_columns)])
    stray = F.transform(F.array_sort(F.collect_list(F.when(F.col("col").isNull(), F.struct("x0", "text")))), lambda t: t["text"])
    keys = [c for c in ("doc_id", "page", "band", "row_id") if c in binned.columns]
    return binned.groupBy(*keys).agg(values.alias("values"), stray.alias("unbinned"))


def bin_nearest(tokens: DataFrame, columns: DataFrame) -> DataFrame:
    """Each value token to its nearest column whatever the distance; the right-most token wins a cell."""
    own = tokens.filter(value_kind(F.col("text")) != "text").join(column_models(columns), ["doc_id", "page"])
    near = F.array_min(F.transform("model", lambda m: F.struct(F.abs(F.col("x1") - m["cx"]).alias("d"), m["col"].alias("col"))))["col"]
    return own.groupBy("doc_id", "page", "row_id", near.alias("col")).agg(F.max_by("text", F.struct("x0", "text")).alias("text"))


def indent_levels(rows: DataFrame, tol: float = 3.0) -> DataFrame:
    """Ascending label edges of a page; a new level when farther than tol from the level's start; each row's nearest.

    A page's rows come together once and get their levels there; the rows are neither made nor joined a second time."""
    own = rows.dropna(subset=["doc_id", "page", "x0"]).select("doc_id", "page", F.struct("y", "x0", "label").alias("row"))
    pages = own.groupBy("doc_id", "page").agg(F.collect_list("row").alias("rows"))
    none = F.array().cast("array<double>")
    fold = lambda s, v: F.when((F.size(s) == 0) | (v - F.element_at(s, -1) > tol), F.concat(s, F.array(v.cast("double")))).otherwise(s)
    pages = pages.withColumn("starts", F.aggregate(F.sort_array(F.array_distinct(F.col("rows")["x0"])), none, fold))
    out = pages.select("doc_id", "page", "starts", F.explode("rows").alias("r")).select("doc_id", "page", "r.*", "starts")
    near = F.array_min(F.transform("starts", lambda s, i: F.struct(F.abs(F.col("x0") - s).alias("far"), i.alias("n"))))["n"]
    return out.select("doc_id", "page", "y", "x0", "label", near.cast("int").alias("level"))


def masked_layout(tokens: DataFrame) -> DataFrame:
    """Each row's words with digits masked and their edges, so that layout shows without figures."""
    word = F.concat(F.regexp_replace("text", r"\d", "#"), F.lit("@"), F.col("x0").cast("int").cast("string"), F.lit("-"), F.col("x1").cast("int").cast("string"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", word.alias("w")))), lambda t: t["w"])
    return tokens.groupBy("doc_id", "page", "row_id").agg(F.array_join(words, " ").alias("masked"))


# Month names, which a signature doesn't keep.
MONTHS = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)(uary|ruary|ch|il|e|y|ust|tember|ober|ember)?\b"


def page_signature(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """First 12 rows of a document's first page, lower-cased, months as <m>, digits as #; 12 hex digits of the first 8 rows'
    SHA-1; with `sizes` (doc_id, page, width, height) the page's size to ten points."""
    head = F.slice(F.array_sort(F.collect_list(F.struct("page", "row_id", "text"))), 1, 12)
    own = rows.groupBy("doc_id").agg(F.min("page").alias("page"), head.alias("head"))
    first = F.slice(F.filter("head", lambda r: r["page"] == F.col("page")), 1, 8)
    shape = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), MONTHS, "<m>"), r"\d+", "#")
    hashes = F.transform(first, lambda r: F.substring(F.sha1(shape(r["text"])), 1, 12))
    own = own.select("doc_id", "page", F.array_distinct(hashes).alias("signature"))
    if sizes is not None:
        ten = lambda c: (F.round(F.col(c) / 10) * 10).cast("int").alias(c)
        own = own.join(sizes.select("doc_id", "page", ten("width"), ten("height")), ["doc_id", "page"], "left")
    return own.drop("page")


#: Documents with one signature from which it counts as frequent; few signatures can be.
FREQUENT = 10_000


def match_recipe(signatures: DataFrame, recipes: DataFrame, least: float = 0.6) -> DataFrame:
    """Per document the recipe with the highest Jaccard of hash sets, the first on a tie; none below `least`.

    Documents printed alike share a signature: each distinct one is compared once, whatever the number of its documents. Those
    of frequent signatures get their recipe from a small table that goes to every task, so that they gather in none."""
    own = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    a = own.select("signature", F.size("signature").alias("na"), F.explode("signature").alias("h"))
    b = recipes.select("slug", "ord", F.size("signature").alias("nb"), F.explode("signature").alias("h"))
    common = a.join(b, "h").groupBy("signature", "slug", "ord", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    score = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    best = common.withColumn("score", score).groupBy("signature").agg(F.max_by(F.struct("slug", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("m"))
    told = own.join(best, "signature")
    often = told.filter(F.col("n") >= FREQUENT).select("signature", F.col("m").alias("often"))
    out = signatures.select("doc_id", "signature").join(F.broadcast(often), "signature", "left")
    # who has its recipe, or has no signature, looks for none below, and lies where its own number puts it
    apart = F.array(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    out = out.withColumn("signature", F.when(F.col("often").isNull() & F.col("signature").isNotNull(), F.col("signature")).otherwise(apart))
    out = out.join(told.filter(F.col("n") < FREQUENT).select("signature", "m"), "signature", "left").withColumn("m", F.coalesce("often", "m"))
    return out.select("doc_id", F.when(F.col("m.score") >= least, F.col("m.slug")).alias("slug"), F.round(F.coalesce("m.score", F.lit(0.0)), 6).alias("score"))
