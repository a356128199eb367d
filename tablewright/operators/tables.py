"""Tables on a page: the bands that hold one, their columns and rows, the names of columns, and where a report's section ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.vocabulary import value_kind


def table_regions(tokens: DataFrame, min_rows: int = 3, gap_rows: int = 3, odd_rows: int = 2) -> DataFrame:
    """Tokens (with row_id) that lie in a band of rows sharing value edges, with the band's number on its page.

    Rows stay together while half of their edges have been seen in the band. Rows without figures belong to it until
    `gap_rows` of them end it; a single row that doesn't fit belongs to it too, but `odd_rows` in a run begin a new one. A
    band needs `min_rows` rows with figures. A page's rows are folded in order, as each depends on the band so far; its
    tokens pass once and keep all their columns.
    """
    keys = ["doc_id", "page", "row_id"]
    rest = [c for c in tokens.columns if c not in keys]
    own = in_pages(tokens.dropna(subset=keys), []).select(*keys, *rest, "figure", "begins")

    def read(page: pa.RecordBatch) -> pa.RecordBatch:
        band, _, _ = bands_in(page, min_rows, gap_rows, odd_rows)
        kept = np.flatnonzero(band.of_token >= 0)
        out = page.select([*keys, *rest]).take(pa.array(kept))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(band.number[band.of_token[kept]], pa.int32())], [*out.schema.names, "band"])

    schema = T.StructType([*[own.schema[c] for c in (*keys, *rest)], T.StructField("band", T.IntegerType())])
    return own.mapInArrow(page_by_page(read), schema)


def in_pages(tokens: DataFrame, order: list[str]) -> DataFrame:
    """Tokens with `figure`, a page's together in order of their rows, the first of each page marked (`begins`)."""
    own = tokens.withColumn("figure", value_kind(F.col("text")) != "text")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row_id", *order))
    return own.withColumn("begins", place == 1)


#: Tokens that are read together at least, so that a step over arrays pays.
TOKENS_AT_ONCE = 100_000


def page_by_page(read: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`read` over whole pages of what `in_pages` brought together, many pages at a time; a page whose end hasn't come waits."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.concat_batches(parts) if len(parts) > 1 else parts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column("begins").to_numpy(zero_copy_only=False))
            if n >= TOKENS_AT_ONCE and len(starts):
                yield read(joined([*held, batch.slice(0, starts[-1])]))
                held, n, batch = [], 0, batch.slice(starts[-1])
            held.append(batch)
            n += batch.num_rows
        if n:
            yield read(joined(held))

    return run


class Band:
    """Rows of a page that share value edges, as they are found from above: rows (row, edges)."""

    def __init__(self):
        self.rows, self.seen, self.blanks = [], set(), 0


def bands_of(rows: list[tuple], gap_rows: int = 3, odd_rows: int = 2) -> list[Band]:
    """The bands of `table_regions` of one page's rows in order, whatever their number of rows."""
    bands, now, odd = [], None, []
    for row in rows:
        edges = row[1]
        if not edges:
            if now is not None:
                now.blanks += 1
                if now.blanks >= gap_rows:
                    now, odd = None, []
                else:
                    now.rows.append(row)
            continue
        if now is not None and now.seen and 2 * len(edges & now.seen) < len(edges):
            odd.append(row)
            now.blanks = 0
            if len(odd) >= odd_rows:
                now = Band()
                bands.append(now)
                now.rows, odd = odd, []
                now.seen = set().union(*[r[1] for r in now.rows])
            continue
        if now is None:
            now = Band()
            bands.append(now)
        now.rows += [*odd, row]
        now.seen |= edges
        now.blanks, odd = 0, []
    if odd:
        now.rows += odd
    return bands


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether an element differs from the one before it in any column; the first one does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def numbers(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return batch.column(name).cast(pa.float64() if kind is float else pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


class Bands(NamedTuple):
    """The bands of several pages: each token's and each row's (-1: none), and each band's number on its page."""

    of_token: np.ndarray
    of_row: np.ndarray
    number: np.ndarray


def bands_in(batch: pa.RecordBatch, min_rows: int = 3, gap_rows: int = 3, odd_rows: int = 2) -> tuple[Bands, np.ndarray, np.ndarray]:
    """The bands of whole pages, the row of each token, and its figures."""
    begins, figure = (batch.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in ("begins", "figure"))
    new_row = begins | changes(numbers(batch, "row_id", int))
    row = np.cumsum(new_row) - 1
    starts = np.append(np.flatnonzero(begins[new_row]), row[-1] + 1)
    at = np.flatnonzero(figure)
    edge = np.rint(numbers(batch, "x1", float)[at] / 8.0).astype(np.int64)
    order = np.lexsort((edge, row[at]))
    by_row, edge = row[at][order], edge[order]
    once = changes(by_row, edge)
    by_row, edge = by_row[once], edge[once]
    ends = np.searchsorted(by_row, np.arange(row[-1] + 2))

    def fold(a: int, b: int) -> tuple[np.ndarray, int]:
        """Each row's band, and their number, of the page with rows a to b."""
        of_row, n, own, at = np.full(b - a, -1), 0, edge[ends[a] : ends[b]].tolist(), (ends[a : b + 1] - ends[a]).tolist()
        for band in bands_of([(r, set(own[at[r] : at[r + 1]])) for r in range(b - a)], gap_rows, odd_rows):
            if sum(bool(r[1]) for r in band.rows) >= min_rows:
                of_row[[r[0] for r in band.rows]] = n
                n += 1
        return of_row, n

    # pages with the same edges row by row have the same bands: among pages read together, each layout is folded once
    folded, size, counts, parts, base = {}, np.diff(ends), [], [], 0
    for a, b in pairwise(starts.tolist()):
        layout = (size[a:b].tobytes(), edge[ends[a] : ends[b]].tobytes())
        if layout not in folded:
            folded[layout] = fold(a, b)
        of_row, n = folded[layout]
        parts.append(np.where(of_row < 0, -1, of_row + base) if n else of_row)
        counts.append(n)
        base += n
    of_row = np.concatenate(parts)
    number = np.arange(base) - np.repeat(np.cumsum(counts) - counts, counts)
    return Bands(of_row[row], of_row, number.astype(np.int32)), row, figure


def columns_in(band: np.ndarray, edges: np.ndarray, n_bands: int, tol: float = 6.0, min_rows: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, least, where each band's begin and end) of the clusters of right edges that `value_columns` finds in each band."""
    order = np.lexsort((edges, band))
    band, edges = band[order], edges[order]
    new = changes(band)
    new[1:] |= edges[1:] - edges[:-1] > tol
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(edges)))
    least = edges[start]
    mean = least + np.bincount(np.cumsum(new) - 1, edges - np.repeat(least, size), len(start)) / size
    kept = size >= min_rows
    return mean[kept], least[kept], np.searchsorted(band[start][kept], np.arange(n_bands + 1))


def tables_in(batch: pa.RecordBatch, tol: float = 6.0) -> pa.RecordBatch:
    """Rows (doc_id, page, band, row_id, x0, label, values, unbinned) of the tables of whole pages, from their tokens in order."""
    bands, row, figure = bands_in(batch)
    x0, x1 = (numbers(batch, c, float) for c in ("x0", "x1"))
    text, n_rows, n_bands = batch.column("text"), len(bands.of_row), len(bands.number)
    inside = bands.of_token >= 0
    if "model" in batch.schema.names:
        page = np.cumsum(batch.column("begins").to_numpy(zero_copy_only=False)) - 1
        models = batch.column("model").filter(batch.column("begins"))
        mean, least = (models.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x1", "lo"))
        ends = np.append(0, np.cumsum(models.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        own_page = np.zeros(n_bands, int)
        own_page[bands.of_token[inside]] = page[inside]
        first, last = ends[own_page], ends[own_page + 1]
    else:
        counted = np.flatnonzero(inside & figure)
        mean, least, ends = columns_in(bands.of_token[counted], x1[counted], n_bands)
        first, last = ends[:-1], ends[1:]
    width = last - first
    zone = np.full(n_bands, np.inf)
    if width.any():
        zone[width > 0] = np.minimum.reduceat(np.append(least, np.inf), np.stack([first, last], 1)[width > 0].ravel())[::2] - 5.0
    inside[inside] = width[bands.of_token[inside]] > 0
    at = np.flatnonzero(inside & figure)
    at = at[x1[at] >= zone[bands.of_token[at]]]
    said = inside.copy()
    said[at] = False
    # the first column within tol, column by column; then the first token of each cell
    col, open_ = np.full(len(at), -1), np.arange(len(at))
    for c in range(width.max(initial=0)):
        open_ = open_[width[bands.of_token[at[open_]]] > c]
        near = np.abs(x1[at[open_]] - mean[first[bands.of_token[at[open_]]] + c]) <= tol
        col[open_[near]] = c
        open_ = open_[~near]
    order = np.lexsort((col, row[at]))
    fills = np.zeros(len(at), bool)
    fills[order] = changes(row[at][order], col[order])
    fills &= col >= 0
    out = np.flatnonzero(bands.of_row >= 0)
    out = out[width[bands.of_row[out]] > 0]
    out = out[np.argsort(bands.of_row[out], kind="stable")]
    place = np.full(n_rows, -1)
    place[out] = np.arange(len(out))

    def lists(which: np.ndarray, texts: pa.Array) -> pa.ListArray:
        """The texts of tokens by the row they lie in, in the order of tokens."""
        own = place[row[which]]
        order = np.argsort(own, kind="stable")
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(own[order], np.arange(len(out) + 1)), pa.int32()), texts.take(pa.array(which[order])))

    cell = np.append(0, np.cumsum(width[bands.of_row[out]]))
    filled = np.full(cell[-1], -1)
    filled[cell[place[row[at[fills]]]] + col[fills]] = at[fills]
    values = pa.ListArray.from_arrays(pa.array(cell, pa.int32()), text.take(pa.array(filled, mask=filled < 0)))
    printed = np.flatnonzero(said & text.is_valid().to_numpy(zero_copy_only=False))
    label = pc.binary_join(lists(printed, text), " ")
    words = np.flatnonzero(said)
    left = np.full(len(out), np.nan)
    np.fmin.at(left, place[row[words]], x0[words])
    some = np.bincount(place[row[words]], minlength=len(out)) > 0
    token = np.zeros(n_rows, int)
    token[row[::-1]] = np.arange(len(row))[::-1]
    keys = [batch.column(c).take(pa.array(token[out])) for c in ("doc_id", "page", "row_id")]
    columns = [*keys[:2], pa.array(bands.number[bands.of_row[out]], pa.int32()), keys[2], pa.array(left, mask=~some), label, values, lists(at[~fills], text)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "band", "row_id", "x0", "label", "values", "unbinned"])


def read_tables(tokens: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """The tables of every page: bands, their columns, and each row's label, values by column and stray figures. `pinned`
    columns (doc_id, col, x1, lo) hold for all pages of a document instead of each band's own.

    A page's tokens come together once, and one pass over many pages at a time yields bands, columns and cells; nothing is
    bounded by more than a page."""
    own = tokens.select("doc_id", "page", F.col("row_id").cast("long").alias("row_id"), F.col("x0").cast("double").alias("x0"), "text", F.col("x1").cast("double").alias("x1"))
    if pinned is not None:
        model = pinned.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("col", F.col("x1").cast("double").alias("x1"), F.col("lo").cast("double").alias("lo")))).alias("model"))
        own = own.join(model, "doc_id")
    own = in_pages(own, ["x0", "text", "x1"])
    if pinned is not None:
        own = own.withColumn("model", F.when(F.col("begins"), F.col("model")))
    keys = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in ("doc_id", "page"))
    return own.mapInArrow(page_by_page(tables_in), f"{keys}, band int, row_id bigint, x0 double, label string, values array<string>, unbinned array<string>")


# A month and year as a column heading prints them.
PERIOD = r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*'?\d{2,4}"


def name_columns(lines: DataFrame, columns: DataFrame, within: int = 15) -> DataFrame:
    """Columns (doc_id, page, col) named by the first of a page's first lines that prints nearly as many periods as there
    are columns; what it doesn't name is C and its number, the last one Total. Pages without such a line keep no names."""
    n = columns.groupBy("doc_id", "page").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = lines.select("doc_id", "page", "line_no", F.regexp_extract_all("text", F.lit(PERIOD), F.lit(0)).alias("months")).filter((F.col("line_no") <= within) & (F.size("months") > 0))
    own = own.join(n, ["doc_id", "page"]).filter(F.size("months") >= F.greatest(F.lit(2), F.col("n") - 2))
    first = own.groupBy("doc_id", "page").agg(F.min_by(F.struct("months", "n"), "line_no").alias("h")).select("doc_id", "page", "h.*")
    name = F.coalesce(F.get("months", F.col("col")), F.when(F.col("col") == F.col("n") - 1, "Total").otherwise(F.concat(F.lit("C"), (F.col("col") + 1).cast("string"))))
    return columns.join(first, ["doc_id", "page"], "left").withColumn("name", F.when(F.col("months").isNotNull(), name)).select("doc_id", "page", "col", "name")


def split_header_names(headers: DataFrame) -> DataFrame:
    """One name for each column with a leaf (doc_id, idx, grp, leaf; "" where blank) of a two-row heading.

    A group holds rightwards until the next one; a leaf takes its group's name if the leaf is printed more than once or doesn't
    hold it. Names still equal take the nearest other group to their left, or else their column's number.
    """
    kinds = headers.schema
    idx, leaf = (kinds[c].dataType.simpleString() for c in ("idx", "leaf"))
    state = f"struct<own:string,other:string,out:array<struct<idx:{idx},leaf:{leaf},own:string,other:string>>>"
    # own: the group that holds here; other: the nearest different one to its left
    start = F.struct(F.lit(None).alias("own"), F.lit(None).alias("other"), F.array().alias("out")).cast(state)

    def step(s: Column, c: Column) -> Column:
        begins = F.coalesce((c["grp"] != "") & ~c["grp"].eqNullSafe(s["own"]), F.lit(False))
        own, other = F.when(begins, c["grp"]).otherwise(s["own"]), F.when(begins, s["own"]).otherwise(s["other"])
        put = F.struct(c["idx"].alias("idx"), c["leaf"].alias("leaf"), F.coalesce(own, F.lit("")).alias("own"), other.alias("other"))
        kept = F.when(c["leaf"] != "", F.concat(s["out"], F.array(put))).otherwise(s["out"])
        return F.struct(own.alias("own"), other.alias("other"), kept.alias("out")).cast(state)

    # a heading comes together once: its columns are told apart within it, not by a window and a sort for each step
    docs = headers.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "grp", "leaf"))).alias("cells"))
    docs = docs.withColumn("cells", F.aggregate("cells", start, step)["out"]).withColumn("leaves", F.col("cells")["leaf"])
    times = lambda names, name: F.size(F.filter(names, lambda x: x == name))

    def named(c: Column) -> Column:
        joined = (c["own"] != "") & ((times("leaves", c["leaf"]) > 1) | ~c["leaf"].contains(c["own"]))
        name = F.when(joined, F.concat_ws(" - ", c["own"], c["leaf"])).otherwise(c["leaf"])
        return F.struct(c["idx"].alias("idx"), c["own"].alias("grp"), c["leaf"].alias("leaf"), c["other"].alias("other"), name.alias("name"))

    docs = docs.withColumn("cells", F.transform("cells", named)).withColumn("names", F.col("cells")["name"])
    own = docs.select("doc_id", "names", F.explode("cells").alias("c")).select("doc_id", "names", "c.*")
    full = F.when(F.col("other").isNotNull(), F.concat_ws(" - ", "other", "name")).otherwise(F.concat(F.col("name"), F.lit(" (col "), F.col("idx").cast("string"), F.lit(")")))
    return own.select("doc_id", "idx", "grp", "leaf", F.when(times("names", F.col("name")) > 1, full).otherwise(F.col("name")).alias("name"))


def rows_to_entities(cells: DataFrame, names: DataFrame) -> DataFrame:
    """A record for each row (doc_id, row_no, idx, text) with two named columns filled at least: name to value."""
    filled = cells.filter("text <> ''").join(names.select("doc_id", "idx", "name"), ["doc_id", "idx"])
    pairs = F.array_sort(F.collect_list(F.struct("idx", "name", F.col("text").alias("value"))))
    own = filled.groupBy("doc_id", "row_no").agg(pairs.alias("p")).filter(F.size("p") >= 2)
    return own.select("doc_id", "row_no", F.map_from_entries(F.transform("p", lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))).alias("record"))


def section_extent(pages: DataFrame, recipes: DataFrame, least: float = 0.6) -> DataFrame:
    """The pages of each document that its report takes up: pages (doc_id, page, slug of the matched recipe or null, edges of
    their value columns over 8, text) and recipes (slug, edges, markers).

    The document's recipe is the one most of its pages match, the first matched on a tie. From its pages on, neighbours
    belong as long as most of their edges are the recipe's; then those that follow and print one of its totals' markers.
    """
    page = F.struct("page", "slug", "edges", "text")
    # a document's pages come together once: all steps look at them there, without windows or joins of pages
    docs = pages.select("doc_id", page.alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("pages"))
    first = lambda s: F.array_min(F.filter("pages", lambda p: p["slug"] == s)["page"])
    slugs = F.array_distinct(F.filter(F.col("pages")["slug"], lambda s: s.isNotNull()))
    votes = F.transform(slugs, lambda s: F.struct(F.size(F.filter("pages", lambda p: p["slug"] == s)).alias("n"), (-first(s)).alias("f"), s.alias("slug")))
    docs = docs.withColumn("recipe", F.array_max(votes)["slug"]).filter("recipe IS NOT NULL")
    library = recipes.select(F.col("slug").alias("recipe"), F.col("edges").alias("want"), "markers")
    own = docs.join(F.broadcast(library), "recipe")  # small beside pages, and most documents may have one recipe

    def judged(p: Column) -> Column:
        matched = F.coalesce(p["slug"] == F.col("recipe"), F.lit(False))
        like = (F.size(p["edges"]) > 0) & (F.size(F.array_intersect(p["edges"], "want")) >= F.lit(least) * F.size(p["edges"]))
        bare = F.regexp_replace(p["text"], " ", "")
        totals = F.exists("markers", lambda m: (m != "") & bare.contains(F.replace(m, F.lit(" "), F.lit(""))))
        return F.struct(p["page"].alias("page"), matched.alias("matched"), (matched | like).alias("inside"), F.coalesce(totals, F.lit(False)).alias("totals"))

    own = own.select("doc_id", "recipe", F.sort_array(F.transform("pages", judged)).alias("pages"))
    # neighbours are as far from each other as their places among the pages inside
    runs = F.transform(F.filter("pages", lambda p: p["inside"]), lambda p, i: F.struct(p["page"].alias("page"), p["matched"].alias("matched"), (p["page"] - i).alias("run")))
    own = own.withColumn("inside", runs).withColumn("held", F.array_distinct(F.filter("inside", lambda r: r["matched"])["run"]))
    own = own.withColumn("section", F.filter("inside", lambda r: F.array_contains("held", r["run"]))["page"]).withColumn("last", F.array_max("section"))
    after = F.filter("pages", lambda p: (p["page"] > F.col("last")) & p["totals"])["page"]
    own = own.withColumn("after", F.filter(F.transform(after, lambda p, i: F.when(p == F.col("last") + i + 1, p)), lambda p: p.isNotNull()))
    why = lambda c, name: F.transform(c, lambda p: F.struct(p.alias("page"), F.lit(name).alias("why")))
    own = own.select("doc_id", "recipe", F.concat(why("section", "section"), why("after", "totals")).alias("found"))
    return own.select("doc_id", "recipe", F.explode_outer("found").alias("f")).filter("f IS NOT NULL").select("doc_id", "f.page", "recipe", "f.why")


def pinned_columns(names: Sequence[tuple[int, float]], spark) -> DataFrame:
    return spark.createDataFrame([(c, float(x)) for c, x in names], "col int, x1 double").withColumn("lo", F.col("x1"))
