"""Reconciliation: figures checked against the totals that the document prints about itself."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.window import Window

from tablewright.functions.vocabulary import parse_figure, value_kind

TOL = 0.011


def has_figures() -> Column:
    return F.exists("values", lambda v: F.coalesce(v, F.lit("")) != "")


def with_indents(rows: DataFrame, deeper: float = 2.0) -> DataFrame:
    """rows with item_x0 and total_x0 of their document (F1), null where no row has figures. A document's rows come together
    once, and all that follows by document stays where it is."""
    edge = F.when(has_figures(), F.bround("x0", 0))
    same, doc = Window.partitionBy("doc_id", "edge"), Window.partitionBy("doc_id")
    own = rows.repartition("doc_id").withColumn("edge", edge)
    first = F.min(F.struct("page", "y")).over(same)
    own = own.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("first", first)
    rank = F.when(F.col("edge").isNotNull(), F.struct("n", (-F.col("first.page")).alias("p"), (-F.col("first.y")).alias("y"), "edge"))
    own = own.withColumn("item_x0", F.max(rank).over(doc)["edge"])
    own = own.withColumn("total_x0", F.min(F.when(F.col("edge") > F.col("item_x0") + deeper, F.col("edge"))).over(doc))
    return own.drop("edge", "n", "first")


def dominant_indent(rows: DataFrame, deeper: float = 2.0) -> DataFrame:
    """per document the most common indent of rows with figures (ties to the first seen), and the least deeper one."""
    own = rows.filter(has_figures() & F.col("x0").isNotNull()).groupBy("doc_id", F.bround("x0", 0).alias("x0")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "y")).alias("first"))
    rank = F.struct("n", (-F.col("first.page")).alias("p"), (-F.col("first.y")).alias("y"), "x0")
    both = own.groupBy("doc_id").agg(F.max(rank)["x0"].alias("item_x0"), F.collect_list("x0").alias("edges"))
    return both.select("doc_id", "item_x0", F.array_min(F.filter("edges", lambda x: x > F.col("item_x0") + deeper)).alias("total_x0"))


def section_totals(rows: DataFrame, col: int | None = None, near: float = 2.0) -> DataFrame:
    """V1: each printed total of a column, or of every column, against the sum of the items since the last heading or total."""
    own = rows if "item_x0" in rows.columns else with_indents(rows)
    own = own.filter(F.col("x0").isNotNull() & F.col("total_x0").isNotNull())
    x, item = F.col("x0"), F.col("item_x0")
    kind = (
        F.when(x < item - near, "break")
        .when(~has_figures(), "skip")
        .when(F.abs(x - item) <= near, "item")
        .when(x >= F.col("total_x0") - near, "total")
        .otherwise("skip")
    )
    w = Window.partitionBy("doc_id").orderBy("page", "y")
    ends = F.col("kind").isin("break", "total").cast("int")
    own = own.withColumn("kind", kind).withColumn("bucket", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = F.transform("values", lambda v, i: F.struct(i.alias("col"), parse_figure(v).alias("v")))
    wanted = lambda c: c["v"].isNotNull() & (F.lit(True) if col is None else c["col"] == col)
    own = own.filter("kind IN ('item', 'total')").withColumn("c", F.explode(F.filter(cells, wanted)))
    is_item, total = F.col("kind") == "item", F.struct("page", "y", "label", F.col("c.v").alias("v"))
    sums = own.groupBy("doc_id", "bucket", F.col("c.col").alias("col")).agg(
        F.sum(F.when(is_item, F.col("c.v"))).alias("sum"), F.count_if(is_item).alias("n"), F.max(F.when(~is_item, total)).alias("t")
    )
    got = F.round("sum", 2).cast("decimal(18,4)")
    diff = F.round(got - F.col("t.v"), 2)
    return sums.filter("n > 0 AND t IS NOT NULL").select(
        "doc_id", "t.page", "t.y", F.lit("section_total").alias("check"), F.concat(F.lit("col"), F.col("col").cast("string")).alias("scope"), "t.label", F.col("t.v").alias("expected"),
        got.alias("got"), diff.cast("decimal(18,2)").alias("diff"), (F.abs(diff) <= F.greatest(F.lit(TOL), F.lit(TOL) * F.col("n"))).alias("ok"),
        F.concat(F.col("n").cast("string"), F.lit(" item(s)")).alias("note"),
    )


# Labels of rows that sum the rows above them.
TOTAL_LABEL = r"(?i)^\s*(grand\s+)?(sub)?\s*totals?\b|^\s*top\s+\d+\b|\btotals?\s*$"


#: Figures are whole numbers of ten-thousandths here, so that sums and products are exact.
UNIT = 10_000
#: A hundredth in units.
HUNDREDTH = 100


def rounded(ratio: float) -> int:
    """A ratio to four places, halves away from zero by its shortest decimal form, in units."""
    near = abs(ratio) * UNIT
    if abs(near % 1 - 0.5) > 1e-3 and near < 1e12:  # far from a half, where the binary form can't tip it
        return round(near) if ratio >= 0 else -round(near)
    return int(Decimal(repr(ratio)).quantize(Decimal("0.0001"), ROUND_HALF_UP) * UNIT)


def methods_of(members: list[list[int | None]], col: int) -> dict[tuple[int, str], int]:
    """(rank, method) to value of the rows that a total of a column covers, read from their moments: sums and counts of each
    column, and sums of its products with the total's own. A column with a gap weighs and divides nothing."""
    width, n = len(members[0]), len(members)
    whole = [x for x in range(width) if x != col and all(m[x] is not None for m in members)]
    sums = {x: sum(m[x] for m in members) for x in [*whole, col]}
    cents, half = divmod(abs(sums[col]), 100)
    found = {(0, "sum"): (cents + (half >= 50)) * 100 * (1 if sums[col] >= 0 else -1), (1, "average"): rounded(sums[col] / UNIT / n)}
    for x in whole:
        if sums[x]:
            found[2, f"average weighted by column {x + 1}"] = rounded((sum(m[x] * m[col] for m in members) / UNIT**2) / (sums[x] / UNIT))
    for x in whole:
        for y in whole:
            if x != y and sums[y]:
                found[3, f"column {x + 1} total over column {y + 1} total"] = rounded((sums[x] / UNIT) / (sums[y] / UNIT))
    return found


def reconciles(method: str, value: int, expected: int, n: int) -> bool:
    """A sum is exact but for a cent a row; an average is made of rounded figures."""
    slack = max(TOL, TOL * n) if method == "sum" else max(0.05, abs(expected) / UNIT * 0.002)
    return abs(value - expected) / UNIT <= slack


def judged_totals(rows: list[tuple], col: int) -> Iterator[tuple]:
    """(page, y, label, expected, n, method, votes, used, value, ok) of each total of a column, rows (page, y, label, is_total, nums) in order.

    A total covers the rows since the last one, which stands in for what it covers itself. The column's method is the one
    with the most rows behind totals that agree with it, simpler ones first, then by name; the sum where none agrees."""
    segments, members = [], []
    for page, y, label, is_total, nums in rows:
        if nums[col] is None:
            continue
        if is_total and members:
            segments.append((page, y, label, nums[col], len(members), methods_of(members, col)))
        if is_total:
            members = []
        members.append(nums)
    votes: dict[tuple[int, str], int] = {}
    for *_, expected, n, methods in segments:
        for key, value in methods.items():
            if reconciles(key[1], value, expected, n):
                votes[key] = votes.get(key, 0) + n
    rank, method = min(votes, key=lambda k: (-votes[k], k)) if votes else (0, "sum")
    for page, y, label, expected, n, methods in segments:
        used = method if (rank, method) in methods else "sum"
        value = methods.get((rank, method), methods[0, "sum"])
        yield page, y, label, expected, n, method, votes.get((rank, method), 0), used, value, reconciles(used, value, expected, n)


#: Sums of products stay exact in 64 bits below this; documents beyond it are judged by `judged_totals`.
EXACT = 2**61
#: Segments times methods that are judged at once, at most about that.
CELLS_AT_ONCE = 2_000_000


def slacks(method: str, expected: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.maximum(TOL, TOL * n) if method == "sum" else np.maximum(0.05, np.abs(expected) / UNIT * 0.002)


def rounded_all(ratio: np.ndarray, exact) -> np.ndarray:
    """`rounded` of every ratio; exact(i) computes the i-th anew where its last bit may matter."""
    near = np.abs(ratio) * UNIT
    near[~np.isfinite(near)] = 0
    whole = np.rint(np.minimum(near, 1e15)).astype(np.int64)
    out = np.where(ratio >= 0, whole, -whole)
    for i in np.flatnonzero((np.abs(near % 1 - 0.5) <= 2e-3) | (near >= 9e11)):
        out[i] = exact(int(i))
    return out


def judged_at_once(doc: np.ndarray, is_total: np.ndarray, nums: np.ndarray, known: np.ndarray, col: int, step: int = 1) -> tuple:
    """`judged_totals` of a column for many documents together: rows in order of document and place, doc their document, nums
    their figures by column (0 where not known), multiples of step. Moments of the rows that a total covers are differences of running sums.

    Returns (row of the total, expected, n, method, votes, used, value, ok), an array each, methods by their names."""
    at = np.flatnonzero(known[col])
    d, total, width = doc[at], is_total[at], len(nums)
    place = np.arange(len(at))
    opens = np.r_[True, d[1:] != d[:-1]] if len(at) else np.zeros(0, bool)
    begins = np.maximum.accumulate(np.where(opens, place, 0)) if len(at) else place
    last = np.maximum.accumulate(np.where(total, place, -1)) if len(at) else place
    last = np.r_[-1, last[:-1]] if len(at) else last
    start = np.maximum(begins, last)
    ends = np.flatnonzero(total & (start < place))
    start, n = start[ends], (ends - start[ends])
    expected = nums[col][at[ends]]
    moment = lambda v: (lambda c: c[ends] - c[start])(np.r_[0, np.cumsum(v)])
    own = nums[col][at]
    sums = {x: moment(nums[x][at]) for x in range(width)}
    full = {x: moment((~known[x][at]).astype(np.int64)) == 0 for x in range(width) if x != col}
    always = np.ones(len(ends), bool)
    cents, half = np.divmod(np.abs(sums[col]), 100)
    made = {(0, "sum"): ((cents + (half >= 50)) * 100 * np.where(sums[col] >= 0, 1, -1), always)}
    made[1, "average"] = rounded_all(sums[col] / UNIT / np.maximum(n, 1), lambda i: rounded(int(sums[col][i]) / UNIT / int(n[i]))), always
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in full:
            if not (full[x] & (sums[x] != 0)).any():
                continue
            products, by, square = moment(nums[x][at] // step * (own // step)), sums[x], (UNIT // step) ** 2
            one = lambda i, p=products, b=by, q=square: rounded((int(p[i]) / q) / (int(b[i]) / UNIT)) if b[i] else 0
            made[2, f"average weighted by column {x + 1}"] = rounded_all((products / square) / (by / UNIT), one), full[x] & (by != 0)
        for x in full:
            for y in full:
                if x != y:
                    one = lambda i, p=sums[x], b=sums[y]: rounded((int(p[i]) / UNIT) / (int(b[i]) / UNIT)) if b[i] else 0
                    made[3, f"column {x + 1} total over column {y + 1} total"] = rounded_all((sums[x] / UNIT) / (sums[y] / UNIT), one), full[x] & full[y] & (sums[y] != 0)
    keys = sorted(made)
    names = np.array([name for _, name in keys], dtype=object)
    values, there = np.array([made[k][0] for k in keys]), np.array([made[k][1] for k in keys])
    fits = np.array([there[k] & (np.abs(values[k] - expected) / UNIT <= slacks(keys[k][1], expected, n)) for k in range(len(keys))])
    e = d[ends]
    firsts = np.flatnonzero(np.r_[True, e[1:] != e[:-1]]) if len(e) else np.zeros(0, np.int64)
    if not len(e):
        return at[ends], expected, n, names[:0], n, names[:0], expected, always
    votes = np.add.reduceat(fits * n, firsts, axis=1)
    which = np.cumsum(np.r_[False, e[1:] != e[:-1]])
    best = votes.argmax(axis=0)
    support, best = votes[best, np.arange(len(firsts))][which], best[which]
    each = np.arange(len(e))
    used = np.where(there[best, each], best, 0)
    return at[ends], expected, n, names[best], support, names[used], values[used, each], fits[used, each]


def judged_columns(doc: np.ndarray, is_total: np.ndarray, nums: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
    """`judged_at_once` of every column, (col, row of the total, expected, n, method, votes, used, value, ok) an array each; documents,
    numbered from 0, whose figures are too large for sums of 64 bits are judged one by one. Where all figures of a document
    are whole hundredths, as most are, its products are made of hundredths and fit much longer."""
    n_docs = int(doc[-1]) + 1 if len(doc) else 0
    length, most, hundredths = np.bincount(doc, minlength=n_docs) + 1.0, np.zeros((len(nums), n_docs)), np.ones(n_docs, bool)
    for col in range(len(nums)):
        np.maximum.at(most[col], doc, np.abs(nums[col].astype(np.float64)))
        hundredths[doc[nums[col] % HUNDREDTH != 0]] = False
    most = np.sort(most, axis=0)
    # products are of two columns; a ratio of sums must fit 64 bits too
    product, sums = most[-1] * (most[-2] if len(nums) > 1 else 0.0) * length, most[-1] * length < 2**49
    coarse = hundredths & sums & (product < EXACT * HUNDREDTH**2)
    fine = ~coarse & sums & (product < EXACT)
    for docs, step in ((coarse, HUNDREDTH), (fine, 1)):
        kept = np.flatnonzero(docs[doc])
        for col in range(len(nums)) if len(kept) else ():
            at, *judged = judged_at_once(doc[kept], is_total[kept], nums[:, kept], known[:, kept], col, step)
            yield col, kept[at], *judged
    large = np.flatnonzero(~(coarse | fine)[doc])
    figures = [[v if k else None for v, k in zip(vs, ks, strict=True)] for vs, ks in zip(nums[:, large].T.tolist(), known[:, large].T.tolist(), strict=True)]
    rows = list(zip(large.tolist(), large.tolist(), large.tolist(), is_total[large].tolist(), figures, strict=True))
    cuts = [0, *(np.flatnonzero(np.diff(doc[large])) + 1).tolist(), len(large)]
    for col in range(len(nums)) if len(large) else ():
        found = [(r[0], *r[3:]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) for r in judged_totals(rows[i:j], col)]
        if found:
            yield col, *[np.array(c) for c in zip(*found, strict=True)]


def total_segments(rows: DataFrame, n_columns: int) -> DataFrame:
    """V2, V3: a row for each total of each column (see `judged_totals`): what it prints, the n rows it covers, the column's method with its
    votes, and the value, by the method that could be used, against which it's judged. A document's rows come together once."""
    nums = F.array(*[(parse_figure(F.get("values", F.lit(i))) * UNIT).cast("long") for i in range(n_columns)])
    own = rows.select("doc_id", "page", "y", "label", F.coalesce(F.col("label").rlike(TOTAL_LABEL), F.lit(False)).alias("is_total"), nums.alias("nums"))
    # dealt by document before the rows are brought together, so that figures are read in generated code and not within the aggregate
    docs = own.repartition("doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("page", "y", "label", "is_total", "nums")).alias("rows"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"doc_id {kind['doc_id']}, col int, page {kind['page']}, y {kind['y']}, label string, expected long, n long, method string, votes long, used string, value long, ok boolean"
    fields = T._parse_datatype_string(out)

    kinds = [to_arrow_type(f.dataType) for f in fields.fields[1:]]

    def judged_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = batch.column("rows"), batch.column("rows").flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
        rank = lambda k: np.unique(rows.field(k).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((rank(1), rank(0), doc))
        figures = [pc.list_element(rows.field(4), col) for col in range(n_columns)]
        known = np.array([f.is_valid().to_numpy(zero_copy_only=False)[order] for f in figures])
        nums = np.array([f.fill_null(0).to_numpy(zero_copy_only=False)[order] for f in figures], np.int64)
        d, is_total = doc[order], rows.field(3).to_numpy(zero_copy_only=False).astype(bool)[order]
        parts = []
        for col, at, *judged in judged_columns(d, is_total, nums, known):
            taken = pa.array(order[at])
            made = [d[at], np.full(len(at), col), *[rows.field(k).take(taken) for k in range(3)], *judged]
            parts.append([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(made, [pa.int64(), *kinds], strict=True)])
        if not parts:
            return pa.RecordBatch.from_pylist([], to_arrow_schema(fields))
        columns = [pa.concat_arrays(cs) for cs in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], fields.names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(CELLS_AT_ONCE // (8 * n_columns**2), 1)
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                yield judged_batch(batch.slice(k, step))

    found = docs.mapInArrow(judge, fields)
    exact = lambda c: F.expr(f"cast(cast({c} as decimal(20,0)) * 0.0001 as decimal(18,4))")
    return found.withColumns({"expected": exact("expected"), "value": exact("value")})


def total_method_vote(segments: DataFrame) -> DataFrame:
    """V3: per document and column the method that its totals agree on, and how many rows stand behind those that do."""
    return segments.groupBy("doc_id", "col").agg(F.first("method").alias("method"), F.first("votes").alias("votes"))


def flat_totals(rows: DataFrame, n_columns: int) -> DataFrame:
    """V2: totals known by their label, each judged by the one method that its column's totals agree on."""
    return total_segments(rows, n_columns).select(
        "doc_id", "page", "y", F.lit("table_total").alias("check"), F.concat(F.lit("col"), F.col("col").cast("string")).alias("scope"), "label", "expected", F.col("value").alias("got"),
        F.round(F.col("value") - F.col("expected"), 2).cast("decimal(18,2)").alias("diff"), "ok", F.concat(F.col("n").cast("string"), F.lit(" row(s) above it, as "), F.col("used")).alias("note"),
    )


#: Rows whose checks are made at once, about that; a document's rows stay together.
ROWS_AT_ONCE = 65_536
#: Of each of a row's first cells it is told in two bits whether it is there and whether it is filled; then what the row is.
CELLS_TOLD, IS_TOTAL, UNREAD = 30, 1 << 60, 1 << 61
MADE = ["section_total", "table_total", "unbinned", "ragged_row"]


def units(figures: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The figures of a decimal(18,4) column in units, 0 where not known, and which are known."""
    known = figures.is_valid().to_numpy(zero_copy_only=False)
    halves = np.frombuffer(figures.buffers()[1], np.int64)[2 * figures.offset : 2 * (figures.offset + len(figures)) : 2]
    return np.where(known, halves, 0), known


def places(values: pa.Array) -> np.ndarray:
    """Numbers that sort as the values do, nulls first."""
    if not values.null_count and pa.types.is_primitive(values.type):
        return values.to_numpy(zero_copy_only=False)
    valid, out = values.is_valid().to_numpy(zero_copy_only=False), np.full(len(values), -1)
    out[valid] = np.unique(values.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def indents_of(doc: np.ndarray, edge: np.ndarray, place: np.ndarray, deeper: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`with_indents` of many documents: item_x0 and total_x0 of each, and which have both; from rows with figures (doc, edge, place)."""
    n_docs = int(doc[-1]) + 1 if len(doc) else 0
    item, total, both = np.full(n_docs, np.nan), np.full(n_docs, np.nan), np.zeros(n_docs, bool)
    if not len(doc):
        return item, total, both
    order = np.lexsort((place, edge, doc))
    d, e, p = doc[order], edge[order], place[order]
    same = (e[1:] == e[:-1]) | (np.isnan(e[1:]) & np.isnan(e[:-1]))
    starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | ~same])
    n, d, e, p = np.diff(np.r_[starts, len(order)]), d[starts], e[starts], p[starts]
    ranked = np.lexsort((e, -p, n, d))
    last = ranked[np.flatnonzero(np.r_[d[ranked][1:] != d[ranked][:-1], True])]
    item[d[last]] = e[last]
    far = after(e, item[d] + deeper)
    np.fmin.at(total, d[far], e[far])
    both[d[far]] = True
    return item, total, both


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b, where NaN is greater than any number."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def sections_at_once(x: np.ndarray, item: np.ndarray, total: np.ndarray, doc: np.ndarray, filled: np.ndarray, near: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`section_totals`' rows of many documents, in order: which are items, where each stretch up to a heading or total begins, and
    whether it ends with a total."""
    ends = after(item - near, x)
    items = ~ends & filled & (np.abs(x - item) <= near)
    totals = ~ends & filled & ~items & ~after(total - near, x)
    ends |= totals
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | ends[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return items, starts, totals[np.r_[starts[1:], len(doc)] - 1] if len(doc) else totals


def summed_at_once(nums: np.ndarray, known: np.ndarray, items: np.ndarray, starts: np.ndarray, closed: np.ndarray) -> tuple:
    """The totals of a column over rows in stretches (see `sections_at_once`): (row of the total, expected, n, value, ok), an array each."""
    if not len(starts):
        return starts, starts, starts, starts, closed
    last = np.r_[starts[1:], len(items)] - 1
    own = items & known
    n = np.add.reduceat(own.astype(np.int64), starts)
    wanted = closed & known[last] & (n > 0)
    values = np.where(own, nums, 0)
    sums = np.add.reduceat(values, starts)
    for i in np.flatnonzero(np.add.reduceat(np.abs(values.astype(np.float64)), starts) > 2**62):
        sums[i] = sum(values[starts[i] : last[i] + 1].tolist())  # exact; an error where 64 bits don't hold it
    last, n, sums = last[wanted], n[wanted], sums[wanted]
    cents = lambda v: np.sign(v) * ((np.abs(v) + 50) // 100)
    got, expected = cents(sums) * 100, nums[last]
    return last, expected, n, got, np.abs(cents(got - expected)) / 100 <= np.maximum(TOL, TOL * n)


def whole_documents(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come document by document, in batches of about that many that cut no document, with the document's number in its batch."""
    numbers = lambda b: b.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    held, n, least = [], 0, at_once
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        whole = pa.concat_batches(held)
        doc = numbers(whole)
        cut = int(np.argmax(doc == doc[-1]))
        if cut:
            yield whole.slice(0, cut), doc[:cut]
        held, n = [whole.slice(cut)], n - cut
        least = max(at_once, 2 * n)  # a document larger than that is put together a few times only
    if n:
        whole = pa.concat_batches(held)
        yield whole, numbers(whole)


def run_checks(rows: DataFrame, n_columns: int) -> DataFrame:
    """V6: section totals where a document has an indent for totals, else totals by label; stray figures always, ragged rows where it
    is indented. A document's rows come together once; all checks of many documents are made over their rows together."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = rows if "unbinned" in rows.columns else rows.withColumn("unbinned", F.lit(None).cast("array<string>"))
    first = min(n_columns, CELLS_TOLD)
    cell = lambda i: F.get("values", F.lit(i))
    # the first cells are read in generated code, those beyond only where there are any: null if empty, a blank if no figure
    size = F.size("values")
    named = F.lower("label").contains("to") & F.col("label").rlike(TOTAL_LABEL)  # the pattern, total or top, is tried where it can fit
    told = F.when(F.col("values").isNull(), UNREAD).otherwise(0) + F.when(named, IS_TOTAL).otherwise(0)
    for i in range(first):
        told = told + F.when(size > i, F.when(F.coalesce(cell(i), F.lit("")) != "", 3 << 2 * i).otherwise(1 << 2 * i)).otherwise(0)
    rest = F.transform(F.slice("values", first + 1, F.greatest(size - first, F.lit(1))), lambda v: F.when(v != "", F.coalesce(parse_figure(v).cast("string"), F.lit(" "))))
    own = own.repartition("doc_id").sortWithinPartitions("doc_id").select(
        "doc_id", "page", "y", "label", F.col("x0").cast("double").alias("x0"), told.cast("long").alias("told"), *[parse_figure(cell(i)).alias(f"f{i}") for i in range(first)],
        # empty rather than null: Arrow's writer goes over all null arrays at the end of a batch again for each further row
        F.when(size > first, rest).otherwise(F.array().cast("array<string>")).alias("rest"), F.when(F.size("unbinned") > 0, F.array_join("unbinned", " ")).alias("stray"),
    )
    out = f"doc_id {kind['doc_id']}, page {kind['page']}, y {kind['y']}, label string, made int, col int, expected long, value long, n long, used string, ok boolean, note string"
    fields = T._parse_datatype_string(out)
    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields.fields]

    def checked(batch: pa.RecordBatch, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((places(batch.column("y")), places(batch.column("page")), doc))
        batch = batch.take(pa.array(order))
        page, y = places(batch.column("page")), places(batch.column("y"))
        place = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]) | (y[1:] != y[:-1])])
        x, at_x = batch.column("x0").fill_null(0).to_numpy(), batch.column("x0").is_valid().to_numpy(zero_copy_only=False)
        told, rest = batch.column("told").to_numpy(), batch.column("rest")
        bounds, beyond = rest.offsets.to_numpy(), rest.values
        is_figure = pc.fill_null(pc.not_equal(beyond, " "), False)
        more = pc.replace_substring(pc.if_else(is_figure, beyond, "0"), ".", "").cast(pa.int64()).to_numpy()
        is_figure = is_figure.to_numpy(zero_copy_only=False)
        wide, written = np.diff(bounds), np.r_[0, np.cumsum(beyond.is_valid().to_numpy(zero_copy_only=False))]
        size = sum((told >> 2 * i & 1 for i in range(first)), wide)
        full = sum((told >> 2 * i + 1 & 1 for i in range(first)), np.diff(written[bounds]))
        at_edge = np.flatnonzero((full > 0) & at_x)
        item, total, both = (np.r_[a, np.full(int(doc[-1]) + 1 - len(a), f)] for a, f in zip(indents_of(doc[at_edge], np.rint(x[at_edge]), place[at_edge]), (np.nan, np.nan, False), strict=True))
        indented = both[doc]

        def figures(col: int) -> tuple[np.ndarray, np.ndarray]:
            if col < first:
                return units(batch.column(f"f{col}"))
            v, k, there = np.zeros(len(doc), np.int64), np.zeros(len(doc), bool), np.flatnonzero(wide > col - first)
            v[there], k[there] = more[bounds[there] + col - first], is_figure[bounds[there] + col - first]
            return v, k

        parts: list[tuple] = []

        def add(made: int, at: np.ndarray, col, expected, value, n, used, ok, note=None) -> None:
            each = lambda v, k: v if isinstance(v, pa.Array) else pa.array(v, k) if isinstance(v, (np.ndarray, list)) else pa.repeat(pa.scalar(v, k), len(at))
            parts.append((at, [each(v, k) for v, k in zip((made, col, expected, value, n, used, ok, note), kinds[4:], strict=True)]))

        own = np.flatnonzero(indented & at_x)
        filled = (full > 0) | (told & UNREAD > 0)
        items, starts, closed = sections_at_once(x[own], item[doc[own]], total[doc[own]], doc[own], filled[own])
        read = [figures(col) for col in range(max(n_columns, first + int(wide[own].max()) if len(own) else 0))]
        for col, (v, k) in enumerate(read):
            at, expected, n, value, ok = summed_at_once(v[own], k[own], items, starts, closed)
            add(0, own[at], col, expected, value, n, None, ok)
        flat = np.flatnonzero(~indented)
        ranks = np.cumsum(np.r_[0, np.diff(doc[flat]) > 0]) if len(flat) else flat
        nums, known = (np.array([f[k][flat] for f in read[:n_columns]]).reshape(n_columns, len(flat)) for k in (0, 1))
        for col, at, expected, n, _, _, used, value, ok in judged_columns(ranks, told[flat] & IS_TOTAL > 0, nums, known):
            add(1, flat[at], col, expected, value, n, used, ok)
        at = np.flatnonzero(batch.column("stray").is_valid().to_numpy(zero_copy_only=False))
        add(2, at, None, None, None, None, None, False, batch.column("stray").take(pa.array(at)))
        at = own[(np.abs(x[own] - item[doc[own]]) <= 2.0) & (full[own] > 0) & (full[own] < size[own])]
        cells = lambda i: [*[told[i] >> 2 * k & 3 for k in range(first) if told[i] >> 2 * k & 1], *[1 if v is None else 3 for v in rest[int(i)].as_py()]]
        empty = [",".join(str(k) for k, c in enumerate(cells(i)) if c == 1) for i in at]
        add(3, at, None, None, None, None, None, False, empty)
        taken = pa.array(np.concatenate([p[0] for p in parts]))
        made = [pa.concat_arrays(cs) for cs in zip(*[p[1] for p in parts], strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in names[:4]], *made], names)

    at_once = min(ROWS_AT_ONCE, max(2 * CELLS_AT_ONCE // max(n_columns, 1) ** 2, 1))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc in whole_documents(batches, at_once):
            yield checked(batch, doc)

    found = own.mapInArrow(check, fields)
    exact = lambda c: F.expr(f"cast(cast({c} as decimal(20,0)) * 0.0001 as decimal(18,4))")
    made, n = F.col("made"), F.col("n").cast("string")
    scope = F.coalesce(F.get(F.array(*[F.lit(f"col{i}") for i in range(first)]), F.col("col")), F.concat(F.lit("col"), F.col("col").cast("string")), F.lit("row"))
    return found.withColumns({"expected": exact("expected"), "value": exact("value")}).select(
        "doc_id", "page", "y", F.get(F.array(*[F.lit(m) for m in MADE]), made).alias("check"), scope.alias("scope"), "label", "expected",
        F.col("value").alias("got"), F.round(F.col("value") - F.col("expected"), 2).cast("decimal(18,2)").alias("diff"), "ok",
        F.when(made == 0, F.concat(n, F.lit(" item(s)"))).when(made == 1, F.concat(n, F.lit(" row(s) above it, as "), F.col("used"))).when(made == 2, F.col("note"))
        .otherwise(F.concat(F.lit("empty column(s): "), F.col("note"))).alias("note"),
    )


def unbinned_audit(rows: DataFrame) -> DataFrame:
    """V4: every row with a figure that fell in no column fails, with the figures."""
    return rows.filter(F.size("unbinned") > 0).select("doc_id", "page", "y", *(["label"] if "label" in rows.columns else []), F.lit("unbinned").alias("check"), F.lit(False).alias("ok"), F.array_join("unbinned", " ").alias("note"))


def ragged_rows(rows: DataFrame) -> DataFrame:
    """V5: item rows that fill some columns but not all, with the empty ones."""
    own = (rows if "item_x0" in rows.columns else with_indents(rows)).filter(F.abs(F.col("x0") - F.col("item_x0")) <= 2.0)
    empty = F.filter(F.transform("values", lambda v, i: F.when(F.coalesce(v, F.lit("")) == "", i)), lambda i: i.isNotNull())
    return own.withColumn("empty", empty).filter((F.size("empty") > 0) & (F.size("empty") < F.size("values"))).select("doc_id", "page", "y", "label", F.array_join("empty", ",").alias("empty"))


def check_summary(checks: DataFrame) -> DataFrame:
    """V7: passed and failed by check, and a row `all` with the totals."""
    each = checks.select(F.explode(F.array("check", F.lit("all"))).alias("check"), "ok")
    return each.groupBy("check").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def failing_rows(checks: DataFrame) -> DataFrame:
    """V7: the checks that failed, with what they read and what is printed."""
    return checks.filter(~F.col("ok")).select("doc_id", "page", "y", "check", "scope", "label", "expected", "got", "diff", "note")


def periodic_tie_out(rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """V9: whether the parts of a row, two at least, sum to its total column: the first of `names` that is total, ytd or sum,
    else the last column."""
    named = [i for i, n in enumerate(names or []) if n.strip().lower() in ("total", "ytd", "sum")]
    parsed = F.transform("values", parse_figure)
    at = F.lit(named[0]) if named else F.size("v") - 1
    own = rows.withColumn("v", parsed).withColumn("total", F.get("v", at))
    own = own.withColumn("parts", F.filter(F.transform("v", lambda x, i: F.when(i != at, x)), lambda x: x.isNotNull()))
    own = own.filter((F.size("parts") >= 2) & F.col("total").isNotNull())
    got = F.aggregate("parts", F.lit(0).cast("decimal(38,4)"), lambda s, x: (s + x).cast("decimal(38,4)"))
    return own.select("doc_id", "row_no", "total", got.alias("got"), (F.abs(got - F.col("total")) < 0.02).alias("ok"))


def arithmetic_identities(rows: DataFrame, rules: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """For each rule (expected, got, tolerance) a check of every row where both are present."""
    made = [F.struct(F.lit(name).alias("check"), e.cast("decimal(18,4)").alias("expected"), g.cast("decimal(18,4)").alias("got"), (F.abs(e - g) <= tol).alias("ok")) for name, (e, g, tol) in rules.items()]
    return rows.select("doc_id", "row_no", F.explode(F.array(*made)).alias("c")).select("doc_id", "row_no", "c.*").filter("expected IS NOT NULL AND got IS NOT NULL")


def bill_balance(rows: DataFrame) -> DataFrame:
    """Previous + current - payments = due within 0.02, only where all four are printed."""
    names = ["previous", "current", "payments", "due"]
    # read within a generator, through which no condition is pushed: each figure is read once, not again for every use
    read = F.inline(F.array(F.struct(*[parse_figure(F.col(n)).alias(n) for n in names])))
    own = rows.select("doc_id", *names).filter(" AND ".join(f"{n} IS NOT NULL" for n in names)).select("doc_id", read).dropna(subset=names)
    got = F.col("previous") + F.col("current") - F.col("payments")
    return own.select("doc_id", "due", got.cast("decimal(18,4)").alias("got"), (F.abs(got - F.col("due")) <= 0.02).alias("ok"))


def token_census(source: DataFrame, output: DataFrame) -> DataFrame:
    """Money tokens (doc_id, token) that don't occur equally often on both sides."""
    a, b = source.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n_source")), output.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n_output"))
    both = a.join(b, ["doc_id", "token"], "full_outer")
    both = both.select("doc_id", "token", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_output", F.lit(0)).alias("n_output"))
    return both.filter("n_source <> n_output")


def column_type_vote(cells: DataFrame) -> DataFrame:
    """The most common kind of each column's values; ties to the kind seen first."""
    counts = cells.withColumn("kind", value_kind(F.col("text"))).groupBy("col", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("col").agg(F.max_by("kind", F.struct("n", (-F.col("first")).alias("f"))).alias("kind"), F.sum("n").alias("n"))


def flag_rollup(checks: DataFrame) -> DataFrame:
    """Per row of a document the failed checks' notes joined and the columns they mark."""
    bad = checks.filter(~F.col("ok"))
    return bad.groupBy("doc_id", "page", "y").agg(
        F.array_join(F.array_sort(F.collect_set("check")), "; ").alias("why"), F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("columns")
    )


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str, intended: DataFrame) -> DataFrame:
    """Cells that differ between two versions; `intended` says which of the differences were meant."""
    joined = before.select(*keys, F.col(value).alias("was")).join(after.select(*keys, F.col(value).alias("now")), keys, "full_outer")
    changed = joined.filter(~F.col("was").eqNullSafe(F.col("now")))
    meant = intended.select(*keys).distinct().withColumn("meant", F.lit(True))
    return changed.join(meant, keys, "left").withColumn("meant", F.coalesce("meant", F.lit(False)))


def recipe_scoreboard(runs: DataFrame) -> DataFrame:
    """Per recipe how often it was applied, reconciled and failed."""
    return runs.groupBy("slug").agg(F.count(F.lit(1)).alias("applied"), F.count_if("reconciled").alias("reconciled"), F.count_if(~F.col("reconciled")).alias("failed"))


def count_parity(anchors: DataFrame, records: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Documents whose number of anchors differs from their number of records, or of steps where both sides have a column
    `steps`; and with `issues` (doc_id) those that yield neither a record nor an issue."""
    steps = "steps" in anchors.columns and "steps" in records.columns
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name), *([F.sum("steps").alias(f"{name}_steps")] if steps else []))
    both = count(anchors, "anchors").join(count(records, "records"), "doc_id", "full_outer")
    both = both.na.fill(0, [c for c in both.columns if c != "doc_id"])
    wrong = F.col("anchors") != F.col("records")
    if steps:
        wrong = wrong | (F.col("anchors_steps") != F.col("records_steps"))
    if issues is not None:
        both = both.join(issues.select("doc_id").distinct().withColumn("stated", F.lit(True)), "doc_id", "left")
        silent = (F.col("records") == 0) & F.col("stated").isNull()
        both, wrong = both.withColumn("silent", silent).drop("stated"), wrong | F.col("silent")
    return both.filter(wrong)


def evidence_lines(values: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of a page that print a value, not inside a longer word or figure; a value that no line prints alone is looked
    for across line ends, and is then found at the line where it begins. Joined by page, not by all lines."""
    quoted = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), v, F.lit(r"\E(?![A-Za-z0-9])"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = lines.groupBy("doc_id", "page").agg(rows.alias("rows"))
    own = values.filter("value <> ''").select("doc_id", "page", "field", "value").join(pages, ["doc_id", "page"])
    prints = lambda r: r["text"].contains(F.col("value")) & F.regexp_like(r["text"], quoted(F.col("value")))
    own = own.withColumn("at", F.transform(F.filter("rows", prints), lambda r: r["line_no"]))
    whole = F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["text"]), " "), r"\s+", " ")
    flat = F.regexp_replace("value", r"\s+", " ")
    place = F.when(whole.contains(flat) & F.regexp_like(whole, quoted(flat)), F.instr(whole, flat))
    own = own.withColumn("place", F.when(F.size("at") == 0, place))
    ends = F.transform("rows", lambda r, i: F.struct(r["line_no"].alias("n"), F.length(F.regexp_replace(F.array_join(F.transform(F.slice("rows", 1, i + 1), lambda x: x["text"]), " "), r"\s+", " ")).alias("upto")))
    across = F.get(F.filter(ends, lambda e: e["upto"] >= F.col("place")), F.lit(0))["n"]
    own = own.withColumn("found", F.when(F.size("at") > 0, F.transform("at", lambda n: F.struct(n.alias("line_no"), F.lit("line").alias("method")))).when(F.col("place").isNotNull(), F.array(F.struct(across.alias("line_no"), F.lit("across lines").alias("method")))))
    return own.select("doc_id", "page", "field", "value", F.explode("found").alias("f")).select("doc_id", "page", "field", "value", "f.*")


def ground_values(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Cells (doc_id, row_no, value) not found in their source: a figure must occur there by its signed value, other text
    of four letters and digits or more as a part of the folded text. Blank cells are not looked at."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\(?-?\$?[\d,]*\.?\d+\)?-?%?"), F.lit(0)), parse_figure))
    src = sources.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    src = src.select("doc_id", found.alias("figures"), plain(F.col("text")).alias("folded"))
    own = cells.filter("trim(value) <> ''").join(src, "doc_id", "left").withColumn("v", parse_figure(F.col("value")))
    text = plain(F.col("value"))
    ok = F.when(F.col("v").isNotNull(), F.array_contains("figures", F.col("v"))).when(F.length(text) >= 4, F.col("folded").contains(text)).otherwise(True)
    return own.withColumn("ok", F.coalesce(ok, F.lit(False))).select("doc_id", "row_no", "value", "ok")


def ungrounded(checked: DataFrame) -> DataFrame:
    """Of what `ground_values` returns per document how many cells were checked and how many aren't grounded."""
    return checked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("ok")).alias("ungrounded"))


def output_shape(tables: DataFrame, declared: Sequence[str] | None = None, most_columns: int = 80, most_rows: int = 1000) -> DataFrame:
    """Tables (doc_id, columns, rows) with their rows padded or cut to the columns, how many were, and what is wrong."""
    names = F.transform("columns", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    own = tables.select("doc_id", names.alias("columns"), "rows")
    width = F.size("columns")
    blank = F.array_repeat(F.lit(None).cast("string"), width)
    why = (
        F.when((width < 1) | (width > most_columns), "number of columns")
        .when(F.exists("columns", lambda c: c == "") | (F.size(F.array_distinct("columns")) < width), "column names blank or repeated")
        .when(~(F.col("columns") == F.array(*[F.lit(c) for c in declared])) if declared else F.lit(False), "not the declared columns")
        .when((F.size("rows") < 1) | (F.size("rows") > most_rows), "number of rows")
    )
    level = F.transform("rows", lambda r: F.slice(F.concat(r, blank), 1, F.greatest(width, F.lit(1))))
    return own.select("doc_id", "columns", level.alias("rows"), F.size(F.filter("rows", lambda r: F.size(r) != width)).alias("ragged"), F.coalesce(why, F.lit("")).alias("problem"))


def cell_verify(output: DataFrame, printed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per field how many of the cells that should be there (keys, field, value as printed) agree with the output's number
    when that is printed with as many decimals; mismatches, and those without an output to compare."""
    digits = lambda c: F.regexp_replace(c, r"[$,\s]", "")
    own = printed.select(*keys, "field", digits(F.col("value")).alias("want")).filter("want <> ''")
    own = own.join(output.select(*keys, "field", F.col("value").cast("decimal(28,6)").alias("out")), [*keys, "field"], "left")
    negative = F.col("want").rlike(r"^\(.*\)$|-")
    bare = F.regexp_replace("want", "[()-]", "")
    places = F.length(F.regexp_extract(bare, r"\.(\d+)$", 1))
    shown = F.coalesce(*[F.when(places == n, F.abs("out").cast(f"decimal(28,{n})").cast("string")) for n in range(7)])
    same = (shown == F.regexp_replace(bare, r"^\.", "0.")) & (((F.col("out") < 0) == negative) | (F.col("out") == 0))
    own = own.withColumn("same", F.when(F.col("out").isNotNull() & bare.rlike(r"^\d*\.?\d+$"), same))
    return own.groupBy("field").agg(F.count("same").alias("compared"), F.count_if(~F.col("same")).alias("mismatches"), F.count_if(F.col("same").isNull()).alias("unchecked"))


def printed_section_totals(data: DataFrame, printed: DataFrame) -> DataFrame:
    """V8: each section's column sums against the report's own total line (doc_id, section, values), within 0.011."""
    cells = lambda df: df.select("doc_id", "section", F.posexplode(F.transform("values", parse_figure)).alias("col", "v")).filter("v IS NOT NULL")
    sums = cells(data).groupBy("doc_id", "section", "col").agg(F.sum("v").alias("got"), F.count(F.lit(1)).alias("n"))
    both = cells(printed).withColumnRenamed("v", "expected").join(sums, ["doc_id", "section", "col"])
    diff = F.col("got") - F.col("expected")
    return both.select("doc_id", "section", "col", "expected", "got", "n", (F.abs(diff) <= TOL).alias("ok"))


def variance_tie_out(rows: DataFrame, least: int = 5) -> DataFrame:
    """Per document the consecutive columns (a, b, v) whose rows best hold a - b = v, if half of them do; ties to the first."""
    parsed = rows.select("doc_id", F.transform("values", parse_figure).alias("v")).filter(F.size("v") >= 3)
    triple = F.transform(F.sequence(F.lit(0), F.size("v") - 3), lambda i: F.struct(i.alias("first"), F.get("v", i).alias("a"), F.get("v", i + 1).alias("b"), F.get("v", i + 2).alias("d")))
    own = parsed.select("doc_id", F.explode(triple).alias("t")).select("doc_id", "t.*").dropna()
    counts = own.groupBy("doc_id", "first").agg(F.count_if(F.abs(F.col("a") - F.col("b") - F.col("d")) < 0.02).alias("ok"), F.count(F.lit(1)).alias("checked"))
    share = F.col("ok") / F.col("checked")
    best = counts.filter(F.col("checked") >= least).groupBy("doc_id").agg(F.max_by(F.struct("first", "ok", "checked"), F.struct(share.alias("s"), (-F.col("first")).alias("f"))).alias("b"))
    return best.select("doc_id", F.col("b.first").alias("first_col"), "b.ok", "b.checked").filter("2 * ok >= checked")


def document_report(pages: DataFrame, checks: DataFrame) -> DataFrame:
    """Per document its pages, tables, mean confidence and reconciled checks; CHECK below 95 % reconciled or 0.4 confidence."""
    p = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.sum("tables").alias("tables"), F.avg("confidence").alias("confidence"))
    c = checks.groupBy("doc_id").agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total"))
    both = p.join(c, "doc_id", "left").withColumns({"ok": F.coalesce("ok", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    doubtful = (F.col("ok") * 100 < F.col("total") * 95) | (F.col("confidence") < 0.4)
    return both.withColumn("status", F.when(doubtful, "CHECK").otherwise("OK"))


def aging_buckets(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Each line's buckets against its amount, and each document's sum of amounts against the printed total."""
    zero = F.lit(0).cast("decimal(38,4)")
    got = F.aggregate(F.transform("buckets", parse_figure), zero, lambda s, x: (s + F.coalesce(x, zero)).cast("decimal(38,4)"))
    own = rows.select("doc_id", "row_no", parse_figure(F.col("amount")).alias("expected"), got.alias("got"))
    sums = own.groupBy("doc_id").agg(F.sum("expected").cast("decimal(38,4)").alias("got"))
    whole = printed.select("doc_id", parse_figure(F.col("total")).alias("expected")).join(sums, "doc_id")
    checks = own.withColumn("check", F.lit("line")).unionByName(whole.withColumn("check", F.lit("document")), allowMissingColumns=True)
    return checks.filter("expected IS NOT NULL").select("doc_id", "row_no", "check", "expected", "got", (F.abs(F.col("got") - F.col("expected")) <= TOL).alias("ok"))


def ground_by_parts(values: DataFrame, sources: DataFrame) -> DataFrame:
    """A value of three digits or more is grounded if its digits occur among the source's, else if half its name parts do. A
    document's values come to its text in one row, so that a text is shuffled once whatever the number of values."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    v = F.trim(F.coalesce("value", F.lit("")))
    parts = F.transform(F.filter(F.split(v, r"[\s,&]+"), lambda p: F.length(p) > 2), plain)
    own = values.select("doc_id", F.struct("field", "value", plain(v).alias("plain"), digits(v).alias("digits"), parts.alias("parts"), (v == "").alias("blank")).alias("v"))
    own = own.groupBy("doc_id").agg(F.collect_list("v").alias("vs"))
    src = sources.select("doc_id", plain(F.col("text")).alias("src"), digits(F.col("text")).alias("src_digits"))
    text = F.col("src")

    def grounded(x: Column) -> Column:
        hits = F.size(F.filter(x["parts"], lambda p: text.contains(p)))
        return (
            F.when(x["blank"], True)
            .when(F.length(x["digits"]) >= 3, F.col("src_digits").contains(x["digits"]))
            .when(F.size(x["parts"]) > 0, hits >= F.greatest(F.lit(1), F.floor(F.size(x["parts"]) / 2)))
            .otherwise(text.contains(x["plain"]))
        )

    judged = F.transform("vs", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.coalesce(grounded(x), F.lit(False)).alias("ok")))
    return own.join(src, "doc_id", "left").select("doc_id", F.explode(judged).alias("j")).select("doc_id", "j.*")


def required_fields(cells: DataFrame, required: list[str], free_layout: bool = False) -> DataFrame:
    """Blank required cells and values not found in the source block; other blanks warn where the layout is free."""
    blank, needed = F.coalesce("value", F.lit("")) == "", F.col("column").isin(required)
    severity = F.when(~blank, F.when(~F.col("matched"), "Blocking")).when(needed, "Blocking").when(F.lit(free_layout), "Warning")
    return cells.withColumn("severity", severity).filter(F.col("severity").isNotNull()).select("doc_id", "row_no", "column", "value", "severity")


def multi_pass_pick(passes: DataFrame, keys: list[str]) -> DataFrame:
    """Per page the pass with the fewest problems, ties to the earlier; keys on which it and the first other, both clean, differ."""
    row = F.struct("problems", "pass", *keys)
    own = passes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    own = own.withColumn("best", F.col("rows")[0])
    others = F.filter("rows", lambda r: r["pass"] != F.col("best.pass"))
    own = own.withColumn("other", F.array_min(F.transform(others, lambda r: F.struct(r["pass"], r.alias("r"))))["r"])
    clean = (F.col("best.problems") == 0) & (F.col("other.problems") == 0)
    differ = F.concat_ws(", ", *[F.when(clean & ~F.col(f"best.{k}").eqNullSafe(F.col(f"other.{k}")), k) for k in keys])
    return own.select("doc_id", "page", F.col("best.pass").alias("pass"), F.col("best.problems").alias("problems"), differ.alias("differ"))


def shadow_flags(rows: DataFrame, tokens: DataFrame, col: int, lo: float, hi: float) -> DataFrame:
    """Rows that read empty in a column although label tokens (doc_id, page, y, text, x1) end within its x range."""
    empty = rows.filter(F.coalesce(F.get("values", F.lit(col)), F.lit("")) == "").select("doc_id", "page", "y", "label")
    inside = tokens.filter(F.col("x1").between(lo, hi)).select("doc_id", "page", "y", "x1", "text")
    parts = F.array_sort(F.collect_list(F.struct("x1", "text")))
    found = empty.join(inside, ["doc_id", "page", "y"]).groupBy("doc_id", "page", "y", "label").agg(parts.alias("p"))
    return found.select("doc_id", "page", "y", "label", F.array_join(F.transform("p", lambda t: t["text"]), " ").alias("detail"))


# What a spreadsheet shows for a cell that failed.
CELL_ERROR = r"^#(REF!|DIV/0!|VALUE!|NAME\?|N/A|NUM!|NULL!)$"


def cell_error_audit(cells: DataFrame) -> DataFrame:
    """The cells that show a spreadsheet error."""
    return cells.filter(F.trim("value").rlike(CELL_ERROR)).select("doc_id", "row_no", "col", "value")
