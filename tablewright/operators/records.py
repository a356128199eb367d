"""Records: physical lines folded into logical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.vocabulary import parse_figure
from tablewright.operators.checks import has_figures, with_indents


def row_kind(rows: DataFrame) -> DataFrame:
    """head (at the item indent, with a label and figures), continuation (figures elsewhere) or note."""
    own = with_indents(rows)
    at_item = F.abs(F.col("x0") - F.col("item_x0")) <= 2.0
    kind = F.when(has_figures() & at_item & (F.trim("label") != ""), "head").when(has_figures(), "continuation").otherwise("note")
    return own.withColumn("kind", F.coalesce(kind, F.lit("note"))).drop("item_x0", "total_x0")


def assemble_records(kinds: DataFrame) -> DataFrame:
    """a new record at each head; rows before the first head are record 0, without a head."""
    w = Window.partitionBy("doc_id").orderBy("page", "y").rowsBetween(Window.unboundedPreceding, 0)
    return kinds.withColumn("record_id", F.sum((F.col("kind") == "head").cast("int")).over(w))


def section_carry(rows: DataFrame, prefix: str) -> DataFrame:
    """the section named by the last heading above, across pages; the heading itself carries its own name."""
    w = Window.partitionBy("doc_id").orderBy("page", "y").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("label").startswith(prefix) & ~has_figures(), F.btrim(F.substr("label", F.lit(len(prefix) + 1))))
    return rows.withColumn("section", F.last(name, ignorenulls=True).over(w))


def inherit_parent(rows: DataFrame) -> DataFrame:
    """rows without a name take the last name above within the document; a total row ends the inheritance."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    ends = F.sum(F.col("is_total").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = rows.withColumn("run", F.coalesce(ends, F.lit(0)))
    inner = Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("parent", F.last("name", ignorenulls=True).over(inner))
    return own.withColumn("orphan", F.col("parent").isNull()).drop("run")


def repeat_keys(rows: DataFrame, money: str = "amount") -> DataFrame:
    """lines without a suite repeat the suite and tenant above; the suite's money stays on its first line alone; a line with
    no suite above is flagged."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("suite").isNotNull(), F.struct("suite", "tenant")), ignorenulls=True).over(w)
    own = rows.withColumn("first", F.col("suite").isNotNull()).withColumn("head", head)
    own = own.withColumns({"suite": F.col("head.suite"), "tenant": F.col("head.tenant"), money: F.when(F.col("first"), F.col(money)), "flag": F.when(F.col("head").isNull(), "no suite above")})
    return own.drop("head", "first")


def between_markers(lines: DataFrame, start: str, end: str) -> DataFrame:
    """F16: the lines after a start marker and before the next end marker."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(start), 1).when(F.col("text").rlike(end), 0)
    return lines.withColumn("inside", F.last(mark, ignorenulls=True).over(w)).filter((F.col("inside") == 1) & ~F.col("text").rlike(start)).drop("inside")


# An amount on a bill, and lines of its charges that are no charge.
BILL_AMOUNT = r"-?\$?[\d,]+\.\d{2}"
PERIOD_LINE, TOTAL_LINE = r"(?i)billing\s*period", r"(?i)from\s*this\s*billing"


def charge_lines(lines: DataFrame, start: str, end: str) -> DataFrame:
    """F16: what the lines between two markers are: charge, total (so labelled, or the amount alone if none is) or period; with
    label, amount and days. Lines without an amount are left out but for the period."""
    own = between_markers(lines, start, end)
    amount = F.regexp_extract("text", f"({BILL_AMOUNT})(?!.*{BILL_AMOUNT})", 1)
    rest = F.trim(F.regexp_replace("text", BILL_AMOUNT, ""))
    label = F.regexp_replace(F.regexp_replace(rest, r"(?i)\s*-?\s*for\s+\d+\s*days?.*$", ""), r"^[ -]+|[ -]+$", "")
    days = F.regexp_extract("text", r"(?i)for\s+(\d+)\s*days?", 1)
    kind = (
        F.when(F.col("text").rlike(TOTAL_LINE), "total")
        .when(F.col("text").rlike(PERIOD_LINE), "period")
        .when(amount == "", None)
        .when(F.length(rest) <= 3, "bare")
        .otherwise("charge")
    )
    own = own.select("doc_id", "page", "line_no", kind.alias("kind"), label.alias("label"), parse_figure(amount).alias("amount"), days.try_cast("int").alias("days")).filter("kind IS NOT NULL")
    page = Window.partitionBy("doc_id", "page")
    labelled, last = F.count_if(F.col("kind") == "total").over(page), F.max(F.when(F.col("kind") == "bare", F.col("line_no"))).over(page)
    own = own.withColumns({"labelled": labelled, "last": last})
    kind = F.when((F.col("kind") == "bare") & (F.col("labelled") == 0) & (F.col("line_no") == F.col("last")), "total").otherwise(F.col("kind"))
    return own.withColumn("kind", kind).filter("kind <> 'bare'").drop("labelled", "last")


def rejoin_wrapped(lines: DataFrame) -> DataFrame:
    """lines without figures joined onto the record that the last line with figures began."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("record", F.sum(F.col("text").rlike(r"\d").cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return own.groupBy("doc_id", "page", "record").agg(F.min("line_no").alias("line_no"), text.alias("text"))


def two_line_steps(lines: DataFrame) -> DataFrame:
    """rent steps (a line with a date) with the rate for each foot from the line below, one without a date but with a rent;
    more than one such line below a step, and one with no step above, is flagged."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    own = lines.withColumn("step", F.sum(F.col("step_date").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = F.array_sort(F.collect_list(F.when(F.col("step_date").isNull() & F.col("step_rent").isNotNull(), F.struct("line_no", "step_rent"))))
    head = F.max(F.when(F.col("step_date").isNotNull(), F.struct("line_no", "step_date", "step_rent"))).alias("h")
    own = own.groupBy("doc_id", "step").agg(head, more.alias("more")).filter("step > 0 OR size(more) > 0")
    flag = F.when(F.col("step") == 0, "rate with no step above").when(F.size("more") > 1, "more than one rate")
    return own.select("doc_id", "step", "h.step_date", F.col("h.step_rent").alias("monthly"), F.get("more", F.lit(0))["step_rent"].alias("psf"), flag.alias("flag"))


def series_by_code(steps: DataFrame) -> DataFrame:
    """a record's steps in numbered series, one for each charge code, as long as they are: code's place by first appearance,
    and its amounts in order. `series_wide` lays them out in columns."""
    own = steps.groupBy("doc_id", "code").agg(F.min("step").alias("first"), F.array_sort(F.collect_list(F.struct("step", "amount"))).alias("s"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "code"))
    return own.select("doc_id", "code", place.alias("place"), F.size("s").alias("n"), F.transform("s", lambda x: x["amount"]).alias("amounts"))


def series_wide(series: DataFrame) -> DataFrame:
    """a column for each code and number (code_1, code_2, ...), as many as the longest record has; the codes and their
    widths, a row for each code, are read first."""
    widths = series.groupBy("code").agg(F.max("n").alias("w")).orderBy("code").collect()  # a row for each charge code
    amount = lambda c, k: F.max(F.when(F.col("code") == c, F.get("amounts", F.lit(k)))).alias(f"{c.lower()}_{k + 1}")
    return series.groupBy("doc_id").agg(*[amount(r.code, k) for r in widths for k in range(r.w)])


def header_levels(rows: DataFrame, section: tuple[float, float], group: tuple[float, float], gap: tuple[float, float], values_from: float) -> DataFrame:
    """the section and group above each detail row. Rows (doc_id, page, y, is_detail, words array<struct<x0,text>>) whose first
    word lies in the section band are sections, or end one if they end in Totals; those in the group band are groups, or
    end one if they begin with Total. A group's heading has no word from `values_from` on, and runs through the gap between
    columns unless no detail row is open; other rows in its band continue the detail row above."""
    w = Window.partitionBy("doc_id").orderBy("page", "y").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("words")[0]["x0"]
    text = F.array_join(F.transform("words", lambda x: x["text"]), " ")
    inside = lambda band: (first >= band[0]) & (first < band[1])
    wide = F.exists("words", lambda x: (x["x0"] >= gap[0]) & (x["x0"] < gap[1]))
    far = F.exists("words", lambda x: x["x0"] >= values_from)
    own = rows.withColumn("text", text).withColumn("kind", F.when(F.col("is_detail"), "detail").when(inside(section), F.when(text.endswith("Totals"), "section total").otherwise("section")).when(inside(group) & text.startswith("Total"), "group total").when(inside(group) & ~far & wide, "group").when(inside(group) & ~far, "narrow").otherwise("line"))
    # a narrow row is a heading only where no detail row is open above it
    before = F.last(F.when(F.col("kind").isin("detail", "section", "section total", "group total", "group"), F.col("kind")), ignorenulls=True).over(w)
    own = own.withColumn("before", before)
    own = own.withColumn("kind", F.when(F.col("kind") == "narrow", F.when(F.col("before") == "detail", "line").otherwise("group")).otherwise(F.col("kind")))
    level = lambda name, ends: F.last(F.when(F.col("kind") == name, F.struct(F.col("text").alias("t"))).when(F.col("kind").isin(*ends), F.struct(F.lit(None).cast("string").alias("t"))), ignorenulls=True).over(w)["t"]
    own = own.withColumn("section", level("section", [])).withColumn("group", level("group", ["section", "section total", "group total"]))
    return own.select("doc_id", "page", "y", "kind", "text", "section", "group")


def anchor_blocks(lines: DataFrame, expenses: Sequence[str], most_bumps: int = 12) -> DataFrame:
    """a record for each block, which begins at each line of the first expense: its tenant, the amount of each expense, its first
    step as the current one, the later ones as bumps, and flags: expenses that aren't exactly the expected ones in order, a
    first step that isn't Current, bumps without a rate or beyond the most, no tenant, words in the tenant's column below."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("block", F.sum(F.coalesce(F.col("expense") == expenses[0], F.lit(False)).cast("int")).over(w)).filter("block > 0")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "tenant", "expense", "amount", "step_date", "rate")))
    own = own.groupBy("doc_id", "block").agg(rows.alias("rows"))
    seen = F.transform(F.filter("rows", lambda r: r["expense"].isNotNull()), lambda r: r["expense"])
    steps = F.filter("rows", lambda r: r["step_date"].isNotNull())
    notes = F.filter(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r["tenant"]), lambda t: t.isNotNull())
    own = own.withColumns({"seen": seen, "steps": steps, "notes": notes, "tenant": F.col("rows")[0]["tenant"]})
    bumps = F.slice("steps", F.lit(2), F.lit(most_bumps))
    first = F.get("steps", F.lit(0))
    flags = [
        F.when(F.col("seen") != F.array(*[F.lit(e) for e in expenses]), F.concat(F.lit("expense rows were "), F.array_join("seen", ", "))),
        F.when(first["step_date"] != "Current", "first step is not Current"),
        F.when(F.size("steps") - 1 > most_bumps, f"more than {most_bumps} bumps"),
        F.when(F.exists(bumps, lambda b: b["rate"].isNull()), "bump without a rate"),
        F.when(F.col("tenant").isNull(), "no tenant"),
        F.when(F.size("notes") > 0, F.concat(F.lit("tenant's column also says "), F.array_join("notes", " "))),
    ]
    amount = lambda e: F.element_at(F.concat(F.array(F.lit(None).cast("decimal(18,4)")), F.transform(F.filter("rows", lambda r: r["expense"] == e), lambda r: r["amount"])), -1)
    return own.select(
        "doc_id", "block", "tenant", *[amount(e).alias(f"expense_{n + 1}") for n, e in enumerate(expenses)], first["step_date"].alias("current_date"), first["rate"].alias("current_rate"),
        F.transform(bumps, lambda b: F.struct(b["step_date"].alias("date"), b["rate"].alias("rate"))).alias("bumps"), F.concat_ws("; ", *flags).alias("flags"),
    )


def suite_expense_rows(lines: DataFrame, known: Sequence[str]) -> DataFrame:
    """one row for each suite (a line with a suite begins it): the amount of each known expense, the sum and names of the others,
    the total printed two lines below the last expense, and what is wrong. A line is an expense only with an amount."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("block", F.sum(F.col("suite").isNotNull().cast("int")).over(w)).filter("block > 0")
    own = own.withColumn("is_type", F.col("label").isNotNull() & F.col("amount").isNotNull())
    block = Window.partitionBy("doc_id", "block")
    own = own.withColumn("at", F.row_number().over(block.orderBy("line_no"))).withColumn("last", F.max(F.when(F.col("is_type"), F.col("at"))).over(block))
    other = F.col("is_type") & ~F.col("label").isin(*known)
    agg = own.groupBy("doc_id", "block").agg(
        F.max("suite").alias("suite"),
        *[F.max_by("amount", F.when(F.col("is_type") & (F.col("label") == k), F.col("at"))).alias(f"type_{n + 1}") for n, k in enumerate(known)],
        F.coalesce(F.sum(F.when(other, F.col("amount"))), F.lit(0)).cast("decimal(28,4)").alias("other"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(other, F.struct("at", "label")))), lambda x: x["label"]), ", ").alias("other_names"),
        F.max(F.when((F.col("at") == F.col("last") + 2) & F.col("label").isNull(), F.col("amount"))).alias("total"),
    )
    parts = [F.col(f"type_{n + 1}") for n in range(len(known))]
    got = sum((F.coalesce(p, F.lit(0)) for p in parts), F.col("other")).cast("decimal(28,4)")
    problem = F.concat_ws(
        "; ", *[F.when(p.isNull(), f"missing {k}") for p, k in zip(parts, known, strict=True)],
        F.when(F.col("total").isNull(), "no total").when(F.abs(got - F.col("total")) > 1.5, "parts differ from the total"),
    )
    return agg.withColumn("problem", problem)


def charge_code(tokens: DataFrame) -> DataFrame:
    """per row the right-most all-capital token of two to four letters."""
    own = tokens.filter(F.col("text").rlike("^[A-Z]{2,4}$"))
    return own.groupBy("doc_id", "page", "row_id").agg(F.max_by("text", "x0").alias("code"))


def present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def series_columns(lines: DataFrame, min_records: int = 2, min_rows: int = 2) -> DataFrame:
    """per document the columns (from 0) that most continuation lines of most records fill."""
    record = Window.partitionBy("doc_id", "record_id")
    below = lines.filter("record_id > 0 AND kind = 'continuation'").withColumn("n", F.count(F.lit(1)).over(record)).filter(F.col("n") >= min_rows)
    cells = below.select("doc_id", "record_id", "n", F.posexplode("values").alias("col", "v"))
    counts = cells.groupBy("doc_id", "record_id", "n", "col").agg(F.count_if(present(F.col("v"))).alias("got"))
    seen = Window.partitionBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.withColumn("seen", F.size(F.collect_set("record_id").over(seen)))
    filled = counts.filter(F.col("got") >= F.greatest(F.lit(2.0), F.col("n") * 0.6)).groupBy("doc_id", "col", "seen").agg(F.count(F.lit(1)).alias("records"))
    enough = F.col("records") >= F.greatest(F.lit(float(min_records)), F.col("seen") * 0.6)
    return filled.filter((F.col("seen") >= min_records) & enough).select("doc_id", "col", "records")


def flatten_records(lines: DataFrame, series: list[int]) -> DataFrame:
    """one row for each record: its own fields, blank ones from its first line that has one, then its steps laid out.

    The head carries step one; `values` has room for the steps of the document's longest record. A task holds one record.
    """
    own = lines.filter("record_id > 0 AND kind IN ('head', 'continuation')")
    rows = F.array_sort(F.collect_list(F.struct("page", "y", "label", "values")))
    own = own.groupBy("doc_id", "record_id").agg(rows.alias("rows"))
    step = lambda r: F.array(*[F.get(r["values"], F.lit(i)) for i in series])
    steps = F.filter(F.transform("rows", step), lambda s: F.exists(s, present))
    head = F.col("rows")[0]
    columns = F.filter(F.sequence(F.lit(0), F.size(head["values"]) - 1), lambda i: ~i.isin(series))
    field = lambda i: F.get(F.filter(F.transform("rows", lambda r: F.get(r["values"], i)), present), F.lit(0))
    own = own.select("doc_id", "record_id", head["label"].alias("label"), F.transform(columns, field).alias("fields"), steps.alias("steps"))
    own = own.withColumn("longest", F.max(F.size("steps")).over(Window.partitionBy("doc_id")))
    blank = F.array_repeat(F.lit(None).cast("string"), (F.col("longest") - F.size("steps")) * len(series))
    return own.select("doc_id", "record_id", "label", F.size("steps").alias("n_steps"), F.concat("fields", F.flatten("steps"), blank).alias("values"))


def classify_by_recipe(rows: DataFrame, markers: list[str], contains: list[str], startswith: list[str], key: int | None) -> DataFrame:
    """section, summary, subtotal, other (no figure in the key column) or data, in that order."""
    label = F.trim(F.coalesce("label", F.lit("")))
    no = F.lit(False)
    any_of = lambda tests: F.coalesce(*[F.when(t, True) for t in tests], no) if tests else no
    other = parse_figure(F.get("values", F.lit(key))).isNull() if key is not None else no
    kind = (
        F.when(any_of([label.startswith(m) for m in markers]), "section")
        .when(any_of([label.contains(c) for c in contains]), "summary")
        .when(any_of([label.startswith(p) for p in startswith]), "subtotal")
        .when(other, "other")
        .otherwise("data")
    )
    return rows.withColumn("kind", kind)


def attach_series(classified: DataFrame) -> DataFrame:
    """F8: data rows open records; other rows with figures attach to the open one, its last subtotal is kept apart.

    A section heading closes the record; what follows it before the next data row belongs to none.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "y").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind").isin("data", "section"), F.col("kind")), ignorenulls=True).over(w)
    own = classified.withColumn("record_id", F.sum((F.col("kind") == "data").cast("int")).over(w)).withColumn("open", last == "data")
    role = F.when(F.col("kind") == "data", "head").when((F.col("kind") == "other") & has_figures(), "line").when(F.col("kind") == "subtotal", "subtotal")
    own = own.withColumn("role", role).filter(F.col("open") & F.col("role").isNotNull())
    later = F.max(F.struct("page", "y")).over(Window.partitionBy("doc_id", "record_id", "role"))
    own = own.withColumn("later", later).filter((F.col("role") != "subtotal") | (F.struct("page", "y") == F.col("later")))
    return own.select("doc_id", "record_id", "role", "page", "y", "label", "values")


def rejoin_split_amounts(tokens: DataFrame, gap: float = 30.0) -> DataFrame:
    """a token that starts with a comma joins the number fragment close to its left on the same line."""
    line = Window.partitionBy("doc_id", "page", "top").orderBy("x0", "x1", "text")
    before, edge = F.lag("text").over(line), F.lag("x1").over(line)
    glued = F.ltrim("text").startswith(",") & (F.col("x0") - edge < gap) & F.trim(before).rlike(r"^(-?\$?[\d,]*\d|,[\d,]*\d)$")
    run = F.sum((~F.coalesce(glued, F.lit(False))).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    own = tokens.withColumn("run", run).groupBy("doc_id", "page", "top", "run").agg(parts.alias("p"))
    text = F.when(F.size("p") > 1, F.array_join(F.transform("p", lambda t: F.trim(t["text"])), "")).otherwise(F.col("p")[0]["text"])
    return own.select("doc_id", "page", text.alias("text"), F.col("p")[0]["x0"].alias("x0"), F.element_at("p", -1)["x1"].alias("x1"), "top")
