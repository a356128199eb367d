"""Review: values found again on their pages, replies read back as rows, utility totals, titles and provenance."""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.vocabulary import fold_words


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def distinct_forms(forms: Column, least: int) -> Column:
    """The forms of at least so many characters, once each whatever their case, in order."""
    trimmed = F.filter(F.transform(forms, lambda f: F.trim(f)), lambda f: F.length(f) >= least)
    return F.filter(trimmed, lambda f, i: ~F.array_contains(F.transform(F.slice(trimmed, F.lit(1), i), F.lower), F.lower(f)))


def value_forms(value: Column) -> Column:
    """P10 for a value: as printed, then shorter runs of its leading words, then without its dollar sign."""
    whole = F.btrim(one_space(F.coalesce(value, F.lit(""))), F.lit(" :|"))
    words = F.split(whole, " ")
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda k: F.array_join(F.slice(words, F.lit(1), F.size(words) - k), " "))
    shorter = F.when(F.size(words) > 1, F.filter(shorter, lambda p: F.length(p) >= 3)).otherwise(F.array().cast("array<string>"))
    bare = F.when(whole.startswith("$"), F.array(F.element_at(F.split(F.substr(whole, F.lit(2)), " "), 1))).otherwise(F.array().cast("array<string>"))
    return distinct_forms(F.concat(F.array(whole), shorter, bare), 1)


def figure_forms(figure: Column) -> Column:
    """P10 for a figure: as written, without currency sign, with and without thousands commas and a space before percent; a
    phrase of more than three words also by its first three."""
    whole = F.btrim(one_space(F.coalesce(figure, F.lit(""))), F.lit(" *_`\"'“”.,;:()"))
    bare = F.ltrim(F.regexp_replace(whole, r"^[$€£ ]+", ""))
    plain = F.replace(bare, F.lit(","), F.lit(""))
    number = plain.rlike(r"^-?\d+(\.\d+)?$") & ~bare.contains(",")
    head = F.regexp_extract(bare, r"^(-?\d+)", 1)
    comma = F.concat(F.regexp_replace(head, r"(?<=\d)(?=(\d{3})+$)", ","), F.regexp_extract(bare, r"(\.\d+)$", 1))
    words = F.split(whole, " ")
    forms = F.array(
        whole, bare, plain, F.when(number, comma), F.regexp_replace(bare, r"\s+%", "%"), F.regexp_replace(bare, r"(\d)%", "$1 %"), F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " "))
    )
    return distinct_forms(F.filter(forms, lambda f: f.isNotNull()), 2)


def expand_values(values: DataFrame, figures: bool = False) -> DataFrame:
    """P10: a row for each form under which a value (doc_id, field, value) may be printed, in the order of trying."""
    forms = figure_forms(F.col("value")) if figures else value_forms(F.col("value"))
    return values.select("doc_id", "field", "value", F.posexplode(forms).alias("form_no", "form"))


class Figure(str):
    """A number, as printed."""


def printed(value: object) -> str | None:
    """A value of a reply as text: text and figures as they stand, null as none, what is nested as JSON without spaces."""
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    inner = lambda v: v if isinstance(v, Figure) else json.dumps(v, ensure_ascii=False) if isinstance(v, str) else "null" if v is None else printed(v)
    if isinstance(value, list):
        return "[" + ",".join(inner(v) for v in value) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{inner(v)}" for k, v in value.items()) + "}"


def reply_rows(reply: str | None) -> list[dict] | None:
    """The objects of a reply, None if it can't be read: the whole without its fences, else what its outermost brackets hold. Of a
    repeated name the last counts."""
    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", (reply or "").strip(), flags=re.IGNORECASE | re.MULTILINE).strip()
    for part in (text, text[text.find("[") : text.rfind("]") + 1] if "[" in text else ""):
        try:
            found = json.loads(part, parse_float=Figure, parse_int=Figure, parse_constant=Figure)
        except ValueError:
            continue
        found = [found] if isinstance(found, dict) else found
        return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else None
    return None


def parse_replies(replies: DataFrame) -> DataFrame:
    """Rows of a model's replies (doc_id, reply): fences go; a list of objects, or one object alone, else the outermost bracketed
    part; what isn't an object is dropped. A reply that can't be read is kept as one row with an error. Values stay as printed."""
    own = replies.select("doc_id", "reply")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, cells, errors = [], [], [], []
            for i, reply in enumerate(batch.column("reply").to_pylist()):
                rows = reply_rows(reply)
                for n, row in enumerate(rows if rows is not None else [None]):
                    at.append(i)
                    number.append(None if row is None else n)
                    cells.append(None if row is None else [(k, printed(v)) for k, v in row.items()])
                    errors.append("not readable" if row is None else "")
            kind = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), pa.array(cells, kind), pa.array(errors, pa.string())], ["doc_id", "row_no", "cells", "error"])

    return own.mapInArrow(read, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, row_no int, cells map<string,string>, error string")


def answer_rows(groups: DataFrame, replies: DataFrame, excerpts: DataFrame, unread: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row for each group (grp, files): its reply's value for each field (replies: grp, cells map, error), sources and notes
    apart, the first 12 excerpts (grp, ord, file, label), files not read with their reason (grp, file, why), and how many fields
    were found. A group none of whose files can be read says so."""
    shown = F.slice(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("|", "file", "label").alias("t")))), 1, 12)
    shown = excerpts.groupBy("grp").agg(F.array_join(F.transform(shown, lambda x: x["t"]), "; ").alias("excerpts"))
    left = F.array_sort(F.collect_list(F.struct("file", F.concat(F.col("file"), F.lit(" ("), F.col("why"), F.lit(")")).alias("t"))))
    left = unread.groupBy("grp").agg(F.array_join(F.transform(left, lambda x: x["t"]), "; ").alias("unread"), F.count(F.lit(1)).alias("n_unread"))
    own = groups.join(replies, "grp", "left").join(shown, "grp", "left").join(left, "grp", "left")
    none = F.coalesce("n_unread", F.lit(0)) >= F.col("files")
    error = F.when(none, "nothing readable").when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(F.col("cells").isNull(), "no reply").otherwise("")
    got = lambda f: F.when(~none, F.try_element_at("cells", F.lit(f)))
    found = sum((F.coalesce(~got(f).isin("", "null"), F.lit(False)).cast("int") for f in fields), F.lit(0))
    return own.select(
        "grp", "files", *[got(f).alias(f) for f in fields], got("_sources").alias("sources"), got("_notes").alias("notes"), F.coalesce("excerpts", F.lit("")).alias("excerpts"),
        F.coalesce("unread", F.lit("")).alias("unread"), found.alias("found"), error.alias("error"),
    )


# The amount that a bill of each utility is written to, and the words that name a utility.
UTILITY_FIELDS = {
    "electricity": "total_electricity_bill", "gas": "total_gas_bill", "water": "total_water_bill", "sewer": "total_sewer_bill",
    "water_sewer": "total_water_sewer_bill", "internet": "total_internet_bill", "phone": "total_phone_bill", "trash": "total_trash_bill",
}
UTILITY_WORDS = {
    "electricity": r"\bkwh\b|\belectric(ity|al)?\b|\bpower\b",
    "gas": r"\btherms?\b|\bnatural gas\b|\bgas (service|bill|charges?|usage|supply)\b|\bccf of gas\b",
    "water": r"\bwater\b|\bgallons?\b",
    "sewer": r"\bsewer(age)?\b|\bwastewater\b",
    "internet": r"\binternet\b|\bbroadband\b|\bwi-?fi\b|\bmbps\b",
    "phone": r"\b(tele)?phone\b|\bwireless\b|\bmobile\b|\bminutes\b",
    "trash": r"\btrash\b|\bgarbage\b|\brefuse\b|\brecycling\b|\bwaste (collection|removal)\b",
}
# Fixed value: the first amount in a text: bracket, minus, figure, bracket.
AMOUNT = r"(\(?)\s*(-?)\s*[$€£]?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(\)?)"


def first_amount(text: Column) -> Column:
    """The first figure of a text, beginning with its number; null if there is none."""
    part = lambda k: F.regexp_extract(F.coalesce(text, F.lit("")), AMOUNT, k)
    negative = (part(2) == "-") | ((part(1) == "(") & (part(4) == ")"))
    return F.when(part(3) != "", F.concat(F.when(negative, "-").otherwise(""), F.replace(part(3), F.lit(","), F.lit(""))))


def utility_page_totals(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page, field, value) with their amounts cleaned, and the total of a page that has no utility's amount moved to
    the one utility that its words (doc_id, page, text) name; taxes and other charges, part of the total, are then blanked.
    Several utilities, or none, get a note instead. One row for each page: its fields, whether it can be used, the note."""
    amounts = [*UTILITY_FIELDS.values(), "other_charges", "taxes", "total_utilities"]
    value = F.when(F.col("field").isin(amounts), first_amount(F.col("value"))).otherwise(F.col("value"))
    own = rows.select("doc_id", "page", "field", value.alias("value")).filter("value <> ''").groupBy("doc_id", "page", "field").agg(F.min("value").alias("value"))
    own = own.groupBy("doc_id", "page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    low = F.lower(F.regexp_replace("text", "<[^>]+>", " "))
    met = F.filter(F.array(*[F.when(low.rlike(p), k) for k, p in UTILITY_WORDS.items()]), lambda k: k.isNotNull())
    both = F.array_contains(met, "water") & F.array_contains(met, "sewer")
    kinds = F.when(both, F.concat(F.array_except(met, F.array(F.lit("water"), F.lit("sewer"))), F.array(F.lit("water_sewer")))).otherwise(met)
    own = own.join(pages.select("doc_id", "page", kinds.alias("kinds")), ["doc_id", "page"], "left")
    at = lambda f: F.try_element_at("fields", F.lit(f) if isinstance(f, str) else f)
    has = F.coalesce(*[at(f) for f in UTILITY_FIELDS.values()]).isNotNull()
    total, several = at("total_utilities"), F.coalesce(F.size("kinds"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in UTILITY_FIELDS.items() for x in kv])
    own = own.withColumns({"has": has, "total": total, "several": several})
    moves = ~F.col("has") & F.col("total").isNotNull() & (F.col("several") == 1)
    own = own.withColumn("moves", moves)
    target = names[F.element_at("kinds", 1)]
    filled = F.map_concat(F.map_filter("fields", lambda k, v: ~k.isin("taxes", "other_charges") & (k != target)), F.create_map(target, F.col("total")))
    own = own.withColumn("fields", F.when(F.col("moves"), filled).otherwise(F.col("fields")))
    dated = F.coalesce(at("billing_date"), at("date")).isNotNull()
    amount = F.col("has") | F.col("moves")
    note = (
        F.when(F.col("moves"), F.concat(F.lit("the total is the bill of "), F.element_at("kinds", 1)))
        .when(~F.col("has") & F.col("total").isNotNull() & (F.col("several") > 1), F.concat(F.lit("the total covers "), F.array_join("kinds", ", ")))
        .when(~F.col("has") & F.col("total").isNotNull(), "no word says which utility the total is for")
        .otherwise("")
    )
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return own.select("doc_id", "page", listed.alias("fields"), (amount & dated).alias("usable"), note.alias("note"), (amount & ~dated).alias("undated"))


def nearest(hits: list[tuple], anchors: list[tuple], aside: float) -> list[float | None]:
    """For each hit (x0, y0, x1, y1) how far the nearest anchor is, None without anchors; a hit above or left of an anchor counts
    `aside` times as far. Anchors lie in order of height, and the search from a hit's height outwards ends where height alone
    is as far as the best found."""
    middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    ordered = sorted((*middle(a)[::-1], a[0], a[1]) for a in anchors)
    heights = [a[0] for a in ordered]
    out: list[float | None] = []
    for hit in hits:
        x, y = middle(hit)
        best, up, down = math.inf, bisect.bisect_left(heights, y) - 1, bisect.bisect_left(heights, y)
        while up >= 0 or down < len(ordered):
            above = y - heights[up] if up >= 0 else math.inf
            below = heights[down] - y if down < len(ordered) else math.inf
            if min(above, below) >= best:
                break
            ay, ax, left, top = ordered[up] if above <= below else ordered[down]
            up, down = (up - 1, down) if above <= below else (up, down + 1)
            far = math.sqrt((x - ax) ** 2 + (y - ay) ** 2)
            best = min(best, far * aside if y < top - 0.005 or x < left - 0.005 else far)
        out.append(best if ordered else None)
    return out


def with_nearest(rows: DataFrame, aside: float = 1.0) -> DataFrame:
    """rows (…, hits, anchors: arrays of boxes) with `far`, how far each hit's nearest anchor is."""
    kind = T.StructType([*[f for f in rows.schema.fields if f.name != "anchors"], T.StructField("far", T.ArrayType(T.DoubleType()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
        for batch in batches:
            both = zip(batch.column("hits").to_pylist(), batch.column("anchors").to_pylist(), strict=True)
            far = [nearest([box(h) for h in hits], [box(a) for a in anchors or ()], aside) for hits, anchors in both]
            kept = [batch.column(f.name) for f in kind.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(far, pa.list_(pa.float64()))], kind.names)

    return rows.mapInArrow(search, kind)


def locate_values(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """The box of each value (doc_id, page, field, value, label) among its page's blocks (block, text, x0, y0, x1, y1, fractions of the
    page): of the first form that a block's text holds, the block nearest to one that holds the label; above or left of the
    label counts three times as far. Without the label the first block. Values not found have no row."""
    box = F.struct("block", "x0", "y0", "x1", "y1", fold_words(F.col("text")).alias("t"))
    # folded before it is collected, in generated code
    pages = blocks.select("doc_id", "page", box.alias("box")).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("box")).alias("blocks"))
    own = values.join(pages, ["doc_id", "page"]).withColumn("forms", F.filter(F.transform(value_forms(F.col("value")), fold_words), lambda f: f != ""))
    holding = F.transform("forms", lambda f: F.filter("blocks", lambda b: b["t"].contains(f)))
    own = own.withColumn("hits", F.get(F.filter(holding, lambda h: F.size(h) > 0), F.lit(0))).filter("hits IS NOT NULL")
    label = fold_words(F.coalesce("label", F.lit("")))
    own = own.withColumn("anchors", F.when(F.length(label) >= 3, F.filter("blocks", lambda b: b["t"].contains(label))))
    own = with_nearest(own.select("doc_id", "page", "field", "value", "hits", "anchors"), aside=3.0)
    ranked = F.zip_with("hits", "far", lambda b, d: F.struct(F.round(F.coalesce(d, F.lit(0.0)), 9).alias("d"), b["block"].alias("block"), b.alias("b")))
    return own.withColumn("b", F.array_min(ranked)["b"]).select("doc_id", "page", "field", "value", "b.block", "b.x0", "b.y0", "b.x1", "b.y1")


# Words around a figure that don't tell its copies apart.
NEAR_STOP = (
    "the and for that this with from have been were their there which what when where will would about into than then them they also only over under after "
    "before other some such more most very your yours page total amount value item figure"
).split()


def locate_figure(asked: DataFrame, blocks: DataFrame, most: int = 20) -> DataFrame:
    """Every block that prints a figure (doc_id, figure, near): on each page the blocks of the first form that any of them holds, by the
    surrounding words found on the page less the distance to the nearest (1.5 without any), best first, `most` at most."""
    plain = lambda t: F.lower(one_space(t))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("near"), F.lit(r"[a-z][a-z\-]{3,}"), F.lit(0)), lambda w: ~w.isin(*NEAR_STOP) & ~F.lower("figure").contains(w)))
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1", plain(F.col("text")).alias("t")))).alias("blocks"))
    own = asked.select("doc_id", "figure", F.slice(words, 1, 8).alias("words"), F.transform(figure_forms(F.col("figure")), plain).alias("forms")).join(pages, "doc_id")
    holding = F.transform("forms", lambda f: F.filter("blocks", lambda b: b["t"].contains(f)))
    own = own.withColumn("hits", F.get(F.filter(holding, lambda h: F.size(h) > 0), F.lit(0))).filter("hits IS NOT NULL")
    own = own.withColumn("found", F.transform("words", lambda w: F.filter("blocks", lambda b: b["t"].contains(w))))
    own = own.select("doc_id", "page", "figure", F.size(F.filter("found", lambda a: F.size(a) > 0)).alias("met"), "hits", F.flatten("found").alias("anchors"))
    own = with_nearest(own).select("doc_id", "page", "figure", "met", F.explode(F.arrays_zip("hits", "far")).alias("z"))
    score = F.round(F.col("met") - F.coalesce("z.far", F.lit(1.5)), 3)
    own = own.select("doc_id", "figure", "page", "z.hits.block", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "figure").orderBy(F.desc("score"), "page", "block"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= most)


def table_outline(tables: DataFrame, blocks: DataFrame, pad: float = 0.004) -> DataFrame:
    """The outline of a table (doc_id, page, table_no, first, first_end, last_start, last: the texts of its corners) among a page's
    blocks: the pair of first and last cell that is least high, and a tenth of its width, with the last below and right of
    the first; widened to the ends of both rows and by `pad`."""
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1", F.trim(one_space(F.col("text"))).alias("t")))).alias("blocks"))
    own = tables.join(pages, ["doc_id", "page"])
    printing = lambda c: F.filter("blocks", lambda b: b["t"] == F.left(c, F.lit(60)))
    tops, ends = printing("first"), printing("last")
    pairs = F.flatten(F.transform(tops, lambda t: F.transform(F.filter(ends, lambda b: (b["y1"] >= t["y0"]) & (b["x1"] >= t["x0"])), lambda b: F.struct((b["y1"] - t["y0"] + 0.1 * F.abs(b["x1"] - t["x1"])).alias("d"), t.alias("t"), b.alias("b")))))
    own = own.withColumn("p", F.array_min(pairs)).filter("p IS NOT NULL")
    t, b = F.col("p.t"), F.col("p.b")
    near = lambda c: F.array_min(F.transform(F.filter(printing(c), lambda h: h["y0"].between(t["y0"] - 0.01, b["y1"] + 0.01)), lambda h: F.struct((F.abs(h["y0"] - t["y0"]) + F.abs(h["y0"] - b["y0"])).alias("d"), h.alias("h"))))["h"]
    own = own.withColumn("parts", F.filter(F.array(t, b, near("first_end"), near("last_start")), lambda x: x.isNotNull()))
    edge = lambda c, least: F.round(F.greatest(F.array_min(F.transform("parts", lambda x: x[c])) - pad, F.lit(0.0)) if least else F.least(F.array_max(F.transform("parts", lambda x: x[c])) + pad, F.lit(1.0)), 5).alias(c)
    return own.select("doc_id", "page", "table_no", edge("x0", True), edge("y0", True), edge("x1", False), edge("y1", False))


# The fields that say whom a document is about and when, in the order of asking, and what is no name.
WHO = ["provider_name", "property_name", "landlord_name", "tax_authority", "address", "property_address"]
WHEN = ["billing_date", "date", "statement_date", "appraised_date", "tax_bill_date", "lease_begin_date", "lease_date"]
NO_NAME = ["address", "property", "name", "provider", "n/a", "none"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_year(value: Column) -> Column:
    """Sep 2026 of a date with slashes, dashes or as ISO; null if it is none."""
    us = [F.regexp_extract(value, r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", k) for k in (1, 3)]
    iso = [F.regexp_extract(value, r"\b(\d{4})-(\d{1,2})-\d{1,2}\b", k) for k in (2, 1)]
    names = F.array(*[F.lit(m) for m in MONTHS])
    made = lambda m, y: F.when(m.try_cast("int").between(1, 12), F.concat_ws(" ", F.get(names, m.try_cast("int") - 1), y))
    return F.coalesce(made(*us), made(*iso))


def display_title(history: DataFrame, fields: DataFrame) -> DataFrame:
    """What a record (doc_id, title, by_model, file, kind) is called: the title that the model gave it, or that was typed where there is
    no file; else its kind, whom it is about and when, from its found fields (doc_id, field, value), if two are known;
    else its file's name made readable."""
    found = fields.filter("trim(value) <> ''").groupBy("doc_id", "field").agg(F.min(F.trim("value")).alias("value"))
    found = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("f"))
    own = history.join(found, "doc_id", "left")
    at = lambda name: F.try_element_at("f", F.lit(name))
    who = F.left(F.trim(F.regexp_extract(F.coalesce(*[at(k) for k in WHO]), r"^([^,(\n]*)", 1)), F.lit(40))
    who = F.when((who != "") & ~F.lower(who).isin(NO_NAME), who)
    when = F.coalesce(*[month_year(at(k)) for k in WHEN])
    parts = F.filter(F.array("kind", who, when), lambda p: p.isNotNull() & (p != ""))
    title = F.trim(F.coalesce("title", F.lit("")))
    file = F.coalesce("file", F.lit(""))
    tidy = F.trim(one_space(F.regexp_replace(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), "[_-]+", " ")))
    given = (title != "") & (F.coalesce("by_model", F.lit(False)) | (file == ""))
    return own.select("doc_id", F.when(given, title).when(F.size(parts) >= 2, F.array_join(parts, " · ")).when(tidy != "", tidy).otherwise("Untitled").alias("title"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
