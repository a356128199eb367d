"""Mapping: labels and columns between layouts, corrections, newest runs, approvals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.likeness import NameIndex
from tablewright.functions.shared import materialise
from tablewright.functions.vocabulary import fold_words, squash, us_date


#: Names that one pass compares labels with; a longer list is compared in several passes, so that no task holds more of it.
NAMES_A_PASS = 100_000


def most_alike(labels: DataFrame, canonical: DataFrame, k: int) -> DataFrame:
    """(label, canonical, score, rank) of the k names most alike to each distinct label, all names considered; ties to the first by name.

    Labels are dealt over the tasks and never paired with names outside of one: a pass's names are indexed in each task.
    """
    names = canonical.filter("canonical IS NOT NULL AND trim(canonical) <> ''").select("canonical").distinct()
    first = names.limit(NAMES_A_PASS + 1).collect()
    parts = [first]
    if len(first) > NAMES_A_PASS:
        names = materialise(names, "names")
        n = -(-names.count() // NAMES_A_PASS)
        parts = (names.filter(F.pmod(F.xxhash64("canonical"), F.lit(n)) == p).collect() for p in range(n))
    found = None
    for rows in parts:

        def search(batches: Iterator[pa.RecordBatch], listed=sorted(r.canonical for r in rows)) -> Iterator[pa.RecordBatch]:
            index = NameIndex([" ".join(n.split()) for n in listed])
            place = {n: i for i, n in reversed(list(enumerate(index.names)))}
            for batch in batches:
                hits = [(label, listed[place[name]], score) for label in batch.column(0).to_pylist() for name, score in index.best(" ".join(label.split()), k)]
                columns = zip(*hits, strict=True) if hits else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["label", "canonical", "score"])

        own = labels.select("label").mapInArrow(search, "label string, canonical string, score double")
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "canonical"))
    return found.withColumn("score", F.round("score", 4)).withColumn("rank", rank).filter(F.col("rank") <= k)


def match_labels(rows: DataFrame, canonical: DataFrame, memory: DataFrame, cut: float = 88.0) -> DataFrame:
    """Label to canonical name: learned, then exact when folded, then the most alike one by `likeness`.

    Returns label, canonical, tier (learned, exact, fuzzy from the cut on, weak below it, none if there are no names, empty
    for a blank label) and confidence. Runs of white space count as one space in the comparison.
    """
    labels = rows.filter("label IS NOT NULL").select("label").distinct().withColumn("k", fold_words(F.col("label")))
    names = canonical.select("canonical", fold_words(F.col("canonical")).alias("ck"))
    learned = memory.groupBy("norm_label").agg(F.max_by("canonical", "seq").alias("learned"))
    own = labels.join(learned, F.col("k") == F.col("norm_label"), "left").join(
        names.groupBy("ck").agg(F.min("canonical").alias("exact")), F.col("k") == F.col("ck"), "left"
    )
    blank = F.col("label").rlike(r"^\s*$")
    own = materialise(own.select("label", F.when(~blank, F.col("learned")).alias("learned"), F.when(~blank, F.col("exact")).alias("exact"), blank.alias("blank")), "labels")
    best = most_alike(own.filter("learned IS NULL AND exact IS NULL AND NOT blank"), canonical, 1).withColumnRenamed("canonical", "alike")
    out = own.join(best, "label", "left")
    tier = F.when(F.col("blank"), "empty").when(F.col("learned").isNotNull(), "learned").when(F.col("exact").isNotNull(), "exact")
    tier = tier.when(F.col("score") >= cut, "fuzzy").when(F.col("score").isNotNull(), "weak").otherwise("none")
    sure = F.when(tier.isin("learned", "exact"), 100.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return out.select("label", F.coalesce("learned", "exact", "alike").alias("canonical"), tier.alias("tier"), sure.alias("confidence"))


def label_candidates(rows: DataFrame, canonical: DataFrame, k: int = 3) -> DataFrame:
    """The k canonical names most alike to each label that isn't blank, best first."""
    labels = rows.filter("trim(label) <> ''").select("label").distinct()
    return most_alike(labels, canonical, k)


def apply_corrections(corrections: DataFrame) -> DataFrame:
    """The newest correction of each profile and folded label, with how many were learned."""
    return corrections.groupBy("profile", "norm_label").agg(F.max_by("canonical", "seq").alias("canonical"), F.count(F.lit(1)).alias("learned"))


def map_columns(source: DataFrame, template: DataFrame) -> DataFrame:
    """E5: of the pairs of a source and a template sheet (doc_id, sheet_no, sheet, header) the one with the most headers that are
    equal in letters and digits and unique in the source, the first pair on a tie; the template's headers with their source
    header, null if none. Documents without any pair have no rows.

    A document's headers are dealt out once and stay where they are: by spelling, then by pair of sheets, then by document. What is
    joined at the end is of the size of the input and never sent whole to every task, however small the input's files make it look.
    """
    own = lambda df, side: df.filter("doc_id IS NOT NULL").select("doc_id", F.lit(side).alias("side"), F.struct("sheet_no", "sheet", "header").alias("cell"), squash(F.col("header")).alias("k"))
    rows = own(source, "s").unionByName(own(template, "t")).filter("k <> ''").repartition("doc_id")
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("cell")))
    spelt = rows.groupBy("doc_id", "k").agg(of("s").alias("s"), of("t").alias("t")).filter("size(s) > 0 AND size(t) > 0")
    alone = F.filter("s", lambda x: F.size(F.filter("s", lambda y: y["sheet_no"].eqNullSafe(x["sheet_no"]))) == 1)
    met = spelt.select("doc_id", F.explode(alone).alias("s"), "t").select("doc_id", "s", F.explode("t").alias("t"))
    sheets = [F.col(f"{side[0]}.{c}").alias(f"{side}_{c}") for side in ("source", "template") for c in ("sheet_no", "sheet")]
    equal = F.collect_set(F.struct(F.col("t.header").alias("key"), F.col("s.header").alias("value"))).alias("equal")
    pairs = met.groupBy("doc_id", *sheets).agg(equal)
    rank = F.struct(F.size("equal").alias("n"), (-F.col("source_sheet_no")).alias("s"), (-F.col("template_sheet_no")).alias("t"))
    best = pairs.groupBy("doc_id").agg(F.max_by(F.struct("source_sheet", "template_sheet_no", "template_sheet", "equal"), rank).alias("b"))
    best = best.select("doc_id", "b.source_sheet", "b.template_sheet", F.col("b.template_sheet_no").alias("best_no"), F.map_from_entries("b.equal").alias("equal"))
    headers = template.select("doc_id", "sheet_no", "header").join(best.hint("merge"), "doc_id").filter("sheet_no = best_no")
    return headers.select("doc_id", "source_sheet", "template_sheet", "header", F.try_element_at("equal", F.col("header")).alias("source_header"))


def field_coverage(type_fields: DataFrame, known: DataFrame) -> DataFrame:
    """What of the document types (doc_type, field) the target (doc_type, field) doesn't know: a type, or a field of a type.

    A type that the target has without any field (field null) takes all."""
    listed = known.groupBy("doc_type").agg(F.count("field").alias("fields"))
    own = type_fields.join(listed, "doc_type", "left")
    types = own.filter("fields IS NULL").select("doc_type").distinct().select("doc_type", F.lit(None).cast("string").alias("field"), F.lit("unknown type").alias("problem"))
    fields = own.filter("fields > 0").join(known.select("doc_type", "field"), ["doc_type", "field"], "left_anti")
    return types.unionByName(fields.select("doc_type", "field", F.lit("unknown field").alias("problem")))


def latest_runs(history: DataFrame, keep: int) -> DataFrame:
    """The newest runs of each owner by sequence."""
    w = Window.partitionBy("owner").orderBy(F.desc("seq"))
    return history.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)


def approval_state(review: DataFrame, approvals: DataFrame) -> DataFrame:
    """Per document how many fields need approval and have it; an approval counts while the value is the one approved."""
    joined = review.join(approvals.select("doc_id", "key", "pinned"), ["doc_id", "key"], "left")
    done = F.count_if(F.col("pinned").eqNullSafe(F.col("value")) & F.col("value").isNotNull())
    return joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("need"), done.alias("done"), (done == F.count(F.lit(1))).alias("complete"))


def canonical_columns(cells: DataFrame) -> DataFrame:
    """Column names equal but for case and what stands between their letters and digits take the spelling seen first."""
    own = cells.withColumn("k", fold_words(F.col("column_name")))
    first = own.groupBy("k").agg(F.min_by("column_name", "ord").alias("canonical"))
    return own.join(first, "k").drop("k")


def export_rows(graded: DataFrame, dates: list[str]) -> DataFrame:
    """Page, field, value (null if not found, dates as MM/DD/YYYY where they can be read), confidence high only for yes."""
    value = F.when(F.col("field").isin(dates), F.coalesce(us_date(F.col("value")), F.col("value"))).otherwise(F.col("value"))
    return graded.select("doc_id", "page", "field", F.when(F.col("value") != "", value).alias("value"), F.when(F.col("verdict") == "yes", "high").otherwise("low").alias("confidence"))


def type_from_found_fields(graded: DataFrame, marks: DataFrame) -> DataFrame:
    """R2: the document type whose marks the found fields meet, if it is the only one."""
    met = graded.filter("verdict <> 'none'").select("doc_id", "field").distinct().join(marks, "field").groupBy("doc_id").agg(F.collect_set("doc_type").alias("t"))
    return met.filter(F.size("t") == 1).select("doc_id", F.element_at("t", 1).alias("doc_type"))


def source_profile(docs: DataFrame) -> DataFrame:
    """The producer and those of the first four lines that aren't blank, folded and cut, as a document's grouping key."""
    lines = F.filter(F.slice(F.split(F.left("text", F.lit(400)), r"\r\n|\n|\r"), 1, 4), lambda x: F.trim(x) != "")
    head = F.array_join(F.transform(lines, lambda x: F.left(fold_words(x), F.lit(40))), " ")
    profile = F.left(F.concat(fold_words(F.left(F.coalesce("producer", F.lit("")), F.lit(40))), F.lit("|"), F.coalesce(head, F.lit(""))), F.lit(160))
    return docs.select("doc_id", profile.alias("profile"))


def unit_crosscheck(units: DataFrame) -> DataFrame:
    """The folder's unit against the documents' unit: differing ones are flagged, missing ones filled and flagged."""
    folder, own = F.coalesce("folder_suite", F.lit("")), F.coalesce("suite", F.lit(""))
    flag = F.when((folder != "") & (own == ""), "taken from the folder").when((folder != "") & (squash(folder) != squash(own)), "folder and documents differ")
    return units.select("doc_id", F.when(own != "", own).otherwise(folder).alias("suite"), flag.alias("flag"))


def strict_number(text: Column) -> Column:
    """A value that is cleanly one number, else null: brackets or a leading minus are negative, currency signs and commas go."""
    t = F.trim(text)
    bracket = t.startswith("(") & t.endswith(")")
    s = F.trim(F.btrim(t, F.lit("()")))
    s = F.regexp_replace(F.regexp_replace(s, r"^\+\s*", ""), r"^-\s*", "-")
    s = F.trim(F.replace(F.regexp_replace(s, r"[$£€]\s?", ""), F.lit(","), F.lit("")))
    value = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("decimal(18,4)"))
    return F.when(bracket, -F.abs(value)).otherwise(value)


def template_fill_plan(values: DataFrame, cell_map: list[tuple[str, str, bool]]) -> DataFrame:
    """For each document and target cell (field, cell, numeric) what is written, or why it is skipped."""
    targets = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("cell"), F.lit(n).alias("numeric")) for f, c, n in cell_map])
    one = values.filter(F.trim("value") != "").groupBy("doc_id", "field").agg(F.min("value").alias("value"))
    found = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("found"))
    own = values.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", "found", F.explode(targets).alias("t")).select("doc_id", "found", "t.*")
    own = own.withColumn("raw", F.try_element_at("found", F.col("field"))).withColumn("number", strict_number(F.col("raw")))
    why = F.when(F.col("raw").isNull(), "not found").when(F.col("numeric") & F.col("number").isNull(), "not cleanly a number")
    written = F.when(why.isNull(), F.when(F.col("numeric"), F.col("number").cast("string")).otherwise(F.col("raw")))
    return own.select("doc_id", "field", "cell", written.alias("written"), why.alias("why"))


# The sections of a lease abstract and the column names that belong to each, first match first.
FIELD_SECTIONS = [
    ("identity", r"dba|status \(dark|leased rsf"),
    ("term_dates", r"lease start|lease end|lease term"),
    ("base_rent", r"annual base rent|annual rent psf|annual % increase"),
    ("escalation", r"escalation"),
    ("reimbursement", r"reimb|pro rata|by&by|gross-up|cam|ret|ins"),
    ("termination", r"terminat"),
    ("renewal", r"renewal"),
    ("docs_comments", r"available docs|missing docs|general comments|discrepanc"),
]


def field_sections(columns: DataFrame, sections: list[tuple[str, str]] = FIELD_SECTIONS) -> DataFrame:
    """Each column's section, the first whose pattern its name holds, else other; section_no gives the fixed order."""
    name = F.lower("name")
    hit = F.coalesce(*[F.when(name.rlike(p), F.lit(i)) for i, (_, p) in enumerate(sections)], F.lit(len(sections)))
    names = F.array(*[F.lit(s) for s, _ in sections], F.lit("other"))
    return columns.withColumn("section_no", hit).withColumn("section", F.get(names, F.col("section_no")))


def blocks_to_page_fractions(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of a scaled, cropped render as fractions of the full page, to five places."""
    own = blocks.join(pages, ["doc_id", "page"])
    sx, sy = (F.col(f"sent_{d}") / F.greatest(F.coalesce(f"layout_{d}", f"sent_{d}"), F.lit(1)) for d in "wh")
    at = lambda c, scale, d, crop: F.round((F.col(c) * scale + F.coalesce(crop, F.lit(0))) / F.col(f"full_{d}"), 5).alias(c)
    return own.select("doc_id", "page", "block", at("x0", sx, "w", "crop_x"), at("y0", sy, "h", "crop_y"), at("x1", sx, "w", "crop_x"), at("y1", sy, "h", "crop_y"))


def collapse_same_box(fields: DataFrame) -> DataFrame:
    """The fields that are printed at one box of a page, together."""
    names = F.array_join(F.array_sort(F.collect_set("field")), ", ")
    return fields.groupBy("doc_id", "page", "x0", "y0", "x1", "y1").agg(names.alias("fields"), F.count(F.lit(1)).alias("n"))


def ocr_words_to_tokens(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """Words t, x, y, w, h in render pixels as tokens in page units, to a tenth."""
    at = lambda c: F.round(c / F.lit(float(scale)), 1)
    x, y = F.col("x"), F.col("y")
    return words.select("doc_id", "page", F.col("t").alias("text"), at(x).alias("x0"), at(x + F.col("w")).alias("x1"), at(y).alias("top"), at(y + F.col("h")).alias("bottom"), F.lit("ocr").alias("source"))
