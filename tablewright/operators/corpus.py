"""Corpus shape: manifests, page text, legibility, redaction, tables in markup."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.vocabulary import parse_figure

# How a file is read, by extension, and folders that hold no documents.
ROUTES = {
    "pdf": "pdf", "xlsx": "table", "xls": "table", "xlsm": "table", "csv": "table", "tsv": "table", "docx": "doc", "pptx": "doc",
    "png": "needs_ocr", "jpg": "needs_ocr", "jpeg": "needs_ocr", "tif": "needs_ocr", "tiff": "needs_ocr", "webp": "needs_ocr", "bmp": "needs_ocr",
    "txt": "text", "md": "text", "html": "text", "htm": "text", "json": "text", "xml": "text",
}
SKIPPED = ("node_modules", "__pycache__", "$RECYCLE.BIN", "System Volume Information")
MARKER = r"(?s)<!--\s*=*\s*\[(?:file: [^|\]]*\|\s*)?page (\d+)\]?\s*=*\s*-->"


def scan_manifest(spark: SparkSession, root: str, depth: int = 1, allow_ocr: bool = False) -> DataFrame:
    """One row per file below root: path, name, ext, size, grp (its first folders; root's own name for depth 0), route, note.

    Contents aren't read. Files that begin with "." or "~$", and folders that begin with "." or hold no documents, are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    return routed(files.withColumn("rel", rel), base.rpartition("/")[2], depth, allow_ocr)


def routed(files: DataFrame, root_name: str, depth: int = 1, allow_ocr: bool = False) -> DataFrame:
    """S1 on listed files (path, rel to the root, size)."""
    parts = F.split("rel", "/")
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1))
    routes = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    plain = F.coalesce(routes[ext], F.lit("unsupported"))
    image = plain == "needs_ocr"
    route = F.when(image & F.lit(allow_ocr), "ocr").otherwise(plain)
    note = F.when(image, "read by OCR, which this run allows" if allow_ocr else "an image, and OCR is off").otherwise("")
    grp = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise("(root)") if depth > 0 else F.lit(root_name)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED)) | name.startswith(".") | name.startswith("~$")
    return files.filter(~out).select("path", name.alias("name"), ext.alias("ext"), "size", grp.alias("grp"), route.alias("route"), note.alias("note"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Files, pages and bytes per group and route; a text file takes 8.9 estimated seconds, a page to be read by OCR 2.8."""
    seconds = F.when(F.col("route") == "ocr", F.coalesce("pages", F.lit(1)) * 2.8).when(F.col("route") == "pdf", 8.9).otherwise(0.0)
    return manifest.groupBy("grp", "route").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("pages", F.lit(1))).alias("pages"), F.sum("size").alias("bytes"), F.round(F.sum(seconds), 1).alias("seconds")
    )


def oversize_split(manifest: DataFrame, page_limit: int = 10) -> DataFrame:
    """S3: files to be read by OCR with more pages than the limit are declined, with a reason; unknown pages count as 1."""
    over = (F.col("route") == "ocr") & (F.coalesce("pages", F.lit(1)) > page_limit)
    return manifest.withColumn("declined", over).withColumn("reason", F.when(over, F.concat(F.col("pages").cast("string"), F.lit(f" pages, over {page_limit}"))).otherwise(""))


def split_pages(transcripts: DataFrame) -> DataFrame:
    """A transcript cut at its page markers; without any it is page 1; text before the first marker is dropped."""
    numbers = F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))
    parts = F.slice(F.split("text", MARKER), 2, F.greatest(F.size(numbers), F.lit(1)))
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("1").alias("p"), F.col("text").alias("t")))).otherwise(
        F.zip_with(numbers, parts, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    )
    return transcripts.select("doc_id", F.explode(pages).alias("x")).select("doc_id", F.col("x.p").cast("int").alias("page"), F.btrim(F.col("x.t"), F.lit(" \n")).alias("text"))


def html_to_text(pages: DataFrame) -> DataFrame:
    """Paragraphs of a page: scripts and styles dropped with their bodies, a space for every tag, cut at blank lines."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>", " "), r"(?s)<[^>]+>", " ")
    trimmed = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(bare, r"\n\s*\n"), trimmed), lambda p: p != "")
    return pages.select("page_id", F.posexplode(paragraphs).alias("par_no", "text"))


#: Named references by HTML5, with their semicolon or, for the old ones, without.
NAMED = json.dumps(html.entities.html5)
#: Names that count without a semicolon, longest first, so that the longest beginning is taken.
UNCLOSED = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Numbers of the C1 range stand for what Windows-1252 has there.
RENUMBERED = json.dumps({str(n): bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0)} | {"0": "\ufffd", "13": "\r"})


def decode_entities(text: Column) -> Column:
    """Character references decoded once, as a browser reads them. The text is cut at each ampersand, so that no decoded
    character is read again."""
    known, renumbered = F.from_json(F.lit(NAMED), "map<string,string>"), F.from_json(F.lit(RENUMBERED), "map<string,string>")

    def char(n: Column) -> Column:
        """The character of a code point, by its UTF-8 bytes."""
        hexed = lambda x: F.lpad(F.hex(x), 2, "0")
        tail = lambda k: F.shiftright(n, 6 * k).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)).cast("long")
        return F.decode(
            F.unhex(
                F.when(n < 128, hexed(n.cast("long")))
                .when(n < 2048, F.concat(hexed(F.shiftright(n, 6).bitwiseOR(F.lit(192)).cast("long")), hexed(tail(0))))
                .when(n < 65536, F.concat(hexed(F.shiftright(n, 12).bitwiseOR(F.lit(224)).cast("long")), hexed(tail(1)), hexed(tail(0))))
                .otherwise(F.concat(hexed(F.shiftright(n, 18).bitwiseOR(F.lit(240)).cast("long")), hexed(tail(2)), hexed(tail(1)), hexed(tail(0))))
            ),
            "UTF-8",
        )

    def numbered(digits: Column) -> Column:
        base = F.when(F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits)
        n = F.when(F.length(F.regexp_replace(base, "^0+", "")) > 7, F.lit(0x110000)).otherwise(base.try_cast("int"))
        no_character = n.between(1, 8) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n == 11) | (n % 65536 >= 65534)
        found = F.try_element_at(renumbered, n.cast("string"))
        return F.when(found.isNotNull(), found).when((n >= 0x110000) | n.between(0xD800, 0xDFFF), "\ufffd").when(no_character, "").otherwise(char(n))

    def read(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(piece, "^[^\\t\\n\\f <&#;]{1,32};?", 0)
        begun = F.regexp_extract(name, f"^({UNCLOSED})", 1)
        rest = lambda taken: F.substr(piece, F.length(taken) + 1)
        return (
            F.when(number != "", F.concat(numbered(number), F.regexp_replace(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when(F.try_element_at(known, name).isNotNull(), F.concat(F.try_element_at(known, name), rest(name)))
            .when(begun != "", F.concat(F.try_element_at(known, begun), rest(begun)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&", -1)
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), read), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def normalise_transcripts(pages: DataFrame) -> DataFrame:
    """Markup down to plain lines, cells apart by tabs; blank lines dropped; line_no from 1."""
    t = F.col("text")
    for pattern, to in (
        (r"(?i)</t[dh]>\s*<t[dh][^>]*>", "\t"), (r"(?i)</tr>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"(?s)<!--.*?-->", "\n"), (r"<[^>]+>", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    t = F.regexp_replace(F.regexp_replace(decode_entities(t), r"\\[nr]", " "), r"\*\*|__", "")
    lines = F.filter(F.transform(F.split(t, "\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: F.trim(x) != "")
    return pages.select("doc_id", "page", F.posexplode(lines).alias("n", "text")).select("doc_id", "page", (F.col("n") + 1).alias("line_no"), "text")


# The tags that make a table.
TABLE_TAG = r"(?is)^<(/?)(table|tr|td|th)\b"


def cells_of(text: str) -> dict[tuple[int, int, int], list[str]]:
    """(table, row, column) to the pieces of text of each cell of a page, in one walk over its tags. How many tables are open at a
    place says how deep it lies; at each depth the last table, row and cell begun are the ones it belongs to."""
    cells: dict[tuple[int, int, int], list[str]] = {}
    opened = closed = 0
    at_depth: dict[int, list] = {}  # depth to (table, row, column, whether the cell is open) in hand
    for piece in re.findall(r"(?s)<!--.*?-->|<[^>]*>|[^<]+", text):
        found = re.match(TABLE_TAG, piece)
        tag, end = (found[2].lower(), found[1] == "/") if found else ("", False)
        if tag == "table":
            opened, closed = opened + (not end), closed + end
            if not end:
                at_depth[opened - closed] = [opened - 1, -1, -1, False]
        here = at_depth.get(opened - closed)
        if opened <= closed or here is None:
            continue
        if tag == "tr" and not end:
            here[1:] = [here[1] + 1, -1, False]
        elif tag in ("td", "th") and here[1] >= 0:
            here[2:] = [here[2] + (not end), not end]
        if here[1] >= 0 and here[2] >= 0:
            cells.setdefault((here[0], here[1], here[2]), []).append(piece if here[3] and not piece.startswith("<") else " ")
    return cells


def lift_tables(pages: DataFrame) -> DataFrame:
    """Every cell of every table of a page with its place; empty cells stay, flagged. A table within a cell is a table of
    its own, numbered where it begins; what the outer cell says before and after it stays in the outer cell."""
    own = pages.filter(F.lower("text").contains("<table")).select("doc_id", "page", "text")

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, raw = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = cells_of(text)
                at += [i] * len(found)
                places += found
                raw += ["".join(pieces) for pieces in found.values()]
            numbers = [pa.array(c, pa.int32()) for c in (zip(*places, strict=True) if places else ([], [], []))]
            keys = [batch.column(k).take(pa.array(at, pa.int32())) for k in ("doc_id", "page")]
            yield pa.RecordBatch.from_arrays([*keys, *numbers, pa.array(raw, pa.string())], ["doc_id", "page", "table_no", "row_no", "col_no", "raw"])

    keys = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in ("doc_id", "page"))
    out = own.mapInArrow(lift, f"{keys}, table_no int, row_no int, col_no int, raw string")
    text = F.btrim(F.regexp_replace(decode_entities(F.col("raw")), r"[\s\u00a0]+", " "))
    return out.withColumn("text", text).withColumn("is_empty", F.col("text") == "").drop("raw")


def collapse_runs(cells: DataFrame) -> DataFrame:
    """Of equal neighbours in a row the first stays; blanks at a row's end go."""
    w = Window.partitionBy("doc_id", "page", "table_no", "row_no").orderBy("col_no")
    last = F.max(F.when(F.col("text") != "", F.col("col_no"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = cells.withColumn("before", F.lag("text").over(w)).withColumn("last", last)
    return own.filter((F.col("col_no") <= F.col("last")) & ~F.col("text").eqNullSafe(F.col("before"))).drop("before", "last")


def page_range_filter(pages: DataFrame, spec: str) -> DataFrame:
    """The pages that a range such as "1-3, 7, 9-" names; blank is all, and a part that names no page is passed over."""
    test = F.lit(not spec.strip())
    for low, dash, high in re.findall(r"(?:^|,)\s*(\d*)\s*(-?)\s*(\d*)\s*(?=,|$)", spec):
        if low or high:
            one = F.col("page") >= int(low or 1)
            test = test | (one if dash and not high else one & (F.col("page") <= int(high if dash else low)))
    return pages.filter(test)


def collapse_page_ranges(pages: DataFrame) -> DataFrame:
    """A document's page numbers as "38-41,45"."""
    own = pages.select("doc_id", "page").distinct()
    own = own.withColumn("island", F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    runs = own.groupBy("doc_id", "island").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    sorted_runs = F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x["t"])
    return runs.groupBy("doc_id").agg(F.array_join(sorted_runs, ",").alias("pages"))


def exclude_processed(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose content hash isn't done yet, one per hash (the least name)."""
    new = manifest.join(done.select("hash"), "hash", "left_anti")
    rest = [c for c in manifest.columns if c != "hash"]
    return new.groupBy("hash").agg(F.min_by(F.struct(*rest), "name").alias("r")).select("hash", "r.*").select(*manifest.columns)


# What a word may begin and end with when it is judged, and what may stand inside it.
EDGE, TAIL = "0-9A-Za-z$", "0-9A-Za-z%)"
INSIDE = r"\p{L}\p{N}.,\-/':&#$%()\[\]{}!?;+*=@_~’‘“”–—°§"


def legibility_profile(docs: DataFrame, least: float = 0.89) -> DataFrame:
    """Share of words that are like words, and whether a document's text can be used, with the reason if not.

    Words are counted by kind over the whole text: a word, from its first to its last plain character, votes if it has two
    letters or digits or more; it votes no with a character inside that words don't have, or with five letters or more, no
    digit and no vowel. The first pass takes each word's middle, one to a line; the counts are patterns over these lines.
    """
    middle = F.regexp_replace("text", rf"(?<!\S)[^{EDGE}\s]+|[^{TAIL}\s]+(?!\S)", "")
    words = F.concat(F.lit("\n"), F.regexp_replace(middle, r"\s+", "\n"), F.lit("\n"))
    inner = r"[^\s\p{L}\p{N}]*"
    count = lambda pattern: F.regexp_count("words", F.lit(pattern))
    own = docs.select("doc_id", F.length("text").alias("n"), words.alias("words"))
    votes = count(rf"(?<=\n){inner}[\p{{L}}\p{{N}}]{inner}[\p{{L}}\p{{N}}]\S*(?=\n)")
    odd = count(rf"(?<=\n)(?={inner}[\p{{L}}\p{{N}}]{inner}[\p{{L}}\p{{N}}])[{INSIDE}]*[^{INSIDE}\s]\S*(?=\n)")
    between, letter = rf"[{INSIDE}&&[^\p{{L}}\p{{N}}]]*", r"[\p{L}&&[^aeiouyAEIOUY]]"
    mute = count(rf"(?<=\n)(?=(?:{between}{letter}){{5}})[{INSIDE}&&[^\p{{N}}aeiouyAEIOUY]]*+(?=\n)")
    own = own.select("doc_id", "n", votes.alias("votes"), (votes - odd - mute).alias("yes"))
    ratio = F.when(F.col("votes") > 0, F.col("yes") / F.col("votes"))
    reason = F.when(F.col("n") < 200, "little text").when(F.col("votes") < 20, "few words").when(ratio < least, "not words").otherwise("")
    return own.select("doc_id", "votes", "yes", reason.alias("reason"), (reason == "").alias("usable"))


def text_layer_gate(pages: DataFrame) -> DataFrame:
    """Over a document's first ten pages: 1000 characters or more, and letters, digits and spaces above 0.75 of them.
    Texts are measured first; only their lengths are ordered."""
    good = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\s]", ""))
    own = pages.select("doc_id", "page", F.length("text").alias("n_chars"), good.alias("n_good"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).filter("n <= 10")
    sums = own.groupBy("doc_id").agg(F.sum("n_chars").alias("chars"), F.sum("n_good").alias("good"))
    return sums.withColumn("has_text", (F.col("chars") >= 1000) & (F.col("good") / F.col("chars") > 0.75))


def mixed_document_sample(pages: DataFrame, most: int = 24, blank_below: int = 80) -> DataFrame:
    """Of an even spread of a document's pages how many are blank, and whether a quarter are, with the first of them."""
    own = pages.select("doc_id", "page", (F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) < blank_below).alias("blank"))
    w = Window.partitionBy("doc_id")
    own = own.withColumn("at", F.row_number().over(w.orderBy("page")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    # Python rounds halves to even, and so does bround
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * ((F.col("n") - 1) / F.lit(float(most - 1)))))
    own = own.filter((F.col("n") <= most) | F.array_contains(steps, F.col("at").cast("double")))
    out = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sampled"), F.count_if("blank").alias("blank"), F.min(F.when(F.col("blank"), F.col("page"))).alias("first_blank"))
    return out.withColumn("mixed", F.col("blank") * 4 >= F.col("sampled"))


def page_route(stats: DataFrame) -> DataFrame:
    """P5: a page's text can be used with 60 letters and digits or more, few broken glyphs, and not under a large image; else OCR."""
    broken = F.when(F.col("chars") > 0, F.col("cid") / F.col("chars")).otherwise(0.0)
    usable = (F.col("alnum") >= 60) & (broken <= 0.05) & ~((F.col("image_cover") > 0.5) & (F.col("alnum") < 300))
    return stats.withColumn("route", F.when(usable, "text").otherwise("ocr"))


def redact_terms(docs: DataFrame, replacements: Mapping[str, str]) -> DataFrame:
    """Each term replaced whatever its case, longest first; hits is the number of terms found before replacing."""
    text, hits = F.col("text"), F.lit(0)
    for term in sorted(replacements, key=lambda t: (-len(t), t)):
        pattern = "(?i)" + re.escape(term)
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, replacements[term])
    return docs.select("doc_id", text.alias("text"), hits.alias("hits"))


def redaction_report(docs: DataFrame, replacements: Mapping[str, str]) -> DataFrame:
    """For each term how often it is found and in how many documents, what longer terms replaced before it left out; and a
    row with term null for the documents changed by any."""
    text, made = F.col("text"), []
    for term in sorted(replacements, key=lambda t: (-len(t), t)):
        pattern = "(?i)" + re.escape(term)
        made.append(F.struct(F.lit(term).alias("term"), F.regexp_count(text, F.lit(pattern)).alias("hits")))
        text = F.regexp_replace(text, pattern, replacements[term])
    each = docs.select(F.array(*made).alias("found"))
    any_ = F.struct(F.lit(None).cast("string").alias("term"), F.aggregate("found", F.lit(0), lambda s, x: s + x["hits"]).alias("hits"))
    rows = each.select(F.explode(F.concat("found", F.array(any_))).alias("f"))
    return rows.groupBy("f.term").agg(F.sum("f.hits").alias("hits"), F.count_if(F.col("f.hits") > 0).alias("docs"))


# Labels that are dates or times, and words that begin a report's own lines.
DATEISH = r"(?i)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}:\d{2}\s*[AP]M"
META_HINT = r"(?i)^(period|book|database|prepared|page|report|statement|\*|as of|for the|month|year|budget comparison)\b"


def line_item_filter(rows: DataFrame) -> DataFrame:
    """Rows with a label that is neither a date nor a line of the report about itself, and a figure in a column."""
    label = F.trim(F.coalesce("label", F.lit("")))
    return rows.filter((label != "") & ~label.rlike(DATEISH) & ~label.rlike(META_HINT) & F.exists("values", lambda v: parse_figure(v).isNotNull()))


def merged_table_filter(cells: DataFrame) -> DataFrame:
    """A table's columns came out merged if over 40 % of its cells are empty, or a cell stacks two figures over a line
    break, or holds three in over 40 characters; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    figures = F.regexp_count(text, F.lit(r"\d[\d,]*\.?\d*"))
    crowded = (text.contains("\n") & (figures >= 2)) | ((F.length(text) > 40) & (figures >= 3))
    tables = cells.groupBy("doc_id", "page", "table_no").agg(F.avg((F.trim(text) == "").cast("int")).alias("empty"), F.bool_or(crowded).alias("crowded"))
    return tables.withColumn("merged", (F.col("empty") > 0.4) | F.col("crowded"))
