import pytest
from pyspark.sql import functions as F

from tablewright.functions import vocabulary as v
from tablewright.operators import checks, corpus, labels, layout, mapping, records, retrieve


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "value"),
    [("$1,234.50", 1234.5), ("(12.00)", -12), ("5.00-", -5), ("-7", -7), ("13.0%", 13), (".55", 0.55), ("n/a", None), ("", None), ("1.2.3", None)],
)
def test_parse_figure(spark, text, value):
    got = one(spark, v.parse_figure, text)
    assert got is None if value is None else float(got) == value


@pytest.mark.parametrize(("text", "kind"), [("6/1/25", "date"), ("Sep-27", "date"), ("13.0%", "percent"), ("1,234", "money"), ("12", "number"), ("Item 3", "text"), ("abc", "text")])
def test_value_kind(spark, text, kind):
    assert one(spark, v.value_kind, text) == kind


@pytest.mark.parametrize(("text", "date"), [("9/5/2026", "09/05/2026"), ("2026-09-05", "09/05/2026"), ("September 5, 2026", "09/05/2026"), ("soon", None)])
def test_us_date(spark, text, date):
    assert one(spark, v.us_date, text) == date


def search(spark, text, fields):
    lines = spark.createDataFrame([(1, 1, n, t) for n, t in enumerate(text.split("\n"))], "doc_id long, page int, line_no int, text string")
    return {r.field: r for r in labels.graded_fields(lines, fields).collect()}


def test_label_beside_its_value(spark):
    got = search(spark, "ACCOUNT NO: AC-771\nTotal Amount Due: $45.10  Due Date: 09/05/2026", ["Account number", "Total charges", "Due date"])
    assert got["Account number"].value == "AC-771" and got["Account number"].verdict == "yes"
    assert got["Total charges"].value == "$45.10" and got["Due date"].value == "09/05/2026"


def test_values_after_a_run_of_labels(spark):
    got = search(spark, "Due Date\nTotal Charges\n09/05/2026", ["Due date"])
    assert got["Due date"].value == "09/05/2026" and got["Due date"].where_found == "after 1 other label(s)"


def test_value_to_the_right_and_count_in_brackets(spark):
    got = search(spark, "Due Date\t\t10/01/2026\nWithdrawals", ["Due date"])
    assert got["Due date"].value == "10/01/2026"


def test_heading_is_no_value(spark):
    got = search(spark, "Meter Reading Information\nUsage history", ["Meter reading"])
    assert got["Meter reading"].verdict == "none" and got["Meter reading"].value == ""


def test_odd_shape_is_marked(spark):
    assert search(spark, "Due Date: see reverse", ["Due date"])["Due date"].verdict == "check"


def test_chunks_close_when_full(spark):
    docs = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncc"), (2, "")], "doc_id long, text string")
    assert [r.chunk for r in retrieve.chunk_paragraphs(docs, 6).orderBy("chunk_no").collect()] == ["aaaa\nbbbb", "cc"] and [r.label for r in retrieve.chunk_paragraphs(docs, 6).orderBy("chunk_no").collect()] == ["part 1-2", "part 3-3"]


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [("g", 1, 0, "x" * 100, 1.0), ("g", 1, 1, "x" * 900, 9.0), ("g", 2, 0, "x" * 50, 2.0), ("g", 2, 1, "x" * 10, -1.0)]
    got = retrieve.select_under_budget(spark.createDataFrame(rows, "grp string, doc_id long, chunk_no int, chunk string, score double"), 400).collect()
    assert {(r.doc_id, r.chunk_no) for r in got} == {(1, 0), (2, 0)} and sum(r.size + 80 for r in got) <= 400


def test_recent_turns_cut_the_one_that_overflows(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a" * 900), (1, 2, "assistant", "b" * 600), (1, 3, "user", " "), (1, 4, "user", "c" * 300)], "conv_id long, turn long, role string, text string")
    got = retrieve.recent_turns(turns, 1400).orderBy("turn").collect()
    assert [(r.turn, len(r.text)) for r in got] == [(1, 500), (2, 600), (4, 300)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page int, y double, x0 double, label string, values array<string>")


def test_section_totals(spark):
    rows = [(1, 1, 1.0, 53.0, "INCOME", None), (1, 1, 2.0, 59.0, "Rent", ["10.00"]), (1, 1, 3.0, 59.0, "Fees", ["5.00"]), (1, 1, 4.0, 68.0, "Total", ["15.00"]), (1, 1, 5.0, 59.0, "Tax", ["3.00"]), (1, 1, 6.0, 68.0, "Total", ["4.00"])]
    got = checks.section_totals(rows_of(spark, [(*r[:5], r[5] or [""]) for r in rows]), 0).orderBy("y").collect()
    assert [(float(r.got), r.ok) for r in got] == [(15.0, True), (3.0, False)]


def test_rows_anchor_on_their_first_token(spark):
    tokens = spark.createDataFrame([(1, 1, t, float(k), float(k + 5), top) for k, (t, top) in enumerate([("a", 0.0), ("b", 1.5), ("c", 3.0), ("d", 4.5)])], "doc_id long, page int, text string, x0 double, x1 double, top double")
    assert [r.row_id for r in layout.visual_rows(tokens).orderBy("top").collect()] == [1, 1, 2, 2]
    assert [r.row_id for r in layout.visual_rows_chain(tokens).orderBy("top").collect()] == [1, 1, 1, 1]


def test_no_figure_is_lost_by_binning(spark):
    tokens = spark.createDataFrame([(1, 1, t, x - 10, x, r) for t, x, r in [("1.00", 100.0, 1), ("2.00", 100.0, 2), ("3.00", 101.0, 3), ("9.00", 60.0, 3), ("4.00", 103.0, 3)]], "doc_id long, page int, text string, x0 double, x1 double, row_id long")
    got = layout.rows_with_values(layout.bin_values(tokens, layout.value_columns(tokens)), 1).orderBy("row_id").collect()
    assert [r["values"] for r in got] == [["1.00"], ["2.00"], ["3.00"]] and list(got[2].unbinned) == ["9.00", "4.00"]


def test_pages_split_at_markers(spark):
    docs = spark.createDataFrame([(1, "x<!-- [page 2] -->a<!-- ==[file: f | page 3]== -->b"), (2, "plain")], "doc_id long, text string")
    assert {(r.doc_id, r.page, r.text) for r in corpus.split_pages(docs).collect()} == {(1, 2, "a"), (1, 3, "b"), (2, 1, "plain")}


def test_transcripts_become_lines(spark):
    docs = spark.createDataFrame([(1, 1, "<table><tr><td>Total</td><td>&#36;184.61</td></tr></table>\n**Bold**\\n text ![i](u)")], "doc_id long, page int, text string")
    assert [r.text for r in corpus.normalise_transcripts(docs).orderBy("line_no").collect()] == ["Total\t$184.61", "Bold  text"]


def test_manifest(spark, tmp_path):
    (tmp_path / "g1").mkdir()
    (tmp_path / "__pycache__").mkdir()
    for name in ("g1/a.pdf", "g1/b.PNG", "c.xyz", ".hidden", "g1/~$tmp.docx", "__pycache__/x.txt", "g1/t.csv"):
        (tmp_path / name).write_text("x")
    got = {(r.name, r.grp, r.route) for r in corpus.scan_manifest(spark, str(tmp_path), 1, allow_ocr=True).collect()}
    assert got == {("a.pdf", "g1", "pdf"), ("b.PNG", "g1", "ocr"), ("c.xyz", "(root)", "unsupported"), ("t.csv", "g1", "table")}
    assert {r.grp for r in corpus.scan_manifest(spark, str(tmp_path), 0).collect()} == {tmp_path.name}


def test_labels_match_by_tier(spark):
    rows = spark.createDataFrame([("RENT INCOME",), ("Rent incomes",), ("Old name",), ("Zebra",)], "label string")
    names = spark.createDataFrame([("Rent income",), ("Late fees",)], "canonical string")
    memory = spark.createDataFrame([("old name", "Late fees", 1), ("old name", "Rent income", 2)], "norm_label string, canonical string, seq long")
    got = {r.label: (r.canonical, r.tier) for r in mapping.match_labels(rows, names, memory).collect()}
    assert got == {"RENT INCOME": ("Rent income", "exact"), "Rent incomes": ("Rent income", "fuzzy"), "Old name": ("Rent income", "learned"), "Zebra": ("Rent income", "weak")}


def test_records_open_at_heads(spark):
    rows = rows_of(spark, [(1, 1, float(k), x, lab, val) for k, (x, lab, val) in enumerate([(59.0, "A", ["1"]), (70.0, "", ["2"]), (59.0, "B", ["3"]), (59.0, "note", [""])])])
    assert [r.record_id for r in records.assemble_records(records.row_kind(rows)).orderBy("y").collect()] == [1, 1, 2, 2]
