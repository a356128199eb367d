import glob
import os
import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.functions import vocabulary as v
from tablewright.operators import checks, mapping, records, retrieve
from tablewright.plans import figure_queries, record_queries, review_queries, stream_queries, table_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


MODULES = (record_queries, table_queries, review_queries, stream_queries)


@pytest.mark.parametrize(("module", "name"), [(m, name) for m in MODULES for name in sorted(m.QUERIES)])
def test_query_against_sql(spark, duck, module, name):
    got = module.QUERIES[name](spark, SF)
    want = duck.execute(module.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda row: repr(tuple(round(float(v), 6) if isinstance(v, (float, Decimal)) else v for v in row))
    assert sorted(plain(r[c] for c in columns) for r in got.collect()) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize(("text", "value"), [("(5-)", -5), ("-(5)", None), ("--5", None), ("(5", None), ("5.", 5), ("$(1,200.10)", -1200.1), ("7%", 7), ("-", None), ("()", None)])
def test_signs_of_figures(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(v.parse_figure(F.col("t")).alias("x")).first().x
    assert got is None if value is None else float(got) == value


@pytest.mark.parametrize(("text", "value"), [("1,204.90", 1204.9), ("$5,940.20", 5940.2), ("08/31/2026", None), ("+ $5,569.77 (6 items)", None), ("(12.00)", -12), ("- 3", -3), ("", None), (None, None)])
def test_strict_number(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(mapping.strict_number(F.col("t")).alias("x")).first().x
    assert got is None if value is None else float(got) == value


LINES = "doc_id long, record_id long, kind string, page int, y double, label string, values array<string>"


def test_a_series_needs_two_records(spark):
    one = [(1, 1, "head", 1, 0.0, "A", ["x", "1"]), (1, 1, "continuation", 1, 1.0, "", [None, "2"]), (1, 1, "continuation", 1, 2.0, "", ["", "3"])]
    assert records.series_columns(spark.createDataFrame(one, LINES)).isEmpty()
    two = one + [(1, 2, k, 1, y + 5, label, values) for _, _, k, _, y, label, values in one]
    assert [(r.col, r.records) for r in records.series_columns(spark.createDataFrame(two, LINES)).collect()] == [(1, 2)]


def test_flattened_record_takes_blank_fields_from_its_lines(spark):
    rows = [(1, 1, "head", 1, 0.0, "A", [None, "1"]), (1, 1, "continuation", 1, 1.0, "", ["late", "2"]), (1, 2, "head", 1, 2.0, "B", ["own", None]), (1, 0, "continuation", 1, -1.0, "", ["before", "9"])]
    got = {r.label: (r.n_steps, r["values"]) for r in records.flatten_records(spark.createDataFrame(rows, LINES), [1]).collect()}
    assert got == {"A": (2, ["late", "1", "2"]), "B": (0, ["own", None, None])}


def test_nothing_attaches_after_a_section(spark):
    rows = [(1, 0, "data", 1, 0.0, "A", ["1"]), (1, 0, "other", 1, 1.0, "a", ["2"]), (1, 0, "section", 1, 2.0, "S", [None]), (1, 0, "other", 1, 3.0, "b", ["3"])]
    got = records.attach_series(spark.createDataFrame(rows, LINES).drop("record_id")).collect()
    assert sorted((r.role, r.label) for r in got) == [("head", "A"), ("line", "a")]


def test_amount_in_three_pieces(spark):
    tokens = [(1, 1, "$1", 10.0, 20.0, 5.0), (1, 1, ",003", 30.0, 40.0, 5.0), (1, 1, ",900.10", 45.0, 60.0, 5.0), (1, 1, ",7", 95.0, 99.0, 5.0)]
    got = records.rejoin_split_amounts(spark.createDataFrame(tokens, "doc_id long, page int, text string, x0 double, x1 double, top double")).collect()
    assert sorted((r.text, r.x0, r.x1) for r in got) == [("$1,003,900.10", 10.0, 60.0), (",7", 95.0, 99.0)]


def test_names_are_grounded_by_half_of_their_parts(spark):
    values = [(1, "n", "RICHARD A. Kaminsky"), (1, "b", ""), (1, "x", "Other Person"), (2, "n", "Nobody Here")]
    got = checks.ground_by_parts(spark.createDataFrame(values, "doc_id long, field string, value string"), spark.createDataFrame([(1, "Tenant: Richard A. Kaminsky")], "doc_id long, text string"))
    assert {(r.doc_id, r.field): r.ok for r in got.collect()} == {(1, "n"): True, (1, "b"): True, (1, "x"): False, (2, "n"): False}


def test_a_single_pass_has_no_other(spark):
    rows = [(1, 1, 1, 0, "a"), (2, 1, 1, 0, "a"), (2, 1, 2, 0, None)]
    got = checks.multi_pass_pick(spark.createDataFrame(rows, "doc_id long, page int, pass int, problems int, k string"), ["k"]).collect()
    assert {r.doc_id: (r["pass"], r.differ) for r in got} == {1: (1, ""), 2: (1, "k")}


def test_misspelt_label_without_a_word_in_common(spark):
    names = spark.createDataFrame([("Receivables",), ("Net Income",), ("Deferred tax",)], "canonical string")
    rows = spark.createDataFrame([("Recievables",), ("Receivable",), ("Nett Incomes",), ("Net Incone",), ("--",)], "label string")
    memory = spark.createDataFrame([], "norm_label string, canonical string, seq long")
    got = {r.label: (r.tier, r.canonical) for r in mapping.match_labels(rows, names, memory).collect()}
    assert got["Receivable"] == ("fuzzy", "Receivables") and got["Recievables"] == ("fuzzy", "Receivables")
    assert got["Nett Incomes"] == ("fuzzy", "Net Income") and got["Net Incone"] == ("fuzzy", "Net Income") and got["--"][0] == "weak"
    best = {r.label: r.canonical for r in mapping.label_candidates(rows, names, 1).collect()}
    assert best.pop("--") and best == {"Receivable": "Receivables", "Recievables": "Receivables", "Nett Incomes": "Net Income", "Net Incone": "Net Income"}


def test_entities_are_scored_by_what_a_chunk_mentions(spark):
    texts = ["ACME suite 0012", "acmeish, 12a", "the Élan-Bar 7", "Bar 007 and 12", "sub_acme 1207", None, "o'neil 10-B", "O'Neil LLC 010-B."]
    scored = spark.createDataFrame([("g", n, 0, 1.0, t) for n, t in enumerate(texts)], "grp string, doc_id long, chunk_no int, score double, chunk string")
    own = [("g", 0, "12", "Acme LLC"), ("g", 1, "007", "lan Bar"), ("g", 2, "10-B", "O'Neil"), ("h", 3, "5", "Acme")]
    got = {(r.entity, r.doc_id): r.score for r in retrieve.score_for_entity(scored, spark.createDataFrame(own, "grp string, entity int, suite string, names string")).collect()}

    def plain(names, suite, others, text):
        text = text or ""
        words = [w for w in re.split(r"[^A-Za-z0-9']+", names) if len(w) > 2 and w.lower() not in ("llc", "the", "dba")]
        met = sum(bool(re.search(r"\b" + re.escape(w), text, re.I)) for w in words)
        number = lambda s: bool(re.search(r"\b0*" + re.escape(s.lstrip("0")) + r"\b", text))
        return 1.0 + 5.0 * min(4, met + number(suite)) - 12.0 * any(number(s) for s in others)

    assert got == {(e, n): plain(names, suite, [s for g, x, s, _ in own if g == "g" and x != e], t) for g, e, suite, names in own if g == "g" for n, t in enumerate(texts)}


def test_columns_are_mapped_without_sending_a_side_to_every_task(spark):
    """However small the files make the input look, no side of a join is broadcast; repeated spellings and pairs as before."""
    source = spark.createDataFrame([(1, 0, "A", "Sq. Ft."), (1, 0, "A", "Notes"), (1, 0, "A", "notes."), (1, 1, "B", "Notes"), (1, 1, "B", "sqft"), (2, 0, "A", "x"), (None, 0, "A", "y")], "doc_id long, sheet_no int, sheet string, header string")
    template = spark.createDataFrame([(1, 0, "T", "SQ FT"), (1, 0, "T", "Notes"), (1, 0, "T", ""), (1, 0, "T", None), (1, 1, "U", "Notes"), (2, 0, "T", "z"), (None, 0, "T", "y")], "doc_id long, sheet_no int, sheet string, header string")
    found = mapping.map_columns(source, template)
    assert {tuple(r) for r in found.collect()} == {(1, "B", "T", "SQ FT", "sqft"), (1, "B", "T", "Notes", "Notes"), (1, "B", "T", "", None), (1, "B", "T", None, None)}
    small_files = figure_queries.columns(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in small_files._jdf.queryExecution().sparkPlan().toString()
