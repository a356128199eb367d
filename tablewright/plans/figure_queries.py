"""Queries of records and reconciliation over report rows derived from lineitem, and of mapping over part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.vocabulary import parse_figure
from tablewright.operators import checks, mapping, records
from tablewright.sources.derived import LINES, REPORT_ROWS, ROLL_ROWS, both_rows, derived, report_rows, roll_rows, table

RR = f"WITH rr AS ({REPORT_ROWS})"
TOTALS = f"""WITH {LINES}, s AS (SELECT doc_id, l_returnflag, row_number() OVER (PARTITION BY doc_id ORDER BY l_returnflag) AS sec, sum(amt) AS amt, sum(q) AS q, count(*) AS n FROM l GROUP BY 1, 2),
ind AS (SELECT doc_id, CASE WHEN sum(n) >= count(*) THEN true END AS has FROM s GROUP BY 1)"""


def ragged(spark, sf):
    rows = report_rows(spark, sf)
    gap = (F.col("doc_id") % 5 == 0) & (F.col("x0") == 59.0)
    return checks.ragged_rows(rows.withColumn("values", F.when(gap, F.array(F.lit(""), F.element_at("values", 2))).otherwise(F.col("values"))))


def indented(spark, sf):
    """Both columns' checks of the indented report."""
    return checks.section_totals(report_rows(spark, sf))


def mixed_rows(spark, sf):
    """Indented reports, and flat ones under other numbers; a stray figure in some."""
    stray = F.when(F.col("label") == "Item 2", F.array(F.lit("7.5"))).otherwise(F.array().cast("array<string>"))
    return both_rows(spark, sf).withColumn("unbinned", stray)


def all_checks(spark, sf):
    return checks.run_checks(mixed_rows(spark, sf), 3)


def items(spark, sf):
    return derived(spark, sf, f"with {LINES} select doc_id, n as row_no, q, amt, tax from l")


def identities(spark, sf):
    return checks.arithmetic_identities(
        items(spark, sf),
        {"price": (F.col("amt"), F.floor(F.col("amt") / F.col("q")) * F.col("q"), 25.0), "tax": (F.col("tax"), F.lit(0.05).cast("decimal(18,4)"), 0.02)},
    )


def periodic(spark, sf):
    """The total is named and stands first; the last column is a part."""
    total = F.col("q") + F.col("amt") + F.when(F.col("row_no") == 2, 1).otherwise(0)
    rows = items(spark, sf).select("doc_id", "row_no", F.array(total.cast("decimal(18,2)").cast("string"), F.col("q").cast("string"), F.col("amt").cast("string")).alias("values"))
    return checks.periodic_tie_out(rows, ["YTD ", "Jan", "Feb"])


def balance(spark, sf):
    own = items(spark, sf).withColumn("doc_id", F.col("doc_id") * 100 + F.col("row_no"))
    due = F.col("q") + F.col("amt") - F.col("tax") + F.when(F.col("doc_id") % 3 == 0, 5).otherwise(0)
    text = lambda c: c.cast("decimal(18,2)").cast("string")
    return checks.bill_balance(own.select("doc_id", text(F.col("q")).alias("previous"), F.concat(F.lit("$"), text(F.col("amt"))).alias("current"), text(F.col("tax")).alias("payments"), F.when(F.col("doc_id") % 7 != 0, text(due)).alias("due")))


def census(spark, sf):
    own = items(spark, sf).select("doc_id", F.col("amt").cast("string").alias("token"), "row_no")
    return checks.token_census(own, own.filter("row_no <> 3"))


def diff(spark, sf):
    before = items(spark, sf).select("doc_id", "row_no", F.col("q").cast("string").alias("v"))
    after = before.filter("row_no <> 5").withColumn("v", F.when(F.col("row_no") == 2, "0.00").otherwise(F.col("v")))
    return checks.snapshot_diff(before, after, ["doc_id", "row_no"], "v", before.filter("row_no = 2 AND doc_id % 2 = 0"))


def parity(spark, sf):
    own = items(spark, sf).withColumn("steps", F.col("row_no"))
    kept = own.filter("row_no <> 4").withColumn("steps", F.when((F.col("doc_id") % 4 == 0) & (F.col("row_no") == 1), 2).otherwise(F.col("steps")))
    return checks.count_parity(own.select("doc_id", "steps"), kept.filter("doc_id % 10 > 0").select("doc_id", "steps"), own.filter("doc_id % 20 = 0").select("doc_id"))


def series(spark, sf):
    own = derived(spark, sf, f"with {LINES} select doc_id, l_returnflag as code, n as step, amt as amount from l")
    return records.series_by_code(own)


def codes(spark, sf):
    own = derived(spark, sf, f"with {LINES} select doc_id, 1 as page, n as row_id, n as x0, case when n % 2 = 0 then 'CAM' else 'Rent' end as text from l")
    return records.charge_code(own.withColumn("row_id", F.lit(1)))


def parents(spark, sf):
    own = derived(spark, sf, f"with {LINES} select doc_id, n as line_no, case when n % 3 = 2 then 'S' || cast(n as string) end as name, n % 4 = 0 as is_total from l")
    return records.inherit_parent(own)


def parts(spark, sf):
    return table(spark, sf, "part")


def matched(spark, sf):
    """Labels as printed: a word too many, in capitals with a hyphen, a letter short, of one word in common, learned, or inside a longer text."""
    names, key = parts(spark, sf), F.col("p_partkey")
    label = (
        F.when(key % 5 == 0, F.concat("p_name", F.lit(" x")))
        .when(key % 5 == 1, F.regexp_replace(F.upper("p_name"), " ", " - "))
        .when(key % 5 == 2, F.expr("left(p_name, length(p_name) - 1)"))
        .when(key % 40 == 3, F.concat(F.lit("zzz"), key.cast("string")))
        .when(key % 5 == 3, F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" qqqqq")))
        .otherwise(F.concat(F.lit("Total "), "p_name", F.lit(" expense for year")))
    )
    canonical = names.select(F.col("p_name").alias("canonical")).distinct()
    memory = names.filter("p_partkey % 40 = 3").select(F.concat(F.lit("zzz"), key.cast("string")).alias("norm_label"), F.lit("learned").alias("canonical"), key.alias("seq"))
    return mapping.match_labels(names.select(label.alias("label")), canonical, memory)


def candidates(spark, sf):
    rows = parts(spark, sf).select(F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" qqqqq")).alias("label"))
    return mapping.label_candidates(rows, parts(spark, sf).select(F.col("p_name").alias("canonical")).distinct())


def corrections(spark, sf):
    own = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("profile"), (F.col("o_custkey") % 50).cast("string").alias("norm_label"), F.col("o_orderkey").cast("string").alias("canonical"), F.col("o_orderkey").alias("seq"))
    return mapping.apply_corrections(own)


def columns(spark, sf):
    """Workbooks of two source and two template sheets; headers differ in case and punctuation, some repeat."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    sheet = lambda no, name, *headers: F.array(*[F.struct(F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet"), (h if not isinstance(h, str) else F.lit(h)).alias("header")) for h in headers])
    rent = F.when(F.col("doc_id") % 3 == 0, "Rent").otherwise("Rent, psf")
    source = own.select("doc_id", F.explode(F.concat(sheet(0, "Data", "Sq. Ft.", "TENANT name", rent, "Notes", "notes."), sheet(1, "Other", "Suite #", "Notes"))).alias("h")).select("doc_id", "h.*")
    template = own.select("doc_id", F.explode(F.concat(sheet(0, "Cover", "Suite"), sheet(1, "Roll", "Sq Ft", "Tenant Name", "Rent", "Notes"))).alias("h")).select("doc_id", "h.*")
    return mapping.map_columns(source, template)


def coverage(spark, sf):
    types = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_type"), F.col("n_name").alias("field"))
    target = table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_regionkey").alias("doc_type"), F.when((F.col("n_nationkey") % 2 == 0) & (F.col("n_regionkey") != 2), F.col("n_name")).alias("field"))
    return mapping.field_coverage(types, target)


def runs(spark, sf):
    own = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"))
    return mapping.latest_runs(own, 3)


def spellings(spark, sf):
    """One name in three spellings: upper case, with dots and runs of spaces, and plain."""
    name, key = F.col("o_orderpriority"), F.col("o_orderkey")
    spelt = F.when(key % 3 == 0, F.upper(name)).when(key % 3 == 1, F.regexp_replace(name, "[ -]+", " .  ")).otherwise(F.lower(name))
    own = table(spark, sf, "orders").select(spelt.alias("column_name"), key.alias("ord"))
    return mapping.canonical_columns(own).groupBy("column_name", "canonical").agg(F.count(F.lit(1)).alias("n"))


def events(spark, sf):
    return table(spark, sf, "events")


def scoreboard(spark, sf):
    return checks.recipe_scoreboard(events(spark, sf).select(F.col("event_type").alias("slug"), (F.col("value") > 50).alias("reconciled")))


QUERIES = {
    "dominant_indent": lambda s, d: checks.dominant_indent(report_rows(s, d)),
    "section_totals": lambda s, d: checks.section_totals(report_rows(s, d), 1).drop("note"),
    "flat_totals": lambda s, d: checks.flat_totals(roll_rows(s, d), 3).drop("page", "check").withColumn("got", (F.floor(F.col("got") * 100) / 100).cast("double")),
    "total_method_vote": lambda s, d: checks.total_method_vote(checks.total_segments(roll_rows(s, d), 3)),
    "run_checks": lambda s, d: all_checks(s, d).groupBy("doc_id", "check", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok")),
    "check_summary": lambda s, d: checks.check_summary(indented(s, d).withColumn("check", F.concat_ws(":", "check", "scope"))),
    "failing_rows": lambda s, d: checks.failing_rows(indented(s, d)),
    "flag_rollup": lambda s, d: checks.flag_rollup(indented(s, d)),
    "ragged_rows": ragged,
    "arithmetic_identities": identities,
    "periodic_tie_out": periodic,
    "bill_balance": balance,
    "token_census": census,
    "snapshot_diff": diff,
    "count_parity": parity,
    "row_kind": lambda s, d: records.row_kind(report_rows(s, d)).drop("values"),
    "assemble_records": lambda s, d: records.assemble_records(records.row_kind(report_rows(s, d))).groupBy("doc_id", "record_id").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y")),
    "section_carry": lambda s, d: records.section_carry(report_rows(s, d), "SECTION ").drop("values"),
    "series_by_code": lambda s, d: series(s, d).withColumn("amounts", F.array_join(F.transform("amounts", lambda x: x.cast("string")), "|")),
    "series_wide": lambda s, d: records.series_wide(series(s, d)).select("doc_id", "a_1", "a_2", "n_1", "r_1"),
    "charge_code": codes,
    "inherit_parent": parents,
    "match_labels": matched,
    "label_candidates": candidates,
    "apply_corrections": corrections,
    "map_columns": columns,
    "field_coverage": coverage,
    "latest_runs": runs,
    "canonical_columns": spellings,
    "recipe_scoreboard": scoreboard,
}

SECTION = """SELECT doc_id, CAST(1 AS INT) AS page, CAST(sec * 1000 + 999 AS DOUBLE) AS y, 'section_total' AS "check", 'col1' AS scope, 'Total ' || l_returnflag AS label,
 CAST(CASE WHEN doc_id % 7 = 0 AND sec = 1 THEN amt + 1 ELSE amt END AS DECIMAL(18,4)) AS expected, CAST(amt AS DECIMAL(18,4)) AS got,
 CAST(CASE WHEN doc_id % 7 = 0 AND sec = 1 THEN -1 ELSE 0 END AS DECIMAL(18,2)) AS diff, (NOT (doc_id % 7 = 0 AND sec = 1)) OR 0.011 * n >= 1 AS ok"""
IT = f"WITH {LINES}"
MODE = "item_x0"
INDENT = "SELECT doc_id, x0 AS item_x0 FROM (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(y)) AS k FROM rr WHERE v0 IS NOT NULL GROUP BY doc_id, x0) WHERE k = 1"
# totals of the flat report: what each covers, every method's value over these rows, votes by rows, and the judgement
V = "CAST(CASE col WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END AS DECIMAL(18,4))"
ROLL = f"""WITH rl AS MATERIALIZED (SELECT *, NOT label LIKE 'Suite%' AS is_total FROM ({ROLL_ROWS})),
b AS (SELECT *, coalesce(sum(CASE WHEN is_total THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM rl),
mem AS (SELECT doc_id, k, v0::DECIMAL(18,4) AS a, v1::DECIMAL(18,4) AS b, v2::DECIMAL(18,4) AS c FROM b WHERE NOT is_total UNION ALL SELECT doc_id, k + 1, v0::DECIMAL(18,4), v1::DECIMAL(18,4), v2::DECIMAL(18,4) FROM b WHERE is_total),
s AS (SELECT doc_id, k, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(a::DECIMAL(30,4) * b)::DOUBLE AS ab, sum(a::DECIMAL(30,4) * c)::DOUBLE AS ac, sum(b::DECIMAL(30,4) * c)::DOUBLE AS bc FROM mem GROUP BY 1, 2),
t AS (SELECT b.doc_id, b.k, b.y, b.label, v.col, {V.format("v0", "v1", "v2")} AS printed, s.* EXCLUDE (doc_id, k) FROM b JOIN s ON b.doc_id = s.doc_id AND b.k = s.k, (VALUES (0), (1), (2)) AS v(col) WHERE is_total),
h AS (SELECT doc_id, k, y, label, col, printed, n, 'sum' AS method, 0 AS rank, round({V.format("a", "b", "c")}, 2)::DECIMAL(18,4) AS value FROM t
  UNION ALL SELECT doc_id, k, y, label, col, printed, n, 'average', 1, round({V.format("a", "b", "c")}::DOUBLE / n, 4)::DECIMAL(18,4) FROM t
  UNION ALL SELECT doc_id, k, y, label, col, printed, n, 'average weighted by column ' || w, 2, round(CASE WHEN (col, w) IN ((0, 2), (1, 1)) THEN ab WHEN (col, w) IN ((0, 3), (2, 1)) THEN ac ELSE bc END / CASE w WHEN 1 THEN a::DOUBLE WHEN 2 THEN b::DOUBLE ELSE c::DOUBLE END, 4)::DECIMAL(18,4)
    FROM t, (VALUES (1), (2), (3)) AS x(w) WHERE w <> col + 1
  UNION ALL SELECT doc_id, k, y, label, col, printed, n, 'column ' || x || ' total over column ' || z || ' total', 3, round(CASE x WHEN 1 THEN a::DOUBLE WHEN 2 THEN b::DOUBLE ELSE c::DOUBLE END / CASE z WHEN 1 THEN a::DOUBLE WHEN 2 THEN b::DOUBLE ELSE c::DOUBLE END, 4)::DECIMAL(18,4)
    FROM t, (VALUES (1), (2), (3)) AS p(x), (VALUES (1), (2), (3)) AS r(z) WHERE x <> z AND col + 1 NOT IN (x, z)),
o AS MATERIALIZED (SELECT *, abs(value - printed)::DOUBLE <= CASE WHEN method = 'sum' THEN greatest(0.011::DOUBLE, 0.011::DOUBLE * n) ELSE greatest(0.05::DOUBLE, abs(printed)::DOUBLE * 0.002::DOUBLE) END AS fit FROM h),
m AS MATERIALIZED (SELECT doc_id, col, CASE WHEN votes > 0 THEN method ELSE 'sum' END AS method, votes FROM (SELECT doc_id, col, method, rank, CAST(coalesce(sum(n) FILTER (fit), 0) AS BIGINT) AS votes FROM o GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, col ORDER BY votes DESC, rank, method) = 1),
j AS (SELECT o.doc_id, y, o.col, label, printed, value AS got, fit AS ok, n, o.method AS used FROM o JOIN m ON o.doc_id = m.doc_id AND o.col = m.col AND o.method = m.method)"""


# Scores from the measure's definition: (w + ' qqqqq') and (w + ' ' + noun) share the word w, and no letter besides; see the closed forms.
ALIKE = """c AS (SELECT DISTINCT p_name AS canonical FROM part), w AS (SELECT canonical, split_part(canonical, ' ', 1) AS adj, length(split_part(canonical, ' ', 1)) AS s, length(split_part(canonical, ' ', 2)) AS n FROM c),
a AS (SELECT adj || ' qqqqq' AS label, canonical, round(greatest(200.0 * (s + 1) / (2 * s + 7 + n), 95.0 - 95.0 * (5 + n) / (2 * s + 7 + n), 95.0 - 95.0 * 6 / (2 * s + 6), 95.0 - 95.0 * (1 + n) / (2 * s + 1 + n))::DOUBLE, 4) AS score FROM w)"""
MATCH = f"""WITH p AS (SELECT p_partkey AS key, p_name AS name FROM part), {ALIKE},
b AS (SELECT label, arg_min(canonical, (-score, canonical)) AS canonical, max(score) AS score FROM a GROUP BY 1)
SELECT DISTINCT name || ' x' AS label, name AS canonical, 'fuzzy' AS tier, 95.0::DOUBLE AS confidence FROM p WHERE key % 5 = 0
UNION SELECT regexp_replace(upper(name), ' ', ' - '), name, 'exact', 100 FROM p WHERE key % 5 = 1
UNION SELECT left(name, length(name) - 1), name, CASE WHEN 200.0 * (length(name) - 1) / (2 * length(name) - 1) >= 88 THEN 'fuzzy' ELSE 'weak' END, round((200.0 * (length(name) - 1) / (2 * length(name) - 1))::DOUBLE, 4) FROM p WHERE key % 5 = 2
UNION SELECT 'zzz' || key, 'learned', 'learned', 100 FROM p WHERE key % 40 = 3 AND key % 5 > 2
UNION SELECT b.label, b.canonical, 'weak', b.score FROM p JOIN b ON b.label = split_part(name, ' ', 1) || ' qqqqq' WHERE key % 5 = 3 AND key % 40 <> 3
UNION SELECT 'Total ' || name || ' expense for year', name, 'fuzzy', 90 FROM p WHERE key % 5 = 4 AND key % 40 <> 3"""
ORACLES = {
    "dominant_indent": f"""{RR}, c AS (SELECT doc_id, x0, count(*) AS n, min(y) AS first FROM rr WHERE v0 IS NOT NULL GROUP BY 1, 2),
      i AS (SELECT doc_id, x0 AS item_x0, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c)
      SELECT i.doc_id, item_x0, min(CASE WHEN c.x0 > item_x0 + 2 THEN c.x0 END) AS total_x0 FROM i JOIN c ON c.doc_id = i.doc_id WHERE k = 1 GROUP BY 1, 2""",
    "section_totals": f"{TOTALS} {SECTION} FROM s",
    "flat_totals": f"""{ROLL} SELECT doc_id, y, 'col' || col AS scope, label, printed AS expected, CAST(floor(got * 100) / 100 AS DOUBLE) AS got, CAST(round(got - printed, 2) AS DECIMAL(18,2)) AS diff, ok, n || ' row(s) above it, as ' || used AS note FROM j""",
    "check_summary": f"""{TOTALS} SELECT 'section_total:col0' AS "check", count(*) AS passed, CAST(0 AS BIGINT) AS failed FROM s
      UNION ALL SELECT 'section_total:col1', count(*) FILTER (NOT (doc_id % 7 = 0 AND sec = 1) OR 0.011 * n >= 1), count(*) FILTER (doc_id % 7 = 0 AND sec = 1 AND 0.011 * n < 1) FROM s
      UNION ALL SELECT 'all', count(*) + count(*) FILTER (NOT (doc_id % 7 = 0 AND sec = 1) OR 0.011 * n >= 1), count(*) FILTER (doc_id % 7 = 0 AND sec = 1 AND 0.011 * n < 1) FROM s""",
    "flag_rollup": f"""{TOTALS} SELECT doc_id, CAST(1 AS INT) AS page, CAST(sec * 1000 + 999 AS DOUBLE) AS y, 'section_total' AS why, 'col1' AS columns FROM s WHERE doc_id % 7 = 0 AND sec = 1 AND 0.011 * n < 1""",
    "ragged_rows": f"{RR} SELECT doc_id, page, y, label, '0' AS empty FROM rr WHERE doc_id % 5 = 0 AND x0 = 59",
    "arithmetic_identities": f"""{IT} SELECT doc_id, n AS row_no, 'price' AS "check", CAST(amt AS DECIMAL(18,4)) AS expected, CAST(floor(amt / q)::DECIMAL(18,2) * q AS DECIMAL(18,4)) AS got, abs(amt - floor(amt / q)::DECIMAL(18,2) * q) <= 25 AS ok FROM l
      UNION ALL SELECT doc_id, n, 'tax', CAST(tax AS DECIMAL(18,4)), CAST(0.05 AS DECIMAL(18,4)), abs(tax - 0.05) <= 0.02 FROM l""",
    "periodic_tie_out": f"{IT} SELECT doc_id, n AS row_no, CAST(q + amt + CASE WHEN n = 2 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS total, CAST(q + amt AS DECIMAL(38,4)) AS got, n <> 2 AS ok FROM l",
    "bill_balance": f"""{IT}, b AS (SELECT doc_id * 100 + n AS d, q, amt, tax FROM l) SELECT d AS doc_id, CAST(q + amt - tax + CASE WHEN d % 3 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,4)) AS due, CAST(q + amt - tax AS DECIMAL(18,4)) AS got, d % 3 <> 0 AS ok FROM b WHERE d % 7 <> 0""",
    "token_census": f"""{IT}, a AS (SELECT doc_id, CAST(amt AS VARCHAR) AS token, count(*) AS n_source, count(*) FILTER (n <> 3) AS n_output FROM l GROUP BY 1, 2) SELECT * FROM a WHERE n_source <> n_output""",
    "snapshot_diff": f"""{IT} SELECT doc_id, n AS row_no, CAST(q AS VARCHAR) AS was, CASE WHEN n = 2 THEN '0.00' END AS now, n = 2 AND doc_id % 2 = 0 AS meant FROM l WHERE n = 5 OR n = 2""",
    "count_parity": f"""{IT}, p AS (SELECT doc_id, count(*) AS anchors, CAST(sum(n) AS BIGINT) AS anchors_steps, count(*) FILTER (n <> 4 AND doc_id % 10 > 0) AS records,
        CAST(coalesce(sum(CASE WHEN doc_id % 4 = 0 AND n = 1 THEN 2 ELSE n END) FILTER (n <> 4 AND doc_id % 10 > 0), 0) AS BIGINT) AS records_steps, doc_id % 10 = 0 AND doc_id % 20 <> 0 AS silent FROM l GROUP BY doc_id)
      SELECT * FROM p WHERE anchors <> records OR anchors_steps <> records_steps OR silent""",
    "section_carry": f"""{RR} SELECT doc_id, page, y, x0, label, split_part(max(CASE WHEN label LIKE 'SECTION %' THEN lpad(CAST(CAST(y AS INT) AS VARCHAR), 9, '0') || ' ' || substr(label, 9) END) OVER (PARTITION BY doc_id ORDER BY y ROWS UNBOUNDED PRECEDING), ' ', 2) AS section FROM rr""",
    "series_by_code": f"""{IT}, s AS (SELECT doc_id, l_returnflag AS code, min(n) AS first, count(*) AS k, string_agg(amt::VARCHAR, '|' ORDER BY n) AS amounts FROM l GROUP BY 1, 2)
      SELECT doc_id, code, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INT) AS place, CAST(k AS INT) AS n, amounts FROM s""",
    "charge_code": f"{IT} SELECT DISTINCT doc_id, CAST(1 AS INT) AS page, CAST(1 AS INT) AS row_id, 'CAM' AS code FROM l WHERE n = 2",
    "inherit_parent": f"""{IT}, a AS (SELECT doc_id, n AS line_no, CASE WHEN n % 3 = 2 THEN 'S' || n END AS name, n % 4 = 0 AS is_total, (n - 1) // 4 AS run FROM l)
      SELECT doc_id, line_no, name, is_total, last_value(name IGNORE NULLS) OVER w AS parent, last_value(name IGNORE NULLS) OVER w IS NULL AS orphan FROM a WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no ROWS UNBOUNDED PRECEDING)""",
    "apply_corrections": "SELECT o_orderpriority AS profile, CAST(o_custkey % 50 AS VARCHAR) AS norm_label, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS canonical, count(*) AS learned FROM orders GROUP BY 1, 2",
    "map_columns": """SELECT c_custkey AS doc_id, 'Data' AS source_sheet, 'Roll' AS template_sheet, h AS header, CASE h WHEN 'Sq Ft' THEN 'Sq. Ft.' WHEN 'Tenant Name' THEN 'TENANT name' WHEN 'Rent' THEN CASE WHEN c_custkey % 3 = 0 THEN 'Rent' END END AS source_header
      FROM customer, (VALUES ('Sq Ft'), ('Tenant Name'), ('Rent'), ('Notes')) AS v(h)""",
    "field_coverage": "SELECT n_regionkey AS doc_type, n_name AS field, 'unknown field' AS problem FROM nation WHERE n_regionkey NOT IN (1, 2) AND n_nationkey % 2 = 1 UNION ALL SELECT DISTINCT n_regionkey, NULL, 'unknown type' FROM nation WHERE n_regionkey = 1",
    "latest_runs": "SELECT o_custkey AS owner, o_orderkey AS seq, CAST(row_number() OVER w AS INT) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC) QUALIFY row_number() OVER w <= 3",
    "canonical_columns": """WITH o AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN regexp_replace(o_orderpriority, '[ -]+', ' .  ', 'g') ELSE lower(o_orderpriority) END AS column_name, o_orderkey AS ord, o_orderpriority AS p FROM orders),
      c AS (SELECT p, arg_min(column_name, ord) AS canonical FROM o GROUP BY 1) SELECT column_name, canonical, count(*) AS n FROM o JOIN c USING (p) GROUP BY 1, 2""",
    "recipe_scoreboard": "SELECT event_type AS slug, count(*) AS applied, count(*) FILTER (value > 50) AS reconciled, count(*) FILTER (NOT value > 50) AS failed FROM events GROUP BY 1",
    "total_method_vote": f"""{ROLL} SELECT doc_id, CAST(col AS INT) AS col, method, votes FROM m""",
    "run_checks": f"""WITH a AS (SELECT * FROM ({ROLL} SELECT -doc_id - 1 AS doc_id, 'table_total' AS "check", 'col' || col AS scope, ok FROM j)
      UNION ALL SELECT * FROM ({TOTALS} SELECT doc_id, 'section_total', 'col0', true FROM s UNION ALL SELECT doc_id, 'section_total', 'col1', NOT (doc_id % 7 = 0 AND sec = 1) OR 0.011 * n >= 1 FROM s)
      UNION ALL SELECT * FROM ({IT} SELECT doc_id, 'unbinned', 'row', false FROM l WHERE n = 2))
      SELECT doc_id, "check", scope, count(*) AS n, count(*) FILTER (ok) AS ok FROM a GROUP BY 1, 2, 3""",
    "failing_rows": f"""{TOTALS} SELECT doc_id, CAST(1 AS INT) AS page, CAST(sec * 1000 + 999 AS DOUBLE) AS y, 'section_total' AS "check", 'col1' AS scope, 'Total ' || l_returnflag AS label, CAST(amt + 1 AS DECIMAL(18,4)) AS expected, CAST(amt AS DECIMAL(18,4)) AS got,
      CAST(-1 AS DECIMAL(18,2)) AS diff, n || ' item(s)' AS note FROM s WHERE doc_id % 7 = 0 AND sec = 1 AND 0.011 * n < 1""",
    "row_kind": f"{RR} SELECT doc_id, page, y, x0, label, CASE WHEN x0 = 53 THEN 'note' WHEN abs(x0 - {MODE}) <= 2 THEN 'head' ELSE 'continuation' END AS kind FROM rr JOIN ({INDENT}) USING (doc_id)",
    "assemble_records": f"""{RR}, k AS (SELECT doc_id, y, CASE WHEN x0 <> 53 AND abs(x0 - {MODE}) <= 2 THEN 1 ELSE 0 END AS head FROM rr JOIN ({INDENT}) USING (doc_id)),
      r AS (SELECT *, CAST(sum(head) OVER (PARTITION BY doc_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record_id FROM k) SELECT doc_id, record_id, count(*) AS n, min(y) AS y FROM r GROUP BY 1, 2""",
    "series_wide": f"""{IT}, s AS (SELECT doc_id, l_returnflag AS c, amt, row_number() OVER (PARTITION BY doc_id, l_returnflag ORDER BY n) AS k FROM l)
      SELECT doc_id, max(amt) FILTER (c = 'A' AND k = 1) AS a_1, max(amt) FILTER (c = 'A' AND k = 2) AS a_2, max(amt) FILTER (c = 'N' AND k = 1) AS n_1, max(amt) FILTER (c = 'R' AND k = 1) AS r_1 FROM s GROUP BY 1""",
    "match_labels": MATCH,
    "label_candidates": f"""WITH {ALIKE}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, canonical) AS INT) AS rank FROM a) SELECT * FROM r WHERE rank <= 3""",
}
