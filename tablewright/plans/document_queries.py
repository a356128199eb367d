"""Queries of label search and layout over statements derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.shared import materialise
from tablewright.functions.vocabulary import value_kind
from tablewright.operators import checks, labels, layout, mapping, records, tables
from tablewright.sources.derived import LINES, NOTICE_LINES, REPORT_ROWS, SETTLEMENT_LINES, STATEMENT_LINES, STATEMENT_TOKENS, derived, report_rows, statement_lines, statement_tokens, table, token

FIELDS = ["Account number", "Statement date", "Total charges"]
SL, ST, RR = (f"WITH {n} AS ({sql})" for n, sql in (("sl", STATEMENT_LINES), ("st", STATEMENT_TOKENS), ("rr", REPORT_ROWS)))


def graded(spark, sf):
    return labels.graded_fields(statement_lines(spark, sf), FIELDS)


GRADED = f"""WITH o AS (
  SELECT o_orderkey AS doc_id, CAST((o_orderkey % 3) + 1 AS INT) AS page, o_custkey, o_orderkey % 5 AS v, strftime(o_orderdate, '%m/%d/%Y') AS dt FROM orders),
{LINES}, t AS (SELECT doc_id, sum(amt) AS total FROM l GROUP BY doc_id),
f AS (
  SELECT doc_id, page, 'Account number' AS field, CASE WHEN v <> 2 THEN 'AC-' || o_custkey END AS value, 'account no' AS lab, 'beside the label' AS wh,
         'Account No: AC-' || o_custkey AS ev FROM o
  UNION ALL SELECT doc_id, page, 'Statement date', dt, CASE WHEN v = 4 THEN 'bill date' ELSE 'statement date' END,
         CASE WHEN v = 1 THEN 'below the label' ELSE 'beside the label' END,
         CASE WHEN v = 1 THEN 'Statement Date' WHEN v = 4 THEN 'Bill Date:  ' || dt ELSE 'Statement Date: ' || dt END FROM o
  UNION ALL SELECT o.doc_id, page, 'Total charges', '$' || CAST(CASE WHEN v = 3 THEN total + 10 ELSE total END AS VARCHAR), 'total amount due', 'beside the label',
         'Total Amount Due: $' || CAST(CASE WHEN v = 3 THEN total + 10 ELSE total END AS VARCHAR) FROM o LEFT JOIN t ON o.doc_id = t.doc_id),
g AS (SELECT DISTINCT doc_id, page, field, coalesce(value, '') AS value, CASE WHEN value IS NULL THEN 'none' ELSE 'yes' END AS verdict,
       CASE WHEN value IS NULL THEN '' ELSE lab END AS matched_label, CASE WHEN value IS NULL THEN '' ELSE wh END AS where_found,
       CASE WHEN value IS NULL THEN '' ELSE ev END AS evidence FROM f)"""


def tokens_in_rows(spark, sf):
    return layout.visual_rows_chain(statement_tokens(spark, sf))


def binned(spark, sf):
    rows = tokens_in_rows(spark, sf)
    return layout.bin_values(rows, layout.value_columns(rows, min_rows=3))


ROWS = f"""{ST}, g AS (SELECT *, CASE WHEN top - lag(top) OVER w > 2.0 OR lag(top) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM st WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, x0)),
r AS (SELECT doc_id, page, text, x0, x1, top, CAST(sum(s) OVER (PARTITION BY doc_id, page ORDER BY top, x0) AS BIGINT) AS row_id FROM g)"""
VAL = r"regexp_matches(text, '[0-9]')"
COLUMNS = f"""{ROWS}, c0 AS (SELECT *, CASE WHEN x1 - lag(x1) OVER w <= 6 THEN 0 ELSE 1 END AS new FROM r WHERE {VAL} WINDOW w AS (PARTITION BY doc_id, page ORDER BY x1)),
c1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x1) AS island FROM c0),
c2 AS (SELECT doc_id, page, avg(x1) AS x1, count(*) AS n, min(x1) AS lo, max(x1) AS hi FROM c1 GROUP BY doc_id, page, island HAVING count(*) >= 3),
c AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY x1) - 1 AS INT) AS col, x1, n, lo, hi FROM c2)"""
BINNED = f"""{COLUMNS}, n AS (SELECT r.doc_id, r.page, r.row_id, r.x0, r.x1, r.text, min(CASE WHEN abs(r.x1 - c.x1) <= 6 THEN c.col END) AS col
  FROM r LEFT JOIN c ON r.doc_id = c.doc_id AND r.page = c.page WHERE regexp_matches(r.text, '[0-9]') GROUP BY ALL),
b AS (SELECT doc_id, page, row_id, x0, x1, text, CASE WHEN col IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, page, row_id, col ORDER BY x0, text) = 1 THEN col END AS col FROM n)"""


def parsed_rows(spark, sf):
    return layout.rows_with_values(binned(spark, sf), 3)


def signatures(spark, sf):
    texts = layout.row_texts(tokens_in_rows(spark, sf))
    return layout.page_signature(texts)


def matched(spark, sf):
    """Recipes: the signatures that several documents share."""
    own = materialise(signatures(spark, sf), "signatures")  # both sides and their counts read it
    recipes = own.groupBy("signature").agg(F.min("doc_id").alias("ord"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    recipes = recipes.select(F.concat(F.lit("recipe-"), F.col("ord").cast("string")).alias("slug"), "ord", "signature")
    return layout.match_recipe(own, recipes)


def wrapped(spark, sf):
    return records.rejoin_wrapped(statement_lines(spark, sf))


def typed_cells(spark, sf):
    cells = statement_tokens(spark, sf).select(F.col("x1").cast("int").alias("col"), "text", (F.col("doc_id") * 10000 + F.col("top")).alias("ord"))
    return checks.column_type_vote(cells)


def evidence(spark, sf):
    return checks.evidence_lines(graded(spark, sf).select("doc_id", "page", "field", "value"), statement_lines(spark, sf))


def grounded(spark, sf):
    """Cells of statements, every sixth line's figure made up, a name that is printed and one that isn't."""
    lines = statement_lines(spark, sf)
    printed, n = F.element_at(F.split("text", "\t"), -1), F.col("line_no")
    name = F.when(F.col("doc_id") % 2 == 0, "Account  statement").otherwise("Harbor Water")
    off = F.when(n == 1, name).when(n == 6, F.concat(F.lit("9"), printed)).when(n == 7, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(printed)
    # figures and names in one reading of the lines
    cells = lines.filter("(text LIKE 'Item %' AND line_no > 5) OR line_no = 1").select("doc_id", n.alias("row_no"), off.alias("value"))
    return checks.ground_values(cells, lines)


def notices(spark, sf):
    return derived(spark, sf, NOTICE_LINES)


ASKED = ["Provider name", "Ending balance", "Due date"]


SETTLED = ["Closing date", "Loan amount", "parcel_id", "Deal reference", "Premium rate", "Insurance number"]


def settled(spark, sf):
    """Fields that no list knows, two labels of the caller's for one of them, and every part's name as a label of another."""
    own = spark.createDataFrame([("Deal reference", "our ref"), ("Deal reference", "dossier no")], "field string, label string")
    labels_of_caller = own.unionByName(table(spark, sf, "part").select(F.lit("Insurance number").alias("field"), F.col("p_name").alias("label")))
    return labels.graded_fields(derived(spark, sf, SETTLEMENT_LINES), SETTLED, labels_of_caller)


def banded_tokens(spark, sf):
    """Statement tokens, three lines of prose below, and a second table with columns of its own."""
    n = F.col("n")
    place = lambda t, x0, x1, top: token(t, F.lit(x0), F.lit(x1), top)
    note, second = place(F.lit("Note"), 59.0, 79.0, 700 + 20 * n), 1000 + 12 * n
    notes = F.when(n <= 3, F.array(note)).otherwise(F.filter(F.array(note), lambda _: F.lit(False)))
    sums = F.array(place(F.lit("Sum"), 59.0, 74.0, second), place(n.cast("string"), 245.0, 250.0, second), place(F.concat(n.cast("string"), F.lit(".50")), 580.0, 600.0, second))
    return statement_tokens(spark, sf, notes, sums)


def read(spark, sf):
    rows = layout.visual_rows_chain(banded_tokens(spark, sf))
    return tables.read_tables(rows).select("doc_id", "band", "row_id", "label", F.array_join("values", "|", "-").alias("cells"), F.array_join("unbinned", "|").alias("unbinned"))


def pinned(spark, sf):
    rows = layout.visual_rows_chain(banded_tokens(spark, sf))
    columns = rows.select("doc_id").distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.lit(x).alias("x1"), F.lit(x).alias("lo")) for k, x in enumerate((300.0, 420.0, 470.0))]))).select("doc_id", "c.*")
    return tables.read_tables(rows, columns).groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.get("values", F.lit(k))).alias(f"c{k}") for k in range(3)], F.sum(F.size("unbinned")).alias("stray"))


def word_tokens(spark, sf):
    """A label, a charge code in a text column of its own, and now and then a second word in it."""
    own = statement_tokens(spark, sf).filter("text = 'Item'").select("doc_id", "page", ((F.col("top") - 100) / 12).cast("int").alias("row_id"))
    token = lambda t, x0: F.struct(F.lit(t).alias("text"), F.lit(x0).alias("x0"))
    code = F.when(F.col("row_id") % 4 == 3, F.array(token("BRT", 201.5), token("extra", 203.0))).otherwise(F.array(token("ABA", 200.0)))
    return own.select("doc_id", "page", "row_id", F.explode(F.concat(F.array(token("Tenant", 59.0)), code)).alias("t")).select("doc_id", "page", "row_id", "t.*")


def words_in_columns(spark, sf):
    own = word_tokens(spark, sf)
    label = own.select("doc_id", "page").distinct().withColumn("x0", F.lit(60.0))
    return own, layout.text_columns(own, exclude=label)


def export(spark, sf):
    return mapping.export_rows(graded(spark, sf), ["Statement date"])


def doc_type(spark, sf):
    marks = spark.sql("SELECT * FROM VALUES ('statement', 'Account number'), ('bill', 'Due date') AS t(doc_type, field)")
    return mapping.type_from_found_fields(graded(spark, sf), marks)


def approvals(spark, sf):
    review = graded(spark, sf).select("doc_id", F.col("field").alias("key"), F.when(F.col("value") != "", F.col("value")).alias("value"))
    given = review.filter("doc_id % 2 = 0").select("doc_id", "key", F.when(F.col("doc_id") % 4 == 0, F.col("value")).otherwise("old").alias("pinned"))
    return mapping.approval_state(review, given)


BANDS = f"WITH {LINES}, b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM l QUALIFY k >= 3)"
GROUNDED = SL + """, c AS (SELECT doc_id, line_no AS row_no, CASE WHEN line_no = 6 THEN '9' || split_part(text, chr(9), 3) WHEN line_no = 7 THEN '(' || split_part(text, chr(9), 3) || ')' ELSE split_part(text, chr(9), 3) END AS value FROM sl WHERE text LIKE 'Item %' AND line_no > 5),
  f AS MATERIALIZED (SELECT DISTINCT doc_id, try_cast(replace(unnest(regexp_extract_all(text, '-?[0-9,.]*[0-9]')), ',', '') AS DECIMAL(18,4)) AS v FROM sl),
  g AS (SELECT doc_id, row_no, value, CASE WHEN value LIKE '(%' THEN -CAST(replace(replace(value, '(', ''), ')', '') AS DECIMAL(18,4)) ELSE CAST(value AS DECIMAL(18,4)) END IN (SELECT v FROM f WHERE f.doc_id = c.doc_id) AS ok FROM c
    UNION ALL SELECT doc_id, line_no, CASE WHEN doc_id % 2 = 0 THEN 'Account  statement' ELSE 'Harbor Water' END, doc_id % 2 = 0 FROM sl WHERE line_no = 1)"""
QUERIES = {
    "graded_fields": graded,
    "label_hits": lambda s, d: labels.label_hits(statement_lines(s, d), FIELDS).groupBy("field", "label_key").agg(F.count(F.lit(1)).alias("n")),
    "field_summary": lambda s, d: labels.field_summary(graded(s, d)),
    "fields_wide": lambda s, d: labels.fields_wide(graded(s, d), FIELDS),
    "evidence_long": lambda s, d: labels.evidence_long(graded(s, d)),
    "heading_rows": lambda s, d: labels.heading_rows(statement_lines(s, d)).select("doc_id", "page", "line_no", "n_cells", "is_heading"),
    "nearest_heading_above": lambda s, d: labels.nearest_heading_above(statement_lines(s, d)).select("doc_id", "page", "line_no", F.array_join("head", "|").alias("head")),
    "visual_rows_chain": tokens_in_rows,
    "visual_rows": lambda s, d: layout.visual_rows(statement_tokens(s, d)),
    "row_texts": lambda s, d: layout.row_texts(tokens_in_rows(s, d)),
    "value_columns": lambda s, d: layout.value_columns(tokens_in_rows(s, d)),
    "bin_values": binned,
    "table_rows": lambda s, d: parsed_rows(s, d).select("doc_id", "page", "row_id", F.array_join("values", "|", "-").alias("cells"), F.array_join("unbinned", "|").alias("unbinned")),
    "read_tables": read,
    "read_tables_pinned": pinned,
    "table_regions": lambda s, d: tables.table_regions(layout.visual_rows_chain(banded_tokens(s, d)).select("doc_id", "page", "row_id", "text", "x1")).groupBy("doc_id", "band").agg(F.countDistinct("row_id").alias("rows"), F.min("row_id").alias("first")),
    "text_columns": lambda s, d: words_in_columns(s, d)[1].select("doc_id", "col", F.round("x0", 4).alias("x0"), "n", "lo", "hi"),
    "bin_text": lambda s, d: layout.bin_text(*words_in_columns(s, d)).select("doc_id", "row_id", "x0", "text", "col"),
    "notice_fields": lambda s, d: labels.graded_fields(notices(s, d), ASKED).select("doc_id", "field", "value", "verdict", "where_found"),
    "graded_own_labels": settled,
    "bin_nearest": lambda s, d: layout.bin_nearest(tokens_in_rows(s, d), layout.value_columns(tokens_in_rows(s, d))),
    "unbinned_audit": lambda s, d: checks.unbinned_audit(parsed_rows(s, d).withColumn("y", F.col("row_id"))),
    "masked_layout": lambda s, d: layout.masked_layout(tokens_in_rows(s, d)),
    "stable_column_count": lambda s, d: layout.stable_column_count(statement_tokens(s, d).filter(value_kind(F.col("text")) != "text").withColumn("x1", F.col("x1") + F.col("top") % 5).withColumn("width", F.lit(600.0))),
    "page_signature": lambda s, d: signatures(s, d).select("doc_id", F.array_join("signature", ",").alias("signature")),
    "match_recipe": matched,
    "indent_levels": lambda s, d: layout.indent_levels(report_rows(s, d)),
    "between_markers": lambda s, d: records.between_markers(statement_lines(s, d), "^Item\t", "^Total"),
    "rejoin_wrapped": wrapped,
    "column_type_vote": typed_cells,
    "evidence_lines": evidence,
    "ground_values": grounded,
    "ungrounded": lambda s, d: checks.ungrounded(grounded(s, d)),
    "export_rows": export,
    "type_from_found_fields": doc_type,
    "approval_state": approvals,
}

ORACLES = {
    "graded_fields": f"{GRADED} SELECT * FROM g",
    "evidence_long": f"{GRADED} SELECT * FROM g",
    "label_hits": SL + r""", k(field, label_key, p) AS (VALUES
  ('Account number', 'account number', 'account[^a-z0-9]{0,3}number'), ('Account number', 'customer number', 'customer[^a-z0-9]{0,3}number'), ('Account number', 'acct number', 'acct[^a-z0-9]{0,3}number'),
  ('Account number', 'customer no', 'customer[^a-z0-9]{0,3}no'), ('Account number', 'account no', 'account[^a-z0-9]{0,3}no'), ('Account number', 'account', 'account'), ('Account number', 'acct no', 'acct[^a-z0-9]{0,3}no'),
  ('Statement date', 'statement date', 'statement[^a-z0-9]{0,3}date'), ('Statement date', 'bill date', 'bill[^a-z0-9]{0,3}date'), ('Statement date', 'as of', 'as[^a-z0-9]{0,3}of'),
  ('Total charges', 'total charges', 'total[^a-z0-9]{0,3}charges'), ('Total charges', 'total current charges', 'total[^a-z0-9]{0,3}current[^a-z0-9]{0,3}charges'), ('Total charges', 'total amount due', 'total[^a-z0-9]{0,3}amount[^a-z0-9]{0,3}due'),
  ('Total charges', 'amount due', 'amount[^a-z0-9]{0,3}due'), ('Total charges', 'total due', 'total[^a-z0-9]{0,3}due'), ('Total charges', 'balance due', 'balance[^a-z0-9]{0,3}due'), ('Total charges', 'total', 'total'))
SELECT field, label_key, count(*) AS n FROM sl JOIN k ON regexp_matches(lower(text), '(^|[^a-z0-9])' || p) GROUP BY 1, 2""",
    "field_summary": f"""{GRADED} SELECT doc_id, count(*) AS asked, count(*) FILTER (verdict <> 'none') AS found,
        count(*) FILTER (verdict = 'none') AS missing, count(*) FILTER (verdict = 'check') AS odd FROM g GROUP BY doc_id""",
    "fields_wide": f"""{GRADED} SELECT doc_id, page, max(CASE WHEN field = 'Account number' THEN value END) AS account_number,
        max(CASE WHEN field = 'Statement date' THEN value END) AS statement_date, max(CASE WHEN field = 'Total charges' THEN value END) AS total_charges FROM g GROUP BY 1, 2""",
    "heading_rows": SL + """ SELECT doc_id, page, line_no, CAST(len(list_filter(regexp_split_to_array(text, '\\t|  +'), lambda x: trim(x) <> '')) AS INT) AS n_cells,
        text LIKE 'Item' || chr(9) || '%' AS is_heading FROM sl""",
    "nearest_heading_above": SL.replace("sl AS (", "sl AS MATERIALIZED (") + """, h AS (SELECT *, CASE WHEN text LIKE 'Item' || chr(9) || '%' THEN 'Item|Quantity|Amount' END AS is_head,
      len(list_filter(regexp_split_to_array(text, '\\t|  +'), lambda x: trim(x) <> '')) AS n FROM sl),
      a AS (SELECT doc_id, page, line_no, n, last_value(is_head IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS head FROM h)
      SELECT doc_id, page, line_no, CASE WHEN n <= 3 THEN head END AS head FROM a""",
    "visual_rows_chain": f"{ROWS} SELECT * FROM r",
    "visual_rows": f"{ST} SELECT doc_id, page, text, x0, x1, top, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY floor((top - 100) / 12)) AS BIGINT) AS row_id FROM st",
    "row_texts": f"{ROWS} SELECT doc_id, page, row_id, min(top) AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM r GROUP BY 1, 2, 3",
    "value_columns": f"{COLUMNS} SELECT * FROM c",
    "bin_values": f"{BINNED} SELECT * FROM b",
    "table_rows": f"""{BINNED} SELECT doc_id, page, row_id, coalesce(max(CASE WHEN col = 0 THEN text END), '-') || '|' || coalesce(max(CASE WHEN col = 1 THEN text END), '-') || '|' ||
        coalesce(max(CASE WHEN col = 2 THEN text END), '-') AS cells, coalesce(string_agg(CASE WHEN col IS NULL THEN text END, '|' ORDER BY x0, text), '') AS unbinned FROM b GROUP BY 1, 2, 3""",
    "bin_nearest": f"""{COLUMNS}, n AS (SELECT r.doc_id, r.page, r.row_id, r.x0, r.x1, r.text, arg_min(c.col, abs(r.x1 - c.x1) * 1000 + c.col) AS col FROM r JOIN c ON r.doc_id = c.doc_id AND r.page = c.page
        WHERE regexp_matches(r.text, '[0-9]') GROUP BY ALL) SELECT doc_id, page, row_id, col, arg_max(text, x0) AS text FROM n GROUP BY 1, 2, 3, 4""",
    "unbinned_audit": f"""{BINNED} SELECT doc_id, page, row_id AS y, 'unbinned' AS "check", false AS ok, string_agg(text, ' ' ORDER BY x0, text) AS note FROM b WHERE col IS NULL GROUP BY 1, 2, 3""",
    "masked_layout": f"""{ROWS} SELECT doc_id, page, row_id, string_agg(regexp_replace(text, '[0-9]', '#', 'g') || '@' || CAST(CAST(x0 AS INT) AS VARCHAR) || '-' || CAST(CAST(x1 AS INT) AS VARCHAR), ' ' ORDER BY x0, text) AS masked
        FROM r GROUP BY 1, 2, 3""",
    "page_signature": f"""{ROWS}, t AS (SELECT doc_id, row_id, string_agg(text, ' ' ORDER BY x0, text) AS text FROM r GROUP BY 1, 2),
        h AS (SELECT doc_id, row_id, substr(sha1(regexp_replace(lower(text), '[0-9]+', '#', 'g')), 1, 12) AS h FROM t WHERE row_id <= 8),
        u AS (SELECT doc_id, h, min(row_id) AS first FROM h GROUP BY 1, 2) SELECT doc_id, string_agg(h, ',' ORDER BY first) AS signature FROM u GROUP BY 1""",
    "indent_levels": f"""{RR} SELECT doc_id, page, y, x0, label, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY x0) - 1 AS INT) AS level FROM rr""",
    "between_markers": SL + " SELECT doc_id, page, line_no, text FROM sl WHERE text LIKE 'Item %' AND line_no > 5",
    "rejoin_wrapped": SL + r""", n AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record FROM sl)
        SELECT doc_id, page, record, min(line_no) AS line_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM n GROUP BY 1, 2, 3""",
    "column_type_vote": ST + r""", k AS (SELECT CAST(x1 AS INT) AS col, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'text' WHEN regexp_matches(text, '[.,$]') THEN 'money' ELSE 'number' END AS kind FROM st),
        c AS (SELECT col, kind, count(*) AS n FROM k GROUP BY 1, 2) SELECT col, arg_max(kind, n) AS kind, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "evidence_lines": f"{GRADED}, sl AS ({STATEMENT_LINES}) " + r"""SELECT g.doc_id, g.page, g.field, g.value, sl.line_no, 'line' AS method FROM g JOIN sl ON g.doc_id = sl.doc_id AND g.page = sl.page
        WHERE g.value <> '' AND regexp_matches(sl.text, '(^|[^A-Za-z0-9])' || regexp_escape(g.value) || '([^A-Za-z0-9]|$)')""",
    "ground_values": f"{GROUNDED} SELECT * FROM g",
    "ungrounded": f"{GROUNDED} SELECT doc_id, count(*) AS checked, count(*) FILTER (NOT ok) AS ungrounded FROM g GROUP BY 1",
    "read_tables": f"""{BANDS}, a AS (SELECT doc_id, CAST(0 AS INT) AS band, n AS row_id, 'Item' AS label, q || '|' || amt || '|' || CASE WHEN n = 4 THEN '-' ELSE tax::VARCHAR END AS cells, CASE WHEN n = 4 THEN tax::VARCHAR ELSE '' END AS unbinned FROM b),
      x AS (SELECT * FROM a UNION ALL SELECT DISTINCT doc_id, 0, k + j, 'Note', '-|-|-', '' FROM b, (VALUES (1), (2)) AS v(j) UNION ALL SELECT doc_id, 1, k + 3 + n, 'Sum', n || '|' || n || '.50', '' FROM b)
      SELECT * FROM x""",
    "read_tables_pinned": f"""{BANDS} SELECT doc_id, CAST(0 AS INT) AS band, max(k) + 2 AS n, max(k) AS c0, max(k) AS c1, CAST(CASE WHEN max(k) >= 4 THEN 1 ELSE 0 END AS BIGINT) AS c2, CAST(max(k) - CASE WHEN max(k) >= 4 THEN 1 ELSE 0 END AS BIGINT) AS stray FROM b GROUP BY 1
      UNION ALL SELECT doc_id, 1, max(k), 0, 0, 0, max(k) FROM b GROUP BY 1""",
    "table_regions": f"""{BANDS} SELECT doc_id, CAST(0 AS INT) AS band, max(k) + 2 AS rows, CAST(1 AS BIGINT) AS first FROM b GROUP BY 1 UNION ALL SELECT doc_id, 1, max(k), max(k) + 4 FROM b GROUP BY 1""",
    "text_columns": f"""WITH {LINES}, t AS (SELECT doc_id, CASE WHEN n % 4 = 3 THEN 201.5 ELSE 200.0 END AS x FROM l UNION ALL SELECT doc_id, 203.0 FROM l WHERE n % 4 = 3)
      SELECT doc_id, CAST(0 AS INT) AS col, round(avg(x::DOUBLE), 4) AS x0, count(*) AS n, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM t GROUP BY 1 HAVING count(*) >= 3""",
    "bin_text": f"""WITH {LINES}, k AS (SELECT doc_id, count(*) + count(*) FILTER (n % 4 = 3) >= 3 AS has FROM l GROUP BY 1)
      SELECT doc_id, CAST(n AS INT) AS row_id, 59.0::DOUBLE AS x0, 'Tenant' AS text, CAST(NULL AS INT) AS col FROM l
      UNION ALL SELECT doc_id, n, CASE WHEN n % 4 = 3 THEN 201.5 ELSE 200 END, CASE WHEN n % 4 = 3 THEN 'BRT' ELSE 'ABA' END, CASE WHEN has THEN 0 END FROM l JOIN k USING (doc_id)
      UNION ALL SELECT doc_id, n, 203, 'extra', NULL FROM l WHERE n % 4 = 3""",
    "notice_fields": """WITH o AS (SELECT o_orderkey AS d, o_orderkey % 3 AS v, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS a, CAST(o_custkey % 900 + 100 AS VARCHAR) AS b FROM orders)
      SELECT d AS doc_id, 'Provider name' AS field, CASE v WHEN 0 THEN 'Metro Light & Power' WHEN 1 THEN 'Harbor Water Company' ELSE '' END AS value, CASE WHEN v = 2 THEN 'none' ELSE 'guess' END AS verdict,
        CASE WHEN v = 2 THEN '' ELSE 'no label, reads as an organisation''s name' END AS where_found FROM o
      UNION ALL SELECT d, 'Ending balance', a || '.20', 'yes', 'under the Balance column' FROM o
      UNION ALL SELECT d, 'Due date', CASE WHEN v = 2 THEN '10/06/2026' ELSE '09/05/2026' END, 'yes', CASE WHEN v = 2 THEN 'under the heading' ELSE 'line below' END FROM o""",
    "graded_own_labels": """WITH o AS (SELECT o_orderkey AS d, o_orderkey % 4 AS v, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS a, CAST(o_custkey + 1000 AS VARCHAR) AS b, strftime(o_orderdate, '%m/%d/%Y') AS dt FROM orders),
      f AS (
        SELECT d, 'Closing date' AS field, CASE WHEN v = 3 THEN 'see below' ELSE dt END AS value, CASE WHEN v = 3 THEN 'check' ELSE 'yes' END AS verdict, 'closing date' AS l, 'beside the label' AS w, CASE WHEN v = 3 THEN 'Closing date: see below' ELSE 'Closing date ' || dt END AS e FROM o
        UNION ALL SELECT d, 'Loan amount', CASE WHEN v = 1 THEN '$' || a || '.75' ELSE '$' || a || '.50' END, 'yes', 'loan amount', CASE WHEN v = 1 THEN 'below the label' ELSE 'beside the label' END, CASE WHEN v = 1 THEN 'Loan amount' ELSE 'Loan amount $' || a || '.50' END FROM o
        UNION ALL SELECT d, 'parcel_id', '12-' || b, 'yes', 'parcel number', 'beside the label', 'Parcel Number: 12-' || b FROM o
        UNION ALL SELECT d, 'Deal reference', CASE WHEN v = 2 THEN 'D ' || b ELSE 'X' || a END, 'yes', CASE WHEN v = 2 THEN 'dossier no' ELSE 'our ref' END, 'beside the label', CASE WHEN v = 2 THEN 'Dossier-No' || chr(9) || 'D ' || b ELSE 'OUR REF (internal): X' || a END FROM o
        UNION ALL SELECT d, 'Premium rate', CASE WHEN v = 2 THEN '' ELSE '4.' || a || '%' END, CASE WHEN v = 2 THEN 'none' ELSE 'yes' END, CASE WHEN v = 2 THEN '' ELSE 'premium rate' END, CASE WHEN v = 2 THEN '' ELSE 'same row, 1 cell(s) right' END,
          CASE WHEN v = 2 THEN '' ELSE 'Premium rate' || chr(9) || 'Premium rate' || chr(9) || '4.' || a || '%' END FROM o
        UNION ALL SELECT d, 'Insurance number', '', 'none', '', '', '' FROM o)
      SELECT d AS doc_id, CAST(1 AS INT) AS page, field, value, verdict, l AS matched_label, w AS where_found, e AS evidence FROM f""",
    "stable_column_count": r"""WITH st AS MATERIALIZED (""" + STATEMENT_TOKENS + r"""), e AS (SELECT doc_id, x1 + top % 5 AS x FROM st WHERE text <> 'Item'),
      t AS (SELECT doc_id, x, tol FROM e, (SELECT unnest(range(4, 48, 2)) AS tol)), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, tol ORDER BY x) <= tol THEN 0 ELSE 1 END AS new FROM t),
      c AS (SELECT doc_id, tol, CAST(sum(new) AS INT) AS columns FROM g GROUP BY 1, 2 HAVING count(*) >= 4), h AS (SELECT doc_id, columns, count(*) AS n, min(tol) AS first FROM c GROUP BY 1, 2)
      SELECT doc_id, CAST(1 AS INT) AS page, columns, n AS most, CAST(22 AS INT) AS tried, round(n / 22.0::DOUBLE, 6) AS confidence FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY columns >= 2 DESC, n DESC, first) = 1""",
    "match_recipe": f"""{ROWS}, t AS MATERIALIZED (SELECT doc_id, row_id, string_agg(text, ' ' ORDER BY x0, text) AS text FROM r GROUP BY 1, 2),
      h AS MATERIALIZED (SELECT DISTINCT doc_id, substr(sha1(regexp_replace(lower(text), '[0-9]+', '#', 'g')), 1, 12) AS h, min(row_id) OVER (PARTITION BY doc_id, substr(sha1(regexp_replace(lower(text), '[0-9]+', '#', 'g')), 1, 12)) AS first FROM t WHERE row_id <= 8),
      sg AS (SELECT doc_id, list(h ORDER BY first) AS sig, count(*) AS na FROM h GROUP BY 1), rc AS (SELECT sig, min(doc_id) AS ord, any_value(na) AS nb FROM sg GROUP BY 1 HAVING count(*) > 1),
      sn AS (SELECT sig AS own, na FROM (SELECT DISTINCT sig, na FROM sg)), bs AS (SELECT own, rc.ord, len(list_intersect(own, rc.sig)) / (na + nb - len(list_intersect(own, rc.sig))) AS score FROM sn, rc),
      k AS (SELECT own, ord, score FROM bs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, ord) = 1)
      SELECT doc_id, CASE WHEN score >= 0.6 THEN 'recipe-' || ord END AS slug, round(coalesce(score, 0)::DOUBLE, 6) AS score FROM sg LEFT JOIN k ON sg.sig = k.own""",
    "export_rows": f"{GRADED} SELECT doc_id, page, field, CASE WHEN value <> '' THEN value END AS value, CASE WHEN verdict = 'yes' THEN 'high' ELSE 'low' END AS confidence FROM g",
    "type_from_found_fields": f"{GRADED} SELECT DISTINCT doc_id, 'statement' AS doc_type FROM g WHERE field = 'Account number' AND verdict <> 'none'",
    "approval_state": f"""{GRADED} SELECT doc_id, count(*) AS need, count(*) FILTER (doc_id % 4 = 0 AND value <> '') AS done,
        count(*) FILTER (doc_id % 4 = 0 AND value <> '') = count(*) AS complete FROM g GROUP BY doc_id""",
}
