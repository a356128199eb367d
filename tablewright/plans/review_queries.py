"""Queries of review: values located on pages, replies, answers, utility totals and titles, over tables derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import review
from tablewright.sources.derived import LINES, derived, table

IT = f"WITH {LINES}"


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("v"), (F.col("o_custkey") % 900 + 1000).cast("string").alias("a"))


def printed(spark, sf):
    value = F.when(F.col("v") == 0, F.concat(F.lit("$"), F.col("a"), F.lit(".10  DUE BY 10/26"))).when(F.col("v") == 1, "ab cd").when(F.col("v") == 2, " : ").otherwise(F.concat(F.lit("No "), F.col("a")))
    return review.expand_values(orders(spark, sf).select("doc_id", F.lit("f").alias("field"), value.alias("value"))).drop("field", "value")


def figures(spark, sf):
    value = F.when(F.col("v") == 0, F.concat(F.lit("**$"), F.col("a"), F.lit(".50**"))).when(F.col("v") == 1, "12  %").when(F.col("v") == 2, "7.5%").when(F.col("v") == 3, "the net operating income").otherwise("1,234")
    return review.expand_values(orders(spark, sf).select("doc_id", F.lit("f").alias("field"), value.alias("value")), figures=True).drop("field", "value")


def replies(spark, sf):
    a, fence = F.col("a"), "```"
    reply = (
        F.when(F.col("v") == 0, F.concat(F.lit(f'{fence}json\n[{{"Item": "x", "Amount": '), a, F.lit(f'.50}}, 5, {{"Item": null}}]\n{fence}')))
        .when(F.col("v") == 1, F.concat(F.lit('{"Item": "old", "Item": "'), a, F.lit('"}')))
        .when(F.col("v") == 2, F.concat(F.lit('Here are the rows: [{"Item": "'), a, F.lit('"}] as asked.')))
        .when(F.col("v") == 3, F.concat(F.lit("The total is **"), a, F.lit("**.")))
        .when(F.col("v") == 4, '{"Item": "x"} trailing [1, 2]')
    )
    out = review.parse_replies(orders(spark, sf).select("doc_id", reply.alias("reply")))
    cells = F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("doc_id", "row_no", F.coalesce(cells, F.lit("")).alias("cells"), "error")


def answers(spark, sf):
    """Folders of an order's lines as files: one reply for each, some files unread, all of them in some."""
    own = derived(spark, sf, f"with {LINES} select doc_id as grp, n, case when n % 3 = 0 or doc_id % 7 = 0 then 'needs OCR' end as why from l")
    file = F.concat(F.lit("f"), F.lpad(F.col("n").cast("string"), 2, "0"))
    groups = own.groupBy("grp").agg(F.count(F.lit(1)).alias("files"))
    made = groups.filter("grp % 5 > 0").select("grp", F.create_map(F.lit("rent"), F.col("grp").cast("string"), F.lit("term"), F.when(F.col("grp") % 2 == 0, "null").otherwise("10"), F.lit("_notes"), F.lit("n")).alias("cells"), F.when(F.col("grp") % 11 == 0, "reply was not JSON").alias("error"))
    made = made.withColumn("cells", F.when(F.col("error").isNull(), F.col("cells")))
    shown = own.filter("why IS NULL").select("grp", F.col("n").alias("ord"), file.alias("file"), F.lit("part 1-2").alias("label"))
    return review.answer_rows(groups, made, shown, own.filter("why IS NOT NULL").select("grp", file.alias("file"), "why"), ["rent", "term"])


def utilities(spark, sf):
    own = orders(spark, sf)
    field = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    fields = F.array(
        field("total_utilities", F.concat(F.lit("TOTAL $"), F.col("a"), F.lit(".28 DUE BY 09/26"))), field("taxes", F.lit("(5.71)")), field("billing_date", F.when(F.col("v") != 4, "09/05/2026")),
        field("total_gas_bill", F.when(F.col("v") == 3, "USD 55.10")),
    )
    rows = own.select("doc_id", F.lit(1).alias("page"), F.explode(fields).alias("f")).select("doc_id", "page", "f.*")
    text = F.when(F.col("v") == 0, "Usage 812 <b>kWh</b> of electric power").when(F.col("v") == 1, "Water and sewer, 900 gallons").when(F.col("v") == 2, "internet and phone").when(F.col("v") == 5, "thank you").otherwise("Refuse collection")
    return review.utility_page_totals(rows, own.select("doc_id", F.lit(1).alias("page"), text.alias("text"))).drop("page")


def blocks(spark, sf):
    """Four blocks of a page: a label, its value to the right, the same value far above, and the value with more text."""
    own = orders(spark, sf)
    box = lambda n, t, x, y: F.struct(F.lit(n).alias("block"), t.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 0.1).alias("x1"), F.lit(y + 0.02).alias("y1"))
    value = F.concat(F.lit("$"), F.col("a"), F.lit(".00"))
    made = F.array(box(0, value, 0.5, 0.05), box(1, F.when(F.col("v") == 1, "other").otherwise("Amount Due:"), 0.1, 0.5), box(2, F.when(F.col("v") != 2, value).otherwise("none"), 0.3, 0.5), box(3, F.concat(F.lit("paid "), value, F.lit(" in May")), 0.1, 0.9))
    return own.select("doc_id", F.lit(1).alias("page"), F.explode(made).alias("b")).select("doc_id", "page", "b.*")


def located(spark, sf):
    asked = orders(spark, sf).select("doc_id", F.lit(1).alias("page"), F.lit("due").alias("field"), F.when(F.col("v") == 3, "nowhere at all").otherwise(F.concat(F.lit("$"), F.col("a"), F.lit(".00 by May"))).alias("value"), F.lit("amount due").alias("label"))
    return review.locate_values(asked, blocks(spark, sf)).select("doc_id", "field", "block", F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0"))


def figure(spark, sf):
    asked = orders(spark, sf).select("doc_id", F.concat(F.lit("$"), F.col("a"), F.lit(".00")).alias("figure"), F.when(F.col("v") % 2 == 0, "the amount paid in may").otherwise("total").alias("near"))
    return review.locate_figure(asked, blocks(spark, sf)).select("doc_id", "page", "block", "score", "rank")


def outline(spark, sf):
    own = orders(spark, sf)
    box = lambda n, t, x, y: F.struct(F.lit(n).alias("block"), F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 0.1).alias("x1"), F.lit(y + 0.02).alias("y1"))
    made = F.array(box(0, "Item", 0.1, 0.05), box(1, "Item", 0.1, 0.4), box(2, "Amount", 0.6, 0.4), box(3, "9.99", 0.6, 0.02), box(4, "Total", 0.08, 0.7), box(5, "9.99", 0.65, 0.7), box(6, "9.99", 0.6, 0.9))
    placed = own.select("doc_id", F.lit(1).alias("page"), F.explode(made).alias("b")).select("doc_id", "page", "b.*")
    corners = own.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_no"), F.when(F.col("v") == 5, "Missing").otherwise("Item").alias("first"), F.lit("Amount").alias("first_end"), F.lit("Total").alias("last_start"), F.lit("9.99").alias("last"))
    return review.table_outline(corners, placed)


def titles(spark, sf):
    own = orders(spark, sf)
    v = F.col("v")
    history = own.select("doc_id", F.when(v == 0, " The bill ").when(v == 1, "typed").otherwise("").alias("title"), (v == 0).alias("by_model"), F.when((v == 2), "").otherwise(F.concat(F.lit("bill_of-"), F.col("a"), F.lit(".v2.pdf"))).alias("file"), F.when(v != 4, "Utility bill").alias("kind"))
    field = lambda f, x: F.struct(F.lit(f).alias("field"), x.alias("value"))
    made = F.array(field("address", F.when(v == 3, F.concat(F.col("a"), F.lit(" Main St, Springfield"))).when(v == 4, "Address")), field("billing_date", F.when(v == 3, "2026-09-05").when(v == 5, "soon")), field("lease_date", F.when(v == 5, "due 4/30/2025")))
    return review.display_title(history, own.select("doc_id", F.explode(made).alias("f")).select("doc_id", "f.*"))


QUERIES = {
    "expand_values": printed,
    "expand_figures": figures,
    "parse_replies": replies,
    "answer_rows": answers,
    "utility_page_totals": utilities,
    "locate_values": located,
    "locate_figure": figure,
    "table_outline": outline,
    "display_title": titles,
}

O = "WITH o AS (SELECT o_orderkey AS d, o_orderkey % 6 AS v, CAST(o_custkey % 900 + 1000 AS VARCHAR) AS a FROM orders)"  # noqa: E741
ORACLES = {
    "expand_values": f"""{O}, f AS (SELECT d, CASE v WHEN 0 THEN ['$' || a || '.10 DUE BY 10/26', '$' || a || '.10 DUE BY', '$' || a || '.10 DUE', '$' || a || '.10', a || '.10'] WHEN 1 THEN ['ab cd'] WHEN 2 THEN [] ELSE ['No ' || a] END AS fs FROM o)
      SELECT d AS doc_id, CAST(i - 1 AS INT) AS form_no, fs[i] AS form FROM f, unnest(range(1, len(fs) + 1)) AS u(i)""",
    "expand_figures": f"""{O}, f AS (SELECT d, CASE v WHEN 0 THEN ['$' || a || '.50', a || '.50', left(a, 1) || ',' || substr(a, 2) || '.50'] WHEN 1 THEN ['12 %', '12%'] WHEN 2 THEN ['7.5%', '7.5 %'] WHEN 3 THEN ['the net operating income', 'the net operating'] ELSE ['1,234', '1234'] END AS fs FROM o)
      SELECT d AS doc_id, CAST(i - 1 AS INT) AS form_no, fs[i] AS form FROM f, unnest(range(1, len(fs) + 1)) AS u(i)""",
    "parse_replies": f"""{O} SELECT d AS doc_id, CAST(0 AS INT) AS row_no, 'Amount=' || a || '.50;Item=x' AS cells, '' AS error FROM o WHERE v = 0 UNION ALL SELECT d, 1, 'Item', '' FROM o WHERE v = 0
      UNION ALL SELECT d, 0, 'Item=' || a, '' FROM o WHERE v IN (1, 2) UNION ALL SELECT d, NULL, '', 'not readable' FROM o WHERE v IN (3, 5)""",
    "answer_rows": f"""{IT}, g AS (SELECT doc_id AS grp, count(*) AS files, count(*) FILTER (n % 3 = 0 OR doc_id % 7 = 0) AS lost, string_agg('f' || lpad(n::VARCHAR, 2, '0') || ' (needs OCR)', '; ' ORDER BY n) FILTER (n % 3 = 0 OR doc_id % 7 = 0) AS unread,
        list('f' || lpad(n::VARCHAR, 2, '0') || '|part 1-2' ORDER BY n) FILTER (n % 3 <> 0 AND doc_id % 7 <> 0) AS ex FROM l GROUP BY 1),
      s AS (SELECT *, lost = files AS none, grp % 5 > 0 AND grp % 11 <> 0 AS has FROM g)
      SELECT grp, files, CASE WHEN NOT none AND has THEN grp::VARCHAR END AS rent, CASE WHEN NOT none AND has THEN CASE WHEN grp % 2 = 0 THEN 'null' ELSE '10' END END AS term, CAST(NULL AS VARCHAR) AS sources, CASE WHEN NOT none AND has THEN 'n' END AS notes,
        coalesce(array_to_string(ex[1:12], '; '), '') AS excerpts, coalesce(unread, '') AS unread, CAST(CASE WHEN none OR NOT has THEN 0 WHEN grp % 2 = 0 THEN 1 ELSE 2 END AS INT) AS found,
        CASE WHEN none THEN 'nothing readable' WHEN grp % 5 = 0 THEN 'no reply' WHEN grp % 11 = 0 THEN 'reply was not JSON' ELSE '' END AS error FROM s""",
    "utility_page_totals": f"""{O}, k AS (SELECT *, CASE v WHEN 0 THEN 'electricity' WHEN 1 THEN 'water_sewer' WHEN 4 THEN 'trash' END AS kind, CASE WHEN v <> 4 THEN 'billing_date=09/05/2026;' ELSE '' END AS dt FROM o)
      SELECT d AS doc_id, CASE WHEN kind IS NOT NULL THEN dt || CASE kind WHEN 'electricity' THEN 'total_electricity_bill=' || a || '.28;total_utilities=' || a || '.28' WHEN 'water_sewer' THEN 'total_utilities=' || a || '.28;total_water_sewer_bill=' || a || '.28' ELSE 'total_trash_bill=' || a || '.28;total_utilities=' || a || '.28' END
        ELSE dt || 'taxes=-5.71;' || CASE WHEN v = 3 THEN 'total_gas_bill=55.10;' ELSE '' END || 'total_utilities=' || a || '.28' END AS fields, (kind IS NOT NULL OR v = 3) AND v <> 4 AS usable,
        CASE WHEN kind IS NOT NULL THEN 'the total is the bill of ' || kind WHEN v = 2 THEN 'the total covers internet, phone' WHEN v = 5 THEN 'no word says which utility the total is for' ELSE '' END AS note, v = 4 AS undated FROM k""",
    "locate_values": f"""{O} SELECT d AS doc_id, 'due' AS field, CAST(CASE WHEN v = 1 THEN 0 WHEN v = 2 THEN 3 ELSE 2 END AS INT) AS block, CASE WHEN v = 1 THEN 0.5 WHEN v = 2 THEN 0.1 ELSE 0.3 END::DOUBLE AS x0, CASE WHEN v = 1 THEN 0.05 WHEN v = 2 THEN 0.9 ELSE 0.5 END::DOUBLE AS y0 FROM o WHERE v <> 3""",
    "locate_figure": f"""{O}, b AS (SELECT o.*, n, x, y FROM o, (VALUES (0, 0.5, 0.05), (2, 0.3, 0.5), (3, 0.1, 0.9)) AS t(n, x, y) WHERE NOT (v = 2 AND n = 2)),
      s AS (SELECT d, n, CASE WHEN v % 2 = 0 THEN 1 - sqrt(pow(x - 0.1, 2) + pow(y - 0.9, 2)) ELSE -1.5 END AS score FROM b)
      SELECT d AS doc_id, CAST(1 AS INT) AS page, CAST(n AS INT) AS block, round(score, 3)::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY d ORDER BY round(score, 3) DESC, n) AS INT) AS rank FROM s""",
    "table_outline": f"""{O} SELECT d AS doc_id, CAST(1 AS INT) AS page, CAST(0 AS INT) AS table_no, 0.076::DOUBLE AS x0, 0.396::DOUBLE AS y0, 0.754::DOUBLE AS x1, 0.724::DOUBLE AS y1 FROM o WHERE v <> 5""",
    "display_title": f"""{O} SELECT d AS doc_id, CASE v WHEN 0 THEN 'The bill' WHEN 1 THEN 'bill of ' || a || '.v2' WHEN 2 THEN 'Untitled' WHEN 3 THEN 'Utility bill · ' || a || ' Main St · Sep 2026' WHEN 4 THEN 'bill of ' || a || '.v2' ELSE 'Utility bill · Apr 2025' END AS title FROM o""",
}
