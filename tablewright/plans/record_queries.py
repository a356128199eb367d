"""Queries of records, reconciliation and mapping over rows derived from orders and lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import checks, mapping, records
from tablewright.sources.derived import LINES, REPORT_ROWS, STATEMENT_LINES, derived, report_rows, statement_lines, table

IT = f"WITH {LINES}"


def items(spark, sf, columns: str):
    return derived(spark, sf, f"with {LINES} select doc_id, 1 as page, n, cast(n as double) as y, {columns} from l")


# Records of three lines: a head, then two lines that repeat the first column and one that fills the second.
FILLED = "case when n % 3 = 1 and doc_id % 2 = 0 then null else cast(amt as string) end"


def record_lines(spark, sf):
    own = items(spark, sf, f"cast((n + 2) div 3 as bigint) as record_id, case when n % 3 = 1 then 'head' else 'continuation' end as kind, 'Item ' || cast(n as string) as label, array(cast(q as string), {FILLED}, case when n % 3 = 2 then cast(tax as string) end) as values")
    return own.drop("n")


def series_columns(spark, sf):
    return records.series_columns(record_lines(spark, sf)).withColumn("col", F.col("col").cast("int"))


def flatten(spark, sf):
    out = records.flatten_records(record_lines(spark, sf), [0])
    joined = F.array_join("values", "|", "-")
    return out.select("doc_id", "record_id", "label", "n_steps", joined.alias("line"))


def classified(spark, sf):
    return records.classify_by_recipe(report_rows(spark, sf), ["SECTION "], ["Total N"], ["Total "], 1)


def classify(spark, sf):
    return classified(spark, sf).select("doc_id", "y", "label", "kind")


def attach(spark, sf):
    own = items(spark, sf, "'Item ' || cast(n as string) as label, array(cast(q as string), cast(amt as string)) as values, case n % 4 when 1 then 'data' when 0 then 'subtotal' else 'other' end as kind")
    return records.attach_series(own).select("doc_id", "record_id", "role", "label")


def rejoin(spark, sf):
    whole = "cast(cast(floor(amt / 1000) as bigint) as string)"
    tail = "',' || lpad(cast(amt - floor(amt / 1000) * 1000 as string), 6, '0')"
    own = items(spark, sf, f"{whole} as a, {tail} as b")
    parts = own.select("doc_id", "page", F.col("y").alias("top"), F.explode(F.array(F.struct(F.col("a").alias("text"), F.lit(10.0).alias("x0"), F.lit(40.0).alias("x1")), F.struct(F.col("b").alias("text"), (50.0 + (F.col("n") % 2) * 40).alias("x0"), F.lit(120.0).alias("x1")))).alias("t"))
    return records.rejoin_split_amounts(parts.select("doc_id", "page", "top", "t.*"))


def printed_totals(spark, sf):
    rows = report_rows(spark, sf)
    data = records.section_carry(rows, "SECTION ").filter("x0 = 59")
    printed = rows.filter("x0 = 68").withColumn("section", F.element_at(F.split("label", " "), -1))
    out = checks.printed_section_totals(data, printed)
    return out.select("doc_id", "section", F.col("col").cast("int").alias("col"), "expected", F.col("got").cast("decimal(28,4)").alias("got"), "n", "ok")


def variance(spark, sf):
    third = "cast(q - amt + case when n % 3 = 0 then 1 else 0 end as decimal(18,2))"
    return checks.variance_tie_out(items(spark, sf, f"array(cast(q as string), cast(amt as string), cast({third} as string), cast(tax as string)) as values"))


def report(spark, sf):
    pages = items(spark, sf, "1").select("doc_id", F.col("n").alias("page"), F.lit(1).alias("tables"), F.when(F.col("doc_id") % 4 == 0, 0.25).otherwise(0.75).alias("confidence"))
    return checks.document_report(pages, items(spark, sf, "n <> 3 as ok"))


def aging(spark, sf):
    rows = items(spark, sf, "array(cast(q as string), null, cast(tax as string)) as buckets, cast(q + tax + case when n = 2 then 1 else 0 end as string) as amount").withColumnRenamed("n", "row_no")
    printed = derived(spark, sf, f"with {LINES} select doc_id, cast(sum(q + tax) as string) as total from l group by doc_id")
    return checks.aging_buckets(rows, printed)


def grounded(spark, sf):
    lines = statement_lines(spark, sf)
    source = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    pairs = {"amount": "cast(amt + case when doc_id % 5 = 0 then 7000 else 0 end as string)", "title": "case when doc_id % 2 = 0 then 'Account Holder & Statement' else 'Lease, Roll' end"}
    own = items(spark, sf, ", ".join(f"{sql} as {name}" for name, sql in pairs.items()))
    return checks.ground_by_parts(own.select("doc_id", F.explode(F.array(*[F.struct(F.concat(F.lit(p), F.col("n").cast("string")).alias("field"), F.col(p).alias("value")) for p in pairs])).alias("v")).select("doc_id", "v.*"), source)


def required(spark, sf):
    own = items(spark, sf, "case n % 3 when 0 then 'Total' when 1 then 'Date' else 'Note' end as column, case when n % 2 = 0 then cast(q as string) end as value, q > 25 as matched").withColumnRenamed("n", "row_no")
    return checks.required_fields(own, ["Total"], free_layout=True)


def passes(spark, sf):
    own = items(spark, sf, "cast(q as bigint) % 3 as problems, tax as total, l_returnflag as account").withColumn("page", F.ceil(F.col("n") / 3).cast("int")).withColumn("n", F.col("n") - 3 * (F.col("page") - 1)).withColumnRenamed("n", "pass")
    return checks.multi_pass_pick(own.drop("y"), ["total", "account"])


def shadows(spark, sf):
    rows = items(spark, sf, "'Item ' || cast(n as string) as label, array(cast(q as string), case when n % 2 = 0 then cast(tax as string) end) as values")
    tokens = items(spark, sf, "1").select("doc_id", "page", "y", F.explode(F.array(F.struct(F.lit("Item").alias("text"), F.lit(79.0).alias("x1")), F.struct(F.col("n").cast("string").alias("text"), (95.0 + F.col("n")).alias("x1")))).alias("t"))
    return checks.shadow_flags(rows, tokens.select("doc_id", "page", "y", "t.*"), 1, 70.0, 98.0)


def errors(spark, sf):
    own = items(spark, sf, "case when n = 2 then '#REF!' when n = 3 then '#N/A' when n = 4 then 'see #REF!' else cast(q as string) end as value, 0 as col")
    return checks.cell_error_audit(own.withColumnRenamed("n", "row_no"))


def profiles(spark, sf):
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("producer"), F.concat_ws("\n", F.col("o_orderpriority"), F.lit(" "), F.lit("Statement, of Account!"), (F.col("o_custkey") % 3).cast("string"), F.lit("fifth")).alias("text"))
    return mapping.source_profile(own).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def units(spark, sf):
    key = F.col("o_orderkey")
    own = table(spark, sf, "orders").select(key.alias("doc_id"), F.when(key % 3 > 0, F.concat(F.lit("A-"), (key % 50).cast("string"))).alias("folder_suite"), F.when(key % 4 > 0, F.concat(F.lit("a"), ((key + F.when(key % 5 == 0, 1).otherwise(0)) % 50).cast("string"))).alias("suite"))
    return mapping.unit_crosscheck(own)


CELLS = [("price", "B2", True), ("status", "B3", False), ("date", "B4", True), ("clerk", "B5", False)]


def fill_plan(spark, sf):
    own = items(spark, sf, "case when doc_id % 2 = 0 then '($' || cast(amt as string) || ')' else '+ ' || cast(amt as string) end as price, l_returnflag as status, '08/31/2026' as date").withColumn("doc_id", F.col("doc_id") * 100 + F.col("n"))
    values = own.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("price", "status", "date")])).alias("v")).select("doc_id", "v.*")
    return mapping.template_fill_plan(values, CELLS)


def sections(spark, sf):
    own = table(spark, sf, "orders").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Lease Start", "Renewal term", "DBA name", "Pro Rata share", "Guarantor")]), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(" "), F.col("o_orderpriority")).alias("name"))
    return mapping.field_sections(own).groupBy("name", "section_no", "section").agg(F.count(F.lit(1)).alias("n"))


def fractions(spark, sf):
    blocks = items(spark, sf, "cast(q as double) as x0, cast(n * 8 as double) as y0, cast(q + 64 as double) as x1, cast(n * 8 + 8 as double) as y1").drop("y").withColumnRenamed("n", "block")
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(512).alias("sent_w"), F.lit(512).alias("sent_h"), F.lit(256).alias("layout_w"), F.lit(512).alias("layout_h"), F.lit(16).alias("crop_x"), F.lit(32).alias("crop_y"), F.lit(1024).alias("full_w"), F.lit(1024).alias("full_h")).distinct()
    return mapping.blocks_to_page_fractions(blocks, pages)


def boxes(spark, sf):
    own = items(spark, sf, "'f' || cast(n as string) as field, cast(n % 2 as double) as x0, 0.0D as y0, 1.0D as x1, 1.0D as y1")
    return mapping.collapse_same_box(own)


def words(spark, sf):
    own = items(spark, sf, "'w' || cast(n as string) as t, cast(n * 4 as double) as x, cast(q as double) as w, 16.0D as h")
    return mapping.ocr_words_to_tokens(own.withColumn("y", F.col("n") * 8.0), scale=4.0)


QUERIES = {
    "series_columns": series_columns, "flatten_records": flatten, "classify_by_recipe": classify, "attach_series": attach, "rejoin_split_amounts": rejoin,
    "printed_section_totals": printed_totals, "variance_tie_out": variance, "document_report": report, "aging_buckets": aging, "ground_by_parts": grounded,
    "required_fields": required, "multi_pass_pick": passes, "shadow_flags": shadows, "cell_error_audit": errors, "source_profile": profiles,
    "unit_crosscheck": units, "template_fill_plan": fill_plan, "field_sections": sections, "blocks_to_page_fractions": fractions,
    "collapse_same_box": boxes, "ocr_words_to_tokens": words,
}

RECS = f"""{IT}, r AS (SELECT doc_id, (n + 2) // 3 AS record_id, n, n % 3 = 1 AS head, CAST(q AS VARCHAR) AS c0, CASE WHEN n % 3 = 1 AND doc_id % 2 = 0 THEN NULL ELSE CAST(amt AS VARCHAR) END AS c1,
  CASE WHEN n % 3 = 2 THEN CAST(tax AS VARCHAR) END AS c2 FROM l)"""
RR = f"WITH rr AS ({REPORT_ROWS})"
ORACLES = {
    "series_columns": f"""{RECS}, b AS (SELECT doc_id, record_id, count(*) AS n, count(c0) AS g0, count(c1) AS g1, count(c2) AS g2 FROM r WHERE NOT head GROUP BY 1, 2 HAVING count(*) >= 2),
      s AS (SELECT doc_id, count(*) AS seen FROM b GROUP BY 1),
      c AS (SELECT doc_id, n, 0 AS col, g0 AS got FROM b UNION ALL SELECT doc_id, n, 1, g1 FROM b UNION ALL SELECT doc_id, n, 2, g2 FROM b)
      SELECT doc_id, CAST(col AS INT) AS col, count(*) AS records FROM c JOIN s USING (doc_id) WHERE got >= 2 AND got >= 0.6 * n AND seen >= 2 GROUP BY doc_id, col, seen HAVING count(*) >= 2 AND count(*) >= 0.6 * seen""",
    "flatten_records": f"""{RECS}, g AS (SELECT doc_id, record_id, 'Item ' || min(n) AS label, count(*) AS k, string_agg(c0, '|' ORDER BY n) AS steps, coalesce(arg_min(c1, n) FILTER (c1 IS NOT NULL), '-') AS f1, coalesce(arg_min(c2, n) FILTER (c2 IS NOT NULL), '-') AS f2 FROM r GROUP BY 1, 2)
      SELECT doc_id, record_id, label, CAST(k AS INT) AS n_steps, f1 || '|' || f2 || '|' || steps || repeat('|-', CAST(max(k) OVER (PARTITION BY doc_id) - k AS INT)) AS line FROM g""",
    "classify_by_recipe": f"""{RR} SELECT doc_id, y, label, CASE WHEN x0 = 53 THEN 'section' WHEN label = 'Total N' THEN 'summary' WHEN x0 = 68 THEN 'subtotal' WHEN v1 IS NULL THEN 'other' ELSE 'data' END AS kind FROM rr""",
    "attach_series": f"""{IT} SELECT doc_id, (n + 3) // 4 AS record_id, CASE n % 4 WHEN 1 THEN 'head' WHEN 0 THEN 'subtotal' ELSE 'line' END AS role, 'Item ' || n AS label FROM l""",
    "rejoin_split_amounts": f"""{IT}, a AS (SELECT doc_id, n, CAST(CAST(floor(amt / 1000) AS BIGINT) AS VARCHAR) AS a, ',' || lpad(CAST(CAST(amt % 1000 AS DECIMAL(18,2)) AS VARCHAR), 6, '0') AS b FROM l)
      SELECT doc_id, CAST(1 AS INT) AS page, a || b AS text, CAST(10 AS DOUBLE) AS x0, CAST(120 AS DOUBLE) AS x1, CAST(n AS DOUBLE) AS top FROM a WHERE n % 2 = 0
      UNION ALL SELECT doc_id, 1, a, 10, 40, n FROM a WHERE n % 2 = 1 UNION ALL SELECT doc_id, 1, b, 90, 120, n FROM a WHERE n % 2 = 1""",
    "printed_section_totals": f"""{IT}, s AS (SELECT doc_id, l_returnflag AS section, row_number() OVER (PARTITION BY doc_id ORDER BY l_returnflag) AS sec, sum(q) AS q, sum(amt) AS amt, count(*) AS n FROM l GROUP BY 1, 2)
      SELECT doc_id, section, CAST(0 AS INT) AS col, CAST(q AS DECIMAL(18,4)) AS expected, CAST(q AS DECIMAL(28,4)) AS got, n, true AS ok FROM s
      UNION ALL SELECT doc_id, section, 1, CAST(amt + CASE WHEN doc_id % 7 = 0 AND sec = 1 THEN 1 ELSE 0 END AS DECIMAL(18,4)), CAST(amt AS DECIMAL(28,4)), n, NOT (doc_id % 7 = 0 AND sec = 1) FROM s""",
    "variance_tie_out": f"""{IT}, c AS (SELECT doc_id, CAST(0 AS INT) AS first_col, count(*) FILTER (n % 3 <> 0) AS ok, count(*) AS checked FROM l GROUP BY 1
      UNION ALL SELECT doc_id, 1, count(*) FILTER (abs(amt - (q - amt + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) - tax) < 0.02), count(*) FROM l GROUP BY 1)
      SELECT doc_id, first_col, ok, checked FROM c WHERE checked >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ok DESC, first_col) = 1 AND 2 * ok >= checked""",
    "document_report": f"""{IT}, d AS (SELECT doc_id, count(*) AS pages, count(*) AS tables, CASE WHEN doc_id % 4 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS confidence, count(*) FILTER (n <> 3) AS ok, count(*) AS total FROM l GROUP BY doc_id)
      SELECT *, CASE WHEN ok * 100 < total * 95 OR confidence < 0.4 THEN 'CHECK' ELSE 'OK' END AS status FROM d""",
    "aging_buckets": f"""{IT} SELECT doc_id, n AS row_no, 'line' AS "check", CAST(q + tax + CASE WHEN n = 2 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS expected, CAST(q + tax AS DECIMAL(38,4)) AS got, n <> 2 AS ok FROM l
      UNION ALL SELECT doc_id, NULL, 'document', CAST(sum(q + tax) AS DECIMAL(18,4)), CAST(sum(q + tax) + count(*) FILTER (n = 2) AS DECIMAL(38,4)), count(*) FILTER (n = 2) = 0 FROM l GROUP BY doc_id""",
    "ground_by_parts": f"""WITH sl AS ({STATEMENT_LINES}), t AS (SELECT doc_id, regexp_replace(string_agg(text, '' ORDER BY line_no), '[^0-9]', '', 'g') AS d FROM sl GROUP BY 1),
      {LINES}, v AS (SELECT doc_id, 'amount' || n AS field, CAST(amt + CASE WHEN doc_id % 5 = 0 THEN 7000 ELSE 0 END AS VARCHAR) AS value FROM l
      UNION ALL SELECT doc_id, 'title' || n, CASE WHEN doc_id % 2 = 0 THEN 'Account Holder & Statement' ELSE 'Lease, Roll' END FROM l)
      SELECT doc_id, field, value, coalesce(CASE WHEN field LIKE 'amount%' THEN contains(d, regexp_replace(value, '[^0-9]', '', 'g')) ELSE d IS NOT NULL AND doc_id % 2 = 0 END, false) AS ok FROM v LEFT JOIN t USING (doc_id)""",
    "required_fields": f"""{IT}, c AS (SELECT doc_id, n AS row_no, CASE n % 3 WHEN 0 THEN 'Total' WHEN 1 THEN 'Date' ELSE 'Note' END AS "column", CASE WHEN n % 2 = 0 THEN CAST(q AS VARCHAR) END AS value, q FROM l)
      SELECT doc_id, row_no, "column", value, CASE WHEN value IS NOT NULL OR "column" = 'Total' THEN 'Blocking' ELSE 'Warning' END AS severity FROM c WHERE value IS NULL OR q <= 25""",
    "multi_pass_pick": f"""{IT}, p AS (SELECT doc_id, CAST(ceil(n / 3.0) AS INT) AS page, n - 3 * CAST(ceil(n / 3.0) - 1 AS BIGINT) AS n, CAST(q AS BIGINT) % 3 AS problems, tax, l_returnflag AS f FROM l),
      b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY problems, n) = 1),
      o AS (SELECT p.* FROM p JOIN b USING (doc_id, page) WHERE p.n <> b.n QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY p.n) = 1)
      SELECT b.doc_id, b.page, b.n AS pass, b.problems, CASE WHEN b.problems = 0 AND o.problems = 0 THEN concat_ws(', ', CASE WHEN b.tax <> o.tax THEN 'total' END, CASE WHEN b.f <> o.f THEN 'account' END) ELSE '' END AS differ FROM b LEFT JOIN o USING (doc_id, page)""",
    "shadow_flags": f"""{IT} SELECT doc_id, CAST(1 AS INT) AS page, CAST(n AS DOUBLE) AS y, 'Item ' || n AS label, 'Item' || CASE WHEN n <= 3 THEN ' ' || n ELSE '' END AS detail FROM l WHERE n % 2 = 1""",
    "cell_error_audit": f"{IT} SELECT doc_id, n AS row_no, CAST(0 AS INT) AS col, CASE n WHEN 2 THEN '#REF!' ELSE '#N/A' END AS value FROM l WHERE n IN (2, 3)",
    "source_profile": """WITH p AS (SELECT o_orderkey AS k, lower(o_orderstatus) || '|' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9 ]+', ' ', 'g')) || ' statement of account ' || o_custkey % 3 AS profile FROM orders)
      SELECT profile, count(*) AS n, min(k) AS first_doc FROM p GROUP BY 1""",
    "unit_crosscheck": """WITH u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN 'A-' || o_orderkey % 50 END AS f, CASE WHEN o_orderkey % 4 > 0 THEN 'a' || (o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 50 END AS s FROM orders)
      SELECT k AS doc_id, coalesce(s, f, '') AS suite, CASE WHEN f IS NOT NULL AND s IS NULL THEN 'taken from the folder' WHEN f IS NOT NULL AND k % 5 = 0 THEN 'folder and documents differ' END AS flag FROM u""",
    "template_fill_plan": f"""{IT}, o AS (SELECT doc_id * 100 + n AS doc_id, doc_id % 2 AS odd, amt, l_returnflag FROM l)
      SELECT doc_id, 'price' AS field, 'B2' AS cell, CAST(CAST(CASE WHEN odd = 0 THEN -amt ELSE amt END AS DECIMAL(18,4)) AS VARCHAR) AS written, NULL AS why FROM o
      UNION ALL SELECT doc_id, 'status', 'B3', l_returnflag, NULL FROM o UNION ALL SELECT doc_id, 'date', 'B4', NULL, 'not cleanly a number' FROM o UNION ALL SELECT doc_id, 'clerk', 'B5', NULL, 'not found' FROM o""",
    "field_sections": """WITH c AS (SELECT o_orderkey % 5 AS k, o_orderpriority AS p FROM orders)
      SELECT ['Lease Start', 'Renewal term', 'DBA name', 'Pro Rata share', 'Guarantor'][k + 1] || ' ' || p AS name, CAST([1, 6, 0, 4, 8][k + 1] AS INT) AS section_no,
      ['term_dates', 'renewal', 'identity', 'reimbursement', 'other'][k + 1] AS section, count(*) AS n FROM c GROUP BY k, p""",
    "blocks_to_page_fractions": f"""{IT} SELECT doc_id, CAST(1 AS INT) AS page, n AS block, round((CAST(q AS DOUBLE) * 2 + 16) / 1024, 5) AS x0, round((n * 8 + 32) / 1024, 5) AS y0, round((CAST(q + 64 AS DOUBLE) * 2 + 16) / 1024, 5) AS x1, round((n * 8 + 40) / 1024, 5) AS y1
      FROM l JOIN (SELECT DISTINCT o_orderkey FROM orders) ON doc_id = o_orderkey""",
    "collapse_same_box": f"""{IT} SELECT doc_id, CAST(1 AS INT) AS page, CAST(n % 2 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(1 AS DOUBLE) AS x1, CAST(1 AS DOUBLE) AS y1, string_agg('f' || n, ', ' ORDER BY 'f' || n) AS fields, count(*) AS n FROM l GROUP BY doc_id, n % 2""",
    "ocr_words_to_tokens": f"""{IT} SELECT doc_id, CAST(1 AS INT) AS page, 'w' || n AS text, CAST(n AS DOUBLE) AS x0, round((n * 4 + CAST(q AS DOUBLE)) / 4, 1) AS x1, CAST(n * 2 AS DOUBLE) AS top, CAST(n * 2 + 4 AS DOUBLE) AS bottom, 'ocr' AS source FROM l""",
}
