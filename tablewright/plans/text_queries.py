"""Queries of retrieval and corpus shape over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import corpus, retrieve
from tablewright.sources.derived import table

ASKED, INSTRUCTION, BARRED = ["thing amount", "nicht total"], "entre mente", ["rights reserved"]


def docs(spark, sf):
    return table(spark, sf, "documents")


def as_pages(spark, sf):
    """A source as one document whose pages are its rows."""
    return docs(spark, sf).select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "text")


def grouped(spark, sf):
    return docs(spark, sf).select(F.col("source").alias("grp"), "doc_id", "text")


def scored(spark, sf):
    chunks = docs(spark, sf).select("doc_id", F.col("text").alias("chunk"))
    return retrieve.score_chunks(chunks, ASKED, INSTRUCTION, BARRED)


def entities(spark, sf):
    """Tenants of each source: their names are words of its texts, and their suites small numbers."""
    names = F.array(*[F.lit(x) for x in ("thing and", "nicht LLC", "entre the")])
    one = docs(spark, sf).select(F.col("source").alias("grp")).distinct()
    rows = one.select("grp", F.posexplode(names).alias("entity", "names"))
    return rows.withColumn("suite", F.concat(F.lit("0"), (F.col("entity") + 1).cast("string")))


def chunked(spark, sf):
    return docs(spark, sf).select(F.col("source").alias("grp"), "doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"))


def second(spark, sf):
    """Groups with fields still missing, the first choice set aside."""
    rated = retrieve.score_chunks(chunked(spark, sf), ASKED)
    missing = rated.filter("doc_id % 3 = 0").select("grp").distinct()
    return retrieve.second_pass(rated, retrieve.select_under_budget(rated, 20000, 1), missing, 20000)


TYPES = [("bill", 0, r"\b(thing|amount)\b", ["Due date", "Total"]), ("lease", 1, r"\b(nicht|landlord)\b", ["Tenant", "Due date"]), ("roll", 2, r"\brent roll\b", ["Suite"])]


def types(spark, sf):
    kinds = spark.createDataFrame(TYPES, "doc_type string, ord int, pattern string, fields array<string>")
    own = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "Rent_Roll.txt").otherwise("file.txt").alias("name"), "text")
    out = retrieve.detect_doc_types(own, kinds)
    return out.select("doc_id", F.array_join("types", ",").alias("types"), F.array_join("fields", ",").alias("fields"), "fallback")


QUESTIONS = [(1, "What is the thing nicht entre pathetic on page 7 or pages 40-42?"), (2, "Which AMOUNT is total? Total.")]
ALLOWANCE = 12000


def ranked(spark, sf):
    """Two questions to every source."""
    pages = as_pages(spark, sf).withColumnRenamed("doc_id", "grp")
    hits = pages.filter("page % 11 = 0").select("grp", "page", F.lit(2).alias("n"))
    questions = pages.select("grp").distinct().join(F.broadcast(spark.createDataFrame(QUESTIONS, "question_id int, question string")))
    return retrieve.keyword_rank(pages, questions, ALLOWANCE, hits)


def bundled(spark, sf):
    files = grouped(spark, sf).select("grp", "doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    return retrieve.capped_bundle(files)


def listing(spark, sf):
    """Paths of files as a scan would list them."""
    key = F.col("o_orderkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("a/b/", "", "node_modules/x/", "c/.git/", "d/__pycache__/", "System Volume Information/")]), (key % 6 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("x.PDF", "y.csv", ".hidden", "~$z.docx", "w.docx", "v.tsv", "u.webp", "t.xml", "s.bmp", "noext", "r.parquet")]), (key % 11 + 1).cast("int"))
    own = table(spark, sf, "orders").select(F.concat(folder, key.cast("string"), F.lit("/"), name).alias("rel"), F.col("o_custkey").alias("size"))
    return corpus.routed(own.withColumn("path", F.concat(F.lit("/root/"), F.col("rel"))), "root")


def report_labels(spark, sf):
    labels = F.array(*[F.lit(x) for x in ("Rent", "Page 3", "Prepared by", "09/05/2026 rent", "10:30 AM run", "Monthly rent", "* note", " ")])
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(labels, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("label"), F.array(F.lit(None).cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string")).otherwise("n/a")).alias("values"))
    return corpus.line_item_filter(own).select("doc_id", "label")


def marked(spark, sf):
    """Transcripts in markup, with what has to go."""
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("<table><tr><td>Total</td> <th class='x'>&#36;"), F.col("o_custkey").cast("string"), F.lit("</th></tr></table>\n<!-- a\nb -->**"), F.col("o_orderpriority"), F.lit("** ![i](u)end<br/>\\nlast &#x41;&amp;lt;&eacute;&copy &notit;&#150;&nosuch;  \n \n")).alias("text"))
    return corpus.normalise_transcripts(own)


def nested(spark, sf):
    """A table in a cell of another, between two pieces of that cell's text."""
    key = F.col("o_orderkey").cast("string")
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("<TABLE><tr><td>a</td><td>b "), F.lit("<table><tr><td>"), key, F.lit("</td><td></td></tr><tr><th>x &#233; y</th></tr></table> c</td></tr><tr><td>d<br>e</td></tr></table> out <table><tr><td>z")).alias("text"))
    return corpus.lift_tables(own)


def budgeted(spark, sf):
    chunks = retrieve.chunk_paragraphs(docs(spark, sf)).join(grouped(spark, sf).select("grp", "doc_id"), "doc_id")
    return retrieve.select_under_budget(retrieve.score_chunks(chunks, ASKED), 40000)


def manifest(spark, sf):
    exts = F.array(*[F.lit(x) for x in ("pdf", "png", "txt", "zip", "tif")])
    ext = F.element_at(exts, (F.col("doc_id") % 5 + 1).cast("int"))
    routes = F.create_map(*[F.lit(x) for x in ("pdf", "pdf", "png", "ocr", "txt", "text", "zip", "unsupported", "tif", "ocr")])
    return docs(spark, sf).select(
        F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("name"), ext.alias("ext"), F.col("source").alias("grp"), routes[ext].alias("route"),
        F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 30).cast("int")).alias("pages"), F.sha1("text").alias("hash"),
    )


MANIFEST = """m AS (SELECT 'file' || doc_id AS name, ['pdf', 'png', 'txt', 'zip', 'tif'][doc_id % 5 + 1] AS ext, source AS grp,
  ['pdf', 'ocr', 'text', 'unsupported', 'ocr'][doc_id % 5 + 1] AS route, n_chars AS size, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 30 AS INT) END AS pages, sha1(text) AS hash FROM documents)"""


def new_files(spark, sf):
    own = manifest(spark, sf)
    return corpus.exclude_processed(own, own.filter("ext = 'zip'").select("hash").distinct()).select("name", "hash")


def transcripts(spark, sf):
    """Two pages of a transcript from the halves of each text."""
    half = F.floor(F.length("text") / 2).cast("int")
    clean = docs(spark, sf).withColumn("text", F.regexp_replace("text", r"[<>\n]", " "))
    text = F.concat(F.lit("lead <!-- [page 1] -->"), F.left("text", half), F.lit("<!-- === [file: a | page 2] === -->"), F.substr("text", half + 1))
    return clean.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(text).alias("text"))


def tables(spark, sf):
    row = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td class='x'>"), x, F.lit("</td>")) for x in c], F.lit("</tr>"))
    own = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"),
        F.concat(F.lit("a <table>"), row(F.lit("Priority"), F.lit("Priority"), F.lit("caf&eacute; &amp;&mdash;")), row(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(" ")), F.lit("</table>")).alias("text"),
    )
    return corpus.lift_tables(own)


def crowded(spark, sf):
    """Cells of tables, some of which hold several figures or nothing."""
    text = F.when((F.col("doc_id") % 3 == 0) & (F.col("col_no") == 0), "1,200\n3.5").when((F.col("doc_id") % 4 == 0) & (F.col("row_no") == 0), " ").otherwise(F.col("text"))
    return tables(spark, sf).withColumn("text", text)


QUERIES = {
    "chunk_paragraphs": lambda s, d: retrieve.chunk_paragraphs(docs(s, d)),
    "score_chunks": lambda s, d: scored(s, d).select("doc_id", "score"),
    "select_under_budget": budgeted,
    "score_pages": lambda s, d: retrieve.score_pages(docs(s, d)).select("doc_id", "score"),
    "top_pages": lambda s, d: retrieve.top_pages(as_pages(s, d).withColumn("score", (F.length("text") % 7 - 2).cast("double"))).select("doc_id", "page", "score"),
    "prefix_budget": lambda s, d: retrieve.prefix_budget(as_pages(s, d), 40000).select("doc_id", "page", "used"),
    "recent_turns": lambda s, d: retrieve.recent_turns(table(s, d, "conversations"), 1500),
    "followup_query": lambda s, d: retrieve.followup_query(table(s, d, "conversations")),
    "capped_bundle": lambda s, d: bundled(s, d).select("grp", "doc_id", F.length("piece").alias("size"), "reason"),
    "bundle_text": lambda s, d: retrieve.bundle_text(bundled(s, d)).select("grp", F.md5("bundle").alias("bundle")),
    "keyword_rank": ranked,
    "question_pages": lambda s, d: retrieve.question_pages(ranked(s, d), ALLOWANCE),
    "search_terms": lambda s, d: retrieve.search_terms(docs(s, d).select(F.col("doc_id").alias("ord"), F.lit("field").alias("kind"), F.left("text", F.lit(300)).alias("phrase"))).select("ord", F.array_join("words", " ").alias("words")),
    "figure_weight": lambda s, d: retrieve.figure_weight(table(s, d, "part").select(F.lit("field").alias("kind"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Rate"))).otherwise(F.col("p_name")).alias("phrase"))),
    "score_for_entity": lambda s, d: retrieve.score_for_entity(retrieve.score_chunks(chunked(s, d), ASKED), entities(s, d)).select("grp", "entity", "doc_id", "score"),
    "second_pass": second,
    "detect_doc_types": types,
    "scan_manifest": listing,
    "line_item_filter": report_labels,
    "normalise_transcripts": marked,
    "nested_tables": nested,
    "redaction_report": lambda s, d: corpus.redaction_report(docs(s, d), {"pathetic": "[x]", "thing": "[y]", "All rights reserved": "[z]"}),
    "mixed_document_sample": lambda s, d: corpus.mixed_document_sample(as_pages(s, d).withColumn("text", F.when(F.col("page") % 3 == 0, F.left("text", F.lit(60))).otherwise(F.col("text")))),
    "manifest_summary": lambda s, d: corpus.manifest_summary(manifest(s, d)),
    "oversize_split": lambda s, d: corpus.oversize_split(manifest(s, d)).select("name", "declined", "reason"),
    "exclude_processed": new_files,
    "split_pages": lambda s, d: corpus.split_pages(transcripts(s, d)),
    "html_to_text": lambda s, d: corpus.html_to_text(table(s, d, "pages")),
    "lift_tables": tables,
    "merged_table_filter": lambda s, d: corpus.merged_table_filter(crowded(s, d)),
    "collapse_runs": lambda s, d: corpus.collapse_runs(tables(s, d)),
    "page_range_filter": lambda s, d: corpus.page_range_filter(as_pages(s, d), "1-30, 77, 900-").select("doc_id", "page"),
    "collapse_page_ranges": lambda s, d: corpus.collapse_page_ranges(docs(s, d).select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("doc_id"), F.floor(F.col("doc_id") / 12).cast("int").alias("page"))),
    "legibility_profile": lambda s, d: corpus.legibility_profile(docs(s, d)),
    "text_layer_gate": lambda s, d: corpus.text_layer_gate(as_pages(s, d)),
    "page_route": lambda s, d: corpus.page_route(docs(s, d).select("doc_id", F.length("text").alias("chars"), F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")).alias("alnum"), F.regexp_count("text", F.lit("ou")).alias("cid"), ((F.col("doc_id") % 10) / 10).alias("image_cover"))),
    "redact_terms": lambda s, d: corpus.redact_terms(docs(s, d), {"pathetic": "[x]", "thing": "[y]", "All rights reserved": "[z]"}),
}

# rank of pages: words and what they weigh, found values, the first pages; then what a fold over the order takes
RANK = f"""p AS (SELECT CAST(substr(source, 4) AS BIGINT) AS grp, CAST(doc_id AS INT) AS page, CAST(k AS INT) AS part, substr(text, k * 3000 + 1, 3000) AS text FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil(length(text) / 3000.0) AS BIGINT)))) AS k)),
t(question_id, term) AS (VALUES (1, 'thing'), (1, 'nicht'), (1, 'entre'), (1, 'pathetic'), (1, '40-42'), (2, 'amount'), (2, 'total')),
n AS (SELECT grp, count(DISTINCT page) AS pages FROM p GROUP BY 1),
m AS MATERIALIZED (SELECT question_id, grp, page, part, term, (length(lower(text)) - length(replace(lower(text), term, ''))) / length(term) AS tf FROM p, t),
d AS (SELECT question_id, grp, term, count(*) AS df FROM m WHERE tf > 0 GROUP BY 1, 2, 3),
s AS (SELECT question_id, grp, page, part, sum(ln(1 + pages / df::DOUBLE) * least(tf, 3)) AS score FROM m JOIN d USING (question_id, grp, term) JOIN n USING (grp) WHERE tf > 0 GROUP BY 1, 2, 3, 4),
k AS MATERIALIZED (SELECT q.question_id, grp, page, part, CAST(length(text) AS INT) AS size, q.question_id = 1 AND page IN (7, 40, 41, 42) AS named,
  round((coalesce(score, 0) + CASE WHEN page <= 3 THEN 1.5::DOUBLE - 0.4::DOUBLE * (page - 1) ELSE 0.0::DOUBLE END + 0.4::DOUBLE * CASE WHEN page % 11 = 0 THEN 2 ELSE 0 END)::DOUBLE, 6) AS score
  FROM p CROSS JOIN (SELECT CAST(unnest([1, 2]) AS INT) AS question_id) q LEFT JOIN s USING (question_id, grp, page, part))"""
ENTITY = r"""WITH c AS (SELECT source AS grp, doc_id, text, CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:thing|amount)') AS INT) + CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:nicht|total)') AS INT) AS named,
   len(regexp_extract_all(text, '[$€£]\s?[\d,]{3,}')) + len(regexp_extract_all(text, '\d{1,3}(?:\.\d+)?\s?%')) + len(regexp_extract_all(text, '(?:[A-Z][a-z]{2,9}\s+\d{1,2},\s+\d{4})|(?:\d{1,2}/\d{1,2}/\d{2,4})'))
     + least(len(regexp_extract_all(text, '\b\d[\d,]{2,}(?:\.\d+)?\b')), 10) AS figures FROM documents),
  b AS (SELECT *, CASE WHEN trim(text) = '' THEN 0.0 ELSE named * 4.0 + CASE WHEN named > 0 THEN least(figures, 12) * 0.8 ELSE 0.0 END END AS base FROM c),
  e(entity, w1, w2, suite) AS (VALUES (0, 'thing', 'and', '1'), (1, 'nicht', 'nicht', '2'), (2, 'entre', 'entre', '3')),
  m AS (SELECT grp, CAST(entity AS INT) AS entity, doc_id, base, CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])' || w1) AS INT) + CASE WHEN w2 <> w1 THEN CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])' || w2) AS INT) ELSE 0 END
      + CAST(regexp_matches(text, '(?:^|[^\p{L}\p{N}_])0*' || suite || '(?:[^\p{L}\p{N}_]|$)') AS INT) AS met,
    (suite <> '1' AND regexp_matches(text, '(?:^|[^\p{L}\p{N}_])0*1(?:[^\p{L}\p{N}_]|$)')) OR (suite <> '2' AND regexp_matches(text, '(?:^|[^\p{L}\p{N}_])0*2(?:[^\p{L}\p{N}_]|$)')) OR (suite <> '3' AND regexp_matches(text, '(?:^|[^\p{L}\p{N}_])0*3(?:[^\p{L}\p{N}_]|$)')) AS other FROM b, e)"""
BUNDLE = """WITH p AS (SELECT source AS grp, doc_id, CASE WHEN doc_id % 9 <> 0 AND text <> '' THEN chr(10) || '===== FILE: f' || doc_id || ' =====' || chr(10) || left(text, 9000) END AS t FROM documents),
  b AS (SELECT *, CAST(coalesce(sum(coalesce(length(t), 0)) OVER (PARTITION BY grp ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef FROM p)"""
CHUNKS = r"""ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
      cw AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk, 0 AS held, CAST(NULL AS VARCHAR) AS part FROM ps UNION ALL
        SELECT doc_id, ps, i + 1, chunk + CASE WHEN held + length(ps[i]) >= 2500 THEN 1 ELSE 0 END, CASE WHEN held + length(ps[i]) >= 2500 THEN 0 ELSE held + length(ps[i]) END, chunk || ':' || ps[i] FROM cw WHERE i <= len(ps)),
      r AS (SELECT doc_id, i, CAST(string_split(part, ':')[1] AS INT) AS chunk_no, substr(part, strpos(part, ':') + 1) AS t FROM cw WHERE part IS NOT NULL),
      chunks AS MATERIALIZED (SELECT doc_id, chunk_no, string_agg(t, chr(10) ORDER BY i) AS chunk, 'part ' || (min(i) - 1) || '-' || (max(i) - 1) AS label FROM r GROUP BY 1, 2)"""


def rated(chunks: str) -> str:
    """Units (grp, doc_id, chunk_no, size, score) of chunks by what they name, with 3 more for the first of a file."""
    return rf"""units AS MATERIALIZED (SELECT grp, doc_id, chunk_no, CAST(length(chunk) AS INT) AS size, (CASE WHEN trim(chunk) = '' THEN 0.0 ELSE named * 4.0 + CASE WHEN named > 0 THEN least(figures, 12) * 0.8 ELSE 0.0 END END + CASE WHEN chunk_no < 1 THEN 3.0 ELSE 0.0 END)::DOUBLE AS score FROM (
      SELECT *, CAST(regexp_matches(chunk, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:thing|amount)') AS INT) + CAST(regexp_matches(chunk, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:nicht|total)') AS INT) AS named,
        len(regexp_extract_all(chunk, '[$€£]\s?[\d,]{{3,}}')) + len(regexp_extract_all(chunk, '\d{{1,3}}(?:\.\d+)?\s?%')) + len(regexp_extract_all(chunk, '(?:[A-Z][a-z]{{2,9}}\s+\d{{1,2}},\s+\d{{4}})|(?:\d{{1,2}}/\d{{1,2}}/\d{{2,4}})'))
        + least(len(regexp_extract_all(chunk, '\b\d[\d,]{{2,}}(?:\.\d+)?\b')), 10) AS figures FROM {chunks}))"""


def greedy(p: str, source: str, floor: int, budget: int) -> str:
    """{p}_taken: units of `source` in the order of trying that still fit what is left of the budget, one after the other."""
    return f"""{p}_n AS (SELECT *, row_number() OVER (PARTITION BY grp, doc_id ORDER BY score DESC, chunk_no) AS nth FROM {source}), {p}_f AS (SELECT *, nth <= {floor} AND (score > 0 OR chunk_no = 0) AS first FROM {p}_n),
      {p}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY NOT first, CASE WHEN first THEN doc_id END, CASE WHEN first THEN nth END, -score, doc_id, chunk_no) AS i FROM {p}_f WHERE first OR score > 0),
      {p}_w AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, false AS took FROM {p}_o UNION ALL
        SELECT w.grp, o.i, w.used + CASE WHEN w.used + o.size + 80 <= {budget} THEN o.size + 80 ELSE 0 END, w.used + o.size + 80 <= {budget} FROM {p}_w AS w JOIN {p}_o AS o ON o.grp = w.grp AND o.i = w.i + 1),
      {p}_taken AS MATERIALIZED (SELECT o.* FROM {p}_o AS o JOIN {p}_w AS w ON o.grp = w.grp AND o.i = w.i WHERE took)"""


ORACLES = {
    "score_chunks": r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0.0 ELSE named * 4.0 + least(loose, 8) * 0.5 - barred * 8.0 + CASE WHEN named > 0 THEN least(figures, 12) * 0.8 ELSE 0.0 END END AS score FROM (
      SELECT doc_id, text, CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:thing|amount)') AS INT) + CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:nicht|total)') AS INT) AS named,
        CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])entre') AS INT) + CAST(regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])mente') AS INT) AS loose, CAST(regexp_matches(text, '(?i)rights reserved') AS INT) AS barred,
        len(regexp_extract_all(text, '[$€£]\s?[\d,]{3,}')) + len(regexp_extract_all(text, '\d{1,3}(?:\.\d+)?\s?%')) + len(regexp_extract_all(text, '(?:[A-Z][a-z]{2,9}\s+\d{1,2},\s+\d{4})|(?:\d{1,2}/\d{1,2}/\d{2,4})'))
        + least(len(regexp_extract_all(text, '\b\d[\d,]{2,}(?:\.\d+)?\b')), 10) AS figures FROM documents)""",
    "top_pages": """WITH p AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(doc_id AS INT) AS page, CAST(length(text) % 7 - 2 AS DOUBLE) AS score FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n <= 3 ORDER BY score DESC, page DESC) AS r FROM n)
      SELECT doc_id, page, score FROM r WHERE n <= 3 OR (r <= 8 AND score > 0)""",
    "prefix_budget": """WITH p AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(doc_id AS INT) AS page, text FROM documents),
      u AS (SELECT doc_id, page, CAST(sum(length(text) + 18 + length(CAST(page AS VARCHAR))) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS used FROM p WHERE text <> '') SELECT * FROM u WHERE used <= 40000""",
    "recent_turns": """WITH o AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
      u AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM o)
      SELECT conv_id, turn, role, CASE WHEN upto <= 1500 THEN text ELSE right(text, CAST(1500 - upto + length(text) AS BIGINT)) END AS text FROM u WHERE upto <= 1500 OR 1500 - upto + length(text) >= 400""",
    "followup_query": """SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS query FROM conversations WHERE role = 'user'""",
    "capped_bundle": f"{BUNDLE} SELECT grp, doc_id, CAST(CASE WHEN t IS NULL OR bef >= 26000 THEN 0 ELSE length(left(t, 26000 - bef)) END AS INT) AS size, CASE WHEN bef >= 26000 THEN 'over the total' WHEN t IS NULL THEN 'no text' ELSE '' END AS reason FROM b",
    "bundle_text": f"{BUNDLE} SELECT grp, md5(left(string_agg(t, '' ORDER BY doc_id), 26000)) AS bundle FROM b WHERE bef < 26000 AND t IS NOT NULL GROUP BY 1",
    "manifest_summary": f"""WITH {MANIFEST} SELECT grp, route, count(*) AS files, CAST(sum(coalesce(pages, 1)) AS BIGINT) AS pages, CAST(sum(size) AS BIGINT) AS bytes,
      round(sum(CAST(CASE WHEN route = 'ocr' THEN coalesce(pages, 1) * 2.8 WHEN route = 'pdf' THEN 8.9 ELSE 0.0 END AS DOUBLE)), 1) AS seconds FROM m GROUP BY 1, 2""",
    "oversize_split": f"""WITH {MANIFEST} SELECT name, route = 'ocr' AND coalesce(pages, 1) > 10 AS declined, CASE WHEN route = 'ocr' AND coalesce(pages, 1) > 10 THEN pages || ' pages, over 10' ELSE '' END AS reason FROM m""",
    "exclude_processed": f"WITH {MANIFEST} SELECT min(name) AS name, hash FROM m WHERE hash NOT IN (SELECT hash FROM m WHERE ext = 'zip') GROUP BY hash",
    "split_pages": r"""WITH c AS (SELECT doc_id, regexp_replace(text, '[<>\n]', ' ', 'g') AS t FROM documents), h AS (SELECT *, CAST(floor(length(t) / 2) AS BIGINT) AS half FROM c)
      SELECT doc_id, CAST(1 AS INT) AS page, trim(CASE WHEN doc_id % 4 = 0 THEN t ELSE left(t, half) END) AS text FROM h UNION ALL SELECT doc_id, CAST(2 AS INT), trim(substr(t, half + 1)) FROM h WHERE doc_id % 4 <> 0""",
    "lift_tables": """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(0 AS INT) AS table_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, t AS text, t = '' AS is_empty FROM orders,
      LATERAL (VALUES (0, 0, 'Priority'), (0, 1, 'Priority'), (0, 2, 'café &—'), (1, 0, o_orderpriority), (1, 1, o_orderstatus), (1, 2, '')) AS v(r, c, t)""",
    "collapse_runs": """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(0 AS INT) AS table_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, t AS text, false AS is_empty FROM orders,
      LATERAL (VALUES (0, 0, 'Priority'), (0, 2, 'café &—'), (1, 0, o_orderpriority), (1, 1, o_orderstatus)) AS v(r, c, t)""",
    "merged_table_filter": """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(0 AS INT) AS table_no,
      CAST(1 + CASE WHEN o_orderkey % 4 <> 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS DOUBLE) / 6 AS empty, o_orderkey % 3 = 0 AS crowded, o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 AS merged FROM orders""",
    "page_range_filter": "SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(doc_id AS INT) AS page FROM documents WHERE doc_id BETWEEN 1 AND 30 OR doc_id = 77 OR doc_id >= 900",
    "collapse_page_ranges": """WITH p AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(floor(doc_id / 12) AS INT) AS page FROM documents), i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM p),
      r AS (SELECT doc_id, min(page) AS lo, max(page) AS hi FROM i GROUP BY doc_id, k) SELECT doc_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS pages FROM r GROUP BY 1""",
    "chunk_paragraphs": f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks",
    "select_under_budget": f"WITH RECURSIVE {CHUNKS}, {rated('(SELECT source AS grp, doc_id, chunk_no, chunk FROM chunks JOIN documents USING (doc_id))')}, {greedy('a', 'units', 2, 40000)} SELECT grp, doc_id, chunk_no, size, score FROM a_taken",
    "second_pass": f"WITH RECURSIVE {rated('(SELECT source AS grp, doc_id, CAST(0 AS INT) AS chunk_no, text AS chunk FROM documents)')}, {greedy('a', 'units', 1, 20000)}, "
    f"rest AS MATERIALIZED (SELECT * FROM units WHERE (grp, doc_id) NOT IN (SELECT grp, doc_id FROM a_taken) AND grp IN (SELECT source FROM documents WHERE doc_id % 3 = 0)), {greedy('b', 'rest', 1, 30000)} SELECT grp, doc_id, chunk_no, size, score FROM b_taken",
    "question_pages": f"""WITH RECURSIVE {RANK}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id, grp ORDER BY NOT named, CASE WHEN named THEN 0 ELSE -score END, page, part) AS i FROM k WHERE size > 0),
      w AS (SELECT DISTINCT question_id, grp, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS took, CAST(0 AS INT) AS page, CAST(0 AS INT) AS part FROM o UNION ALL
        SELECT w.question_id, w.grp, o.i, w.used + CASE WHEN o.size + 40 <= 12000 - w.used THEN o.size + 40 WHEN o.named AND w.used < 12000 THEN least(o.size, greatest(0, 12000 - w.used - 80)) + 67 ELSE 0 END,
          CASE WHEN o.size + 40 <= 12000 - w.used THEN o.size WHEN o.named AND w.used < 12000 THEN least(o.size, greatest(0, 12000 - w.used - 80)) + 27 END, o.page, o.part FROM w JOIN o ON o.question_id = w.question_id AND o.grp = w.grp AND o.i = w.i + 1)
      SELECT question_id, grp, CAST(page AS BIGINT) AS page, part, CAST(took AS INT) AS size FROM w WHERE took IS NOT NULL""",
    "score_pages": "SELECT doc_id, round(CAST(" + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in retrieve.PAGE_WEIGHTS) + " + k * 2.0 + CASE WHEN k > 0 AND f > 0 THEN least(f, 8) * 1.2 WHEN k > 0 THEN -3.0 ELSE 0 END AS DOUBLE), 4) AS score FROM (SELECT doc_id, text, "
    + " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in retrieve.FIELD_HINTS) + " AS k, " + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in retrieve.PAGE_FIGURES) + " AS f FROM documents)",
    "page_route": """SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS INT) AS alnum, CAST(len(regexp_extract_all(text, 'ou')) AS INT) AS cid, (doc_id % 10) / 10 AS image_cover,
      CASE WHEN length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 60 AND len(regexp_extract_all(text, 'ou')) / greatest(length(text), 1) <= 0.05 AND NOT ((doc_id % 10) / 10 > 0.5 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 300) THEN 'text' ELSE 'ocr' END AS route FROM documents""",
    "html_to_text": r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
      p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM b)
      SELECT page_id, CAST(i - 1 AS INT) AS par_no, ps[i] AS text FROM p, unnest(range(1, len(ps) + 1)) AS u(i)""",
    "keyword_rank": f"WITH {RANK} SELECT question_id, grp, page, part, size, named, score FROM k",
    "search_terms": r"""WITH w AS (SELECT doc_id AS ord, list_filter(regexp_split_to_array(lower(regexp_replace(left(text, 300), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains(""" + str(sorted(retrieve.STOP)) + r""", x)) AS ws FROM documents)
      SELECT ord, coalesce(array_to_string(list_transform(list_filter(list_transform(range(1, len(ws) + 1), lambda i: {'i': i, 'w': ws[i]}), lambda e: list_position(ws, e.w) = e.i), lambda e: e.w), ' '), '') AS words FROM w""",
    "figure_weight": f"""SELECT round(avg(CAST(regexp_matches(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' Rate' ELSE p_name END, '(?i){retrieve.NUMERIC_HINT}') AS INT)) * 0.8, 6) AS figure_weight FROM part""",
    "score_for_entity": ENTITY + " SELECT grp, entity, doc_id, base + least(met, 4) * 5.0 - CASE WHEN other THEN 12.0 ELSE 0.0 END AS score FROM m",
    "detect_doc_types": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Rent Roll.txt' ELSE 'file.txt' END || chr(10) || left(text, 20000) AS c FROM documents),
      h AS (SELECT doc_id, regexp_matches(c, '(?i)(?:^|[^\p{L}\p{N}_])(thing|amount)(?:[^\p{L}\p{N}_]|$)') AS a, regexp_matches(c, '(?i)(?:^|[^\p{L}\p{N}_])(nicht|landlord)(?:[^\p{L}\p{N}_]|$)') AS b, doc_id % 5 = 0 OR regexp_matches(c, '(?i)(?:^|[^\p{L}\p{N}_])rent roll(?:[^\p{L}\p{N}_]|$)') AS r FROM d),
      f AS (SELECT *, NOT (a OR b OR r) AS fallback FROM h)
      SELECT doc_id, concat_ws(',', CASE WHEN a OR fallback THEN 'bill' END, CASE WHEN b OR fallback THEN 'lease' END, CASE WHEN r OR fallback THEN 'roll' END) AS types,
        concat_ws(',', CASE WHEN a OR fallback THEN 'Due date,Total' END, CASE WHEN b AND NOT a AND NOT fallback THEN 'Tenant,Due date' WHEN b OR fallback THEN 'Tenant' END, CASE WHEN r OR fallback THEN 'Suite' END) AS fields, fallback FROM f""",
    "scan_manifest": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS size, ['a/b/', '', 'node_modules/x/', 'c/.git/', 'd/__pycache__/', 'System Volume Information/'][o_orderkey % 6 + 1] AS f,
        ['x.PDF', 'y.csv', '.hidden', '~$z.docx', 'w.docx', 'v.tsv', 'u.webp', 't.xml', 's.bmp', 'noext', 'r.parquet'][o_orderkey % 11 + 1] AS name FROM orders)
      SELECT '/root/' || f || k || '/' || name AS path, name, CASE WHEN name = 'noext' THEN '' ELSE lower(string_split(name, '.')[-1]) END AS ext, size, CASE WHEN f = '' THEN CAST(k AS VARCHAR) ELSE 'a' END AS grp,
        ['pdf', 'table', '', '', 'doc', 'table', 'needs_ocr', 'text', 'needs_ocr', 'unsupported', 'unsupported'][k % 11 + 1] AS route, CASE WHEN k % 11 IN (6, 8) THEN 'an image, and OCR is off' ELSE '' END AS note
      FROM o WHERE k % 6 < 2 AND k % 11 NOT IN (2, 3)""",
    "line_item_filter": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 8 WHEN 0 THEN 'Rent' WHEN 6 THEN '* note' ELSE 'Monthly rent' END AS label FROM orders WHERE o_orderkey % 8 IN (0, 5, 6) AND o_orderkey % 3 > 0""",
    "normalise_transcripts": r"""SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(n AS INT) AS line_no, CASE n WHEN 1 THEN 'Total' || chr(9) || '$' || o_custkey WHEN 2 THEN o_orderpriority || '  end' ELSE ' last A&lt;é© ¬it;–&nosuch;' END AS text FROM orders, (VALUES (1), (2), (3)) AS v(n)""",
    "nested_tables": """SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS page, CAST(t AS INT) AS table_no, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, x AS text, x = '' AS is_empty FROM orders,
      LATERAL (VALUES (0, 0, 0, 'a'), (0, 0, 1, 'b c'), (0, 1, 0, 'd e'), (1, 0, 0, CAST(o_orderkey AS VARCHAR)), (1, 0, 1, ''), (1, 1, 0, 'x é y'), (2, 0, 0, 'z')) AS v(t, r, c, x)""",
    "redaction_report": r"""WITH a AS (SELECT len(regexp_extract_all(text, '(?i)All rights reserved')) AS h1, regexp_replace(text, '(?i)All rights reserved', '[z]', 'g') AS t FROM documents),
      b AS (SELECT h1, len(regexp_extract_all(t, '(?i)pathetic')) AS h2, len(regexp_extract_all(regexp_replace(t, '(?i)pathetic', '[x]', 'g'), '(?i)thing')) AS h3 FROM a)
      SELECT term, CAST(sum(h) AS BIGINT) AS hits, count(*) FILTER (h > 0) AS docs FROM b, LATERAL (VALUES ('All rights reserved', h1), ('pathetic', h2), ('thing', h3), (NULL, h1 + h2 + h3)) AS v(term, h) GROUP BY 1""",
    "mixed_document_sample": r"""WITH p AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, CAST(doc_id AS INT) AS page, length(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN left(text, 60) ELSE text END, '^\s+|\s+$', '', 'g')) < 80 AS blank FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
      s AS (SELECT * FROM n WHERE n <= 24 OR i IN (SELECT round_even(k * ((n - 1) / 23.0::DOUBLE), 0) FROM range(24) AS r(k)))
      SELECT doc_id, count(*) AS sampled, count(*) FILTER (blank) AS blank, min(page) FILTER (blank) AS first_blank, count(*) FILTER (blank) * 4 >= count(*) AS mixed FROM s GROUP BY 1""",
    "legibility_profile": r"""WITH w AS (SELECT doc_id, length(text) AS n, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '^[^0-9A-Za-z$]+|[^0-9A-Za-z%)]+$', '', 'g')) AS ws FROM documents),
      v AS (SELECT doc_id, n, list_filter(list_transform(ws, lambda b: CASE WHEN length(regexp_replace(b, '[^\p{L}\p{N}]', '', 'g')) <= 1 THEN 9 WHEN regexp_matches(b, '[^\p{L}\p{N}.,\-/'':&#$%()\[\]{}!?;+*=@_~’‘“”–—°§]') THEN 0
        WHEN NOT regexp_matches(b, '\p{L}') OR regexp_matches(b, '\p{N}') THEN 1 WHEN length(regexp_replace(b, '[^\p{L}]', '', 'g')) >= 5 AND NOT regexp_matches(b, '[aeiouyAEIOUY]') THEN 0 ELSE 1 END), lambda x: x < 9) AS vs FROM w),
      c AS (SELECT doc_id, n, CAST(len(vs) AS INT) AS votes, CAST(len(list_filter(vs, lambda x: x = 1)) AS INT) AS yes FROM v)
      SELECT doc_id, votes, yes, CASE WHEN n < 200 THEN 'little text' WHEN votes < 20 THEN 'few words' WHEN yes / votes < 0.89 THEN 'not words' ELSE '' END AS reason, NOT (n < 200 OR votes < 20 OR yes / votes < 0.89) AS usable FROM c""",
    "text_layer_gate": r"""WITH p AS (SELECT CAST(substr(source, 4) AS BIGINT) AS doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
      s AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g'))) AS BIGINT) AS good FROM p WHERE n <= 10 GROUP BY 1) SELECT *, chars >= 1000 AND good / chars > 0.75 AS has_text FROM s""",
    "redact_terms": r"""WITH a AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)All rights reserved')) AS h1, regexp_replace(text, '(?i)All rights reserved', '[z]', 'g') AS t1 FROM documents),
      b AS (SELECT *, len(regexp_extract_all(t1, '(?i)pathetic')) AS h2, regexp_replace(t1, '(?i)pathetic', '[x]', 'g') AS t2 FROM a)
      SELECT doc_id, regexp_replace(t2, '(?i)thing', '[y]', 'g') AS text, CAST(h1 + h2 + len(regexp_extract_all(t2, '(?i)thing')) AS INT) AS hits FROM b""",
}
