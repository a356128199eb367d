"""Document tables derived from the shipped ones, as SQL that Spark and DuckDB read alike: statements, tokens, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = """l as (
  select l_orderkey as doc_id,
         row_number() over (partition by l_orderkey
           order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_shipdate) as n,
         l_returnflag, cast(l_quantity as decimal(18,2)) as q, cast(l_extendedprice as decimal(18,2)) as amt,
         cast(l_tax as decimal(18,2)) as tax
  from lineitem)"""

STATEMENT_LINES = f"""
with o as (
  select o_orderkey as doc_id, cast((o_orderkey % 3) + 1 as int) as page, o_custkey, o_orderkey % 5 as v,
         lpad(cast(month(o_orderdate) as string),2,'0') || '/' || lpad(cast(day(o_orderdate) as string),2,'0')
           || '/' || cast(year(o_orderdate) as string) as dt
  from orders),
{LINES},
t as (select doc_id, sum(amt) as total, max(n) as last_n from l group by doc_id)
select o.doc_id, o.page, 1 as line_no, 'ACCOUNT STATEMENT' as text from o
union all select o.doc_id, o.page, 2, case when v = 2 then 'Member since 2001' else 'Account No: AC-' || cast(o_custkey as string) end from o
union all select o.doc_id, o.page, 3, case when v = 1 then 'Statement Date' when v = 4 then 'Bill Date:  ' || dt else 'Statement Date: ' || dt end from o
union all select o.doc_id, o.page, 4, dt from o where v = 1
union all select o.doc_id, o.page, 5, 'Item' || chr(9) || 'Quantity' || chr(9) || 'Amount' from o
union all select o.doc_id, o.page, cast(5 + n as int), 'Item ' || cast(n as string) || chr(9) || cast(q as string)
                                           || chr(9) || cast(amt as string) from o join l on o.doc_id = l.doc_id
union all select o.doc_id, o.page, cast(6 + last_n as int), 'Total Amount Due: $'
                 || cast(case when v = 3 then total + 10 else total end as string) from o join t on o.doc_id = t.doc_id
"""

STATEMENT_TOKENS = f"""
with {LINES}
select doc_id, 1 as page, 'Item' as text, cast(59 as double) as x0, cast(79 as double) as x1, cast(100 + 12 * n as double) as top from l
union all select doc_id, 1, cast(q as string), cast(300 - 5 * length(cast(q as string)) as double), cast(300 as double), cast(100 + 12 * n as double) + cast(0.4 as double) from l
union all select doc_id, 1, cast(amt as string), cast(420 - 5 * length(cast(amt as string)) as double), cast(420 as double), cast(100 + 12 * n as double) + cast(0.8 as double) from l
union all select doc_id, 1, cast(tax as string), cast((case when n = 4 then 470 else 500 end) - 5 * length(cast(tax as string)) as double),
                 cast(case when n = 4 then 470 else 500 end as double), cast(100 + 12 * n as double) + cast(0.2 as double) from l
"""

REPORT_ROWS = f"""
with {LINES},
s as (select doc_id, l_returnflag, row_number() over (partition by doc_id order by l_returnflag) as sec,
             sum(q) as q, sum(amt) as amt from l group by doc_id, l_returnflag)
select doc_id, 1 as page, cast(sec * 1000 as double) as y, cast(53 as double) as x0, 'SECTION ' || l_returnflag as label,
       cast(null as string) as v0, cast(null as string) as v1 from s
union all select l.doc_id, 1, cast(s.sec * 1000 + 10 * l.n as double), cast(59 as double), 'Item ' || cast(l.n as string),
       cast(l.q as string), cast(l.amt as string) from l join s on l.doc_id = s.doc_id and l.l_returnflag = s.l_returnflag
union all select doc_id, 1, cast(sec * 1000 + 999 as double), cast(68 as double), 'Total ' || l_returnflag, cast(q as string),
       cast(case when doc_id % 7 = 0 and sec = 1 then amt + 1 else amt end as string) from s
"""


# A flat report: every row at one indent, subtotals of each flag, a grand total straight after the last of them, and in every
# fifth document a line of the five largest. Columns: quantity, amount, amount for each unit.
ROLL_ROWS = f"""
with {LINES},
s as (select doc_id, l_returnflag, row_number() over (partition by doc_id order by l_returnflag) as sec, sum(q) as q, sum(amt) as amt from l group by doc_id, l_returnflag),
g as (select doc_id, sum(q) as q, sum(amt) as amt, max(n) as last_n from l group by doc_id),
r as (select l.doc_id, s.sec * 1000 + 10 * l.n as y, 'Suite ' || cast(l.n as string) as label, l.q, l.amt from l join s on l.doc_id = s.doc_id and l.l_returnflag = s.l_returnflag
  union all select doc_id, sec * 1000 + 998, 'Subtotal ' || l_returnflag, q, amt from s
  union all select doc_id, 9000, 'Grand total', q, case when doc_id % 7 = 0 then amt + 500 else amt end from g
  union all select doc_id, 9001, 'Top 10 Tenant Exposure', q, amt from g where doc_id % 5 = 0)
select doc_id, 1 as page, cast(y as double) as y, cast(59 as double) as x0, label, cast(q as string) as v0, cast(amt as string) as v1,
       cast(cast(floor(cast(amt as double) * 100 / cast(q as double)) / 100 as decimal(18,2)) as string) as v2 from r
"""

# A notice with a letterhead and a table under named columns: page 1 of each order; a third print the issuer in a stub below.
NOTICE_LINES = """
with o as (select o_orderkey as doc_id, o_orderkey % 3 as v, cast(o_orderkey % 900 + 100 as string) as a, cast(o_custkey % 900 + 100 as string) as b from orders)
select doc_id, 1 as page, 1 as line_no, case when v = 0 then 'Metro Light & Power' when v = 1 then 'JANE OKAFOR' else 'Account Summary:' end as text from o
union all select doc_id, 1, 2, 'Description' || chr(9) || 'Debits' || chr(9) || 'Credits' || chr(9) || 'Balance' from o
union all select doc_id, 1, 3, 'Beginning balance' || chr(9) || '1.00' || chr(9) || '2.00' || chr(9) || a || '.10' from o
union all select doc_id, 1, 4, 'ENDING BALANCE' || chr(9) || b || '.00' || chr(9) || a || '.20' from o
union all select doc_id, 1, 5, 'Due Date' || chr(9) || 'Meter' from o
union all select doc_id, 1, 6, '09/05/2026' from o where v <> 2
union all select doc_id, 1, 7, '10/06/2026' || chr(9) || 'MTR-' || b from o where v = 2
union all select doc_id, 1, 8, 'Usage (kWh) ' || a from o
union all select doc_id, 1, 9, 'Remit to  Harbor Water Company' from o where v = 1
"""

# A settlement notice whose fields no list knows: the shape comes from a field's name, and one field has labels of the caller's.
SETTLEMENT_LINES = """
with o as (select o_orderkey as doc_id, o_orderkey % 4 as v, cast(o_orderkey % 900 + 100 as string) as a, cast(o_custkey + 1000 as string) as b,
  lpad(cast(month(o_orderdate) as string),2,'0') || '/' || lpad(cast(day(o_orderdate) as string),2,'0') || '/' || cast(year(o_orderdate) as string) as dt from orders)
select doc_id, 1 as page, 1 as line_no, 'SETTLEMENT NOTICE' as text from o
union all select doc_id, 1, 2, 'Closing date ' || dt from o where v <> 3
union all select doc_id, 1, 3, 'Closing date: see below' from o
union all select doc_id, 1, 4, case when v = 1 then 'Loan amount' else 'Loan amount $' || a || '.50' end from o
union all select doc_id, 1, 5, '$' || a || '.75' from o where v = 1
union all select doc_id, 1, 6, 'Parcel Number: 12-' || b from o
union all select doc_id, 1, 7, case when v = 2 then 'Dossier-No' || chr(9) || 'D ' || b else 'OUR REF (internal): X' || a end from o
union all select doc_id, 1, 8, 'Premium rate' || chr(9) || 'Premium rate' || chr(9) || '4.' || a || '%' from o where v <> 2
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


# The same tables for Spark: an order's lines are brought together once, and every row made from them. The SQL above reads
# them line by line; queries are compared with what DuckDB makes of it. Rows are exploded by the outer form: the plain one
# also puts a condition on the array's size below itself, and the array is then made twice. An array is a column before it
# is exploded: made within the explode it would be evaluated without generated code.


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its lines (flag, q, amt, tax) in order."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate",
        F.col("l_returnflag").alias("flag"), money("l_quantity").alias("q"), money("l_extendedprice").alias("amt"), money("l_tax").alias("tax"),
    )
    # a struct is a column before it is collected: made within the aggregate it would be evaluated without generated code
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line.alias("line"))
    own = own.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    kept = F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), x["flag"].alias("flag"), x["q"].alias("q"), x["amt"].alias("amt"), x["tax"].alias("tax")))
    return own.select("doc_id", kept.alias("lines"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line: doc_id, its number n in the order, flag, q, amt, tax. For what is made line by line; no array is built."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate", "l_returnflag")
    own = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    return own.select(F.col("l_orderkey").alias("doc_id"), "n", F.col("l_returnflag").alias("flag"), money("l_quantity").alias("q"), money("l_extendedprice").alias("amt"), money("l_tax").alias("tax"))


def total(lines: Column, name: str) -> Column:
    zero = F.lit(0).cast("decimal(28,2)")
    return F.aggregate(lines, zero, lambda s, x: (s + x[name]).cast("decimal(28,2)"))


def text(c: Column) -> Column:
    return c.cast("string")


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("page"), "o_custkey",
        (F.col("o_orderkey") % 5).alias("v"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("dt"),
    ).join(order_lines(spark, sf_dir), "doc_id", "left")
    v, dt, lines = F.col("v"), F.col("dt"), F.coalesce("lines", F.array().cast("array<struct<n:int,flag:string,q:decimal(18,2),amt:decimal(18,2),tax:decimal(18,2)>>"))
    row = lambda n, t: F.struct(F.lit(n).cast("int").alias("line_no") if isinstance(n, int) else n.cast("int").alias("line_no"), t.alias("text"))
    some = lambda test, r: F.when(test, F.array(r)).otherwise(F.array().cast("array<struct<line_no:int,text:string>>"))
    due = total(lines, "amt") + F.when(v == 3, 10).otherwise(0)
    rows = F.concat(
        F.array(
            row(1, F.lit("ACCOUNT STATEMENT")),
            row(2, F.when(v == 2, "Member since 2001").otherwise(F.concat(F.lit("Account No: AC-"), text(F.col("o_custkey"))))),
            row(3, F.when(v == 1, "Statement Date").when(v == 4, F.concat(F.lit("Bill Date:  "), dt)).otherwise(F.concat(F.lit("Statement Date: "), dt))),
        ),
        some(v == 1, row(4, dt)),
        F.array(row(5, F.lit("Item\tQuantity\tAmount"))),
        F.transform(lines, lambda x: row(x["n"] + 5, F.concat_ws("\t", F.concat(F.lit("Item "), text(x["n"])), text(x["q"]), text(x["amt"])))),
        some(F.size(lines) > 0, row(F.size(lines) + 6, F.concat(F.lit("Total Amount Due: $"), text(due.cast("decimal(28,2)"))))),
    )
    return own.select("doc_id", "page", rows.alias("rows")).select("doc_id", "page", F.explode_outer("rows").alias("r")).filter("r IS NOT NULL").select("doc_id", "page", "r.*")


def token(t: Column, x0: Column, x1: Column, top: Column) -> Column:
    return F.struct(t.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"))


def statement_tokens(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The tokens of each line (n, q, amt, tax); `more` are arrays of further ones, made from the same line."""
    own = numbered_lines(spark, sf_dir)
    ending = lambda t, edge, drop: token(t, edge - 5 * F.length(t), edge, 100 + 12 * F.col("n") + F.lit(drop))
    edge = F.when(F.col("n") == 4, 470).otherwise(500)
    tokens = F.array(
        ending(F.lit("Item"), F.lit(79), 0.0), ending(text(F.col("q")), F.lit(300), 0.4), ending(text(F.col("amt")), F.lit(420), 0.8), ending(text(F.col("tax")), edge, 0.2)
    )
    rows = own.select("doc_id", (F.concat(tokens, *more) if more else tokens).alias("tokens")).select("doc_id", F.explode_outer("tokens").alias("t"))
    return rows.filter("t IS NOT NULL").select("doc_id", F.lit(1).alias("page"), "t.*")


def made_row(y: Column, x0: float, label: Column, *values: Column) -> Column:
    return F.struct(F.lit(1).alias("page"), y.cast("double").alias("y"), F.lit(x0).alias("x0"), label.alias("label"), F.array(*values).cast("array<string>").alias("values"))


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`numbered_lines` with the place `sec` of their flag in the order (from 1, none last), whether a line is the first of its flag, and
    the sums of the flag (sum_q, sum_amt) and of the order (all_q, all_amt). One shuffle; every row of a report is made beside a line."""
    own = numbered_lines(spark, sf_dir).withColumn("bare", F.col("flag").isNull())
    doc = Window.partitionBy("doc_id").orderBy("bare", "flag")
    # one window for all: the lines of a flag are those that the order leaves equal
    over = lambda c, frame: F.sum(c).over(frame)
    flag, whole = doc.rangeBetween(Window.currentRow, Window.currentRow), doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumns({
        "sec": F.dense_rank().over(doc), "first": F.rank().over(doc) == F.row_number().over(doc), "sum_q": over("q", flag), "sum_amt": over("amt", flag), "all_q": over("q", whole), "all_amt": over("amt", whole),
    })
    return own.withColumns({"q_text": text(F.col("q")), "amt_text": text(F.col("amt"))})


def rows_of(own: DataFrame, rows: list[Column]) -> DataFrame:
    return own.select("doc_id", F.array(*rows).alias("rows")).select("doc_id", F.explode_outer("rows").alias("r")).filter("r IS NOT NULL").select("doc_id", "r.*")


def report_made() -> list[Column]:
    """The rows of the indented report beside a line of `section_lines`, null where there is none."""
    doc, n, flag, sec, first = (F.col(c) for c in ("doc_id", "n", "flag", "sec", "first"))
    amount = F.col("sum_amt") + F.when((doc % 7 == 0) & (sec == 1), 1).otherwise(0)
    return [
        F.when(first, made_row(sec * 1000, 53.0, F.concat(F.lit("SECTION "), flag), F.lit(None), F.lit(None))),
        F.when(flag.isNotNull(), made_row(sec * 1000 + 10 * n, 59.0, F.concat(F.lit("Item "), text(n)), F.col("q_text"), F.col("amt_text"))),
        F.when(first, made_row(sec * 1000 + 999, 68.0, F.concat(F.lit("Total "), flag), text(F.col("sum_q")), text(amount.cast("decimal(28,2)")))),
    ]


def roll_made() -> list[Column]:
    """The rows of the flat report beside a line of `section_lines`, null where there is none."""
    doc, n, flag, sec = (F.col(c) for c in ("doc_id", "n", "flag", "sec"))

    def full(test, y, label, q, amt, *texts):
        rate = (F.floor(amt.cast("double") * 100 / q.cast("double")) / 100).cast("decimal(18,2)")
        return F.when(test, made_row(y, 59.0, label, *(texts or (text(q), text(amt))), text(rate)))

    off = (F.col("all_amt") + F.when(doc % 7 == 0, 500).otherwise(0)).cast("decimal(28,2)")
    return [
        full(flag.isNotNull(), sec * 1000 + 10 * n, F.concat(F.lit("Suite "), text(n)), F.col("q"), F.col("amt"), F.col("q_text"), F.col("amt_text")),
        full(F.col("first"), sec * 1000 + 998, F.concat(F.lit("Subtotal "), flag), F.col("sum_q"), F.col("sum_amt")),
        full(n == 1, F.lit(9000), F.lit("Grand total"), F.col("all_q"), off),
        full((n == 1) & (doc % 5 == 0), F.lit(9001), F.lit("Top 10 Tenant Exposure"), F.col("all_q"), F.col("all_amt")),
    ]


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page rows with values array<string>, null where a column is empty."""
    return rows_of(section_lines(spark, sf_dir), report_made())


def roll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat report of ROLL_ROWS, values array<string>."""
    return rows_of(section_lines(spark, sf_dir), roll_made())


def both_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`report_rows` and, under the number -doc_id - 1, `roll_rows`, made beside the same lines."""
    report, roll = report_made(), roll_made()
    rows = section_lines(spark, sf_dir).select("doc_id", F.array(*report, *roll).alias("rows")).select("doc_id", F.posexplode_outer("rows").alias("k", "r")).filter("r IS NOT NULL")
    return rows.select(F.when(F.col("k") < len(report), F.col("doc_id")).otherwise(-F.col("doc_id") - 1).alias("doc_id"), "r.*")
