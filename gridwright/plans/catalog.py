"""Every registered core query, each beside the SQL that says the same.

The driver's tables are clean, so queries derive messy cells from them by
expressions that both engines can write, and put them through the operators.
"""

from __future__ import annotations

import atexit
import csv
import json
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.config import Settings
from gridwright.functions import cells as C
from gridwright.functions import clean
from gridwright.functions.fields import US_DATES, FieldRegistry
from gridwright.functions.similarity import indel_ratio
from gridwright.operators import cleaning, mapping, overlap, profiling, quality, records, structure
from gridwright.plans import pipeline, report, sinks
from gridwright.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out if it is a scan of fewer partitions than there are cores: for costly expressions over a small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ------------------------------------------------------------------ scalar functions
@query(r"""
    SELECT doc_id, md5(t) AS clean_md5, CAST(length(t) AS BIGINT) AS n_chars, t IS NOT NULL AS valid
    FROM (SELECT doc_id, nullif(trim(regexp_replace(replace(chr(160) || replace(text, ' ', '  ') || chr(9), chr(160), ' '), '\s+', ' ', 'g')), '') AS t FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\t"))
    got = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", C.once(clean.clean_text(C.text_cell(messy))).alias("c"))
    return got.select("doc_id", F.md5("c.value").alias("clean_md5"), F.length("c.value").cast("long").alias("n_chars"), "c.valid")


_PLACEHOLDERS = "CASE event_id % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN 'TBD' WHEN 3 THEN '' WHEN 4 THEN 'Nil' WHEN 5 THEN '0' WHEN 6 THEN NULL ELSE event_type END"


@query(f"""
    SELECT event_id, coalesce(lower(trim(v)) IN ('', 'n/a', 'na', 'none', 'null', '-', '--', 'tbd', 'unknown', '?', 'pending', 'n.a.', 'nil'), true) AS is_null
    FROM (SELECT event_id, {_PLACEHOLDERS} AS v FROM events)""")
def null_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr(_PLACEHOLDERS)
    return table(spark, sf_dir, "events").select("event_id", C.is_placeholder(C.text_cell(v)).alias("is_null"))


_AMOUNT = """CASE o_orderkey % 9 WHEN 0 THEN '$' || n WHEN 1 THEN '(' || n || ')' WHEN 2 THEN n || '.50' WHEN 3 THEN 'x' || n WHEN 4 THEN '€ ' || n || ',000'
    WHEN 5 THEN n || 'e2' WHEN 6 THEN '1_' || n WHEN 7 THEN 'N/A' ELSE '($' || n || '.25)' END"""


@query(rf"""
    WITH t AS (SELECT o_orderkey, {_AMOUNT} AS s FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS n FROM orders)),
    p AS (SELECT o_orderkey, s, s LIKE '(%)' AS neg, CASE WHEN s LIKE '(%)' THEN substr(s, 2, length(s) - 2) ELSE s END AS inner_s FROM t WHERE s <> 'N/A'),
    b AS (SELECT *, trim(regexp_replace(inner_s, '[$€£₹,]', '', 'g')) AS bare FROM p),
    v AS (SELECT *, try_cast(bare AS DOUBLE) AS x FROM b)
    SELECT o_orderkey, CASE WHEN neg THEN -x ELSE x END AS num, x IS NOT NULL AS valid,
           CASE WHEN x IS NULL THEN 'unparseable numeric value: ''' || inner_s || '''' WHEN bare <> inner_s THEN 'currency symbols/commas stripped' END AS note
    FROM v UNION ALL SELECT o_orderkey, NULL, false, NULL FROM t WHERE s = 'N/A'""")
def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").cast("string").alias("n")))
    got = t.select("o_orderkey", C.once(clean.clean_numeric(C.text_cell(F.expr(_AMOUNT)))).alias("c"))
    return got.select("o_orderkey", "c.num", "c.valid", "c.note")


_DAY = """CASE o_orderkey % 14
    WHEN 0 THEN y || '-' || m2 || '-' || d2 WHEN 1 THEN m2 || '/' || d2 || '/' || y WHEN 2 THEN d || '/' || m || '/' || y WHEN 3 THEN m2 || '-' || d2 || '-' || y
    WHEN 4 THEN d2 || '-' || m2 || '-' || y WHEN 5 THEN y || '/' || m || '/' || d WHEN 6 THEN mname || ' ' || d || ', ' || y WHEN 7 THEN substr(mname, 1, 3) || ' ' || d2 || ', ' || y
    WHEN 8 THEN d || ' ' || upper(mname) || ' ' || y WHEN 9 THEN d2 || ' ' || substr(mname, 1, 3) || ' ' || y WHEN 10 THEN m || '/' || d || '/' || substr(y, 3, 2)
    WHEN 11 THEN d2 || '/' || m2 || '/' || substr(y, 3, 2) WHEN 12 THEN 'soon' ELSE y || '-13-45' END"""
_MONTH = "CASE mo " + " ".join(f"WHEN {i} THEN '{m.capitalize()}'" for i, m in enumerate(clean._MONTHS, 1)) + " END"
_DATES = f"""SELECT o_orderkey, {_DAY} AS s FROM (SELECT *, CAST(yr AS VARCHAR(4)) AS y, CAST(mo AS VARCHAR(2)) AS m, CAST(da AS VARCHAR(2)) AS d, lpad(CAST(mo AS VARCHAR(2)), 2, '0') AS m2,
    lpad(CAST(da AS VARCHAR(2)), 2, '0') AS d2, {_MONTH} AS mname
    FROM (SELECT o_orderkey, year(o_orderdate) AS yr, month(o_orderdate) AS mo, day(o_orderdate) AS da FROM orders))"""


def _date_sql(names: list[str]) -> str:
    # a four-digit year takes four digits
    parsed = {f: f"try_strptime(CASE WHEN regexp_matches(s, '[0-9]{{4}}') THEN s END, '{f}')" if "%Y" in f else f"try_strptime(s, '{f}')" for f in names}
    tried = ", ".join(f"strftime({p}, '%Y-%m-%d')" for p in parsed.values())
    which = " ".join(f"WHEN {p} IS NOT NULL THEN '{f}'" for f, p in parsed.items())
    return f"SELECT o_orderkey, coalesce({tried}) AS iso, CASE {which} END AS fmt FROM ({_DATES})"


def _messy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).createOrReplaceTempView("gw_orders")
    return spark.sql(_DATES.replace("FROM orders", "FROM gw_orders").replace("VARCHAR(4)", "STRING").replace("VARCHAR(2)", "STRING"))


@query(_date_sql(US_DATES))
def clean_date_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messy_dates(spark, sf_dir).select("o_orderkey", C.once(clean.parse_date(F.col("s"), "us")).alias("x")).select("o_orderkey", "x.iso", "x.fmt")


@query(_date_sql(clean.date_formats("international")))
def clean_date_intl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messy_dates(spark, sf_dir).select("o_orderkey", C.once(clean.parse_date(F.col("s"), "international")).alias("x")).select("o_orderkey", "x.iso", "x.fmt")


@query(f"""
    SELECT o_orderkey, coalesce(us <> intl, false) AS ambiguous FROM (SELECT o_orderkey,
        coalesce(try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%m-%d-%Y'), try_strptime(s, '%m/%d/%y')) AS us,
        coalesce(try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%d-%m-%Y'), try_strptime(s, '%d/%m/%y')) AS intl FROM ({_DATES}))""")
def ambiguous_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messy_dates(spark, sf_dir).select("o_orderkey", clean.is_ambiguous(F.col("s")).alias("ambiguous"))


_EMAIL = "CASE c_custkey % 5 WHEN 0 THEN replace(c_name, '#', '.') || '@Example.COM' WHEN 1 THEN c_name WHEN 2 THEN ' a' || c_custkey || '@mail.example.org ' WHEN 3 THEN 'x@y' ELSE 'n/a' END"


@query(f"""
    SELECT c_custkey, v AS value, coalesce(regexp_matches(v, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}$'), false) AS valid
    FROM (SELECT c_custkey, CASE WHEN s <> 'n/a' THEN lower(trim(s)) END AS v FROM (SELECT c_custkey, {_EMAIL} AS s FROM customer))""")
def clean_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "customer").select("c_custkey", C.once(clean.clean_email(C.text_cell(F.expr(_EMAIL)))).alias("c"))
    return got.select("c_custkey", "c.value", "c.valid")


_PHONE = "CASE c_custkey % 4 WHEN 0 THEN '+1 (555) ' || lpad(CAST(c_custkey AS STRING), 7, '0') WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN '00' || repeat('12', 8) ELSE '555-' || lpad(CAST(c_custkey AS STRING), 4, '0') END"


@query(f"""
    SELECT c_custkey, v AS value, length(replace(v, '+', '')) BETWEEN 7 AND 15 AS valid
    FROM (SELECT c_custkey, regexp_replace({_PHONE.replace("STRING", "VARCHAR")}, '[^0-9+]', '', 'g') AS v FROM customer)""")
def clean_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "customer").select("c_custkey", C.once(clean.clean_phone(C.text_cell(F.expr(_PHONE)))).alias("c"))
    return got.select("c_custkey", "c.value", "c.valid")


# ------------------------------------------------------------------ a messy sheet of orders
HEADERS = ["Order ID", "Customer Name", "Order Date", "Total Amount", "Order Status"]
_BLANK, _HEAD, _BAD = "o_orderkey % 50 = 0", "o_orderkey % 70 = 1", "o_orderkey % 90 = 2"


def _orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, blank row, header, then an order a row; some rows blank, some the header again, some with nothing usable."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"))
    text = lambda x: C.text_cell(F.expr(x) if isinstance(x, str) else x)
    blank, head, bad = F.expr(_BLANK), F.expr(_HEAD), F.expr(_BAD)
    plain = [
        text("CAST(o_orderkey AS STRING)"),
        text("concat('Customer  ', o_custkey % 100)"),
        text(F.date_format("o_orderdate", "yyyy-MM-dd")),
        C.number_cell(F.expr("CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice END")),
        text("CASE o_orderstatus WHEN 'F' THEN 'n/a' ELSE o_orderstatus END"),
    ]
    empty = [text(F.lit(x)) for x in (None, " - ", "", "TBD", None)]
    again = [text(F.lit(h.upper())) for h in HEADERS]
    junk = [text(F.lit(x)) for x in ("?", "unknown", "soon", "x", "--")]
    cells = F.when(blank, F.array(*empty)).when(head, F.array(*again)).when(bad, F.array(*junk)).otherwise(F.array(*plain))
    rows = o.select(F.lit("orders").alias("sheet"), F.lit(0).alias("sheet_ord"), (F.col("o_orderkey") + 3).cast("long").alias("row_idx"), cells.alias("cells"))
    top = spark.range(3).select(
        F.lit("orders").alias("sheet"),
        F.lit(0).alias("sheet_ord"),
        F.col("id").alias("row_idx"),
        F.when(F.col("id") == 0, F.array(text(F.lit("Order export")), *[C.null_cell()] * 4))
        .when(F.col("id") == 1, F.array(*[C.null_cell()] * 5))
        .otherwise(F.array(*[text(F.lit(h)) for h in HEADERS]))
        .alias("cells"),
    )
    return rows.unionByName(top)


def _orders_cleaned(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, mapped headers).  Header and mapping are found on the first rows alone; ``keep``: for several readers."""
    grid = _orders_grid(spark, sf_dir)
    top = grid.where(F.col("row_idx") < structure.SEARCH_ROWS)
    profiles = mapping.pin(structure.header_rows(top))
    mapped = mapping.pin(mapping.map_headers(mapping.headers_of(top, profiles)))
    cleaned = cleaning.clean_rows(grid, profiles, mapped)
    return cleaned.persist(StorageLevel.MEMORY_AND_DISK) if keep else cleaned, mapped


_DROPPED = f"CASE WHEN {_BLANK} THEN 'blank_or_separator_row' WHEN {_HEAD} THEN 'repeated_header_row' WHEN {_BAD} THEN 'empty_or_malformed' END"
_RECORDS = f"""SELECT 'orders' AS sheet, o_orderkey + 4 AS source_row, CAST(o_orderkey AS VARCHAR) AS id, 'Customer ' || (o_custkey % 100) AS full_name,
    strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status FROM orders WHERE NOT ({_BLANK} OR {_HEAD} OR {_BAD})"""


@query(f"SELECT o_orderkey + 4 AS source_row, {_DROPPED} AS dropped FROM orders")
def row_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_cleaned(spark, sf_dir)[0].select("source_row", "dropped")


@query(f"SELECT {_DROPPED} AS reason, CAST(count(*) AS BIGINT) AS n FROM orders WHERE {_DROPPED} IS NOT NULL GROUP BY 1")
def dropped_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dropped_reasons(_orders_cleaned(spark, sf_dir)[0]).select("reason", "n")


@query(f"SELECT CAST(count(*) AS BIGINT) AS raw, CAST(count(*) FILTER ({_DROPPED} IS NULL) AS BIGINT) AS extracted, CAST(count(*) FILTER ({_DROPPED} IS NOT NULL) AS BIGINT) AS dropped FROM orders")
def row_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reconcile(_orders_cleaned(spark, sf_dir)[0]).select("raw", "extracted", "dropped")


@query(_RECORDS)
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.to_records(_orders_cleaned(spark, sf_dir)[0])
    return got.select("sheet", "source_row", "id", "full_name", "date", "amount", "status")


@query(f"""
    WITH r AS ({_RECORDS}), n AS (SELECT count(*) AS total FROM r),
    l AS (SELECT 'id' AS field, id AS v, try_cast(id AS DOUBLE) AS x, source_row FROM r UNION ALL SELECT 'full_name', full_name, NULL, source_row FROM r
          UNION ALL SELECT 'date', date, NULL, source_row FROM r UNION ALL SELECT 'amount', CAST(amount AS VARCHAR), amount, source_row FROM r UNION ALL SELECT 'status', status, NULL, source_row FROM r)
    SELECT field, CAST(any_value(total) AS BIGINT) AS total_count, CAST(any_value(total) - count(v) AS BIGINT) AS null_count,
           (any_value(total) - count(v)) / any_value(total) * 100.0 AS null_pct, CAST(count(DISTINCT v) AS BIGINT) AS unique_count,
           CASE WHEN field IN ('id', 'amount') THEN round(min(x), 2) END AS min_value, CASE WHEN field IN ('id', 'amount') THEN round(max(x), 2) END AS max_value,
           CASE WHEN field = 'date' THEN min(v) END AS min_date, CASE WHEN field = 'date' THEN max(v) END AS max_date,
           CAST(CASE WHEN field = 'amount' THEN count(*) FILTER (x < 0) ELSE 0 END AS BIGINT) AS invalid_count
    FROM l, n GROUP BY field""")
def records_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, mapped = _orders_cleaned(spark, sf_dir, keep=True)
    recs = records.to_records(cleaned)
    long = records.long_records(recs, only=[r.field for r in mapped.collect()])  # a row for each header
    issues = quality.row_issues(cleaned).unionByName(quality.negative_amounts(recs))
    return profiling.profile(long.withColumn("ord", F.col("source_row")), None, issues).select("field", "total_count", "null_count", "null_pct", "unique_count", "min_value", "max_value", "min_date", "max_date", "invalid_count")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({_RECORDS}) WHERE amount < 0")
def suspicious_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, _ = _orders_cleaned(spark, sf_dir, keep=True)
    return quality.suspicious_values(cleaned, records.to_records(cleaned)).select("n")


@query(f"""
    SELECT severity, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT 'info' AS severity, count(*) AS n FROM orders WHERE {_DROPPED} IS NOT NULL
        UNION ALL SELECT 'warning', count(*) FROM ({_RECORDS}) WHERE amount < 0
        UNION ALL SELECT 'warning', 2 * count(*) FROM orders WHERE {_BAD} AND NOT ({_BLANK}) AND NOT ({_HEAD})) GROUP BY 1""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, _ = _orders_cleaned(spark, sf_dir, keep=True)
    issues = quality.row_issues(cleaned).unionByName(quality.negative_amounts(records.to_records(cleaned)))
    return quality.issue_summary(issues)


@query(f"""
    SELECT '[WARNING] orders:row ' || (source_row) || ':col ''amount''' AS place, source_row AS row FROM ({_RECORDS}) WHERE amount < 0""")
def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwright.plans.sinks import issue_place

    issues = quality.negative_amounts(records.to_records(_orders_cleaned(spark, sf_dir)[0]))
    return issues.select(issue_place().alias("place"), "row")


@query(f"SELECT status, CAST(count(*) AS BIGINT) AS n, round(sum(amount), 0) AS amount FROM ({_RECORDS}) GROUP BY status")
def sql_over_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records.to_records(_orders_cleaned(spark, sf_dir)[0]).createOrReplaceTempView("gw_records")
    return spark.sql("SELECT status, count(*) AS n, round(sum(amount), 0) AS amount FROM gw_records GROUP BY status")


# ------------------------------------------------------------------ structure
def _customer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on 25 sheets: title, blank row, header, then a customer a row."""
    text = lambda c: C.text_cell(F.lit(c) if isinstance(c, str) else c)
    c = table(spark, sf_dir, "customer").select(F.expr("CAST(c_custkey % 25 AS INT)").alias("s"), F.expr("c_custkey DIV 25 + 3").alias("row_idx"), "c_custkey", "c_name", "c_nationkey")
    sheet = lambda s: F.concat(F.lit("s"), s.cast("string")).alias("sheet")
    rows = c.select(sheet(F.col("s")), F.col("s").alias("sheet_ord"), F.col("row_idx").cast("long"),
        F.array(C.whole_cell(F.col("c_custkey")), text(F.col("c_name")), C.whole_cell(F.col("c_nationkey"))).alias("cells"))
    top = spark.range(75).select(
        sheet(F.expr("id DIV 3")), F.expr("CAST(id DIV 3 AS INT)").alias("sheet_ord"), F.expr("id % 3").alias("row_idx"),
        F.when(F.expr("id % 3 = 0"), F.array(text("Customer export"), C.null_cell(), C.null_cell()))
        .when(F.expr("id % 3 = 1"), F.array(C.null_cell(), text("  "), C.null_cell()))
        .otherwise(F.array(text("Customer Key"), text("Name"), text("Nation Key"))).alias("cells"),
    )
    return rows.unionByName(top)


_SHEETS = "SELECT 's' || s AS sheet, s FROM range(25) t(s)"
_CUSTOMERS = f"""SELECT 's' || (c_custkey % 25) AS sheet, c_custkey // 25 + 3 AS row_idx, 1 AS texts, 3 AS filled,
    CAST(len(list_distinct([CAST(c_custkey AS VARCHAR), lower(c_name), CAST(c_nationkey AS VARCHAR)])) AS INT) AS uniq FROM customer
    UNION ALL SELECT sheet, 0, 1, 1, 1 FROM ({_SHEETS}) UNION ALL SELECT sheet, 1, 0, 0, 0 FROM ({_SHEETS}) UNION ALL SELECT sheet, 2, 3, 3, 3 FROM ({_SHEETS})"""


@query(f"""
    WITH s AS (SELECT sheet, row_idx, texts / filled * .5 + uniq / filled * .3 + filled / 3 * .2 AS score FROM ({_CUSTOMERS}) WHERE filled > 0 AND row_idx < 15)
    SELECT sheet, CAST(arg_max(row_idx, score * 1000 - row_idx / 1000) AS BIGINT) AS header_row, max(score) >= .4 AS found, CAST(count(*) FILTER (score >= .55) AS BIGINT) AS candidates FROM s GROUP BY sheet""")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.header_rows(_customer_grid(spark, sf_dir)).select("sheet", "header_row", "found", F.size("candidates").cast("long").alias("candidates"))


@query(f"SELECT sheet, CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_cols, sum(3 - filled) / (3 * count(*)) AS sparse_ratio FROM ({_CUSTOMERS}) GROUP BY sheet")
def sheet_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sheet_shapes(_customer_grid(spark, sf_dir)).select("sheet", "n_rows", "n_cols", "sparse_ratio")


@query(f"SELECT sheet, CAST(count(*) AS BIGINT) AS n FROM ({_CUSTOMERS}) WHERE row_idx < 10 GROUP BY sheet")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.limit_rows(_customer_grid(spark, sf_dir), 10).groupBy("sheet").agg(F.count("*").alias("n"))


@query(f"""
    SELECT sheet, CAST(0 AS BIGINT) AS row_idx, 'Customer export' AS c0, 'Customer export' AS c1, 'Customer export' AS c2 FROM ({_SHEETS})
    UNION ALL SELECT sheet, 1, NULL, '  ', NULL FROM ({_SHEETS}) UNION ALL SELECT sheet, 2, 'Customer Key', 'Name', 'Nation Key' FROM ({_SHEETS})
    UNION ALL SELECT 's' || (c_custkey % 25), c_custkey // 25 + 3, CASE WHEN c_custkey // 25 BETWEEN 3 AND 5 THEN CAST(75 + c_custkey % 25 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END, c_name, CAST(c_nationkey AS VARCHAR) FROM customer""")
def merged_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _customer_grid(spark, sf_dir)
    sheets = spark.range(25).selectExpr("concat('s', id) AS sheet")
    title = sheets.selectExpr("sheet", "0L AS r0", "0L AS c0", "0L AS r1", "2L AS c1")
    block = sheets.selectExpr("sheet", "6L AS r0", "0L AS c0", "8L AS r1", "0L AS c1")
    got = structure.fill_merged(grid, title.unionByName(block))
    return got.select("sheet", "row_idx", *[F.get("cells", F.lit(i))["s"].alias(f"c{i}") for i in range(3)])


@query("SELECT 's' || (c_custkey % 25) AS sheet, bool_or(c_custkey % 50 = 7 AND c_custkey // 25 < 100) AS has_formulas FROM customer GROUP BY 1")
def detect_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN c_custkey % 50 = 7 THEN '=SUM(A1:A3)' ELSE c_name END")
    grid = table(spark, sf_dir, "customer").select(F.expr("concat('s', c_custkey % 25)").alias("sheet"), F.lit(0).alias("sheet_ord"), F.expr("c_custkey DIV 25").cast("long").alias("row_idx"), F.array(C.text_cell(text)).alias("cells"))
    return structure.has_formulas(grid)


# ------------------------------------------------------------------ headers
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _header_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, i, c) for t in TABLES for i, c in enumerate(table(spark, sf_dir, t).columns)]
    return mapping.unique_headers(spark.createDataFrame(rows, "sheet string, col_idx int, raw string"))


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '__' || p_brand || ' No.'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part")
def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("__"), "p_brand", F.lit(" No."))
    return table(spark, sf_dir, "part").select("p_partkey", mapping.normalize(raw).alias("norm"))


@query("""
    SELECT CAST(p_size AS VARCHAR) AS sheet, p_partkey AS col_idx, p_brand || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS header
    FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS n FROM part)""")
def header_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("sheet"), F.col("p_partkey").alias("col_idx"), F.col("p_brand").alias("raw"))
    return mapping.unique_headers(h).select("sheet", "col_idx", "header")


_SYNONYMS = ", ".join(f"({i}, '{f}', '{re.sub('[^a-z0-9]+', ' ', x.lower()).strip()}')" for i, f, x in FieldRegistry().synonyms())
_BITS = "CAST(pow(2, length(a)) AS HUGEINT) - 1"
#: The longest common subsequence, as bits of one number, a letter of b at a time.
_LCS = f"""l AS (SELECT a, b, 0 AS i, {_BITS} AS v FROM p
    UNION ALL SELECT a, b, i + 1, ((v + u) | (v - u)) & ({_BITS}) FROM (SELECT *, v & coalesce(list_sum([CASE WHEN substr(a, CAST(j AS INT), 1) = substr(b, i + 1, 1) THEN CAST(pow(2, j - 1) AS HUGEINT) ELSE 0 END
        FOR j IN range(1, length(a) + 1)]), 0) AS u FROM l WHERE i < length(b))),
    ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (length(a) - bit_count(CAST(v AS HUGEINT))) / (length(a) + length(b)) END AS score FROM l WHERE i = length(b))"""


def _mapped_sql(headers: str, select: str) -> str:
    """``select`` over m: (sheet, col_idx, header, field, confidence, method) of the ``headers`` (sheet, col_idx, header)."""
    return f"""WITH RECURSIVE h AS ({headers}), s(syn_ord, field, b) AS (VALUES {_SYNONYMS}),
    names AS (SELECT DISTINCT header, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS a FROM h),
    exact AS (SELECT header, arg_min(field, syn_ord) AS field FROM names JOIN s ON a = b GROUP BY 1),
    rest AS (SELECT * FROM names WHERE header NOT IN (SELECT header FROM exact)),
    p AS (SELECT DISTINCT a, b FROM rest, s), {_LCS},
    scored AS (SELECT header, field, syn_ord, score FROM rest JOIN s ON true JOIN ratios USING (a, b)),
    fuzzy AS (SELECT header, field, score FROM scored QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, syn_ord) = 1),
    m AS (SELECT h.sheet, h.col_idx, h.header, coalesce(exact.field, CASE WHEN score >= .72 THEN fuzzy.field END) AS field,
          CASE WHEN exact.field IS NOT NULL THEN 1.0 ELSE coalesce(score, 0.0) END AS confidence,
          CASE WHEN exact.field IS NOT NULL THEN 'exact' WHEN score >= .72 THEN 'fuzzy' ELSE 'unmapped' END AS method
          FROM h LEFT JOIN exact ON h.header = exact.header LEFT JOIN fuzzy ON h.header = fuzzy.header)
    {select}"""


_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS sheet, CAST(row_number() OVER () - 1 AS INT) AS col_idx, column_name AS header FROM (DESCRIBE {t})" for t in TABLES)


@query(_mapped_sql(_COLUMNS, "SELECT sheet, col_idx, header, field, round(confidence, 3) AS confidence, method FROM m"))
def schema_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names of all tables to canonical fields."""
    got = mapping.map_headers(_header_table(spark, sf_dir))
    return got.select("sheet", "col_idx", "header", "field", F.round("confidence", 3).alias("confidence"), "method")


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey, lower(p_name) AS a, lower(p_brand || ' ' || p_name) AS b FROM part), p AS (SELECT DISTINCT a, b FROM t), {_LCS}
    SELECT p_partkey, round(score, 9) AS ratio FROM t JOIN ratios USING (a, b)""")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))
    return p.select("p_partkey", F.round(indel_ratio(F.lower("p_name"), F.lower(F.concat("p_brand", F.lit(" "), "p_name"))), 9).alias("ratio"))


#: A header a part: exact, misspelt and unknown ones, 24 to a sheet.
_HEADER = """CASE p_partkey % 24 WHEN 0 THEN 'Customer Nmae' WHEN 1 THEN 'E-Mail Adress' WHEN 2 THEN 'Phone #' WHEN 3 THEN 'Totl Amount' WHEN 4 THEN 'Order Dte' WHEN 5 THEN 'Zip' WHEN 6 THEN 'Compny Name'
    WHEN 7 THEN 'STATUS' WHEN 8 THEN 'Qty.' WHEN 9 THEN 'Remarks!!' WHEN 10 THEN 'ref number' WHEN 11 THEN 'Sales Region' WHEN 12 THEN p_brand WHEN 13 THEN 'Grand  Total' WHEN 14 THEN 'mobil no' WHEN 15 THEN 'Adress'
    WHEN 16 THEN 'Clint' WHEN 17 THEN 'sku' WHEN 18 THEN 'Unit price' WHEN 19 THEN 'units sold' WHEN 20 THEN '%' WHEN 21 THEN 'Date of brith' WHEN 22 THEN 'Organisation' ELSE 'Weight (kg)' END"""
_HEADERS = f"SELECT 'p' || (p_partkey // 24) AS sheet, CAST(p_partkey % 24 AS INT) AS col_idx, {_HEADER} AS header FROM part"


def _part_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.expr("concat('p', p_partkey DIV 24)").alias("sheet"), F.expr("CAST(p_partkey % 24 AS INT)").alias("col_idx"), F.expr(_HEADER).alias("raw"))
    return mapping.map_headers(mapping.unique_headers(raw))


@query(_mapped_sql(_HEADERS, "SELECT sheet, col_idx, header, field, round(confidence, 9) AS confidence, method FROM m"))
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_headers(spark, sf_dir).select("sheet", "col_idx", "header", "field", F.round("confidence", 9).alias("confidence"), "method")


@query(_mapped_sql(_HEADERS, "SELECT field, sheet, arg_max(header, col_idx) AS header FROM m WHERE field IS NOT NULL GROUP BY 1, 2"))
def column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.align_columns(_part_headers(spark, sf_dir)).select("field", F.explode("sheets").alias("sheet", "header"))


@query(_mapped_sql(_HEADERS, "SELECT sheet, field, round(arg_max(confidence, col_idx), 9) AS confidence FROM m WHERE field IS NOT NULL GROUP BY 1, 2"))
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.field_confidence(_part_headers(spark, sf_dir)).select("sheet", "field", F.round("confidence", 9).alias("confidence"))


def _one_sheet(spark: SparkSession) -> DataFrame:
    rows = [("c", 0, "Customer Name"), ("c", 1, "Total"), ("c", 2, "Amount Due"), ("c", 3, "Segment")]
    return mapping.unique_headers(spark.createDataFrame(rows, "sheet string, col_idx int, raw string"))


def _customer_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = C.text_cell
    cells = F.array(
        text(F.col("c_name")),
        text(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE concat('$', c_custkey) END")),
        text(F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('', c_custkey * 2) END")),
        text(F.col("c_mktsegment")),
    )
    grid = c.select(F.lit("c").alias("sheet"), F.lit(0).alias("sheet_ord"), (F.col("c_custkey") + 1).alias("row_idx"), cells.alias("cells"))
    heads = mapping.pin(mapping.map_headers(_one_sheet(spark)))
    profiles = spark.range(1).selectExpr("'c' AS sheet", "0L AS header_row")
    return cleaning.clean_rows(grid, profiles, heads)


@query("""
    SELECT c_custkey + 2 AS source_row, c_name AS full_name, CAST(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey WHEN c_custkey % 4 <> 0 THEN c_custkey * 2 END AS DOUBLE) AS amount,
           c_mktsegment AS segment FROM customer""")
def collision_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.to_records(_customer_cleaned(spark, sf_dir))
    return got.select("source_row", "full_name", "amount", F.col("extra")["Segment"].alias("segment"))


@query("SELECT c_custkey + 2 AS source_row, 'Amount Due' AS header, 'amount' AS key FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0")
def collision_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.collisions(_customer_cleaned(spark, sf_dir)).select("source_row", "header", "key")


@query("""SELECT c_custkey + 2 AS source_row, '{"Segment":"' || c_mktsegment || '"}' AS extra_fields FROM customer""")
def records_extra_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_records(_customer_cleaned(spark, sf_dir)).select("source_row", F.to_json("extra").alias("extra_fields"))


_CONTACTS = f"""SELECT c_custkey + 2 AS source_row, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN s <> 'n/a' THEN lower(trim(s)) END AS email, CASE WHEN c_custkey % 3 <> 0 THEN regexp_replace(p, '[^0-9+]', '', 'g') END AS phone,
    CASE WHEN c_custkey % 3 <> 0 THEN p END AS said, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM (SELECT *, {_EMAIL} AS s, {_PHONE.replace("STRING", "VARCHAR")} AS p FROM customer)"""
_NOTED = f"""SELECT *, CASE WHEN NOT regexp_matches(email, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}$') THEN 'does not match a valid email pattern: ''' || email || '''' END AS bad_email,
    CASE WHEN length(replace(phone, '+', '')) < 7 THEN 'too few digits to be a valid phone number: ''' || said || '''' WHEN length(replace(phone, '+', '')) > 15 THEN 'too many digits to be a valid phone number: ''' || said || '''' END AS bad_phone FROM ({_CONTACTS})"""


def _contacts_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the headers Customer ID, E-mail, Phone and a blank one; every third row ends after two cells."""
    text = C.text_cell
    cells = F.array(text(F.col("c_custkey").cast("string")), text(F.expr(_EMAIL)), text(F.expr(_PHONE)), text(F.col("c_mktsegment")))
    cells = F.when(F.col("c_custkey") % 3 == 0, F.slice(cells, 1, 2)).otherwise(cells)
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    rows = c.select(F.lit("contacts").alias("sheet"), F.lit(0).alias("sheet_ord"), (F.col("c_custkey") + 1).cast("long").alias("row_idx"), cells.alias("cells"))
    head = spark.range(1).select(F.lit("contacts").alias("sheet"), F.lit(0).alias("sheet_ord"), F.col("id").alias("row_idx"), F.array(*[text(F.lit(h)) for h in ("Customer ID", "E-mail", "Phone", " ")]).alias("cells"))
    profiles = spark.range(1).selectExpr("'contacts' AS sheet", "0L AS header_row")
    grid = rows.unionByName(head)
    mapped = mapping.pin(mapping.map_headers(mapping.headers_of(grid.where("row_idx = 0"), profiles)))
    return cleaning.clean_rows(grid, profiles, mapped)


@query(f"SELECT source_row, id, email, phone, segment AS column_4, concat_ws('; ', 'E-mail: ' || bad_email, 'Phone: ' || bad_phone) AS noted FROM ({_NOTED})")
def contact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.to_records(_contacts_cleaned(spark, sf_dir))
    return got.select("source_row", "id", "email", "phone", F.col("extra")["column_4"].alias("column_4"), F.array_join("issues", "; ").alias("noted"))


@query(f"""WITH n AS ({_NOTED}), w(value_type, header) AS (VALUES ('email', 'E-mail'), ('phone', 'Phone')),
    bad AS (SELECT source_row AS row, 'email' AS value_type, bad_email AS message FROM n WHERE bad_email IS NOT NULL UNION ALL SELECT source_row, 'phone', bad_phone FROM n WHERE bad_phone IS NOT NULL)
    SELECT row, 'cell_note' AS code, header AS "column", message FROM bad JOIN w USING (value_type)
    UNION ALL SELECT row, 'failed_validation', header, 'Value present but failed validation for field type ''' || value_type || '''.' FROM bad JOIN w USING (value_type)""")
def contact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_issues(_contacts_cleaned(spark, sf_dir)).select("row", "code", "column", "message")


@query(f"SELECT CAST(count(bad_email) + count(bad_phone) AS BIGINT) AS n FROM ({_NOTED})")
def suspicious_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _contacts_cleaned(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return quality.suspicious_values(cleaned, records.to_records(cleaned)).select("n")


# ------------------------------------------------------------------ duplicates
@query("""
    SELECT first_row, event_id AS row FROM (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first_row FROM events) WHERE event_id <> first_row""")
def dups_in_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("e").alias("sheet"), F.lit(0).alias("sheet_ord"), F.col("event_id").alias("source_row"), F.col("user_id").cast("string").alias("id"))
    return quality.duplicates_in_sheet(e).select("first_row", "row")


@query("""
    WITH f AS (SELECT c_nationkey AS k, min(c_custkey) AS first_row FROM customer GROUP BY 1)
    SELECT 'customer' AS first_sheet, first_row, 'supplier' AS sheet, s_suppkey AS row FROM supplier JOIN f ON s_nationkey = k""")
def dups_cross_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("sheet"), F.lit(0).alias("sheet_ord"), F.col("c_custkey").alias("source_row"), F.concat(F.lit(" N"), "c_nationkey").alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("sheet"), F.lit(1).alias("sheet_ord"), F.col("s_suppkey").alias("source_row"), F.concat(F.lit("n"), "s_nationkey").alias("id"))
    return quality.duplicates_across_sheets(c.unionByName(s))


# ------------------------------------------------------------------ sheets against sheets
def _entry(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of orders: a and its copy b, c with a part of them, d with other fields, e with all that are on none of these."""
    o = table(spark, sf_dir, "orders")
    values = F.array(_entry("id", F.col("o_orderkey")), _entry("status", F.col("o_orderstatus")), _entry("notes", F.lit(" ")))
    parts = [
        o.where(cond).select(F.lit(s).alias("sheet"), F.lit(i).alias("sheet_ord"), F.col("o_orderkey").alias("source_row"), v.alias("values"))
        for i, (s, cond, v) in enumerate([("a", "o_orderkey % 3 = 0", values), ("b", "o_orderkey % 3 = 0", values), ("c", "o_orderkey % 6 = 0 OR o_orderkey % 6 = 1", values), ("d", "o_orderkey % 10 = 0", F.array(_entry("company", F.col("o_custkey")))), ("e", "o_orderkey % 6 IN (2, 4, 5) AND o_orderkey % 10 <> 0", values)])
    ]
    return records.union_by_name(parts).withColumn("row_hash", overlap.row_hash(F.col("values")))


_SLICES = """WITH t AS (SELECT 'a' AS s, o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'b', o_orderkey FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 'c', o_orderkey FROM orders WHERE o_orderkey % 6 IN (0, 1) UNION ALL SELECT 'd', -1 - o_custkey FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL SELECT 'e', o_orderkey FROM orders WHERE o_orderkey % 6 IN (2, 4, 5) AND o_orderkey % 10 <> 0),
    n AS (SELECT s, count(*) AS n FROM t GROUP BY 1),
    p AS (SELECT x.s AS a, y.s AS b, x.n AS len_a, y.n AS len_b FROM n x JOIN n y ON x.s < y.s),
    h AS (SELECT x.s AS a, y.s AS b, count(DISTINCT x.k) AS shared FROM t x JOIN t y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2)"""


@query(f"{_SLICES} SELECT p.a, p.b, CAST(len_a AS BIGINT) AS len_a, CAST(len_b AS BIGINT) AS len_b, CAST(coalesce(shared, 0) AS BIGINT) AS shared FROM p LEFT JOIN h ON p.a = h.a AND p.b = h.b")
def row_hash_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slices(spark, sf_dir)
    return overlap.shared_rows(rows, overlap.sheet_pairs(rows)).select("a", "b", "len_a", "len_b", "shared")


@query(f"""{_SLICES} SELECT p.a, p.b, CASE WHEN 'd' IN (p.a, p.b) THEN 'UNIQUE' WHEN len_a = len_b AND len_a = shared THEN 'IDENTICAL' WHEN shared > 0 THEN 'PARTIAL_OVERLAP' ELSE 'UNIQUE' END AS class,
    CASE WHEN 'd' IN (p.a, p.b) OR coalesce(shared, 0) = 0 THEN 0.0 WHEN len_a = len_b AND len_a = shared THEN 100.0 ELSE round(CAST(shared AS DOUBLE) / least(len_a, len_b) * 100, 1) END AS overlap_pct
    FROM p LEFT JOIN h ON p.a = h.a AND p.b = h.b""")
def overlap_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slices(spark, sf_dir)
    fields = spark.createDataFrame([("a", ["id", "status"]), ("b", ["id", "status"]), ("c", ["id", "status"]), ("d", ["company"]), ("e", ["id", "status"])], "sheet string, fields array<string>")
    return overlap.classify(overlap.shared_rows(rows, overlap.sheet_pairs(rows)), fields).select("a", "b", "class", "overlap_pct")


@query("SELECT 'a' AS sheet, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'c', count(*) FROM orders WHERE o_orderkey % 6 IN (0, 1) UNION ALL SELECT 'd', count(*) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'e', count(*) FROM orders WHERE o_orderkey % 6 IN (2, 4, 5) AND o_orderkey % 10 <> 0")
def drop_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slices(spark, sf_dir)
    kinds = overlap.classify(overlap.shared_rows(rows, overlap.sheet_pairs(rows)), spark.createDataFrame([("d", ["company"])], "sheet string, fields array<string>"))
    dropped = overlap.decide([r.asDict() for r in kinds.collect()])[1]  # a row for each pair of sheets
    return overlap.drop_sheets(rows, dropped).groupBy("sheet").agg(F.count("*").alias("n"))


_V2 = "o_orderkey % 4 <> 3"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    v1 = o.where("o_orderkey % 5 <> 4").select(F.lit("v1").alias("sheet"), F.lit(0).alias("sheet_ord"), F.col("o_orderkey").alias("source_row"),
        F.array(_entry("id", F.concat(F.lit(" "), "o_orderkey")), _entry("status", F.col("o_orderstatus")), _entry("notes", F.lit(None))).alias("values"))
    v2 = o.where(_V2).select(F.lit("v2").alias("sheet"), F.lit(1).alias("sheet_ord"), (F.col("o_orderkey") + 7).alias("source_row"),
        F.array(_entry("id", F.col("o_orderkey")), _entry("status", F.expr("CASE WHEN o_orderkey % 6 = 0 THEN lower(o_orderstatus) ELSE concat(o_orderstatus, ' ') END")), _entry("notes", F.lit(""))).alias("values"))
    rows = v1.unionByName(v2).withColumn("row_hash", overlap.row_hash(F.col("values")))
    return rows, overlap.sheet_pairs(rows)


@query(f"""
    SELECT 'v1' AS a, 'v2' AS b, CAST(c AS BIGINT) AS common, CAST(x AS BIGINT) AS only_a, CAST(y AS BIGINT) AS only_b, round(CAST(c AS DOUBLE) / (c + x + y) * 100.0, 1) AS overlap_pct
    FROM (SELECT count(*) FILTER (o_orderkey % 5 <> 4 AND {_V2}) AS c, count(*) FILTER (o_orderkey % 5 <> 4 AND NOT ({_V2})) AS x, count(*) FILTER (o_orderkey % 5 = 4 AND {_V2}) AS y FROM orders)""")
def sheet_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.sheet_diffs(*_versions(spark, sf_dir))[0]


@query(f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS row_a, o_orderkey + 7 AS row_b, 'status' AS field, o_orderstatus AS val_a, lower(o_orderstatus) AS val_b
    FROM orders WHERE o_orderkey % 5 <> 4 AND {_V2} AND o_orderkey % 6 = 0 AND lower(o_orderstatus) <> o_orderstatus""")
def sheet_diff_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.sheet_diffs(*_versions(spark, sf_dir))[1].drop("a", "b")


@query(f"""
    SELECT 'a' AS side, o_orderkey AS source_row FROM orders WHERE o_orderkey % 5 <> 4 AND NOT ({_V2})
    UNION ALL SELECT 'b', o_orderkey + 7 FROM orders WHERE o_orderkey % 5 = 4 AND {_V2}""")
def only_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.sheet_diffs(*_versions(spark, sf_dir))[2].drop("a", "b")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS row_a, o_orderkey + 7 AS row_b FROM orders WHERE o_orderkey % 5 <> 4 AND {_V2}")
def sheet_diff_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.common_rows(*_versions(spark, sf_dir)).drop("a", "b")


@query("""
    WITH x AS (SELECT lower(o_orderstatus) || '/' || o_orderdate || '/' || (o_orderkey // 4) AS k, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1),
    y AS (SELECT lower(o_orderstatus) || '/' || o_orderdate || '/' || (o_orderkey // 4) AS k, count(*) AS n FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1)
    SELECT 'u1' AS a, 'u2' AS b, CAST(coalesce(sum(x.n) FILTER (y.n IS NOT NULL), 0) AS BIGINT) AS common, CAST(coalesce(sum(x.n) FILTER (y.n IS NULL), 0) AS BIGINT) AS only_a, CAST(coalesce(sum(y.n) FILTER (x.n IS NULL), 0) AS BIGINT) AS only_b
    FROM x FULL JOIN y ON x.k = y.k""")
def sheet_diff_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets without a key field: rows meet by the hash of all their values."""
    o = table(spark, sf_dir, "orders")
    place = F.expr("concat(o_orderdate, '/', o_orderkey DIV 4)")
    parts = [
        o.where(cond).select(F.lit(sheet).alias("sheet"), F.lit(i).alias("sheet_ord"), F.col("o_orderkey").alias("source_row"), F.array(_entry("status", status), _entry("date", place), _entry("notes", F.lit(" "))).alias("values"))
        for i, (sheet, cond, status) in enumerate([("u1", "o_orderkey % 4 < 3", F.col("o_orderstatus")), ("u2", "o_orderkey % 4 > 0", F.concat(F.lit(" "), F.lower("o_orderstatus")))])
    ]
    rows = records.union_by_name(parts).withColumn("row_hash", overlap.row_hash(F.col("values")))
    return overlap.sheet_diffs(rows, overlap.sheet_pairs(rows))[0].select("a", "b", "common", "only_a", "only_b")


@query("""
    SELECT c_name AS full_name, c_acctbal AS amount, c_mktsegment AS status, 'customer' AS source_sheet FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier""")
def union_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("status"), F.lit("customer").alias("source_sheet"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("full_name"), F.col("s_acctbal").alias("amount"), F.lit("supplier").alias("source_sheet"))
    return records.union_by_name([c, s])


# ------------------------------------------------------------------ files in and out
_FILE = """SELECT c_custkey AS id, c_name AS full_name, CASE c_custkey % 4 WHEN 0 THEN 'c' || c_custkey || '@example.com' WHEN 1 THEN 'no address' WHEN 2 THEN 'N/A' END AS email,
    CASE WHEN c_custkey % 5 = 0 THEN '(' || c_custkey || ')' ELSE '$' || c_custkey || '.5' END AS amount, c_mktsegment || ', "' || c_nationkey || '"' AS Segment FROM customer"""
_FILE_RECORDS = f"""SELECT 'csv_data' AS sheet, row_number() OVER (ORDER BY id) + 1 AS source_row, CAST(id AS VARCHAR) AS id, full_name, CASE WHEN email <> 'N/A' THEN email END AS email,
    CASE WHEN id % 5 = 0 THEN -id ELSE id + .5 END AS amount, Segment AS segment FROM ({_FILE})"""


def _local_folder() -> str:
    """A folder of this process: what is written there is written and read by the driver alone."""
    found = tempfile.mkdtemp(prefix="gridwright-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def _shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and the executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + _local_folder()
    return f"{base.rstrip('/')}/gridwright-file-{uuid.uuid4().hex}"


def _file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("gw_customer")
    return spark.sql(_FILE.replace("FROM customer", "FROM gw_customer"))


def _customer_file(spark: SparkSession, sf_dir: str) -> str:
    """One delimited file of all customers; such files are bounded by ``max_file_size_mb``."""
    path = _shared_folder(spark)
    _file_rows(spark, sf_dir).repartition(1).sortWithinPartitions("id").write.options(header=True, escape='"', quote='"').csv(path)
    return path


def _extracted(spark: SparkSession, sf_dir: str) -> pipeline.Extraction:
    return pipeline.extract(spark, _customer_file(spark, sf_dir), Settings(max_rows_per_sheet=0))


@query(_FILE_RECORDS)
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file through detection, reading, mapping and cleaning."""
    return _extracted(spark, sf_dir).records.select("sheet", "source_row", "id", "full_name", "email", "amount", F.col("extra")["Segment"].alias("segment"))


@query(f"""WITH r AS ({_FILE_RECORDS}), f(sink) AS (VALUES ('csv'), ('json'), ('sqlite'), ('table'), ('csv_folder'), ('json_lines'))
    SELECT sink, source_row, id, full_name, email, amount, segment FROM r, f""")
def file_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, read back from every kind of output."""
    x = _extracted(spark, sf_dir)
    local, folder = _local_folder(), _shared_folder(spark)
    sinks_dir = x.write(local)
    x.append_sqlite(f"{local}/records.db")
    x.append_table(f"{folder}/table")
    x.write_folders(folder)
    ddl = "sink string, source_row bigint, id string, full_name string, email string, amount double, segment string"
    with open(sinks_dir / "cleaned_data.csv", newline="", encoding="utf-8") as f:
        rows = [("csv", int(r["_source_row"]), r["id"], r["full_name"], r["email"] or None, float(r["amount"]), r["Segment"]) for r in csv.DictReader(f)]
    data = json.loads((sinks_dir / "extracted_data.json").read_text(encoding="utf-8"))["records"]
    rows += [("json", r["_source_row"], r["id"], r["full_name"], r["email"], r["amount"], r["Segment"]) for r in data]
    with sqlite3.connect(f"{local}/records.db") as db:
        rows += [("sqlite", *r[:5], json.loads(r[5])["Segment"]) for r in db.execute("SELECT source_row, id, full_name, email, amount, extra_fields FROM records")]
    out = spark.createDataFrame(rows, ddl)
    at_rest = spark.read.parquet(f"{folder}/table").select(F.lit("table").alias("sink"), "source_row", "id", "full_name", "email", "amount", F.get_json_object("extra_fields", "$.Segment").alias("segment"))
    flat = spark.read.options(header=True, escape='"').csv(f"{folder}/csv").select(F.lit("csv_folder").alias("sink"), F.col("_source_row").cast("long").alias("source_row"), "id", "full_name", "email", F.col("amount").cast("double").alias("amount"), F.col("Segment").alias("segment"))
    lines = spark.read.json(f"{folder}/json").select(F.lit("json_lines").alias("sink"), F.col("_source_row").alias("source_row"), "id", "full_name", "email", "amount", F.col("Segment").alias("segment"))
    return records.union_by_name([out, at_rest, flat, lines])


_FILE_ISSUES = f"""SELECT '[WARNING] csv_data:row ' || source_row || ':col ''email'' -- ' || m AS line FROM ({_FILE_RECORDS}), (VALUES ('does not match a valid email pattern: ' || chr(39) || 'no address' || chr(39)), ('Value present but failed validation for field type ''email''.')) t(m) WHERE email = 'no address'
    UNION ALL SELECT '[WARNING] csv_data:row ' || source_row || ':col ''amount'' -- Suspicious negative amount: ' || CAST(CAST(amount AS DOUBLE) AS VARCHAR) FROM ({_FILE_RECORDS}) WHERE amount < 0
    UNION ALL SELECT '[WARNING] csv_data:row ' || source_row || ':col ''amount'' -- currency symbols/commas stripped' FROM ({_FILE_RECORDS}) WHERE CAST(id AS BIGINT) % 5 <> 0"""


@query(_FILE_ISSUES)
def file_issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Path(_local_folder()) / "issues.txt"
    sinks.write_issue_log(_extracted(spark, sf_dir).issues, path)
    return spark.createDataFrame([(x,) for x in path.read_text(encoding="utf-8").splitlines()], "line string")


@query("""SELECT * FROM (VALUES (0, 'id', 'id', 1.0::DOUBLE, 'exact'), (1, 'full_name', 'full_name', 1.0, 'exact'), (2, 'email', 'email', 1.0, 'exact'), (3, 'amount', 'amount', 1.0, 'exact'), (4, 'Segment', NULL, 0.5, 'unmapped')) t(nth, header, field, confidence, method)
    WHERE (SELECT count(*) FROM customer) > 0""")
def file_schema_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Path(_local_folder()) / "schema_map.json"
    sinks.write_schema_map(_extracted(spark, sf_dir).mapped, path)
    found = json.loads(path.read_text(encoding="utf-8"))["csv_data"]
    rows = [(i, h, m["canonical_field"], m["confidence"] if m["canonical_field"] else 0.5, m["method"]) for i, (h, m) in enumerate(found.items())]
    return spark.createDataFrame(rows, "nth int, header string, field string, confidence double, method string")


@query(f"""WITH r AS ({_FILE_RECORDS}), i AS ({_FILE_ISSUES}), n AS (SELECT count(*) AS n FROM r),
    q AS (SELECT greatest(0.0, round(100.0 - (count(*) FILTER (email IS NULL) * 100.0 / count(*) * .5 + 2 * count(*) FILTER (email = 'no address') * 100.0 / count(*) * .5), 1)) AS email,
          greatest(0.0, round(100.0 - count(*) FILTER (CAST(id AS BIGINT) <> 0) * 100.0 / count(*) * .5, 1)) AS amount FROM r)
    SELECT CAST((SELECT n FROM n) AS BIGINT) AS records, CAST(0 AS BIGINT) AS errors, CAST((SELECT count(*) FROM i) AS BIGINT) AS warnings, round((300.0 + email + amount) / 5, 1) AS overall_quality FROM q""")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand in the readable report."""
    text = report.render(_extracted(spark, sf_dir).report_facts())
    of = lambda pattern: float(re.search(pattern, text)[1])
    row = (int(of(r"Total records extracted:\*\* (\d+)")), int(of(r"Errors: (\d+)")), int(of(r"Warnings: (\d+)")), of(r"Overall quality:\*\* ([\d.]+)%"))
    return spark.createDataFrame([row], "records bigint, errors bigint, warnings bigint, overall_quality double")


@query("SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS row_idx, CAST(l_orderkey AS VARCHAR) AS a, l_returnflag || ',\"' AS b, CASE WHEN l_partkey % 9 = 0 THEN CAST(l_partkey AS VARCHAR) END AS c FROM lineitem")
def scan_large_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text of any size: a title line, quoted delimiters, rows of two and three cells."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    line = F.concat(F.col("l_orderkey"), F.lit(',"'), F.col("l_returnflag"), F.lit(',"""'), F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit(","), "l_partkey")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "lineitem").select(*order, line.alias("value"))
    title = spark.range(1).select(F.lit("Line items").alias("value"))
    path = _shared_folder(spark)
    title.unionByName(rows, allowMissingColumns=True).repartition(1).sortWithinPartitions(*order).select("value").write.text(path)  # the title has no keys, so it is first
    got = files.read_large_delimited(spark, path).where("cells[1].s IS NOT NULL")
    return got.select("row_idx", *[F.col("cells")[i]["s"].alias(c) for i, c in enumerate("abc")])


# ------------------------------------------------------------------ profiles
def _lineitem_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of lineitem in long form; ord is any total order: the key columns and quantity."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", "l_partkey"))
    none = F.lit(None).cast("double")
    parts = F.array(
        F.struct(F.lit("quantity").alias("field"), F.lit(None).cast("string").alias("value"), F.col("l_quantity").alias("num")),
        F.struct(F.lit("flag").alias("field"), F.expr("CASE WHEN l_orderkey % 10 = 0 THEN ' ' ELSE l_returnflag END").alias("value"), none.alias("num")),
        F.struct(F.lit("shipped").alias("field"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("value"), none.alias("num")),
        F.struct(F.lit("part").alias("field"), F.col("l_partkey").cast("string").alias("value"), none.alias("num")),
    )
    rows = li.select(F.col("l_orderkey").alias("ord"), F.explode(parts).alias("x")).select("ord", "x.*")
    return rows.withColumn("value", F.coalesce("value", C.float_text(F.col("num"))))


@query("""
    WITH n AS (SELECT count(*) AS total FROM lineitem)
    SELECT 'quantity' AS field, CAST(any_value(total) AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS null_count, round(min(l_quantity), 2) AS min_value, round(max(l_quantity), 2) AS max_value, round(avg(l_quantity), 2) AS mean_value, NULL AS min_date, NULL AS max_date FROM lineitem, n
    UNION ALL SELECT 'flag', any_value(total), count(*) FILTER (l_orderkey % 10 = 0), NULL, NULL, NULL, NULL, NULL FROM lineitem, n
    UNION ALL SELECT 'shipped', any_value(total), 0, NULL, NULL, NULL, min(strftime(l_shipdate, '%Y-%m-%d')), max(strftime(l_shipdate, '%Y-%m-%d')) FROM lineitem, n
    UNION ALL SELECT 'part', any_value(total), 0, round(min(l_partkey), 2), round(max(l_partkey), 2), round(avg(l_partkey), 2), NULL, NULL FROM lineitem, n""")
def profile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.field_stats(_lineitem_long(spark, sf_dir)).drop("null_pct")


@query("""
    WITH v AS (SELECT event_type AS v, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS rank FROM v)
    SELECT 'event_type' AS field, (SELECT CAST(count(*) AS BIGINT) FROM v) AS unique_count, CAST(rank AS INT) AS rank, v AS value, CAST(n AS BIGINT) AS n FROM r WHERE rank <= 5""")
def profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("event_type").alias("field"), F.col("event_type").alias("value"), F.col("event_id").alias("ord"))
    got = profiling.top_values(e).select("field", "unique_count", F.posexplode("top_values").alias("rank", "x"))
    return got.select("field", "unique_count", (F.col("rank") + 1).alias("rank"), "x.value", "x.n")


@query("""
    WITH n AS (SELECT count(*) AS total, count(*) FILTER (c_custkey % 7 = 0) AS nulls, count(*) FILTER (c_acctbal < 0) AS bad FROM customer)
    SELECT 'amount' AS field, nulls / total * 100.0 AS null_pct, bad / total * 100.0 AS invalid_pct, greatest(0.0, round(100.0 - (nulls / total * 100.0 * 0.5 + bad / total * 100.0 * 0.5), 1)) AS quality_score FROM n""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    num = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    long = c.select(F.lit("amount").alias("field"), F.col("c_custkey").alias("ord"), C.float_text(num).alias("value"), num.alias("num"))
    issues = c.where("c_acctbal < 0").select(F.lit("amount").alias("column"))
    return profiling.profile(long, c.count(), issues).select("field", "null_pct", "invalid_pct", "quality_score")
