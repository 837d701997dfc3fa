"""What was dropped, what is doubled, what looks wrong: reports that only observe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.cells import float_text, strip
from gridwright.operators.records import LINEAGE, collisions, has_value

KEY_FIELDS = ("email", "id", "full_name")


# ------------------------------------------------------------------ issues
def row_issues(cleaned: DataFrame) -> DataFrame:
    """(sheet, sheet_ord, severity, code, row, column, message, stage, nth) noted while cleaning."""
    rows = cleaned.select("sheet", "sheet_ord", F.col("source_row").alias("row"), F.posexplode("issues").alias("nth", "x"))
    return rows.select("sheet", "sheet_ord", "x.severity", "x.code", "row", "x.column", "x.message", F.lit(2).alias("stage"), "nth")


def collision_issues(cleaned: DataFrame) -> DataFrame:
    found = collisions(cleaned)
    message = F.concat(F.lit("Two columns hold '"), "key", F.lit("'; an earlier one has a value, so that of '"), "header", F.lit("' is left out."))
    return found.select(
        "sheet", "sheet_ord", F.lit("warning").alias("severity"), F.lit("collision").alias("code"),
        F.col("source_row").alias("row"), F.col("header").alias("column"), message.alias("message"), F.lit(3).alias("stage"), F.lit(0).alias("nth"),
    )


def negative_amounts(records: DataFrame) -> DataFrame:
    bad = records.where("amount < 0")
    return bad.select(
        "sheet", "sheet_ord", F.lit("warning").alias("severity"), F.lit("negative_amount").alias("code"), F.col("source_row").alias("row"),
        F.lit("amount").alias("column"), F.concat(F.lit("Suspicious negative amount: "), float_text(F.col("amount"))).alias("message"),
        F.lit(4).alias("stage"), F.lit(0).alias("nth"),
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ dropped rows
def dropped_reasons(cleaned: DataFrame) -> DataFrame:
    """(sheet, reason, n)."""
    return cleaned.where("dropped IS NOT NULL").groupBy("sheet", F.col("dropped").alias("reason")).agg(F.count("*").alias("n"))


def reconcile(cleaned: DataFrame) -> DataFrame:
    """(sheet, raw, extracted, dropped): raw = extracted + dropped, for every sheet."""
    return cleaned.groupBy("sheet").agg(
        F.count("*").alias("raw"), F.count_if(F.col("dropped").isNull()).alias("extracted"), F.count_if(F.col("dropped").isNotNull()).alias("dropped")
    )


def suspicious_values(cleaned: DataFrame, records: DataFrame) -> DataFrame:
    """(sheet, n): negative amounts and values that failed validation."""
    failed = F.size(F.filter("issues", lambda x: x["code"] == "failed_validation"))
    a = cleaned.groupBy("sheet").agg(F.sum(failed).alias("n"))
    b = records.groupBy("sheet").agg(F.count_if(F.col("amount") < 0).alias("n"))
    return a.unionByName(b).groupBy("sheet").agg(F.sum("n").cast("long").alias("n"))


# ------------------------------------------------------------------ duplicates
def duplicate_key(columns: list[tuple[str, Column]]) -> Column:
    """'field::value' of the first field that has a value, stripped and in lower case; null: no key."""
    return F.coalesce(*[F.when(has_value(c), F.concat(F.lit(f"{name}::"), F.lower(strip(c)))) for name, c in columns], F.lit(None).cast("string"))


def with_key(records: DataFrame, fields: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    types = dict(records.dtypes)
    text = [(f, float_text(F.col(f)) if types[f] == "double" else F.col(f).cast("string")) for f in fields if f in types]
    return records.withColumn("dup_key", duplicate_key(text))


def duplicates_in_sheet(records: DataFrame, fields: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    """(sheet, first_row, row): every later record with the key of an earlier one of its sheet.

    The first row of a key is an aggregate that is joined back, so a key that many
    records share is combined before it is shuffled and its rows may be split over tasks.
    """
    keyed = with_key(records, fields).where("dup_key IS NOT NULL").select("sheet", "source_row", "dup_key")
    first = keyed.groupBy("sheet", "dup_key").agg(F.min("source_row").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, ["sheet", "dup_key"]).where("source_row > first_row").select("sheet", "first_row", F.col("source_row").alias("row"))


def first_duplicates(found: DataFrame, most: int) -> DataFrame:
    """(sheet, n, first): the number of a sheet's duplicates and the first ``most`` of them, as (row, first_row); no other pair is gathered."""
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("row"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", "first_row"))).alias("first"))
    return found.groupBy("sheet").agg(F.count("*").alias("n")).join(top, "sheet")


def duplicates_across_sheets(records: DataFrame, fields: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    """(first_sheet, first_row, sheet, row): records whose key first occurred on another sheet."""
    keyed = with_key(records, fields).where("dup_key IS NOT NULL").select(*LINEAGE, "dup_key")
    first = keyed.groupBy("dup_key").agg(F.min(F.struct("sheet_ord", "source_row", "sheet")).alias("f"), (F.min("sheet_ord") != F.max("sheet_ord")).alias("many"))
    return (
        keyed.join(first.where("many"), "dup_key")
        .where("sheet <> f.sheet")
        .select(F.col("f.sheet").alias("first_sheet"), F.col("f.source_row").alias("first_row"), "sheet", F.col("source_row").alias("row"))
    )
