"""Headers to canonical fields: exact match, else the most similar synonym, else a callable, else unmapped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.cells import strip
from gridwright.functions.fields import FieldRegistry
from gridwright.functions.similarity import indel_ratio

THRESHOLD = 0.72
LLM_CONFIDENCE = 0.6
Suggest = Callable[[str, list[str]], "str | None"]


def header_name(s: Column, col_idx: Column) -> Column:
    """The stripped text of a header cell; column_1, column_2, ... where there is none."""
    return F.coalesce(F.nullif(strip(s), F.lit("")), F.concat(F.lit("column_"), (col_idx + 1).cast("string")))


def headers_of(grid: DataFrame, profiles: DataFrame) -> DataFrame:
    """(sheet, col_idx, raw, header) from each sheet's header row."""
    rows = grid.join(profiles.select("sheet", "header_row"), "sheet").where(F.col("row_idx") == F.col("header_row"))
    cells = rows.select("sheet", F.posexplode("cells").alias("col_idx", "cell"))
    s = F.when(F.col("cell.kind") != "null", F.col("cell.s"))
    return unique_headers(cells.select("sheet", "col_idx", header_name(s, F.col("col_idx")).alias("raw")))


def unique_headers(headers: DataFrame) -> DataFrame:
    """Adds ``header``: the nth repeat of a name within its sheet is name_n."""
    nth = F.row_number().over(Window.partitionBy("sheet", "raw").orderBy("col_idx"))
    return headers.withColumn("header", F.when(nth > 1, F.concat("raw", F.lit("_"), nth.cast("string"))).otherwise(F.col("raw")))


def normalize(s: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 are one space; stripped."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def synonym_table(spark: SparkSession, registry: FieldRegistry) -> DataFrame:
    """(syn_ord, field, synonym), normalised, one partition: as many rows as the schema has synonyms."""
    rows = spark.createDataFrame(registry.synonyms(), "syn_ord int, field string, synonym string").coalesce(1)
    return rows.withColumn("synonym", normalize(F.col("synonym")))


def map_headers(headers: DataFrame, registry: FieldRegistry | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``headers`` with field, confidence and method (exact, fuzzy, unmapped).

    Each distinct name meets the schema's synonyms (a small broadcast table) once;
    the best is an aggregate, so there is no window over the pairs.  Unmapped names keep
    their best score.
    """
    registry = registry or FieldRegistry()
    spark = headers.sparkSession
    names = headers.select("header").distinct().withColumn("norm", normalize(F.col("header")))
    synonyms = F.broadcast(synonym_table(spark, registry))
    exact = names.join(synonyms, F.col("norm") == F.col("synonym")).groupBy("header").agg(F.min_by("field", "syn_ord").alias("exact"))
    rest = names.join(exact, "header", "left_anti").where(F.trim("header") != "")
    scored = rest.crossJoin(synonyms).withColumn("score", indel_ratio(F.col("norm"), F.col("synonym")))
    fuzzy = scored.groupBy("header").agg(
        F.max_by("field", F.struct("score", -F.col("syn_ord"))).alias("best"), F.max("score").alias("score")
    )
    found = names.join(exact, "header", "left").join(fuzzy, "header", "left")
    good = F.col("score") >= threshold
    return headers.join(
        found.select(
            "header",
            F.coalesce("exact", F.when(good, F.col("best"))).alias("field"),
            F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"),
            F.when(F.col("exact").isNotNull(), "exact").when(good, "fuzzy").otherwise("unmapped").alias("method"),
        ),
        "header",
    )


def pin(metadata: DataFrame) -> DataFrame:
    """``metadata`` computed now and held as a local table: a row for each header or sheet, never for data.

    Plans over the data then broadcast it, instead of working it out again in every branch.
    """
    return metadata.sparkSession.createDataFrame(metadata.collect(), metadata.schema)


def sanitize_header(header: str) -> str:
    """A header fit for a prompt: its first 100 characters, no control characters, no double quotes."""
    return "".join(c for c in header[:100] if ord(c) >= 32).replace('"', "'")


def suggest_fields(mapped: DataFrame, suggest: Suggest, registry: FieldRegistry | None = None) -> DataFrame:
    """Ask ``suggest`` for what stayed unmapped, once for each name, on the driver.

    An answer counts only if it is a field of the schema; failures leave the header unmapped.
    """
    registry = registry or FieldRegistry()
    spark, names = mapped.sparkSession, list(registry.fields)
    rows = []
    for r in mapped.where("method = 'unmapped'").select("header").distinct().collect():  # headers, not data
        try:
            answer = (suggest(sanitize_header(r.header), names) or "").strip()
        except Exception:  # any failure of the helper means no suggestion
            answer = ""
        if answer in registry.fields:
            rows.append((r.header, answer))
    if not rows:
        return mapped
    table = F.broadcast(spark.createDataFrame(rows, "header string, suggested string"))
    out = mapped.join(table, "header", "left")
    got = F.col("suggested").isNotNull()
    return out.select(
        *[c for c in mapped.columns if c not in ("field", "confidence", "method")],
        F.coalesce("suggested", "field").alias("field"),
        F.when(got, LLM_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
        F.when(got, "llm").otherwise(F.col("method")).alias("method"),
    )


def align_columns(mapped: DataFrame) -> DataFrame:
    """(field, sheets): for each field the header of every sheet that has it; a sheet's last header wins."""
    last = mapped.where("field IS NOT NULL").groupBy("field", "sheet").agg(F.max_by("header", "col_idx").alias("header"))
    return last.groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sheet", "header")))).alias("sheets"))


def field_confidence(mapped: DataFrame) -> DataFrame:
    """(sheet, field, confidence); a sheet's last header for a field wins."""
    return mapped.where("field IS NOT NULL").groupBy("sheet", "field").agg(F.max_by("confidence", "col_idx").alias("confidence"))
