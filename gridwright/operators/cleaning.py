"""Rows of a grid to cleaned values with their evidence, in one pass.

Every data row gets ``values`` (one struct for each header, in column order), ``dropped``
(the reason, if it is dropped) and ``issues`` (what was noticed, in order).  The
headers of a sheet are one row of a small table, broadcast to its data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.cells import is_placeholder, let, null_cell, once
from gridwright.functions.clean import cell_text, clean_by, cleaners, squeeze
from gridwright.functions.fields import FieldRegistry

REPEATED = 0.8
BLANK, HEADER, MALFORMED = "blank_or_separator_row", "repeated_header_row", "empty_or_malformed"
ISSUE = "struct<severity: string, code: string, column: string, message: string>"
#: What is said of a dropped row.
MESSAGES = {
    BLANK: "Left out: no cell of the row holds a value.",
    HEADER: "Left out: the row says the headers again.",
    MALFORMED: "Left out: nothing usable is left of the row once its cells are cleaned.",
}


def header_arrays(mapped: DataFrame, registry: FieldRegistry) -> DataFrame:
    """(sheet, headers): array of (col_idx, header, field, value_type, key, said) in column order; said: as it repeats in a row."""
    kinds = F.create_map(*[F.lit(x) for f, (t, _) in registry.fields.items() for x in (f, t)])
    kind = F.coalesce(F.element_at(kinds, F.col("field")), F.lit("text"))
    one = F.struct("col_idx", "header", "field", kind.alias("value_type"), F.coalesce("field", "header").alias("key"), F.coalesce(F.lower(squeeze(F.col("header"))), F.lit("")).alias("said"))
    return mapped.groupBy("sheet").agg(F.array_sort(F.collect_list(one)).alias("headers"))


def is_blank(cells: Column) -> Column:
    return F.forall(cells, is_placeholder)


def repeats_header(cells: Column, headers: Column) -> Column:
    """Do at least .8 of the headers stand in their own columns, whatever their case?"""
    same = F.filter(headers, lambda h: (h["said"] != "") & (F.lower(cell_text(F.get(cells, h["col_idx"]))) == h["said"]))
    meaningful = F.size(F.filter(headers, lambda h: h["said"] != ""))
    return (meaningful > 0) & (F.size(same) >= REPEATED * meaningful)


def _issue(severity: str, code: Column | str, column: Column, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), column.alias("column"), message.alias("message"))


def clean_rows(grid: DataFrame, profiles: DataFrame, mapped: DataFrame, locale: str = "us", registry: FieldRegistry | None = None) -> DataFrame:
    """(sheet, sheet_ord, source_row, dropped, values, issues) of every row after its sheet's header.

    source_row counts from 1 within the grid.  Blank rows go first, then repeats of
    the header, then rows of which nothing is left after cleaning.

    All of a row's cleaning is one expression, bound once, so each cell is cleaned
    once however often the result is filtered and selected from.
    """
    registry = registry or FieldRegistry()
    table = cleaners(locale)
    heads = F.broadcast(header_arrays(mapped, registry).join(profiles.select("sheet", "header_row"), "sheet"))
    rows = grid.join(heads, "sheet").where(F.col("row_idx") > F.col("header_row"))
    cells, headers = F.col("cells"), F.col("headers")

    def value(h: Column) -> Column:
        flat = lambda x: F.struct(h["header"].alias("header"), h["field"].alias("field"), h["key"].alias("key"), h["value_type"].alias("value_type"), x["value"].alias("value"), x["num"].alias("num"), x["valid"].alias("valid"), x["note"].alias("note"))
        return let(let(F.coalesce(F.get(cells, h["col_idx"]), null_cell()), lambda cell: clean_by(h["value_type"], cell, table)), flat)

    def judged(early: Column, values: Column) -> Column:
        gone = early.isNull() & ~F.exists(values, lambda x: x["value"].isNotNull())
        return let(F.when(gone, MALFORMED).otherwise(early), lambda dropped: F.struct(dropped.alias("dropped"), values.alias("values"), _row_issues(values, dropped).alias("issues")))

    early = F.when(is_blank(cells), BLANK).when(repeats_header(cells, headers), HEADER)
    made = let(early, lambda e: let(F.when(e.isNull(), F.transform(headers, value)), lambda values: judged(e, values)))
    rows = rows.select("sheet", "sheet_ord", (F.col("row_idx") + 1).alias("source_row"), once(made).alias("made"))
    return rows.select("sheet", "sheet_ord", "source_row", "made.dropped", "made.values", "made.issues")


def _row_issues(values: Column, dropped: Column) -> Column:
    """What is noted of the cells, in column order, then why the row is dropped."""
    of_cell = lambda x: F.array(
        F.when(x["note"].isNotNull(), _issue("warning", "cell_note", x["header"], x["note"])),
        F.when(~x["valid"] & x["value"].isNotNull(), _issue("warning", "failed_validation", x["header"], F.concat(F.lit("Value present but failed validation for field type '"), x["value_type"], F.lit("'.")))),
    )
    none = F.array().cast(f"array<{ISSUE}>")
    noted = F.array_compact(F.flatten(F.transform(values, of_cell))).cast(f"array<{ISSUE}>")
    messages = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    reason = F.array(_issue("info", dropped, F.lit(None).cast("string"), F.element_at(messages, dropped))).cast(f"array<{ISSUE}>")
    return F.concat(F.coalesce(noted, none), F.when(dropped.isNotNull(), reason).otherwise(none))
