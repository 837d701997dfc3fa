"""Cleaned rows to canonical records: one column for each canonical field, the rest in a map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.fields import FieldRegistry

LINEAGE = ["sheet", "sheet_ord", "source_row"]


def has_value(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _of_key(key: Column) -> Column:
    return F.filter("values", lambda x: x["key"] == key)


def first_value(values: Column, part: str) -> Column:
    """The first value in column order that is neither null nor empty."""
    return F.get(F.filter(values, lambda x: has_value(x["value"])), F.lit(0))[part]


def to_records(cleaned: DataFrame, registry: FieldRegistry | None = None) -> DataFrame:
    """(sheet, sheet_ord, source_row, canonical fields, extra, issues) of the rows that were kept.

    ``extra`` holds what has no canonical field under its own header; ``issues`` are the notes on
    cells, each after its header.
    """
    registry = registry or FieldRegistry()
    kept = cleaned.where("dropped IS NULL")
    columns = {}
    for name in registry.fields:
        own = _of_key(F.lit(name))
        columns[name] = first_value(own, "num" if name in registry.numeric() else "value")
    known = list(registry.fields)
    rest = F.filter("values", lambda x: ~x["key"].isin(*known))
    extra = F.map_from_entries(F.transform(rest, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    notes = F.transform(F.filter("issues", lambda x: x["code"] == "cell_note"), lambda x: F.concat(x["column"], F.lit(": "), x["message"]))
    return kept.select(*LINEAGE, *[c.alias(n) for n, c in columns.items()], extra.alias("extra"), notes.alias("issues"))


def collisions(cleaned: DataFrame) -> DataFrame:
    """(sheet, sheet_ord, source_row, header, key): non-empty values that gave way to an earlier column of the same key."""
    filled = F.filter("values", lambda x: has_value(x["value"]))
    rows = cleaned.where("dropped IS NULL").withColumn("filled", filled)
    keys = F.transform("filled", lambda x: x["key"])
    late = F.filter("filled", lambda x, i: F.array_position(keys, x["key"]) <= i)
    rows = rows.select(*LINEAGE, F.explode(late).alias("x"))
    return rows.select(*LINEAGE, F.col("x.header").alias("header"), F.col("x.key").alias("key"))


def long_records(records: DataFrame, registry: FieldRegistry | None = None, only: list[str] | None = None) -> DataFrame:
    """(sheet, sheet_ord, source_row, field, value, num) for every field of every record, also null ones; ``only``: of these fields."""
    registry = registry or FieldRegistry()
    numeric = set(registry.numeric())
    fields = [f for f in registry.fields if only is None or f in only]
    from gridwright.functions.cells import float_text

    entries = [
        F.struct(
            F.lit(f).alias("field"),
            (float_text(F.col(f)) if f in numeric else F.col(f)).alias("value"),
            (F.col(f) if f in numeric else F.lit(None).cast("double")).alias("num"),
        )
        for f in fields
    ]
    more = F.transform(
        F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), F.lit(None).cast("double").alias("num")),
    )
    if only is not None:
        more = F.filter(more, lambda x: x["field"].isin(*only))
    every = F.concat(F.array(*entries), more) if entries else more
    return records.select(*LINEAGE, F.explode(every).alias("x")).select(*LINEAGE, "x.field", "x.value", "x.num")


def present_fields(mapped: DataFrame) -> DataFrame:
    """(sheet, key): the keys that records of a sheet have, whatever their values."""
    return mapped.select("sheet", F.coalesce("field", "header").alias("key")).distinct()


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
