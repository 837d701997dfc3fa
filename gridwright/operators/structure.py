"""What a sheet looks like: header row, shape, sparsity, merged regions, row cap.

A grid is (sheet, sheet_ord, row_idx, cells).  Only aggregates per sheet and the
first ``SEARCH_ROWS`` rows of each leave the grid; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.cells import is_empty, let, strip

SEARCH_ROWS = 15
FEW_REGIONS = 20_000  # merged regions that may be broadcast
CANDIDATE_SCORE = 0.55
LEAST_SCORE = 0.4
NEAR_EMPTY = 0.9  # a sheet's own sparse flag, whatever the note's threshold


def limit_rows(grid: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each sheet, title and header rows included; 0: all."""
    return grid.where(F.col("row_idx") < most) if most > 0 else grid


def row_score(cells: Column) -> Column:
    """How much a row looks like a header: half its share of texts, .3 distinct, .2 filled; null for an empty row."""
    full = F.filter(cells, lambda c: ~is_empty(c))
    n = F.size(full)
    texts = F.size(F.filter(full, lambda c: c["kind"] == "str"))
    distinct = F.size(F.array_distinct(F.transform(full, lambda c: F.lower(strip(c["s"])))))
    some = F.when(n > 0, n)
    return texts / some * 0.5 + distinct / some * 0.3 + n / F.greatest(F.size(cells), F.lit(1)) * 0.2


def header_rows(grid: DataFrame) -> DataFrame:
    """(sheet, header_row, found, candidates): the best of the first rows, the earliest of equals; row 0 if none will do."""
    scored = grid.where(F.col("row_idx") < SEARCH_ROWS).select("sheet", "row_idx", row_score(F.col("cells")).alias("score"))
    best = F.max_by(F.col("row_idx"), F.struct("score", -F.col("row_idx")))
    top = F.max("score")
    return scored.groupBy("sheet").agg(
        F.when(top >= LEAST_SCORE, best).otherwise(F.lit(0)).cast("long").alias("header_row"),
        F.coalesce(top >= LEAST_SCORE, F.lit(False)).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("score") >= CANDIDATE_SCORE, F.col("row_idx")))).alias("candidates"),
    )


def sheet_shapes(grid: DataFrame) -> DataFrame:
    """(sheet, sheet_ord, n_rows, n_cols, sparse_ratio); a sheet without cells is wholly sparse."""
    empty = F.size(F.filter("cells", is_empty))
    cells = F.sum(F.size("cells"))
    return grid.groupBy("sheet").agg(
        F.min("sheet_ord").alias("sheet_ord"),
        F.count("*").alias("n_rows"),
        F.max(F.size("cells")).cast("long").alias("n_cols"),
        F.coalesce(F.sum(empty) / F.nullif(cells, F.lit(0)), F.lit(1.0)).alias("sparse_ratio"),
    )


def profile_sheets(grid: DataFrame, sparse_threshold: float = NEAR_EMPTY) -> DataFrame:
    """One row for each sheet: shape, header, candidates, sparsity by both thresholds."""
    return (
        sheet_shapes(grid)
        .join(header_rows(grid), "sheet", "left")
        .withColumns(
            {
                "header_row": F.coalesce("header_row", F.lit(0).cast("long")),
                "found": F.coalesce("found", F.lit(False)),
                "candidates": F.coalesce("candidates", F.array().cast("array<bigint>")),
                "is_sparse": F.col("sparse_ratio") >= NEAR_EMPTY,
                "noted_sparse": F.col("sparse_ratio") >= sparse_threshold,
            }
        )
    )


def fill_merged(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """Copy each region's anchor into its cells, also an empty anchor.

    ``regions`` is (sheet, r0, c0, r1, c1), zero-based and inclusive: of regions that overlap the one that begins further
    down (then further right) wins.  The anchors are looked up once; then each row carries its sheet's regions and fills its own cells,
    so the grid isn't grouped, and isn't shuffled where the regions are few (``FEW_REGIONS``) and so broadcast.
    """
    numbered = regions.select(F.col("sheet").alias("s"), "r0", "c0", "r1", "c1")
    few = numbered.limit(FEW_REGIONS + 1).count() <= FEW_REGIONS
    hint = F.broadcast if few else lambda df: df
    anchors = grid.join(hint(numbered), (F.col("sheet") == F.col("s")) & (F.col("row_idx") == F.col("r0")))
    region = F.struct("r0", "c0", "r1", "c1", F.get("cells", F.col("c0").cast("int")).alias("anchor"))
    by_sheet = anchors.groupBy("s").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    rows = grid.join(hint(by_sheet), F.col("sheet") == F.col("s"), "left")

    def cell(c: Column, i: Column, own: Column) -> Column:
        return let(F.filter(own, lambda x: i.between(x["c0"], x["c1"])), lambda over: F.when(F.size(over) > 0, F.element_at(over, -1)["anchor"]).otherwise(c))

    of_row = F.filter(F.coalesce("regions", F.array()), lambda x: F.col("row_idx").between(x["r0"], x["r1"]))
    filled = let(of_row, lambda own: F.when(F.size(own) > 0, F.transform("cells", lambda c, i: cell(c, i, own))).otherwise(F.col("cells")))
    return rows.select("sheet", "sheet_ord", "row_idx", filled.alias("cells"))


def has_formulas(grid: DataFrame, rows: int = 100) -> DataFrame:
    """(sheet, has_formulas): does a text in the first rows begin with '='?"""
    found = F.exists("cells", lambda c: (c["kind"] == "str") & c["s"].startswith("="))
    first = F.when(F.col("row_idx") < rows, F.coalesce(found, F.lit(False))).otherwise(F.lit(False))
    return grid.groupBy("sheet").agg(F.bool_or(first).alias("has_formulas"))
