"""Cells of a grid: a tagged value that keeps its text as a person would have typed it.

A cell is ``struct<kind, s, d, ts>``: kind is null, str, int, float, bool or date; s is the
text of any kind (100.0, 1e+16, True); d the number and ts the time, where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.functions.fields import NULL_PLACEHOLDERS

CELL = "struct<kind: string, s: string, d: double, ts: timestamp_ntz>"
GRID = f"sheet string, sheet_ord int, row_idx bigint, cells array<{CELL}>"
#: White space as Unicode has it, with the four ASCII separators.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x bound to a variable: computed once, and the expression stays small however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(x: Column) -> Column:
    """x, for a select list, behind a generator of one row: the optimiser can't copy x into what reads the column."""
    return F.explode(F.array(x))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def float_text(c: Column) -> Column:
    """The shortest decimal text of a double: positional from 1e-4 up to 1e16, else with a two-digit exponent.

    The digits are the JVM's; before Java 19 it gives a few doubles (1.25e22) more than they need.
    """

    def spread(s: Column) -> Column:
        """From the engine's scientific notation."""
        mantissa = F.regexp_replace(F.substring_index(s, "E", 1), "^-", "")
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
        return F.struct(
            F.when(s.startswith("-"), "-").otherwise("").alias("sign"), digits.alias("digits"), F.substring_index(s, "E", -1).try_cast("int").alias("exp")
        )

    def scientific(x: Column) -> Column:
        digits, exp = x["digits"], x["exp"]
        whole = F.rpad(F.substr(digits, F.lit(1), exp + 1), exp + 1, F.lit("0"))
        rest = F.substr(digits, exp + 2)
        big = F.concat(whole, F.lit("."), F.when(F.length(rest) > 0, rest).otherwise("0"))
        point = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))
        power = F.abs(exp).cast("string")
        small = F.concat(
            F.when(F.length(digits) > 1, point).otherwise(digits), F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.when(F.length(power) < 2, F.lit("0")).otherwise(F.lit("")), power
        )
        return F.concat(x["sign"], F.when(exp.between(0, 15), big).when(exp == -4, F.concat(F.lit("0.000"), digits)).otherwise(small))

    return let(
        c.cast("string"),
        lambda s: F.when(s == "NaN", "nan").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").when(~s.contains("E"), s).otherwise(let(spread(s), scientific)),
    )


def text_cell(c: Column) -> Column:
    return F.struct(
        F.when(c.isNull(), "null").otherwise("str").alias("kind"),
        c.cast("string").alias("s"),
        F.lit(None).cast("double").alias("d"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )


def number_cell(c: Column) -> Column:
    d = c.cast("double")
    return F.struct(
        F.when(c.isNull(), "null").otherwise("float").alias("kind"),
        float_text(d).alias("s"),
        d.alias("d"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )


def whole_cell(c: Column) -> Column:
    return F.struct(
        F.when(c.isNull(), "null").otherwise("int").alias("kind"),
        c.cast("string").alias("s"),
        c.cast("double").alias("d"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )


def time_cell(c: Column) -> Column:
    ts = c.cast("timestamp_ntz")
    return F.struct(
        F.when(c.isNull(), "null").otherwise("date").alias("kind"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("s"),
        F.lit(None).cast("double").alias("d"),
        ts.alias("ts"),
    )


def null_cell() -> Column:
    return text_cell(F.lit(None).cast("string"))


def is_empty(cell: Column) -> Column:
    """No value, or text of white space only."""
    return (cell["kind"] == "null") | cell["s"].isNull() | (F.length(strip(cell["s"])) == 0)


def is_placeholder(cell: Column) -> Column:
    """No value, or text that stands for none; numbers never do."""
    return (cell["kind"] == "null") | ((cell["kind"] == "str") & text_is_placeholder(cell["s"]))


def text_is_placeholder(s: Column) -> Column:
    return s.isNull() | F.lower(strip(s)).isin(*NULL_PLACEHOLDERS)
