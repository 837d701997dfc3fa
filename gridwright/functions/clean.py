"""Cleaning of cells by kind of value: each a struct<value, num, valid, note>, all in Column functions.

``value`` is the cleaned text (of numbers: their text), ``num`` the number of a numeric
field.  Every cast is a ``try_``: a bad cell becomes a note, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.functions.cells import WHITE, float_text, is_placeholder, let, strip, text_is_placeholder
from gridwright.functions.fields import INTERNATIONAL_DATES, US_DATES

_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: What a number, an address and a symbol look like (and the notes on cells below).
FLOAT = r"^[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
SYMBOLS = "[$€£₹,]"


def none_text() -> Column:
    return F.lit(None).cast("string")


def _result(value: Column, valid: Column, note: Column, num: Column | None = None) -> Column:
    return F.struct(
        value.cast("string").alias("value"),
        (F.lit(None).cast("double") if num is None else num).alias("num"),
        valid.alias("valid"),
        note.cast("string").alias("note"),
    )


# ------------------------------------------------------------------ text
def squeeze(s: Column) -> Column:
    """Placeholders become null, runs of white space (also no-break) one space, ends are stripped."""
    tidy = strip(F.regexp_replace(s, f"{WHITE}+", " "))
    return F.when(~text_is_placeholder(s), F.nullif(tidy, F.lit("")))


def cell_text(cell: Column) -> Column:
    tidy = F.nullif(strip(F.regexp_replace(cell["s"], f"{WHITE}+", " ")), F.lit(""))
    return F.when(~is_placeholder(cell), tidy)


def clean_text(cell: Column) -> Column:
    return let(cell_text(cell), lambda text: _result(text, text.isNotNull(), none_text()))


# ------------------------------------------------------------------ numbers
def parse_float(s: Column) -> Column:
    """A double where ``s`` is one in Python's grammar (inner underscores, nan, inf; no suffixes)."""
    special = F.lower(F.regexp_replace(s, "^[+]", ""))
    return (
        F.when(s.rlike(FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
        .when(special.isin("nan", "-nan"), F.lit(float("nan")))
        .when(special.isin("inf", "infinity"), F.lit(float("inf")))
        .when(special.isin("-inf", "-infinity"), F.lit(float("-inf")))
    )


def numeric_parts(text: Column) -> Column:
    """struct<num, inner, stripped> of squeezed text: the number, the text without its parentheses, was anything taken out."""
    negative = text.startswith("(") & text.endswith(")")
    inner = F.when(negative, F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)

    def parts(x: Column) -> Column:
        n = parse_float(x["bare"])
        return F.struct(F.when(negative, -n).otherwise(n).alias("num"), x["inner"].alias("inner"), (x["bare"] != x["inner"]).alias("stripped"))

    return let(let(inner, lambda i: F.struct(i.alias("inner"), strip(F.regexp_replace(i, SYMBOLS, "")).alias("bare"))), parts)


def clean_numeric(cell: Column) -> Column:
    own = cell["kind"].isin("int", "float", "bool")

    def result(text: Column) -> Column:
        def made(p: Column) -> Column:
            note = F.when(p["num"].isNull(), F.concat(F.lit("unparseable numeric value: '"), p["inner"], F.lit("'")))
            note = note.when(p["stripped"], F.lit("currency symbols/commas stripped"))
            return _result(float_text(p["num"]), p["num"].isNotNull(), note, p["num"])

        return F.when(text.isNull(), _result(none_text(), F.lit(False), none_text())).otherwise(let(numeric_parts(text), made))

    return F.when(own, _result(float_text(cell["d"]), F.lit(True), none_text(), cell["d"])).when(
        cell["kind"] == "str", let(cell_text(cell), result)
    ).otherwise(_result(none_text(), F.lit(False), F.when(cell["kind"] == "date", F.concat(F.lit("unparseable numeric value: '"), cell["s"], F.lit("'")))))


# ------------------------------------------------------------------ dates
def _date_by(text: Column, fmt: str) -> Column:
    """ISO date where ``text`` has exactly this format (digits as strptime reads them), else null."""
    names = "|".join(m if "%B" in fmt else m[:3] for m in _MONTHS)
    part = {
        "%Y": r"(?<y>\d{4})",
        "%y": r"(?<y>\d{2})",
        "%m": r"(?<m>1[0-2]|0[1-9]|[1-9])",
        "%d": r"(?<d>3[01]|[12]\d|0[1-9]| ?[1-9])",
        "%B": f"(?<m>{names})",
        "%b": f"(?<m>{names})",
    }
    order = re.findall(r"%[a-zA-Z]", fmt)
    pattern = "(?i)^" + re.sub(r"%[a-zA-Z]", lambda x: part[x[0]], re.escape(fmt).replace(r"\%", "%").replace(r"\ ", " ").replace(" ", " +")) + "$"
    got = {p[1]: F.regexp_extract(text, pattern, i + 1) for i, p in enumerate(order)}
    year = got.get("Y")
    if year is None:
        yy = got["y"].try_cast("int")
        year = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000).cast("string")
    month = got.get("m")
    if month is None:
        short = F.substr(F.lower(got.get("B", got.get("b"))), F.lit(1), F.lit(3))
        month = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m[:3], f"{i}")]), short)
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.trim(got["d"]), 2, "0"))
    return F.when(text.rlike(pattern) & (year != "0000"), F.date_format(iso.try_cast("date"), "yyyy-MM-dd"))


def date_formats(locale: str = "us") -> list[str]:
    return INTERNATIONAL_DATES if (locale or "").lower() == "international" else US_DATES


def is_ambiguous(text: Column) -> Column:
    """Does the text name two different dates, month first and day first?"""
    us = F.coalesce(*[_date_by(text, f) for f in ("%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y")])
    other = F.coalesce(*[_date_by(text, f) for f in ("%d/%m/%Y", "%d-%m-%Y", "%d/%m/%y")])
    return F.coalesce(us != other, F.lit(False))


def parse_date(text: Column, locale: str = "us") -> Column:
    """struct<iso, fmt> of the first format that fits; later ones aren't looked at."""
    of = lambda f: lambda iso: F.when(iso.isNotNull(), F.struct(iso.alias("iso"), F.lit(f).alias("fmt")))
    return F.coalesce(*[let(_date_by(text, f), of(f)) for f in date_formats(locale)])


def clean_date(cell: Column, locale: str = "us") -> Column:
    def of_text(text: Column) -> Column:
        def result(got: Column) -> Column:
            fallback = F.when(got["fmt"] != "%Y-%m-%d", F.concat(F.lit("parsed using fallback format '"), got["fmt"], F.lit("'")))
            ambiguous = F.when(
                text.rlike(r"^[\d ]+[/-][\d ]+[/-]\d+$") & is_ambiguous(text),
                F.concat(F.lit("Ambiguous date '"), text, F.lit("' — interpreted as "), got["iso"], F.lit(f" using {locale} format. Set date_locale in config to change.")),
            )
            noted = F.nullif(F.concat_ws("; ", fallback, ambiguous), F.lit(""))
            failed = F.when(text.isNotNull(), F.concat(F.lit("unparseable date value: '"), text, F.lit("'")))
            return _result(got["iso"], got["iso"].isNotNull(), F.when(got["iso"].isNotNull(), noted).otherwise(failed))

        # one look at the characters spares most texts the dozen patterns
        return let(F.when(text.rlike(r"\d"), parse_date(text, locale)), result)

    iso = F.date_format(cell["ts"], "yyyy-MM-dd")
    return F.when(cell["kind"] == "date", _result(iso, iso.isNotNull(), none_text())).otherwise(let(cell_text(cell), of_text))


# ------------------------------------------------------------------ addresses and numbers of people
def clean_email(cell: Column) -> Column:
    def result(text: Column) -> Column:
        ok = text.rlike(EMAIL)
        note = F.when(~ok, F.concat(F.lit("does not match a valid email pattern: '"), text, F.lit("'")))
        return _result(text, F.coalesce(ok, F.lit(False)), note)

    return let(F.lower(cell_text(cell)), result)


def clean_phone(cell: Column) -> Column:
    def result(x: Column) -> Column:
        digits = F.length(F.replace(x["kept"], F.lit("+"), F.lit("")))
        note = F.when(digits < 7, F.concat(F.lit("too few digits to be a valid phone number: '"), x["text"], F.lit("'")))
        note = note.when(digits > 15, F.concat(F.lit("too many digits to be a valid phone number: '"), x["text"], F.lit("'")))
        return _result(x["kept"], F.coalesce(digits.between(7, 15), F.lit(False)), note)

    kept = lambda text: F.struct(text.alias("text"), F.regexp_replace(text, r"(?U)[^\d+]", "").alias("kept"))
    return let(let(cell_text(cell), kept), result)


Cleaner = Callable[[Column], Column]


def cleaners(locale: str = "us") -> dict[str, Cleaner]:
    """Cleaner of each kind of value; extend the returned dict to add kinds."""
    return {
        "text": clean_text,
        "date": lambda c: clean_date(c, locale),
        "number": clean_numeric,
        "currency": clean_numeric,
        "email": clean_email,
        "phone": clean_phone,
    }


def clean_by(value_type: Column, cell: Column, table: dict[str, Cleaner]) -> Column:
    """The cleaner that a row's value type asks for; unknown types are text."""
    chosen = None
    for kind, cleaner in table.items():
        if kind != "text":
            chosen = (F if chosen is None else chosen).when(value_type == kind, cleaner(cell))
    return chosen.otherwise(table["text"](cell))
