"""Cell cleaning against plain Python: strptime, float, str."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from gridwright.functions import cells, clean
from gridwright.functions.fields import FieldRegistry


def column_of(spark, values, f):
    """f over text values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(3)
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def over(cleaner):
    return lambda s: cleaner(cells.text_cell(s))


def py_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def test_numbers_in_python_grammar(spark):
    rng = random.Random(1)
    pool = ["1", "12", "0", "_", ".", "e", "E", "+", "-", "d", "f", "x", "inf", "nan", "Infinity", " ", "5_0", "1e5", "007"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 5))).strip() for _ in range(3000)] + ["1d", "1f", "1_000", "__1", "1__0", "1_", "-inf", "+nan"]
    got = column_of(spark, texts, clean.parse_float)
    for s, x in zip(texts, got, strict=True):
        want = py_float(s) if s.isascii() else None
        assert (x is None) == (want is None) and (want is None or x == want or (x != x and want != want)), s


@pytest.mark.parametrize("text, num, note", [
    ("$1,234.50", 1234.5, "currency symbols/commas stripped"), ("($150)", -150.0, "currency symbols/commas stripped"), ("$(150)", None, "unparseable numeric value: '$(150)'"), ("(-5)", 5.0, None),
    ("100,50", 10050.0, "currency symbols/commas stripped"), ("5%", None, "unparseable numeric value: '5%'"), ("0", 0.0, None), ("n/a", None, None), ("(x)", None, "unparseable numeric value: 'x'"), ("₹ 7", 7.0, "currency symbols/commas stripped"),
])
def test_numeric_cells(spark, text, num, note):
    r = column_of(spark, [text], over(clean.clean_numeric))[0]
    assert (r.num, r.valid, r.note) == (num, num is not None, note)


def py_date(s, formats):
    for f in formats:
        try:
            return dt.datetime.strptime(s, f).date().isoformat(), f
        except ValueError:
            pass
    return None


def random_dates(n, seed):
    rng = random.Random(seed)
    months = ["January", "jan", "MAY", "Sept", "September", "sep", "Feb", "Foo"]
    out = []
    for _ in range(n):
        y = rng.choice(["2026", "1999", "0000", "0004", "26", "70", "68", "69", "5", "20261"])
        a, b = (rng.choice(["1", "01", "12", "13", "31", "32", "0", "00", "29", "2", "001", " 5"]) for _ in range(2))
        sep = rng.choice("/-/.")
        m = rng.choice(months)
        out.append(rng.choice([f"{a}{sep}{b}{sep}{y}", f"{y}{sep}{a}{sep}{b}", f"{m} {a}, {y}", f"{a} {m} {y}", f"{m} {a} {y}", f"{a}{m}{y}"]).strip())
    return [re.sub(r"\s+", " ", s) for s in out]


@pytest.mark.parametrize("locale", ["us", "international"])
def test_dates_as_strptime_reads_them(spark, locale):
    texts = random_dates(3000, locale)
    got = column_of(spark, texts, lambda s: clean.parse_date(s, locale))
    for s, x in zip(texts, got, strict=True):
        want = py_date(s, clean.date_formats(locale))
        assert (tuple(x) if x else None) == want, s


def test_date_notes(spark):
    us = over(lambda c: clean.clean_date(c, "us"))
    other = over(lambda c: clean.clean_date(c, "international"))
    r = column_of(spark, ["03/04/2026", "2026-03-04", "25/12/2026", "soon", "tbd", "4 March 2026"], us)
    assert [x.value for x in r] == ["2026-03-04", "2026-03-04", "2026-12-25", None, None, "2026-03-04"]
    assert r[0].note.startswith("parsed using fallback format '%m/%d/%Y'; Ambiguous date '03/04/2026' — interpreted as 2026-03-04 using us format.")
    assert (r[1].note, r[2].note, r[3].note, r[4].note) == (None, "parsed using fallback format '%d/%m/%Y'", "unparseable date value: 'soon'", None)
    assert column_of(spark, ["03/04/2026"], other)[0].value == "2026-04-03"


def test_ambiguous(spark):
    texts = random_dates(1500, "ambiguous")
    got = column_of(spark, texts, clean.is_ambiguous)
    for s, x in zip(texts, got, strict=True):
        a, b = py_date(s, ["%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y"]), py_date(s, ["%d/%m/%Y", "%d-%m-%Y", "%d/%m/%y"])
        assert x == (a is not None and b is not None and a[0] != b[0]), s


def test_text_and_placeholders(spark):
    texts = ["  a   b\t\n c ", "N/A", " tbd ", "-", "--", "0", "", " x ", "\x1cy\x1c", "unknown", "nil ", "Nope", None]
    got = column_of(spark, texts, over(clean.clean_text))
    assert [x.value for x in got] == ["a b c", None, None, None, None, "0", None, "x", "y", None, None, "Nope", None]
    for s, x in zip(texts, column_of(spark, texts, cells.strip), strict=True):
        assert x == (s.strip() if s is not None else None)


def test_emails_and_phones(spark):
    got = column_of(spark, [" Alice@Example.COM ", "not an email", "n/a", "a@b.c"], over(clean.clean_email))
    assert [(x.value, x.valid) for x in got] == [("alice@example.com", True), ("not an email", False), (None, False), ("a@b.c", False)]
    assert got[1].note == "does not match a valid email pattern: 'not an email'"
    got = column_of(spark, ["(555) 123-4567", "+1 555.123.4567", "12345", "1" * 16, "none", "٠١٢٣٤٥٦٧"], over(clean.clean_phone))
    assert [(x.value, x.valid) for x in got] == [("5551234567", True), ("+15551234567", True), ("12345", False), ("1" * 16, False), (None, False), ("٠١٢٣٤٥٦٧", True)]
    assert got[2].note == "too few digits to be a valid phone number: '12345'" and got[3].note.startswith("too many digits")


def test_text_of_floats(spark):
    rng = random.Random(3)
    xs = [0.0, -0.0, 1.0, 100.0, 1e16, 1e15, 123456789012345.0, 1e-5, 1e-4, 1.5e-4, 0.001, 12345678.0, 1.5e22, -2.5e-7, float("inf"), float("-inf"), 1e100, 9999999.0, 10000000.5]
    xs += [round(rng.uniform(-1e9, 1e9), rng.randint(0, 6)) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r.s for r in df.select("i", cells.float_text(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == [str(x) for x in xs]


def test_numbers_are_no_placeholders(spark):
    df = spark.range(1).select(cells.number_cell(F.lit(5551234567.0)).alias("a"), cells.whole_cell(F.lit(0)).alias("b"), cells.time_cell(F.lit(dt.datetime(2026, 1, 5, 3))).alias("t"))
    r = df.select(clean.clean_phone(F.col("a")).alias("p"), clean.clean_numeric(F.col("b")).alias("n"), clean.clean_text(F.col("t")).alias("t"), clean.clean_date(F.col("t")).alias("d")).first()
    assert r.p.value == "55512345670" and r.n.num == 0.0 and r.t.value == "2026-01-05 03:00:00" and r.d.value == "2026-01-05"


def test_registry():
    registry = FieldRegistry()
    assert [len(s) for _, s in registry.fields.values()] == [16, 12, 6, 9, 13, 13, 6, 5, 5, 5, 5]
    registry.add("iban", "text", ["iban", "account"])
    assert registry.type_of("iban") == "text" and registry.synonyms()[-1] == (96, "iban", "account")
    with pytest.raises(ValueError):
        registry.add("x", "colour", [])
