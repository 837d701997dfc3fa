"""Files to records and reports, end to end."""

import csv
import datetime as dt
import json
import sqlite3

import pytest
from workbooks import xls, xlsx

from gridwright import cli
from gridwright.config import Settings, load_settings
from gridwright.plans import pipeline
from gridwright.sources import delimited, files
from gridwright.sources import xls as xls_source
from gridwright.sources import xlsx as xlsx_source
from gridwright.sources.detect import UnreadableFile, detect_format

FILES = ["cleaned_data.csv", "extracted_data.json", "schema_map.json", "issues.txt", "extraction_report.md"]


def messy():
    customers = [
        ["Customer Export - Q2 2026", None, None, None, None],
        [None] * 5,
        ["ID", "Full Name", "Email", "Amount", "Joined"],
        ["1", "Alice Johnson", "alice.j@example.com", "$1,250.00", "2026-01-05"],
        ["2", "Bob Stone", "bob@example.com", 300, dt.datetime(2026, 2, 1)],
        [None, "n/a", "-", "", None],
        ["3", "Cara Lee", "cara@example", "(40)", "13/02/2026"],
        ["ID", "Full Name", "Email", "Amount", "Joined"],
        ["4", "Bob Again", "BOB@example.com ", "12.5", "02/03/2026"],
        ["5", "Dan", None, "7", "soon"],
        ["6", "Eve", "eve@example.com", "8", None],
    ]
    orders = [["Order ID", "Client", "Total"], ["A1", "Zed", 5], ["A2", "Yan", 6.5], [None, "tbd", None], ["A1", "Zed II", 7], ["A3", "Xi", 8]]
    notes = [[None] * 5 for _ in range(20)]
    notes[0][0], notes[19][4] = "Internal", "see appendix"
    return {"Customers": customers, "Orders": orders, "Notes": notes}


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = tmp_path_factory.mktemp("books") / "messy.xlsx"
    path.write_bytes(xlsx(messy(), merged={"Customers": ["A1:E1"]}, hidden_rows=(4,), hidden_cols=(3,), formulas={("Orders", 1, 2): "2+3"}))
    return path


@pytest.fixture(scope="module")
def result(spark, book, tmp_path_factory):
    return pipeline.run(spark, str(book), tmp_path_factory.mktemp("out"))


def save(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


# ------------------------------------------------------------------ files
def test_formats():
    assert detect_format("a.csv", b"PK\x03\x04") == "csv" and detect_format("x.bin", b"PK\x03\x04....") == "xlsx" and detect_format("x.xlsx", b"\xd0\xcf\x11\xe0") == "xls"
    for name, said in (("a.xlsx", "invalid file signature"), ("a.pdf", "Unsupported")):
        with pytest.raises(UnreadableFile, match=said):
            detect_format(name, b"%PDF")


def test_xlsx_structure(book):
    sheets = {s.name: s for s in xlsx_source.parse(book.read_bytes())}
    assert list(sheets) == ["Customers", "Orders", "Notes"]
    c = sheets["Customers"]
    assert c.merged == [(0, 0, 0, 4)] and c.hidden_rows == [4] and c.hidden_cols == ["C"] and not c.formulas and sheets["Orders"].formulas
    assert c.rows[4][4] == dt.datetime(2026, 2, 1) and c.rows[4][3] == 300 and sheets["Orders"].rows[2][2] == 6.5
    assert not xlsx_source.parse(book.read_bytes(), formulas=False)[1].formulas
    assert [len(s.rows) for s in xlsx_source.parse(book.read_bytes(), max_rows=5)] == [5, 5, 5]
    with pytest.raises(UnreadableFile, match="corrupted"):
        xlsx_source.parse(b"PK\x03\x04 nothing")
    with pytest.raises(UnreadableFile, match="password"):
        xlsx_source.parse(b"\xd0\xcf\x11\xe0....")


def test_date_formats():
    yes, no = ["yyyy-mm-dd", "d/m/yy", "[h]:mm", "mmm"], ["General", "0.00", '"days" 0', "#,##0 [Red]", "@"]
    assert all(map(xlsx_source.is_date_format, yes)) and not any(map(xlsx_source.is_date_format, no))
    assert xlsx_source.from_serial(1, False) == dt.datetime(1900, 1, 1) and xlsx_source.from_serial(61, False) == dt.datetime(1900, 3, 1)


def test_xls(spark, tmp_path):
    rows = [["Full Name", "Email", "Amount", "Date"], ["Alice Smith", "alice@example.com", 5, dt.datetime(2026, 3, 4)], ["Zoë 日本", "zoe@example.com", 2.5, "2026-01-01"], [True, None, -3, None]]
    raw = xls({"Sheet1": rows, "Other": [["x", 1]]})
    sheets = xls_source.parse(raw)
    assert [s.name for s in sheets] == ["Sheet1", "Other"] and sheets[0].rows == rows and sheets[0].notes == xls_source.NOTES
    x = pipeline.extract(spark, save(tmp_path, "old.xls", raw))
    assert [(r.full_name, r.amount, r.date) for r in x.records.where("sheet = 'Sheet1'").orderBy("source_row").collect()] == [("Alice Smith", 5.0, "2026-03-04"), ("Zoë 日本", 2.5, "2026-01-01"), ("True", -3.0, None)]
    with pytest.raises(UnreadableFile):
        xls_source.parse(raw[:700])


@pytest.mark.parametrize("name, content, note, cell", [
    ("a.csv", "Full Name,Email\nA,a@b.co\n\nB,c@d.co\n", "','", "Full Name"), ("a.csv", "Full Name;Email;Amount\nA;x@y.co;100,50\nB;z@y.co;200,00\n", "';'", "Full Name"),
    ("a.tsv", "Full Name\tEmail\nA\ta@b.co\n", "'TAB'", "Full Name"), ("a.csv", "Full Name,City\nFrançois,Montréal\n".encode("latin-1"), "','", "Full Name"), ("a.txt", "a|b\n1|2\n", "'|'", "a"),
])
def test_delimited(name, content, note, cell):
    s = delimited.parse(content if isinstance(content, bytes) else content.encode())
    assert s.name == "csv_data" and f"delimiter: {note}" in s.notes[0] and s.rows[0][0] == cell


def test_delimited_details():
    s = delimited.parse(b'a,b\n"x\ny",NA\n-,TBD\nshort\n')
    assert s.rows == [["a", "b"], ["x\ny", None], ["-", "TBD"], ["short", None]]
    assert delimited.parse(b"Name;Price\nA;100,50\n").rows[1] == ["A", "100,50"]
    assert "Fran\xe7ois" in delimited.parse("n\nFrançois\n".encode("latin-1")).rows[1]
    for bad in (b"", b"a,b\n1,2,3\n"):
        with pytest.raises(UnreadableFile, match="Failed to parse CSV"):
            delimited.parse(bad)


def test_large_delimited(spark, tmp_path):
    path = save(tmp_path, "big.csv", "Name,Total\n" + "".join(f"n{i},{i}\n" for i in range(500)))
    g = files.read_large_delimited(spark, path)
    rows = g.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(501)) and rows[7].cells[0].s == "n6" and rows[0].cells[1].s == "Total"


def test_large_delimited_is_as_wide_as_its_widest_row(spark, tmp_path):
    lines = ["Order export", "", "id,name,amount", '1,"Stone, Bob",5', '2,"say ""hi"", you",6,', '3,5" pipe, 6" pipe', '"C:\\",x', "4,,,note"]
    want = [r for r in csv.reader(lines) if r]
    got = files.read_large_delimited(spark, save(tmp_path, "title.csv", "\n".join(lines) + "\n")).orderBy("row_idx").collect()
    assert [[c.s for c in r.cells] for r in got] == [[x or None for x in r] + [None] * (4 - len(r)) for r in want]
    got = files.read_large_delimited(spark, save(tmp_path, "pipes.txt", 'a\n"1|2"|3\n'), "|").orderBy("row_idx").collect()
    assert [[c.s for c in r.cells] for r in got] == [["a", None], ["1|2", "3"]]


# ------------------------------------------------------------------ the whole run
def test_records(result):
    x, _ = result
    assert x.complete and not x.timed_out
    reports = {r["sheet"]: r for r in x.validation()}
    c, o, n = reports["Customers"], reports["Orders"], reports["Notes"]
    assert (c["raw"], c["extracted"], c["dropped"]) == (8, 6, 2) and c["reasons"] == {"repeated_header_row": 1, "blank_or_separator_row": 1}
    assert (o["raw"], o["extracted"], o["dropped"]) == (5, 4, 1) and (n["raw"], n["extracted"], n["dropped"]) == (19, 1, 18)
    assert c["duplicates"] == [(5, 9)] and o["duplicates"] == [(2, 5)]
    assert x.records.count() == 11
    a = x.records.where("full_name = 'Alice Johnson'").first()
    assert (a.email, a.amount, a.source_row) == ("alice.j@example.com", 1250.0, 4)
    p = {p["sheet"]: p for p in x.profiles}
    assert p["Customers"]["header_row"] == 2 and p["Notes"]["is_sparse"] and p["Notes"]["sparse_ratio"] >= 0.9
    assert x.records.where("sheet = 'Customers' AND source_row = 5").first().extra == {"Joined": "2026-02-01 00:00:00"} or "date" in {m["field"] for m in x.mapped}


def test_files(result):
    x, folder = result
    assert sorted(p.name for p in folder.iterdir()) == sorted(FILES)
    rows = list(csv.DictReader((folder / "cleaned_data.csv").open(newline="", encoding="utf-8")))
    assert len(rows) == 11 and list(rows[0])[-3:] == ["_issues", "_source_row", "_source_sheet"]
    data = json.loads((folder / "extracted_data.json").read_text())
    assert data["record_count"] == 11 == len(data["records"]) and data["records"][0]["_source_sheet"] == "Customers"
    names = json.loads((folder / "schema_map.json").read_text())
    assert names["Orders"]["Client"] == {"raw_header": "Client", "canonical_field": "full_name", "confidence": 1.0, "method": "exact"}
    text = (folder / "extraction_report.md").read_text()
    for part in ("Sparse Sheet Warning", "Sheet Comparison", "Cross-Sheet Column Alignment", "Data Profile", "Sheet: `Customers`", "Issue Summary"):
        assert part in text, part
    assert "[WARNING] Customers:row 7:col 'Email' -- does not match a valid email pattern: 'cara@example'" in (folder / "issues.txt").read_text()


def test_profile_and_issues(result):
    x, _ = result
    got = {r.field: r for r in x.column_profiles.collect()}
    assert got["amount"].min_value == -40.0 and got["amount"].max_value == 1250.0 and got["email"].null_count > 0
    severities = {r.severity for r in x.issues.select("severity").distinct().collect()}
    assert severities == {"info", "warning"}
    assert x.issues.where("code = 'negative_amount'").count() == 1


def two_sheets(spark, tmp_path, a, b, **settings):
    return pipeline.extract(spark, save(tmp_path, "two.xlsx", xlsx({"S1": a, "S2": b})), Settings(**settings))


def test_identical_sheets(spark, tmp_path):
    rows = [["Full Name", "Email"], ["Alice", "alice@example.com"], ["Bob", "bob@example.com"]]
    x = two_sheets(spark, tmp_path, rows, rows)
    assert x.records.count() == 2 and x.dropped_sheets == ("S2",)
    assert (x.overlap_report[0]["action"], x.overlap_report[0]["overlap_pct"], x.overlap_report[0]["shared"]) == ("IDENTICAL: Merged (dropped S2)", 100.0, 2)
    assert two_sheets(spark, tmp_path, rows, rows, cross_sheet_dedup=False).records.count() == 4


def test_partial_and_cross_sheet_duplicates(spark, tmp_path):
    a = [["Full Name", "Email"], ["Alice", "alice@example.com"], ["Bob", "bob@example.com"]]
    b = [["Full Name", "Email Address"], ["Alice", "alice@example.com"], ["Charlie", "c@example.com"]]
    x = two_sheets(spark, tmp_path, a, b)
    assert x.records.count() == 4 and x.overlap_report[0]["action"].startswith("PARTIAL") and x.overlap_report[0]["shared"] == 1
    assert [tuple(r) for r in x.across.collect()] == [("S1", 2, "S2", 2)]
    assert "Cross-sheet duplicate record found: S1:row 2 matches S2:row 2." in [r.message for r in x.issues.collect()]
    assert {r.field: r.sheets for r in x.alignment.collect()}["email"] == {"S1": "Email", "S2": "Email Address"}


def test_unique_sheets_and_modified_values(spark, tmp_path):
    x = two_sheets(spark, tmp_path, [["Full Name", "Email"], ["A", "a@b.co"]], [["Product Code", "Price"], ["P", "$99.99"]])
    assert x.overlap_report[0]["action"].startswith("UNIQUE") and x.records.count() == 2
    head = ["Email", "Full Name", "Amount"]
    x = two_sheets(spark, tmp_path, [head, ["a@b.co", "A", 100.0]], [head, ["a@b.co", "A", 150.0]])
    summary, modified, _ = x.sheet_diffs
    assert summary.first().common == 1 and [(m.field, m.val_a, m.val_b) for m in modified.collect()] == [("amount", "100.0", "150.0")]


def test_duplicate_headers(spark, tmp_path):
    x = pipeline.extract(spark, save(tmp_path, "d.csv", "Name,Name,Email\nA,A,a@b.co\n"))
    assert [m["header"] for m in x.mapped] == ["Name", "Name_2", "Email"]
    assert x.issues.where("code = 'duplicate_header'").count() == 1


def test_row_cap(spark, tmp_path):
    path = save(tmp_path, "cap.xlsx", xlsx({"S": [["Full Name", "Email"], *([f"n{i}", f"n{i}@b.co"] for i in range(20))]}))
    x = pipeline.extract(spark, path, Settings(max_rows_per_sheet=11))
    assert x.records.count() == 10 and any("truncated to 11" in n for n in x.profiles[0]["notes"])


def test_one_bad_sheet(spark, tmp_path):
    good = [["Full Name", "Email"], ["A", "a@b.co"]]
    path = save(tmp_path, "b.xlsx", xlsx({"Bad": good, "Good": good}, broken=("Bad",)))
    x, folder = pipeline.run(spark, path, tmp_path / "out")
    assert x.records.count() == 1 and x.issues.where("severity = 'error'").count() == 1 and len(list(folder.iterdir())) == 5
    path = save(tmp_path, "all.xlsx", xlsx({"Bad": good}, broken=("Bad",)))
    x, folder = pipeline.run(spark, path, tmp_path / "out2")
    assert x.records.count() == 0 and len(list(folder.iterdir())) == 5 and (folder / "cleaned_data.csv").read_text() == ""


def breaking(kind, monkeypatch):
    """A cleaner that fails at run time where a text says so."""
    from pyspark.sql import functions as F

    from gridwright.operators import cleaning

    real = cleaning.cleaners

    def broken(locale="us"):
        out = real(locale)
        own = out[kind]
        out[kind] = lambda c: F.when(c["s"] == "break", F.raise_error(F.lit("broken cell"))).otherwise(own(c))
        return out

    monkeypatch.setattr(cleaning, "cleaners", broken)


def test_a_sheet_that_fails_at_run_time(spark, tmp_path, monkeypatch):
    breaking("email", monkeypatch)
    head = ["Full Name", "Email"]
    path = save(tmp_path, "r.xlsx", xlsx({"A": [head, ["A", "a@b.co"]], "B": [head, ["B", "break"]], "C": [head, ["C", "c@b.co"], ["D", "d@b.co"]]}))
    x, folder = pipeline.run(spark, path, tmp_path / "out")
    assert sorted(r.full_name for r in x.records.collect()) == ["A", "C", "D"] and x.complete
    assert [(r.sheet, r.severity) for r in x.issues.where("code = 'sheet_failed'").collect()] == [("B", "error")]
    assert len(list(folder.iterdir())) == 5 and "cleaning A, B, C failed" in folder.with_name(f"{folder.name}.log").read_text()


def test_time_runs_out_between_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "WAVE", 2)
    asked = iter([False, False, True])  # after reading, before the second wave, before the third
    monkeypatch.setattr(pipeline.Clock, "late", lambda self: next(asked, True))
    head = ["Full Name", "Email"]
    path = save(tmp_path, "w.xlsx", xlsx({f"S{i}": [head, [f"n{i}", f"n{i}@b.co"]] for i in range(6)}))
    x = pipeline.extract(spark, path)
    assert x.timed_out and x.records.count() == 4 and x.issues.where("code = 'timeout'").first().message.endswith("4 of 6 sheets were processed.")


def test_a_job_is_cancelled_when_time_is_up(spark):
    clock = pipeline.Clock(1.0)
    slow = spark.range(0, 10**13, 1, 2).selectExpr("sum(id % 7)")
    with pytest.raises(Exception, match="(?i)cancel"), clock.limited(spark):
        slow.collect()
    assert clock.late() and spark.range(3).count() == 3


def test_only_the_first_duplicates_are_gathered(spark):
    from gridwright.operators import quality

    rows = [("s", 0, i, f"k{i % 3}") for i in range(90)] + [("t", 1, i, f"u{i}") for i in range(5)]
    found = quality.duplicates_in_sheet(spark.createDataFrame(rows, "sheet string, sheet_ord int, source_row long, id string"))
    got = quality.first_duplicates(found, 4).collect()
    assert [(r.sheet, r.n, [tuple(x) for x in r.first]) for r in got] == [("s", 87, [(3, 0), (4, 1), (5, 2), (6, 0)])]


def test_unreadable_and_large_files(spark, tmp_path):
    for name, content, said in (("a.xlsx", b"%PDF", "signature"), ("b.pdf", b"%PDF", "Unsupported"), ("missing.csv", None, "Failed to open")):
        path = save(tmp_path, name, content) if content else str(tmp_path / name)
        x, folder = pipeline.run(spark, path, tmp_path / name.replace(".", "_"))
        r = x.issues.collect()
        assert len(r) == 1 and r[0].severity == "error" and said in r[0].message and len(list(folder.iterdir())) == 5
    x = pipeline.extract(spark, save(tmp_path, "big.csv", "Name,Total\n" + "x,1\n" * 5000), Settings(max_file_size_mb=0.001))
    assert "exceeds limit" in x.issues.first().message


def test_timeout(spark, tmp_path):
    x, folder = pipeline.run(spark, save(tmp_path, "t.csv", "Name,Total\nx,1\n"), tmp_path / "out", Settings(max_processing_time_seconds=-1))
    assert x.timed_out and x.issues.where("code = 'timeout'").count() == 1 and len(list(folder.iterdir())) == 5
    assert Settings().max_processing_time_seconds == 300


def test_sqlite_and_tables_accumulate(spark, book, tmp_path):
    db, table = tmp_path / "r.db", f"{tmp_path}/table"
    for _ in range(2):
        x, _ = pipeline.run(spark, str(book), tmp_path / "out", sqlite_path=str(db))
        x.append_table(table)
    with sqlite3.connect(db) as con:
        assert con.execute("SELECT count(*) FROM records").fetchone() == (22,)
        assert con.execute("SELECT amount FROM records WHERE full_name = 'Alice Johnson' LIMIT 1").fetchone() == (1250.0,)
    spark.read.parquet(table).createOrReplaceTempView("records")
    assert spark.sql("SELECT count(*) AS n, sum(amount) AS s FROM records WHERE source_sheet = 'Orders'").first().n == 8


def test_settings(tmp_path):
    path = save(tmp_path, "c.yaml", "fuzzy_match_threshold: 0.5\ndate_locale: International\nunknown: 1\n")
    s = load_settings(path, max_rows_per_sheet=3)
    assert (s.fuzzy_match_threshold, s.date_locale, s.max_rows_per_sheet, s.sparse_row_threshold) == (0.5, "international", 3, 0.9)
    with pytest.raises(ValueError):
        Settings(date_locale="mars")


def test_cli(spark, tmp_path, capsys):
    path = save(tmp_path, "c.csv", "Name,Total\nx,1\n")
    assert cli.main([path, "--output", str(tmp_path / "o")]) == 0 and "1 records from 1 sheets" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none.csv")]) == 1
    big = save(tmp_path, "tiny.yaml", "max_file_size_mb: 0.000001\n")
    assert cli.main([path, "--config", big]) == 1


def test_streaming(spark, tmp_path):
    from gridwright.streaming.file_drop import watch

    (tmp_path / "in").mkdir()
    save(tmp_path / "in", "a.csv", "Name,Total\nx,1\n")
    for extra in ("b.csv", "c.csv"):
        watch(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        save(tmp_path / "in", extra, "Name,Total\ny,2\nz,3\n")
    watch(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
