"""Structure, mapping, filters, duplicates, overlap and profiles on small grids."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridwright.functions import cells
from gridwright.functions.similarity import indel_ratio
from gridwright.operators import cleaning, mapping, overlap, profiling, quality, records, structure
from gridwright.sources.values import to_cell


def grid(spark, sheets):
    """{name: rows of plain values} to a grid."""
    rows = [(n, o, i, [to_cell(v) for v in r]) for o, (n, rs) in enumerate(sheets.items()) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, cells.GRID)


def mapped(spark, *headers, sheet="s"):
    h = spark.createDataFrame([(sheet, i, x) for i, x in enumerate(headers)], "sheet string, col_idx int, raw string")
    return mapping.map_headers(mapping.unique_headers(h))


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    pairs += [("order id", "order id"), ("customer name", "product name"), ("", ""), ("", "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in df.select("i", indel_ratio(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == pytest.approx([lcs_ratio(*p) for p in pairs])


# ------------------------------------------------------------------ structure
def test_header_behind_title_and_blank(spark):
    g = grid(spark, {"a": [["Export 2026", None, None], [None, None, None], ["Name", "E-Mail", "Total"], ["Ann", "a@b.co", 5], ["Bo", "c@d.co", 5.5]], "n": [[1, 2], [3, 4]], "e": [[None, ""], ["", None]]})
    got = {r.sheet: r for r in structure.profile_sheets(g).collect()}
    assert (got["a"].header_row, got["a"].found, got["a"].n_rows, got["a"].n_cols) == (2, True, 5, 3)
    assert (got["n"].header_row, got["n"].found) == (0, True)  # full and unique numbers still make half a header
    assert (got["e"].header_row, got["e"].found, got["e"].sparse_ratio, got["e"].is_sparse) == (0, False, 1.0, True)
    assert got["a"].candidates == [0, 2, 3, 4]


def test_ties_go_to_the_earlier_row(spark):
    g = grid(spark, {"a": [["x", "y"], ["p", "q"]]})
    assert structure.header_rows(g).first().header_row == 0


def test_merged_regions(spark):
    g = grid(spark, {"a": [["T", None, None], [1, 2, 3], [4, 5, 6]]})
    regions = spark.createDataFrame([("a", 0, 0, 0, 2), ("a", 1, 1, 2, 1), ("a", 9, 9, 9, 9)], "sheet string, r0 long, c0 long, r1 long, c1 long")
    got = {r.row_idx: [c.s for c in r.cells] for r in structure.fill_merged(g, regions).collect()}
    assert got == {0: ["T", "T", "T"], 1: ["1", "2", "3"], 2: ["4", "2", "6"]}


def test_empty_anchor_overwrites(spark):
    g = grid(spark, {"a": [[None, "b"]]})
    regions = spark.createDataFrame([("a", 0, 0, 0, 1)], "sheet string, r0 long, c0 long, r1 long, c1 long")
    assert [c.kind for c in structure.fill_merged(g, regions).first().cells] == ["null", "null"]


def test_row_cap_and_formulas(spark):
    g = grid(spark, {"a": [[i] for i in range(120)] + [["=A1"]], "b": [["=SUM(A1)"]]})
    assert structure.limit_rows(g, 11).where("sheet = 'a'").count() == 11 and structure.limit_rows(g, 0).count() == 122
    assert {r.sheet: r.has_formulas for r in structure.has_formulas(g).collect()} == {"a": False, "b": True}


# ------------------------------------------------------------------ mapping
def test_mapping(spark):
    got = {r.header: (r.field, round(r.confidence, 4), r.method) for r in mapped(spark, "Customer Name", "E-Mail Addr", "Client", "xyzzy", "日付", "l_quantity", "column_1", "Email_2").collect()}
    assert got["Customer Name"] == ("full_name", 1.0, "exact") and got["Client"] == ("full_name", 1.0, "exact")
    assert got["E-Mail Addr"][0] == "email" and got["E-Mail Addr"][2] == "fuzzy"
    assert got["xyzzy"][0] is None and got["xyzzy"][2] == "unmapped" and got["xyzzy"][1] > 0
    assert got["日付"] == ("id", 1.0, "exact")  # '#' normalises to nothing, as does every header without a-z and 0-9
    assert got["l_quantity"] == ("quantity", 0.8889, "fuzzy") and got["column_1"][:2] == (None, 0.6154) and got["Email_2"] == ("email", 0.8333, "fuzzy")


def test_names_of_headers(spark):
    g = grid(spark, {"s": [["Name ", None, "Name", "  ", "Name"]]})
    heads = mapping.headers_of(g, spark.createDataFrame([("s", 0)], "sheet string, header_row long"))
    assert [r.header for r in heads.orderBy("col_idx").collect()] == ["Name", "column_2", "Name_2", "column_4", "Name_3"]


def test_suggestions(spark):
    m = mapped(spark, "zzz qqq", "Email", "vvv")
    asked = []

    def helper(header, fields):
        asked.append(header)
        if header == "vvv":
            raise OSError("no server")
        return " notes "

    got = {r.header: (r.field, r.confidence, r.method) for r in mapping.suggest_fields(m, helper).collect()}
    assert got["zzz qqq"] == ("notes", 0.6, "llm") and got["vvv"][0] is None and got["Email"][2] == "exact" and sorted(asked) == ["vvv", "zzz qqq"]
    assert mapping.suggest_fields(m, lambda h, f: "notes please").where("method = 'llm'").count() == 0
    assert mapping.sanitize_header('a"b\x07' + "c" * 200) == "a'b" + "c" * 96


def test_alignment_takes_the_last_header(spark):
    m = mapped(spark, "Total", "Amount Due", sheet="a").unionByName(mapped(spark, "Price", sheet="b"))
    assert mapping.align_columns(m).first().sheets == {"a": "Amount Due", "b": "Price"}
    assert {(r.sheet, r.field): r.confidence for r in mapping.field_confidence(m).collect()} == {("a", "amount"): 1.0, ("b", "amount"): 1.0}


# ------------------------------------------------------------------ rows
def cleaned_of(spark, headers, rows, locale="us"):
    g = grid(spark, {"s": [headers, *rows]})
    return cleaning.clean_rows(g, spark.createDataFrame([("s", 0)], "sheet string, header_row long"), mapped(spark, *headers), locale)


def test_row_filters_and_reconciliation(spark):
    rows = [["Ann", "a@b.co", "$5"], [None, " - ", "N/A"], ["NAME", "email", "AMOUNT"], ["?", None, "soon"], ["Bo"], ["Cy", "bad", "(7)", "beyond the header"]]
    c = cleaned_of(spark, ["Name", "Email", "Amount"], rows)
    got = {r.source_row: r for r in c.collect()}
    assert {k: r.dropped for k, r in got.items()} == {2: None, 3: cleaning.BLANK, 4: cleaning.HEADER, 5: cleaning.MALFORMED, 6: None, 7: None}
    assert [i.message for i in got[5].issues] == ["unparseable numeric value: 'soon'", cleaning.MESSAGES[cleaning.MALFORMED]]
    r = quality.reconcile(c).first()
    assert (r.raw, r.extracted, r.dropped) == (6, 3, 3)
    assert {r.reason: r.n for r in quality.dropped_reasons(c).collect()} == {cleaning.BLANK: 1, cleaning.HEADER: 1, cleaning.MALFORMED: 1}
    recs = {r.source_row: r for r in records.to_records(c).collect()}
    assert (recs[2].full_name, recs[2].email, recs[2].amount) == ("Ann", "a@b.co", 5.0)
    assert (recs[6].full_name, recs[6].email) == ("Bo", None) and (recs[7].email, recs[7].amount) == ("bad", -7.0)
    assert recs[2].issues == ["Amount: currency symbols/commas stripped"]
    assert quality.suspicious_values(c, records.to_records(c)).first().n == 2  # a negative amount and a bad address


def test_random_sheets_reconcile(spark):
    rng = random.Random(7)
    pool = ["Name", "Total", "Date", None, "", "n/a", "x", 5, -2.5, "2026-01-01", "03/04/2026", "$7", True]
    sheets = {f"s{k}": [["Name", "Total", "Date"], *([rng.choice(pool) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(0, 40)))] for k in range(5)}
    g = grid(spark, sheets)
    profiles = spark.createDataFrame([(n, 0) for n in sheets], "sheet string, header_row long")
    heads = mapping.map_headers(mapping.headers_of(g, profiles))
    c = cleaning.clean_rows(g, profiles, heads)
    counts = {r.sheet: r for r in quality.reconcile(c).collect()}
    for n, rows in sheets.items():
        if len(rows) > 1:
            assert counts[n].raw == len(rows) - 1 == counts[n].extracted + counts[n].dropped
    assert records.to_records(c).count() == sum(r.extracted for r in counts.values())


def test_collisions(spark):
    c = cleaned_of(spark, ["Total", "Amount Due", "Price", "Other"], [["n/a", "5", "6", "o"], ["1", None, "2", None], ["x", "", "tbd", "z"]])
    recs = {r.source_row: r for r in records.to_records(c).collect()}
    assert [recs[i].amount for i in (2, 3, 4)] == [5.0, 1.0, None] and recs[2].extra == {"Other": "o"} and recs[3].extra == {"Other": None}
    assert sorted((r.source_row, r.header) for r in records.collisions(c).collect()) == [(2, "Price"), (3, "Price")]


# ------------------------------------------------------------------ duplicates
def record_rows(spark, rows):
    return spark.createDataFrame(rows, "sheet string, sheet_ord int, source_row long, email string, id string, full_name string")


def test_duplicates(spark):
    r = record_rows(spark, [
        ("a", 0, 2, "x@y.co", "1", "Ann"), ("a", 0, 3, " X@Y.co", "2", "Bo"), ("a", 0, 4, None, "1", "Cy"), ("a", 0, 5, "", "", "ann"), ("a", 0, 6, None, None, "Ann "), ("a", 0, 7, None, None, None),
        ("b", 1, 2, "x@y.co", None, None), ("b", 1, 3, "x@y.co", None, None), ("b", 1, 4, None, "1", None), ("b", 1, 5, None, "9", None), ("b", 1, 6, None, "9", None)])
    assert sorted(tuple(x) for x in quality.duplicates_in_sheet(r).collect()) == [("a", 2, 3), ("a", 5, 6), ("b", 2, 3), ("b", 5, 6)]
    assert sorted(tuple(x) for x in quality.duplicates_across_sheets(r).collect()) == [("a", 2, "b", 2), ("a", 2, "b", 3), ("a", 4, "b", 4)]
    assert quality.duplicates_in_sheet(r, ()).count() == 0


# ------------------------------------------------------------------ overlap
def sheet_rows(spark, sheets):
    rows = [(n, o, i + 2, [(k, v) for k, v in r.items()]) for o, (n, rs) in enumerate(sheets.items()) for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "sheet string, sheet_ord int, source_row long, values array<struct<field: string, value: string>>")
    return df.withColumn("row_hash", overlap.row_hash(F.col("values")))


def test_sheet_diffs(spark):
    rows = sheet_rows(spark, {"v1": [{"email": "A@x", "amount": "1"}, {"email": "b", "amount": "2"}, {"email": None, "amount": "9"}], "v2": [{"email": "a@x ", "amount": "1.5"}, {"email": "c", "amount": ""}, {"email": "", "amount": "9"}]})
    pairs = overlap.sheet_pairs(rows)
    assert pairs.first().key_field == "email"
    summary, modified, alone = overlap.sheet_diffs(rows, pairs)
    s = summary.first()
    assert (s.common, s.only_a, s.only_b, s.overlap_pct) == (2, 1, 1, 50.0)
    assert sorted((m.row_a, m.row_b, m.field, m.val_a, m.val_b) for m in modified.collect()) == [(2, 2, "amount", "1", "1.5"), (2, 2, "email", "A@x", "a@x ")]
    assert sorted((x.side, x.source_row) for x in alone.collect()) == [("a", 3), ("b", 3)]


def classified(spark, sheets, fields):
    rows = sheet_rows(spark, sheets)
    table = spark.createDataFrame(list(fields.items()), "sheet string, fields array<string>")
    kinds = overlap.classify(overlap.shared_rows(rows, overlap.sheet_pairs(rows)), table)
    return overlap.decide([r.asDict() for r in kinds.collect()])


def test_identical_partial_unique(spark):
    two = [{"id": "1"}, {"id": "2"}]
    report, dropped = classified(spark, {"a": two, "b": [{"id": " 2"}, {"id": "1"}], "c": [{"id": "1"}, {"id": "7"}], "d": two}, {k: ["id"] for k in "abcd"})
    assert dropped == ["b", "d"]
    assert [(r["a"], r["b"], r["action"].split(":")[0], r["overlap_pct"], r["shared"]) for r in report] == [("a", "b", "IDENTICAL", 100.0, 2), ("a", "c", "PARTIAL_OVERLAP", 50.0, 1), ("a", "d", "IDENTICAL", 100.0, 2)]


def test_copies_with_inner_repeats_are_partial_and_disjoint_fields_are_unique(spark):
    twice = [{"id": "1"}, {"id": "1"}]
    report, dropped = classified(spark, {"a": twice, "b": twice, "c": twice}, {"a": ["id"], "b": ["id"], "c": ["amount"]})
    assert dropped == [] and [(r["action"].split(":")[0], r["shared"]) for r in report] == [("PARTIAL_OVERLAP", 1), ("UNIQUE", 0), ("UNIQUE", 0)]


# ------------------------------------------------------------------ profiles
def test_profile(spark):
    data = {"full_name": ["Alice", "Bob", "Alice", None], "amount": ["10.0", "50.0", "90.0", " "], "created_at": ["2026-01-01", "2026-02-01", "2026-01-15", ""], "empty": [None] * 4}
    long = spark.createDataFrame([(f, i, v, None) for f, vs in data.items() for i, v in enumerate(vs)], "field string, ord int, value string, num double")
    issues = spark.createDataFrame([("amount",), ("amount",), (None,)], "column string")
    got = {r.field: r for r in profiling.profile(long, 4, issues).collect()}
    a = got["full_name"]
    assert (a.null_count, a.null_pct, a.unique_count, a.quality_score) == (1, 25.0, 2, 87.5) and [tuple(t) for t in a.top_values] == [("Alice", 2), ("Bob", 1)]
    b = got["amount"]
    assert (b.min_value, b.max_value, b.mean_value, b.invalid_count, b.quality_score) == (10.0, 90.0, 50.0, 2, 62.5)
    assert (got["created_at"].min_date, got["created_at"].max_date) == ("2026-01-01", "2026-02-01")
    assert (got["empty"].unique_count, got["empty"].null_pct, got["empty"].quality_score) == (0, 100.0, 50.0)


def test_top_values_break_ties_by_first_occurrence(spark):
    long = spark.createDataFrame([("f", i, v) for i, v in enumerate("dcbaefgag")], "field string, ord int, value string")
    assert [t.value for t in profiling.top_values(long).first().top_values] == ["a", "g", "d", "c", "b"]


def test_local_model():
    import http.server
    import threading

    from gridwright.sources.suggest import local_model

    seen = []

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": " Amount. " if "Cash" in seen[-1]["prompt"] else "anything else"}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = local_model("m", f"http://127.0.0.1:{server.server_port}")
    assert ask("Cash", ["amount", "id"]) == "amount" and ask("Weight", ["amount", "id"]) is None
    assert seen[0]["options"] == {"temperature": 0} and seen[0]["model"] == "m"
    server.shutdown()
