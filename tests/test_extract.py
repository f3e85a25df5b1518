"""Receipt texts of the usual shapes, and layouts."""

import pytest
from pyspark.sql import functions as F

from tillbook.operators import extract, lines

TEXTS = {
    "us": "HOME DEPOT #4821\n123 Main St\n07/12/2026 14:22\nLumber 2x4   8.50\nNails 2.84\nSUBTOTAL 11.34\nSALES TAX 0.94\nTOTAL 12.28\nVISA ************4821\nThank you",
    "next": "Corner Shop\nDate: 30 Jul 2026\nItem A 20.00\nItem B 20.00\nTAX 3.40\nTOTAL\n43.40\nCASH",
    "refund": "Walmart\n2026-01-05\nRETURN\nTOTAL -54.11\nDEBIT",
    "none": "Some Shop\nhello world\n",
    "de": "BAUHAUS\n03.04.2026\nNETTO 208,32\nMwSt 19% 39,58\nSUMME 247,90\ngirocard",
    "mangled": "Acme Tools\n2026-02-03\nSUBTOTAL 98.25\nGST 5% 4.91\nPST 17% 99.0\nTOTAL 112.95\nMC",
    "tip": "Bistro\n2026-03-01\nSUBTOTAL 82.00\nTAX 5.60\nTIP 9.00\nTOTAL 96.60\nAMEX",
    "discount": "Market\n2026-03-01\nSUBTOTAL 40.00\nTAX 3.20\nCOUPON 5.00\nTOTAL 38.20\nCheck",
    "net": "Supply Co\nInvoice # A-1001\nTerms: net 30\nAmount due 1,077.84",
    "noise": ". Lo - Le\n~~ 1 2 a\n",
    "half": "Shop 24\nTAX 90.00\nTOTAL 100.00",
    "empty": "",
}
WANTED = {
    "us": {"total": "1228", "vendor": "Home Depot", "txnDate": "2026-07-12", "paymentType": "VISA ****4821", "taxTotal": 94},
    "next": {"total": "4340", "vendor": "Corner Shop", "txnDate": "2026-07-30", "paymentType": "CASH", "taxTotal": 340},
    "refund": {"total": "-5411", "vendor": "Walmart", "txnDate": "2026-01-05", "paymentType": "DEBIT"},
    "none": {"vendor": "Some Shop"},
    "de": {"total": "24790", "vendor": "Bauhaus", "txnDate": "2026-03-04", "paymentType": "GIROCARD", "taxTotal": 3958},
    "mangled": {"total": "11295", "taxTotal": 1470, "paymentType": "MASTERCARD"},
    "tip": {"total": "9660", "taxTotal": 560, "paymentType": "AMEX"},
    "discount": {"total": "3820", "taxTotal": 320, "paymentType": "CHECK"},
    "net": {"total": "107784", "externalRef": "A-1001", "paymentType": "NET 30", "vendor": "Supply Co"},
    "noise": {},
    "half": {"total": "10000", "vendor": "Shop 24"},
    "empty": {},
}


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEXTS.items())], "page_id long, name string, ocr_text string")
    vendors = spark.createDataFrame([(1, "Home Depot"), (2, "Wal-Mart"), (3, "Bauhaus"), (4, "東京")], "id long, name string")
    out = {}
    for row in extract.fields_long(extract.parse_receipts(pages, vendors), "name").collect():
        out.setdefault(row["name"], {})[row["field"]] = row
    return out


@pytest.mark.parametrize("name", list(TEXTS))
def test_fields(parsed, name):
    import json

    got = {f: (json.loads(r["value"])["totalMinor"] if f == "taxTotal" else r["value"]) for f, r in parsed.get(name, {}).items()}
    for field, value in WANTED[name].items():
        assert got.get(field) == value, (field, got)
    if not WANTED[name]:
        assert not got
    for field in ("total", "taxTotal"):
        if field not in WANTED[name]:
            assert field not in got


def test_confidences_stay_in_range(parsed):
    assert all(0 <= r["confidence"] <= 1 for fields in parsed.values() for r in fields.values())


def test_lines_from_boxes(spark):
    box = lambda t, x, y: (t, (float(x), float(y), 10.0, 12.0), 0.9)
    words = [box("12.28", 80, 31), box("TOTAL", 0, 30), box("Shop", 40, 2), box("Corner", 0, 0)]
    schema = "page_id long, ocr_text string, ocr_words array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>,confidence:double>>"
    page = spark.createDataFrame([(1, None, words), (2, "a\r\n\n b ", [])], schema)
    got = {r["page_id"]: [l["text"] for l in r["lines"]] for r in lines.with_lines(page).select("page_id", "lines").collect()}
    assert got == {1: ["Corner Shop", "TOTAL 12.28"], 2: ["a", "b"]}
    text = lines.text_from_words(page.filter("page_id = 1")).first()["text"]
    assert text == "Corner Shop\nTOTAL 12.28"


def test_known_vendors_meet_texts_by_grams(spark):
    """Against brute force: the longest name that matches the first six lines."""
    names = ["Ace", "Ace Hardware", "Bo", "Target", "Tar", "Home Depot", "Depot", "7-Eleven", "Étoile", "Q", "Quartermaster Supplies", "Quartermain"]
    texts = ["quartermain\n", "quarterma", "the quartermasters", "exq", "ACE HARDWARE 12\nx", "super targets\n", "at the d3pot", "HOME DEP0T", "a\nb\nc\nd\ne\nf\nTarget", "7 eleven bo", "ÉTOILE", "tarmac"]
    vendors = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, ocr_text string")
    lined = lines.with_lines(pages)
    got = {r["page_id"]: r["vendor"] for r in extract.known_vendor_matches(lined, vendors).collect()}

    def folded(s):
        import re

        return re.sub("[^a-z0-9]+", " ", s.lower().translate(str.maketrans("015$", "oiss"))).strip()

    wanted = {}
    for i, t in enumerate(texts):
        hay = folded(" ".join([l.strip() for l in t.split("\n") if l.strip()][:6]))
        best = [n for n in names if (f := folded(n)) and (f in hay or (len(f.split()[0]) >= 4 and f.split()[0] in hay))]
        if best:
            wanted[i] = max(best, key=lambda n: (len(n), -names.index(n)))
    assert got == wanted


def test_layer_gate(spark):
    token = lambda t, x, y, w=50.0, h=12.0: (t, (float(x), float(y), w, h))
    schema = "page_id long, width_px int, height_px int, tokens array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>>>"
    good = [token("word", 10 + 100 * (i % 7), 30 * (i // 7)) for i in range(60)]
    cases = [
        (1, 800, 1000, good), (2, 800, 1000, []), (3, 800, 1000, [token("a", 1, 1)] * 9), (4, 800, 1000, [token("a", 1, 1, 0.0)]),
        (5, 800, 1000, [token("abc", 10 * i, 5, 2.0) for i in range(20)]), (6, 800, 500, [token("…!?", 90 * i, 40 * i) for i in range(5)]),
        (7, 800, 500, [token("ab\ufffd", 90 * i, 40 * i) for i in range(5)]),
    ]
    got = {r["page_id"]: r["reason"] for r in lines.layer_verdicts(spark.createDataFrame(cases, schema)).collect()}
    assert got[1] is None and got[2] == "no text layer" and "share 1 position" in got[3] and "zero-area" in got[4]
    assert "covers" in got[5] or "distinct" in got[5]
    assert got[6] == "junk layer: low alphanumeric ratio" and "unmappable" in got[7]


def test_seed_groups_are_the_earliest_in_reach(spark):
    """Against a search of all first members; and the work grows with the words, not with words times lines."""
    import random
    import time

    from tillbook.operators.lines import first_seed_groups

    rnd = random.Random(3)
    pages = [[rnd.choice([rnd.uniform(0, 90), float(rnd.randrange(90))]) for _ in range(n)] for n in (0, 1, 5, 300)]
    want = []
    for values in pages:
        seeds, groups = [], []
        for v in values:
            near = [k for k, s in enumerate(seeds) if abs(s - v) <= 2.5]
            groups.append(near[0] if near else len(seeds))
            if not near:
                seeds.append(v)
        want.append(groups)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(pages)], "k int, v array<double>")
    got = {r["k"]: list(r["g"]) for r in df.select("k", first_seed_groups(F.col("v"), F.lit(2.5)).alias("g")).collect()}
    assert [got[k] for k in range(len(pages))] == want
    took = []
    for n in (8_000, 8_000, 32_000):
        df = spark.createDataFrame([([float(7 * k % n * 10) for k in range(n)],)], "v array<double>")
        start = time.time()
        assert df.select(F.array_max(first_seed_groups(F.col("v"), F.lit(2.0))).alias("m")).first()["m"] == n - 1
        took.append(time.time() - start)
    assert took[2] <= 4.5 * max(took[1], 0.5)


def test_vendor_names_of_very_long_lines(spark):
    from tillbook.functions.names import normalize_vendor

    lines = ["word " * 40_000, "store " + " " * 100_000 + "x", "# " * 60_000, "12 " * 60_000, "a" + " 1234" * 40_000, "7" * 150_000]
    out = [r[0] for r in spark.createDataFrame(list(enumerate(lines)), "k int, v string").orderBy("k").select(normalize_vendor(F.col("v"))).collect()]
    assert out[0] == ("word " * 40_000).strip() and out[1] == "store x" and out[2] == "" and out[5] == "7" * 150_000
    assert out[4] == ("a" + " 1234" * 39_999)


def test_texts_are_kept_only_in_the_forms_that_names_need(spark, monkeypatch):
    kept = []
    real = extract.stored
    monkeypatch.setattr(extract, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    pages = lines.with_lines(spark.createDataFrame([(1, "Harbor Freight\nTOTAL 1.00"), (2, "Кофе\nTOTAL 2.00")], "page_id long, ocr_text string"))
    found = lambda names: {
        r["page_id"]: r["vendor"]
        for r in extract.known_vendor_matches(pages, spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()}
    assert found(["Harbor Freight"]) == {1: "Harbor Freight"}
    assert {(r["page_id"], r["literal"]) for r in kept[0].collect()} == {(1, False), (2, False)}
    assert found(["Кофе"]) == {2: "Кофе"}
    assert found(["Harbor Freight", "Кофе"]) == {1: "Harbor Freight", 2: "Кофе"}
    assert kept[2].count() == 4


def test_texts_and_columns_read_alike(spark):
    """Money, dates and names in plain Python against the column functions, on texts of all kinds of signs."""
    import random

    from tillbook.functions import dates, money, names
    from tillbook.operators import reading

    rnd = random.Random(11)
    words = (
        "TOTAL T0TAL SUB-TOTAL netto Sales Tax GST 5% M.W.ST mwst 30 Jul 2026 July 4th, 2024 Sept 31/12/99 2020-01-31 2026-02-31 03.04.2026 1-2-3 $12.50 ($12.50) "
        "-5.00 5.00- 1.234,56 1,234.56 12.345 1.2.3 ,5 .50 S4.37 99999999999999999999.00 USD 10 £3 Étoile 東京 ½ a b ~"
    ).split(" ")
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "\xa0", "-", "", "\u2028", "\r"]) for _ in range(rnd.randrange(7))) for _ in range(3000)]
    texts = [t for t in texts if t]
    c = F.col("t")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(
        money.find_money(c, labelled=True).alias("money"), dates.find_date(c, "DMY").alias("date"), dates.parse_date(c, "YMD").alias("whole"),
        names.looks_like_vendor(c).alias("vendor"), names.tax_label(c).alias("tax")).collect()
    for text, row in zip(texts, rows):
        date = lambda d: None if d is None else (d["civil"].isoformat(), d["confidence"], d["ambiguous"])
        assert reading.find_money(text) == (row["money"] and tuple(row["money"])), text
        assert reading.find_date(text, "DMY") == date(row["date"]), text
        assert reading.parse_date(text, "YMD") == date(row["whole"]), text
        assert reading.looks_like_vendor(text) == bool(row["vendor"]), text
        assert reading.tax_label(text) == row["tax"], text


def test_only_pieces_that_a_name_may_have_leave_a_page(spark):
    """Pages used to send every stretch of every length that a name begins with, some hundreds each."""
    from tillbook.plans.marks import marked_pieces, marks

    wanted = spark.createDataFrame([("bcde",), ("harbor f",), ("東京",), ("harbor freight tools",)], "piece string")
    bitmap = marks(wanted, "piece")
    texts = ["abcde trading 12 sep i999 invoice inv i2", "at harbor freight tools", "harbor", "nothing of it " * 30, "", None, "bcdebcde"]
    rows = spark.createDataFrame([(k, k == 7, t) for k, t in enumerate([*texts, "カフェ東京"])], "k int, form boolean, t string")
    got = {r["k"]: {tuple(p) for p in r["p"]} for r in rows.select("k", marked_pieces(F.col("form"), F.col("t"), {False: [4, 8], True: [2]}, bitmap, 20).alias("p")).collect()}
    assert got == {0: {("bcde", "")}, 1: {("harbor f", "reight tools")}, 2: set(), 3: set(), 4: set(), 5: set(), 6: {("bcde", "")}, 7: {("東京", "")}}


def test_names_longer_than_a_gram_travels_with_are_found_in_the_text(spark):
    long = "Quartermaster and Daughters Supplies for Ships and Boats of All Sizes in Port Townsend"
    pages = lines.with_lines(spark.createDataFrame([(1, f"the {long}\nTOTAL 1.00"), (2, long[:70]), (3, long[4:])], "page_id long, ocr_text string"))
    vendors = spark.createDataFrame([(1, "Qu-" + long), (2, "1 " + long), (3, "Port T")], "id long, name string")
    got = {r["page_id"]: r["vendor"] for r in extract.known_vendor_matches(pages, vendors).collect()}
    assert got == {1: "Port T", 3: "Port T"}
    vendors = spark.createDataFrame([(1, "the " + long), (3, "Port T")], "id long, name string")
    assert {r["page_id"]: r["vendor"] for r in extract.known_vendor_matches(pages, vendors).collect()} == {1: "the " + long, 3: "Port T"}


def test_receipts_are_printed_with_one_shuffle_by_order(spark):
    """Sums by rate, by flag and by order used to shuffle five times behind the first sum."""
    from tests.conftest import SF
    from tillbook.session import setting
    from tillbook.sources import receipts

    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = receipts.receipt_facts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    # The first sum and its spread by order, once for the rates and once for the flags, and the orders.
    assert len(shuffles) == 5 and sum("_groupingexpression" in s for s in shuffles) == 2


def test_words_of_runs_are_made_where_their_page_lies(spark):
    """Runs were moved by (page, line) and again by word, row by row; pages of one id still meet, and odd runs stay as they were."""
    nan = float("nan")
    run = lambda t, x, y=0.0, w=40.0, h=20.0: (t, (x, y, w, h))
    rows = [
        (1, [run("ab c", 0.0), run("d ef", 40.0), run("next", 0.0, 30.0)]), (1, [run("gh", 81.0, 0.0, 20.0)]),
        (2, None), (3, [run(None, 0.0), run("", 0.0), run(" ", 5.0), run("a\tb", 0.0)]), (None, [run("x", nan), run("y", 0.0, 0.0, None)]),
    ]
    pages = spark.createDataFrame(rows, "page_id long, tokens array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>>>")
    found = lines.words_from_runs(pages.repartition(4, "page_id").sortWithinPartitions("page_id"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["page_id"], r["line"], r["word_no"]): r["text"] for r in found.collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0, 1): "ab", (1, 0, 2): "cd", (1, 0, 3): "efgh", (1, 1, 1): "next"}
    assert sorted(v for k, v in got.items() if k[0] == 3) == ["a", "b"] and sorted(v for k, v in got.items() if k[0] is None) == ["x", "y"]
