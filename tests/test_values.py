"""Literal cases of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tillbook.functions import checks, dates, money, names
from tillbook.operators import search


def one(spark, column, *values, schema="t string"):
    rows = spark.createDataFrame([(v,) for v in values], schema).select(F.monotonically_increasing_id().alias("i"), column.alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]




def test_money_from_ocr(spark):
    cases = {
        "1,234.56": 123456, "1.234,56": 123456, "$84.37": 8437, "84.37-": -8437, "84,37": 8437, "8437": 8437, "S4.37": 437,
        "($12.50)": -1250, "€10,50": 1050, "USD 20.00": 2000, "0.01": 1, "100": 100, "abc": None, "1,234,567": 123456700,
        "84.3": 8430, "12": 1200, "−5.00": -500, "1.234.567": 123456700, ".5": None, "1.23.45": 12345, "1234.567": 123456700,
    }
    got = one(spark, money.parse_money_ocr(F.col("t")), *cases)
    assert [g and g["minor"] for g in got] == list(cases.values())


def test_money_on_labelled_lines(spark):
    cases = {"TOTAL 100": (10000, 0.6), "TOTAL 1000": (100000, 0.6), "AMOUNT DUE 25": (2500, 0.6), "TOTAL 84.37": (8437, 0.95), "TOTAL -54.11": (-5411, 0.95)}
    got = one(spark, money.find_money(F.col("t"), labelled=True), *cases)
    assert [(g["minor"], g["confidence"]) for g in got] == list(cases.values())


def test_typed_money(spark):
    cases = {"84.37": 8437, "$84.37": 8437, "1,234.56": 123456, "-12.50": -1250, "(12.50)": -1250, "84": 8400, "84.5": 8450, "+3": 300, "(-3)": 300, "": None, "  ": None, None: None}
    got = one(spark, money.parse_money_text(F.col("t")), *cases)
    assert [(g["minor"], g["error"]) for g in got] == [(v, None) for v in cases.values()]
    bad = one(spark, money.parse_money_text(F.col("t")), "abc", "1.234", "12,34", "1,23.4", "--5", "99999999999999999999")
    assert all(b["minor"] is None and b["error"].startswith("invalid amount: ") for b in bad)


def test_dates(spark):
    day = datetime.date
    cases = {
        "2026-07-30": (day(2026, 7, 30), 0.98, False), "30 Jul 2026": (day(2026, 7, 30), 0.95, False), "03/04/2026": (day(2026, 3, 4), 0.55, True),
        "13/04/2026": (day(2026, 4, 13), 0.92, False), "04/13/26": (day(2026, 4, 13), 0.92, False), "5.5.85": (day(1985, 5, 5), 0.9, False),
    }
    got = one(spark, dates.parse_date(F.col("t")), *cases, "2026-02-31", "13/13/2026", "tomorrow", "5.5.1985")
    wanted = [v if v[0].year >= 1990 else None for v in cases.values()] + [None, None, None, None]
    assert [g and (g["civil"], g["confidence"], g["ambiguous"]) for g in got] == wanted
    assert one(spark, dates.parse_date(F.col("t"), "DMY"), "03/04/2026")[0]["civil"] == day(2026, 4, 3)
    assert one(spark, dates.date_order(F.col("t")), "en-GB", "ja", "en", "", None, "de-AT") == ["DMY", "YMD", "MDY", "MDY", "MDY", "DMY"]


def test_vendor_names(spark):
    cases = {
        "HOME DEPOT #4821": "home depot", "Wal-Mart": "wal mart", "7-Eleven": "7 eleven", "99 Ranch Market": "99 ranch market", "76": "76",
        "Chevron 76": "chevron 76", "Acme Inc.": "acme", "Shell Store 12": "shell", "Café Müller GmbH": "café müller",
    }
    assert one(spark, names.normalize_vendor(F.col("t")), *cases) == list(cases.values())
    assert len(set(one(spark, names.vendor_match_key(F.col("t")), "WAL MART", "Walmart"))) == 1
    assert one(spark, names.looks_like_vendor(F.col("t")), "BEST BUY #1188", ". Lo - Le", "#1188", "FEAT a HL I s 1 T e", "x" * 25) == [True, False, False, False, False]


def test_paths_and_json(spark):
    assert one(spark, checks.is_relative_path(F.col("t")), "a/b.jpg", "/a", "C:\\x", "a/../b") == [True, False, False, False]
    assert one(spark, checks.is_inside(F.lit("/new"), F.col("t")), "/new", "/new/a", "/newer/a", "/new/../x") == [True, True, False, False]
    assert one(spark, F.size(checks.json_fields(F.col("t"))), "{bad", '{"a":{"confidence":0.1}}', None) == [0, 1, 0]
    assert one(spark, checks.json_list(F.col("t")), '["a","b"]', "nope", None) == [["a", "b"], [], []]


def test_query_text():
    assert search.clean_query('home* "depot" " AND') == [("home", True), ("depot", False), ("AND", False)]
    for hostile in ("*", "*x", "a *b"):
        with pytest.raises(search.SearchQueryError):
            search.clean_query(hostile)
    assert search.query_tokens([("Müller-Söhne", False), ('--', False)]) == [(["muller", "sohne"], False)]
