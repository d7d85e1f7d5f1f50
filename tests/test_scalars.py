"""Hand-made values of every scalar function."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from segmill.functions import scalars as S
from segmill.functions.categories import most_similar, normalize_category


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_money(spark):
    cases = {"$1,250.00": 1250.0, "-$45.00": -45.0, "(45.00)": 45.0, "12-34": -1234.0, "1.234,56": 1.23456, "1.2.3": None, ".": None, "-": None, " ": None, "free": None, None: None, "R$ 7": 7.0}
    assert apply(spark, S.parse_money, cases) == list(cases.values())


def test_quantity(spark):
    cases = {"5.5": 6, "2.5": 2, "0.5": 0, "one": 1, " Dozen ": 12, "84 pcs": 84, "1,250": 1, "10-20": 10, "-3": None, "N/A": None, "lots": None, None: None}
    assert apply(spark, S.parse_quantity, cases) == list(cases.values())


def test_date(spark):
    d = lambda *a: dt.datetime(*a)
    cases = {
        "21-08-2023": d(2023, 8, 21), "04/16/2021": d(2021, 4, 16), "2023/04/13": d(2023, 4, 13), "2023-01-18": d(2023, 1, 18), "Apr 02, 2022": d(2022, 4, 2), "Apr 02 2022": d(2022, 4, 2), "13/32/2021": None, "00/00/0000": None,
        "31-02-2023": None, "05-04-2023": d(2023, 4, 5), "05-04-2023 10:00": d(2023, 5, 4, 10), "13/05/24": d(2024, 5, 13), "01-02-24": d(2024, 1, 2), "2023": d(2023, 1, 1), "20230118": d(2023, 1, 18), "2 Jan 2023": d(2023, 1, 2), "": None, None: None, "soon": None,
    }
    assert apply(spark, S.parse_date, cases) == list(cases.values())


DATES = [
    "01.02.2021", "13.02.2021", "2021", "202102", "2021-02", "02/2021", "Jan 2022", "4/1/22", "4/1/99", "22/4/13", "4/1/2022 1:05 PM", "2021-02-13 1:05 PM", "02-Apr-2022 13:00", "13-02-2021 10:00", "2021-02-13T10:00:00Z",
    "2021-02-13 10:00+02:00", "Mon, 02 Jan 2006 15:04:05", "1st Jan 2022", "01JAN2009", "20210213101112", "202102131011", "2021-13-01", "1:05 PM 2/13/2021", "2021-02-13 1 PM", "Jan 02 22", "05 22 Jan", "Sept 5, 2021", "12.5", "3 pcs",
    "2021-2-3 24:00", "2021/02/03 10:11:12.123456", "10-11-21", "31/12/2020 23:59", "2021-02-13 12:00 AM", "20210213T101112", "2021-02-30", "1/2/3", "0001-01-01", "Tuesday, April 5 2022", "2022-04-05, 10:15", "99-01-02",
    "1999-12-31 23:59:60", "2021-02-13 10:00:00 +0000", "2.13.2021 5:00pm", "2021-02-13T10", "13 2021 Feb", "feb 13th, 2021", "2021-02-13 13:00 PM", "ORD123456", "$5", "unknown",
]


def test_dates_as_the_mixed_parser_of_pandas_reads_them(spark):
    import pandas as pd

    for day_first in (False, True):
        for text, got in zip(DATES, apply(spark, lambda c, d=day_first: S.parse_mixed(c, d), DATES), strict=True):
            want = pd.to_datetime(pd.Series([text], dtype="string"), format="mixed", errors="coerce", dayfirst=day_first).iloc[0]
            want = None if pd.isna(want) else want.tz_convert("UTC").tz_localize(None) if want.tz else want
            if not (day_first and text == "2022-04-05, 10:15"):  # a comma makes pandas give up year-month-day there
                assert got == want, text


def test_ids(spark):
    cases = {"cus00001": "1", "0001": "1", "client001": "1", "AB-12": "12", "xy12": "12", "John Doe": "johndoe", "17850.0": "0", "000": "0", "2024-001": "1", "UNKNOWN": None, "N/A": None, "---": None, " ": None, None: None}
    assert apply(spark, S.canonical_customer_id, cases) == list(cases.values())
    cases = {"#1234": "1234", "##77": "77", "#N/A": "N/A", "DUPLICATE": None, "#": None, "n/a": None, " x ": "x", None: None}
    assert apply(spark, S.normalize_order_id, cases) == list(cases.values())


def test_category(spark):
    cases = {"TOYS": "Toys", "Beuaty": "Beauty", "buety": "Beauty", "Electrnics": "Electronics", "port": "Sports", "home and garden": "Home & Garden", "home": "Home", "t-shirts": "T-Shirts", "3d printers": "3D Printers", "unknown": None, None: None, " Food  & Grocery": "Food & Grocery"}
    assert apply(spark, normalize_category, cases) == list(cases.values())
    assert most_similar("apparel") is None


def test_rounding_and_formats(spark):
    assert apply(spark, S.round2, [0.125, 2.675, 1.005, None], "double") == [0.12, 2.68, 1.0, None]
    values = [16.45, 0.15, 0.25, 12.349, 1234567.0, -5.0, None, 2.5, 0.35]
    assert apply(spark, S.format_percent, values, "double") == [f"{v or 0:.1f}%" for v in values]
    values = [1.005, 2.675, 1234.565, -5.0, None, 0.125]
    assert apply(spark, S.format_currency, values, "double") == [f"${v or 0:,.2f}" for v in values]


def test_elapsed_days(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00' AS a, timestamp_ntz'2024-01-02 01:00' AS b").select(S.elapsed_days(F.col("a"), F.col("b")), S.elapsed_days(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (0, -1)


@pytest.mark.parametrize(("text", "codes"), [("$5", ["USD"]), ("R$ 5", ["BRL"]), ("5 CNY", ["CNY"]), ("¥5", ["JPY"]), ("CNY 5 ¥", ["CNY", "JPY"]), ("€1 or 2 GBP", ["EUR", "GBP"]), ("usd 5", []), ("5", [])])
def test_currencies(spark, text, codes):
    assert sorted(apply(spark, S.currencies, [text])[0]) == codes


def test_labels(spark):
    assert apply(spark, S.normalize_label, ["At-Risk_High "]) == ["at risk high"]
    assert apply(spark, lambda c: S.contains_any(c, ["at-risk", "churn"]), ["At-Risk High Value", "New", "Churned"]) == [True, False, True]


def test_similar_labels_are_those_of_the_library(spark):
    import difflib

    import numpy as np

    from segmill.functions import categories

    lows = [c.lower() for c in categories.CATEGORIES]
    rng = np.random.default_rng(0)

    def typo():
        word = list(rng.choice(lows))
        for _ in range(rng.integers(0, 5)):
            i = int(rng.integers(0, max(1, len(word))))
            word[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abcdeorst &"), rng.integers(0, 2)))
        return "".join(word)

    for value in {typo() for _ in range(10_000)} | {"", "x", "zz top", "books toys"}:
        near = difflib.get_close_matches(value, lows, n=1, cutoff=categories.SIMILAR)
        assert (categories.most_similar(value) or "").lower() == (near[0] if near else ""), value


def test_spellings_of_categories(spark):
    from segmill.functions import categories

    cases = {" toys ": "Toys", "TOYS": "Toys", "Home  and\tgarden": "Home & Garden", "N/A": None, "": None, " ": None, None: None, "Beuaty": "Beauty", "t-shirts": "T-Shirts", "pet   food": "Pet Food", " Sprots ": "Sports"}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert [r[0] for r in df.select(categories.normalize_category("v")).collect()] == list(cases.values())
