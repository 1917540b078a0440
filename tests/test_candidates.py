import random

import pytest
from dateutil import parser
from pyspark.sql import functions as F

from paperloom.functions.candidates import amount_candidates, date_candidates, date_iso, day_first, lines_of, looks_like_bill

AMOUNTS = {
    "$1,234.56": [1234.56], "$1.234,56": [1234.56], "$1,234": [1234.0], "1,234": [], "$1234.56": [123.0, 4.56], "($50.00)": [-50.0], "(see $50)": [-50.0], "Qty 3 $500": [3.0], "-12.50": [-12.5],
    "1.234.56": [], "12.50 USD": [12.5], "USD 7": [7.0], "€\u00a05": [5.0], "$5 and $5": [5.0], "": [],
}


def test_amounts(spark):
    rows = spark.createDataFrame(list(AMOUNTS.items()), "t string, e array<double>")
    for r in rows.select("t", "e", amount_candidates(F.col("t")).alias("c")).collect():
        assert [c.value for c in r.c] == r.e, r.t


def test_amounts_are_capped_and_keep_their_order(spark):
    text = " ".join(f"${i}.00" for i in range(1, 40))
    got = spark.createDataFrame([(text,)], "t string").select(amount_candidates(F.col("t")).alias("c")).first().c
    assert [c.value for c in got] == [float(i) for i in range(1, 21)]


def test_line_of_a_candidate(spark):
    row = spark.createDataFrame([("a\n  total $5.00 net\nb",)], "t string").select(lines_of(F.col("t"), F.array(F.lit("$5.00"))).alias("l")).first()
    assert row.l == ["total $5.00 net"]
    text = "fee $50\nof $5\n1,250.00\nplus 250.00, or $1234.56"
    row = spark.createDataFrame([(text,)], "t string").select(lines_of(F.col("t"), F.array(*map(F.lit, ["$5", "250.00", "$123", "4.56", "none"]))).alias("l")).first()
    assert row.l[:4] == ["of $5", "plus 250.00, or $1234.56", "plus 250.00, or $1234.56", "plus 250.00, or $1234.56"]


def test_dates_are_read_as_a_date_parser_does(spark):
    rng, raws = random.Random(1), set()
    for _ in range(800):
        a, b, y, sep = rng.randint(1, 33), rng.randint(1, 33), rng.choice([2025, 1999, 2024, 99, 25, 3]), rng.choice("/-.")
        month = rng.choice("Jan January Sept Sep September May Mayor Decem June".split())
        raws.add(rng.choice([f"{a}{sep}{b}{sep}{y:02d}", f"{2000 + b}-{a:02d}-{b:02d}", f"{a} {month} {2000 + b}", f"{month} {a:02d}, {1990 + b}"]))
    rows = spark.createDataFrame([(r, d) for r in raws for d in (True, False)], "r string, d boolean")
    for r in rows.select("r", "d", date_iso(F.col("r"), F.col("d"), 2026).alias("i")).collect():
        try:
            expected = parser.parse(r.r, dayfirst=r.d).date().isoformat()
        except (ValueError, OverflowError):
            expected = None
        assert r.i == expected, r


def test_mixed_separators(spark):
    rows = spark.createDataFrame([("1/2.2025",), ("12/05-2025",)], "r string").select(date_iso(F.col("r"), F.lit(False)).alias("i")).collect()
    assert [r.i for r in rows] == [None, "2025-12-05"]


@pytest.mark.parametrize("text,first,dates", [("due 03/04/2025", False, ["2025-03-04"]), ("£5 due 03/04/2025", True, ["2025-04-03"]), ("v 1.2.2025 and 2025-03-04", True, ["2025-02-01", "2025-04-03"]), ("99/99/9999", False, [])])
def test_dayfirst(spark, text, first, dates):
    row = spark.createDataFrame([(text,)], "t string").select(day_first(F.col("t")).alias("f"), date_candidates(F.col("t")).alias("c")).first()
    assert row.f == first and [c.iso for c in row.c] == dates


@pytest.mark.parametrize("text,bill", [("Invoice for $5", True), ("invoices for $5", False), ("Billing: 3.50", True), ("Bills: 3.50", False), ("Invoice 5", False), (None, False)])
def test_bill_words(spark, text, bill):
    assert spark.createDataFrame([(text,)], "t string").select(looks_like_bill(F.col("t")).alias("b")).first().b == bill


ADDRESSES = {"host 12.23.232.21 up": [], "112.12.12.34": [], "1.2.12.24.74": [], "on 12.11.2024. Then": ["2024-11-12"], "see 1.3 May 2024": ["2024-05-03"], "12.23.232.21 since 1.2.2025": ["2025-02-01"]}


def test_dotted_addresses_are_no_dates(spark):
    rows = spark.createDataFrame(list(ADDRESSES.items()), "t string, e array<string>")
    for r in rows.select("t", "e", date_candidates(F.col("t")).alias("c")).collect():
        assert [c.iso for c in r.c] == r.e, r.t
