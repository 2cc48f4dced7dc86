from __future__ import annotations

from gridmeter.operators.bills import bill_comparison, bill_rejects, parse_bills


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "bill_id int, text string")
    return [(r.bill_date, r.cost, r.consumption) for r in parse_bills(df).orderBy("bill_id").collect()]


def test_labelled_layout(spark):
    text = ("BILL OF SUPPLY FOR THE MONTH  OF - ऑगस्ट-2025\nDate 01-09-2025\nदेयक रक्कम रु. : 1234,50\n"
            "July 2025 99\nAug 2025 120\nSep 2025 7")
    assert parsed(spark, text) == [("August 2025", 1234.5, 120.0)]


def test_date_amount_and_meter_row_fallbacks(spark):
    text = "Bill 05/03/2024 pay 12 and 845.20 only\n4711 1.00 90 o 90\n"
    assert parsed(spark, text) == [("March 2024", 845.2, 90.0)]
    assert parsed(spark, "4711 1.00 90 5 90 on 05/03/2024")[0][2] is None


def test_median_of_rupee_amounts(spark):
    text = "MONTH OF May 2024: Rs. 100.00 Rs 50,00 Rs.300.10 Rs 10.00"
    assert parsed(spark, text) == [("May 2024", 75.0, None)]


def test_summary_layout_and_garbled_currency_sign(spark):
    head = "Bill Month Units Consumed Current Month Bill\n"
    assert parsed(
        spark, head + "AUG-26 145 1283.54\nPay 71270.00", head + "aug 26 145 1283.54 Pay 1270.00",
        head + "SEP-26 14.5\nTotal current month charges : 1283.54", head + "no month here 01-02-2023 100.00",
    ) == [
        ("August 2026", 1270.0, 145.0), ("August 2026", 1270.0, 145.0), ("September 2026", 1283.54, None),
        ("February 2023", 100.0, None),
    ]


def test_second_reading_only_when_it_helps(spark):
    df = spark.createDataFrame([
        (1, "MONTH OF May 2024 Rs 10.00", "May 2024 77"), (2, "MONTH OF May 2024 Rs 10.00", "nothing"), (3, "no month", "May 2024 77"),
    ], "bill_id int, text string, rows string")
    got = {r.bill_id: (r.bill_date, r.consumption) for r in parse_bills(df, "text", "rows").collect()}
    assert got == {1: ("May 2024", 77.0), 2: ("May 2024", None), 3: (None, None)}


def test_rejects_name_the_unreadable_fields(spark):
    df = spark.createDataFrame([(1, "nothing"), (2, "MONTH OF May 2024 Rs 10.00\nMay 2024 5")], "bill_id int, text string")
    assert [(r.bill_id, r.unreadable) for r in bill_rejects(parse_bills(df)).collect()] == [
        (1, ["bill month", "amount", "units consumed"])]


def test_latest_bill_against_the_one_before(spark):
    rows = [(1, "December 2023", 0.0), (1, "January 2024", 30.0), (2, "May 2024", 5.0), (3, "April 2024", 40.0), (3, "May 2024", 50.0)]
    df = spark.createDataFrame(rows, "user_id long, bill_date string, cost double")
    got = {r.user_id: (r.latest_date, r.cost_difference, r.change_percent, r.direction) for r in bill_comparison(df).collect()}
    assert got == {1: ("January 2024", 30.0, 0.0, "higher"), 3: ("May 2024", 10.0, 25.0, "higher")}
