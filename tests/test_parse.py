"""Dates and amounts of the usual shapes, read without formats, are what the formats give."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from folio.sources import canonical


def test_dates_of_usual_shapes(spark):
    good = {"31/12/2024": date(2024, 12, 31), "01-02/2024": date(2024, 2, 1), "29.02.2024": date(2024, 2, 29), "2024-12-31": date(2024, 12, 31), "2024/1/5": date(2024, 1, 5), "1.2.24": date(2024, 2, 1), "0025-02.94": date(2094, 2, 25)}
    bad = ["31/02/2024", "00/01/2024", "01/13/2024", "29/02/2023", "2024-02-30", "31/12/2024x"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", canonical.parse_date(F.col("t")).alias("d")).collect()}
    assert got == good | dict.fromkeys(bad)
    # tried first: a format that doesn't fit costs an exception for each line
    plan = df.select(canonical.parse_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("yyyy-MM-dd HH:mm:ss")


def test_amounts_of_usual_shapes(spark):
    texts = {"12,5": "12.5", "-3.25": "-3.25", " 7 ": "7", "1 234,56 €": "1234.56", "1.234,56": "1234.56", "1,234.56": "1234.56", "1,5,2": "0", "x": "0"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["a"] for r in df.select("t", canonical.parse_amount(F.col("t")).alias("a")).collect()} == {t: Decimal(a) for t, a in texts.items()}
