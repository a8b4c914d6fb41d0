"""Digit law: first and second digits of amounts against Benford's distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import first_of, number, rounded

# Expected shares of the first and second digits, and limits of the mean deviation.
FIRST = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}
SECOND = {0: 0.120, 1: 0.114, 2: 0.109, 3: 0.104, 4: 0.100, 5: 0.097, 6: 0.093, 7: 0.090, 8: 0.088, 9: 0.085}
LIMITS = [(0.006, "Close Conformity"), (0.012, "Acceptable"), (0.015, "Marginally Acceptable")]


def digit(amount: Column, place: int) -> Column:
    """The first or second significant digit of a nonzero amount."""
    plain = F.regexp_replace(F.regexp_replace(F.abs(amount).cast("string"), r"\.", ""), "^0+", "")
    return F.substring(F.concat(plain, F.lit("0")), place, 1).cast("int")


def benford(df: DataFrame, least: int = 100) -> DataFrame:
    """(place, digit, count, observed, expected, deviation, z, suspicious); nothing below least amounts."""
    spark = df.sparkSession
    rows = df.where("amount != 0").groupBy("amount").agg(F.count("*").alias("n"))
    flat = rows.select("n", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), digit(F.col("amount"), p).alias("digit")) for p in (1, 2)])).alias("x"))
    counts = flat.groupBy("x.place", "x.digit").agg(F.sum("n").alias("count"))
    every = rows.agg(F.sum("n").alias("all"))
    law = spark.createDataFrame([(p, d, e) for p, t in ((1, FIRST), (2, SECOND)) for d, e in t.items()], "place int, digit int, expected double")
    j = law.join(counts, ["place", "digit"], "left").crossJoin(every).where(F.col("all") >= least).withColumn("count", F.coalesce("count", F.lit(0)))
    o = F.col("count") / F.col("all")
    z = (o - F.col("expected")) / F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("all"))
    return j.select("place", "digit", "count", rounded(o * 100).alias("observed_pct"), rounded(F.col("expected") * 100).alias("expected_pct"), rounded((o - F.col("expected")) * 100).alias("deviation"), rounded(z).alias("z"), (F.abs(z) > 2).alias("suspicious"))


def benford_test(df: DataFrame, least: int = 100) -> DataFrame:
    """Per place: chi-square statistic, mean absolute deviation of shares, level of conformity."""
    b = benford(df, least)
    o, e = F.col("observed_pct") / 100, F.col("expected_pct") / 100
    n = F.sum("count")
    g = b.groupBy("place").agg((F.sum((o - e) * (o - e) / e) * n).alias("chi"), F.avg(F.abs(o - e)).alias("mad"), n.alias("amounts"))
    return g.select("place", "amounts", rounded(F.col("chi"), 1).alias("chi_square"), rounded(F.col("mad"), 5).alias("mad"), first_of([(F.col("mad") <= t, name) for t, name in LIMITS], "Non-conforming").alias("conformity"))


def benford_entries(df: DataFrame, n: int = 100) -> DataFrame:
    """Amounts with a suspicious first digit, the most frequent first, up to n."""
    odd = benford(df).where("place = 1 AND suspicious").select("digit")
    rows = df.where("amount != 0").groupBy(F.abs("amount").alias("value")).agg(F.count("*").alias("lines"), F.count_distinct("account").alias("accounts")).withColumn("digit", digit(F.col("value"), 1))
    return rows.join(F.broadcast(odd), "digit", "left_semi").orderBy(F.desc("lines"), F.desc("value")).limit(n).select("value", "digit", "lines", "accounts")


def benford_round(df: DataFrame, steps: tuple[int, ...] = (100, 1000, 10_000)) -> DataFrame:
    """Share of amounts that are multiples of each step, against three times what is expected."""
    a, n = F.abs("amount"), F.count_if(F.col("amount") != 0)
    rows = df.agg(n.alias("n"), *[F.count_if((a >= s) & (a % s == 0)).alias(f"c{s}") for s in steps])
    row = lambda s: F.struct(F.lit(s).alias("step"), F.col(f"c{s}").alias("count"), rounded(number(F.col(f"c{s}")) / F.col("n") * 100).alias("pct"), (number(F.col(f"c{s}")) / F.col("n") * 100 > 300 / s).alias("suspicious"))
    return rows.select(F.inline(F.array(*[row(s) for s in steps])))
