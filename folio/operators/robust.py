"""Account profiles and robust statistics over active months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import first_of, number, ratio, rounded, total
from folio.functions.ranks import counted, least_ahead, quantiles, quantiles_of, running

FACTOR = 0.6745


def active_months(df: DataFrame, year: int | None = None, key: str = "account") -> DataFrame:
    """(key, period, month, v): net amount of the months that have lines."""
    rows = df.where(F.col("year") == year) if year else df
    return rows.groupBy(key, "period", "month").agg(number(F.sum("amount")).alias("v"))


def long_form(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value): the cells of columns, cast to kind, nulls left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value IS NOT NULL")


def top_values(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(column, rank, value, lines): the most frequent values of each column, as text, smaller ones first on ties."""
    lines = long_form(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("lines"))
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("lines"), "value")))
    return ranked.where(F.col("rank") <= most).select("column", "rank", "value", "lines")


def profile_columns(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row per column: count, nulls, distinct; of numbers mean, sample deviation, range,
    quartiles and bias-corrected skewness and kurtosis; of texts the mode (first on ties).

    Distinct values are counted by groups and ranked by ranges, so no task holds those of a column.
    """
    made = []
    for c in [*numbers, *texts]:
        x, n = number(F.col(c)) if c in numbers else F.lit(None).cast("double"), F.count(c).cast("double")
        g1, g2 = F.skewness(x), F.kurtosis(x)
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        made.append(
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("nulls"), rounded(F.avg(x), 2).alias("mean"), rounded(F.stddev_samp(x), 2).alias("std"),
                rounded(F.min(x), 2).alias("min"), rounded(F.max(x), 2).alias("max"), rounded(skew, 3).alias("skew"), rounded(kurt, 3).alias("kurtosis"),
            )
        )
    moments = df.agg(F.array(*made).alias("s")).select(F.inline("s"))
    out = "column string, distinct long, q array<double>, mode string"
    known = df.sparkSession.createDataFrame([], out)
    if numbers:
        ranked = counted(long_form(df, numbers, "double"), ["column"], F.col("value"))
        q = ranked.groupBy("column").agg(F.count("*").alias("distinct")).join(quantiles_of(ranked, ["column"], [0.25, 0.5, 0.75]), "column")
        known = known.unionByName(q.withColumn("mode", F.lit(None).cast("string")))
    if texts:
        values = long_form(df, texts, "string").groupBy("column", "value").agg(F.count("*").alias("lines"))
        first = F.min_by("value", F.struct((-F.col("lines")).alias("n"), "value"))
        known = known.unionByName(values.groupBy("column").agg(F.count("*").alias("distinct"), F.lit(None).cast("array<double>").alias("q"), first.alias("mode")))
    quartiles = [rounded(F.get("q", F.lit(i))).alias(f"q{i + 1}") for i in range(3)]
    return moments.join(known, "column", "left").select(
        "column", "count", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "mean", "std", "min", "max", *quartiles, "skew", "kurtosis", "mode"
    )


def profile_accounts(df: DataFrame, year: int) -> DataFrame:
    """Amounts, months, December share, seasonality, regularity, behavior and risk of each account."""
    rows = df.where(F.col("year") == year)
    a = F.abs(number(F.col("amount")))
    lines = rows.groupBy("account").agg(
        F.count("*").alias("entries"), total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"), F.avg(a).alias("m"),
        rounded(F.stddev_samp(a), 2).alias("std"), rounded(F.min(a)).alias("min"), rounded(F.max(a)).alias("max"),
    )
    middle = quantiles(rows, ["account"], a, [0.5]).select("account", rounded(F.get("q", F.lit(0))).alias("median"))
    lines = lines.join(middle, "account", "left")
    v = F.abs("v")
    months = active_months(rows).groupBy("account").agg(
        F.count("*").alias("active_months"), F.avg(v).alias("mm"), F.stddev_samp(v).alias("ms"), F.min_by("period", F.struct(v, F.col("period"))).alias("min_month"),
        F.min_by("period", F.struct(-v, F.col("period"))).alias("max_month"), (F.max(v) - F.min(v)).alias("range"),
        (F.coalesce(F.sum(F.when(F.col("month") == 12, v)), F.lit(0.0)) / F.sum(v) * 100).alias("dec"),
    )
    cv = F.coalesce(F.try_divide(F.col("ms"), F.col("mm")) * 100, F.lit(0.0))
    both = lines.join(months, "account").withColumn("cv", F.round(cv, 6)).withColumn("season", F.least(F.col("cv") / 100, F.lit(1.0)))
    season, regular = F.col("season"), F.greatest(1 - F.col("season"), F.lit(0.0))
    behavior = first_of([(regular > 0.7, "regulier"), (season > 0.5, "saisonnier"), (F.col("active_months") <= 2, "ponctuel")], "irregulier")
    point = lambda cond, x: F.when(cond, x).otherwise(0.0)
    risk = F.least(point(F.col("dec") > 50, 0.4) + point(season > 0.6, 0.3) + point(F.col("active_months") < 6, 0.3), F.lit(1.0))
    return both.select(
        "account", "entries", "active_months", "debit", "credit", rounded(F.col("m"), 6).alias("mean"), "median", "std", "min", "max", rounded(F.col("mm"), 6).alias("monthly_mean"),
        rounded(F.col("ms"), 2).alias("monthly_std"), rounded(F.col("cv")).alias("monthly_cv"), "min_month", "max_month", rounded(F.col("range")).alias("monthly_range"),
        rounded(F.col("dec")).alias("december_pct"), rounded(season).alias("seasonality"), rounded(regular).alias("regularity"), behavior.alias("behavior"), rounded(risk).alias("risk"),
    )


def baseline(df: DataFrame, year: int) -> DataFrame:
    """(dimension, value, lines, net, accounts): totals of the year by month, class and journal."""
    rows = df.where(F.col("year") == year)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in (("month", "period"), ("class", "class"), ("journal", "journal"), ("total", "year"))])
    flat = rows.select("account", "amount", F.explode(pairs).alias("x"))
    return flat.groupBy("x.dimension", "x.value").agg(F.count("*").alias("lines"), total(F.col("amount")).alias("net"), F.count_distinct("account").alias("accounts"))


def prefix_thresholds(df: DataFrame, year: int) -> DataFrame:
    """(prefix_2, threshold): twice the sample deviation of monthly totals, 1000 where it is 0 or unknown."""
    monthly = active_months(df, year, "prefix_2")
    sums = monthly.groupBy("prefix_2").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("s"))
    return sums.where("n > 2").select("prefix_2", rounded(F.when(F.coalesce("s", F.lit(0.0)) > 0, 2 * F.col("s")).otherwise(1000.0)).alias("threshold"))


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean share of nulls over the columns in per cent, and a grade from it (2, 5, 10, 20)."""
    shares = [F.avg(F.col(c).isNull().cast("int")) * 100 for c in columns]
    mean = sum(shares[1:], shares[0]) / len(columns)
    rows = df.agg(rounded(mean).alias("null_pct"), F.array_join(F.array_compact(F.array(*[F.when(s > 1, F.lit(c)) for c, s in zip(columns, shares)])), ",").alias("warned"))
    grade = first_of([(F.col("null_pct") < t, g) for t, g in ((2, "A"), (5, "B"), (10, "C"), (20, "D"))], "E")
    return rows.withColumn("grade", grade)


# Columns that must be filled, and the wording of what a profile warns of and recommends.
CRITICAL = ("account", "date", "debit", "credit")
HIGH_RISK, DECEMBER_HEAVY = 0.7, 80
ADVICE = {
    "nulls": "Colonne critique '{}' a {}% de valeurs manquantes", "risky": "{} comptes identifiés à haut risque d'anomalie",
    "first": "Vérifier en priorité les comptes: {}", "december": "{} comptes avec >80% de mouvement en décembre",
}


def profile_advice(df: DataFrame, year: int, critical: tuple[str, ...] = CRITICAL, most: int = 5) -> DataFrame:
    """(kind, rank, text): warnings on critical columns with over 1 % nulls and on accounts of high risk, and recommendations; the first accounts by number are named."""
    said = lambda key, *values: F.format_string(ADVICE[key].replace("%", "%%").replace("{}", "%s"), *values)
    share = lambda c: F.avg(F.col(c).isNull().cast("int")) * 100
    # one row of as many cells as there are critical columns
    nulls = df.agg(F.array(*[F.struct(F.lit("warning").alias("kind"), F.lit(i).alias("rank"), share(c).alias("pct"), F.lit(c).alias("c")) for i, c in enumerate(critical, 1)]).alias("s")).select(F.inline("s"))
    nulls = nulls.where("pct > 1").select("kind", "rank", said("nulls", F.col("c"), F.format_string("%.1f", rounded(F.col("pct"), 1))).alias("text"))
    profiles = profile_accounts(df, year)
    risky, heavy = F.col("risk") > HIGH_RISK, F.col("december_pct") > DECEMBER_HEAVY
    first = profiles.where(risky).orderBy("account").limit(most).agg(F.array_join(F.array_sort(F.collect_list("account")), ", ").alias("named"))
    counts = profiles.agg(F.count_if(risky).alias("risky"), F.count_if(heavy).alias("heavy")).crossJoin(F.broadcast(first))
    row = lambda kind, rank, cond, text: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), text.alias("text")))
    n = len(critical)
    rows = [
        row("warning", n + 1, F.col("risky") > 0, said("risky", F.col("risky"))), row("recommendation", n + 2, F.col("risky") > 0, said("first", F.col("named"))),
        row("recommendation", n + 3, F.col("heavy") > 0, said("december", F.col("heavy"))),
    ]
    return nulls.unionByName(counts.select(F.inline(F.array_compact(F.array(*rows)))))


def mad(df: DataFrame, year: int, threshold: float = 3.0) -> DataFrame:
    """Median, MAD, largest score and months above the threshold, of accounts with 3 or more active months."""
    m = active_months(df, year)
    centre = m.groupBy("account").agg(F.percentile("v", 0.5).alias("median"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n")).where("n >= 3")
    dev = m.join(centre, "account").withColumn("d", F.abs(F.col("v") - F.col("median")))
    spread = dev.groupBy("account").agg(F.percentile("d", 0.5).alias("raw"))
    scored = dev.join(spread, "account").withColumn("mad", F.when(F.col("raw") == 0, F.col("sd") / FACTOR).otherwise(F.col("raw")))
    scored = scored.withColumn("score", F.coalesce(F.abs(F.try_divide(F.lit(FACTOR) * (F.col("v") - F.col("median")), F.col("mad"))), F.lit(0.0)))
    hit = F.collect_list(F.when(F.col("score") > threshold, F.col("period")))
    out = scored.groupBy("account").agg(F.first("median").alias("med"), F.first("mad").alias("m"), F.max("score").alias("s"), F.array_join(F.array_sort(hit), ",").alias("months"))
    return out.select("account", rounded(F.col("med"), 6).alias("median"), rounded(F.col("m"), 6).alias("mad"), rounded(F.col("s"), 3).alias("score"), (F.col("s") > threshold).alias("is_anomaly"), "months")


def iqr(df: DataFrame, year: int, k: float = 1.5) -> DataFrame:
    """Quartiles, fences and the months outside, of accounts with 4 or more active months."""
    m = active_months(df, year)
    q = m.groupBy("account").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n")).where("n >= 4")
    q = q.select("account", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumns({"lower": F.col("q1") - k * F.col("iqr"), "upper": F.col("q3") + k * F.col("iqr")})
    j = m.join(q, "account")
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("period")))), ",")
    cols = ("q1", "q3", "iqr", "lower", "upper")
    return j.groupBy("account", *cols).agg(listed(F.col("v") < F.col("lower")).alias("low_months"), listed(F.col("v") > F.col("upper")).alias("high_months")).select(
        "account", *[rounded(F.col(c), 6).alias(c) for c in cols], "low_months", "high_months"
    )


def robust(df: DataFrame, year: int) -> DataFrame:
    """(account, method, months) found by MAD and by the quartile fences."""
    a = mad(df, year).where("is_anomaly").select("account", F.lit("mad").alias("method"), "months")
    both = F.concat_ws(",", F.array_sort(F.filter(F.array_union(F.split("low_months", ","), F.split("high_months", ",")), lambda x: x != "")))
    b = iqr(df, year).where("low_months != '' OR high_months != ''").select("account", F.lit("iqr").alias("method"), both.alias("months"))
    return a.unionByName(b)


def seasonality(df: DataFrame, year: int | None = None, min_months: int = 6) -> DataFrame:
    """Month index, pattern, strength, peaks and troughs of accounts with enough active months.

    The index of a month is its mean over the account's mean; missing months count 1.
    """
    m = active_months(df, year)
    w = Window.partitionBy("account")
    s = m.withColumns({"mean": F.avg("v").over(w), "n": F.count("*").over(w)}).where((F.col("n") >= min_months) & (F.round("mean", 6) != 0))
    idx = s.groupBy("account", "month").agg((F.avg("v") / F.first("mean")).alias("i"))
    s = s.join(idx, ["account", "month"]).withColumn("residual", F.col("v") - F.col("mean") * F.col("i"))
    stats = s.groupBy("account").agg(F.first("mean").alias("mean"), F.var_pop("v").alias("var"), F.var_pop("residual").alias("rvar"))
    at = lambda k: F.coalesce(F.max(F.when(F.col("month") == k, F.col("i"))), F.lit(1.0))
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("i", 9)).alias("neg"), F.col("month").alias("month"))))
    shape = idx.groupBy("account").agg(
        F.stddev_pop("i").alias("sd"), at(12).alias("dec"), (sum((at(k) for k in (6, 9, 12)), at(3)) / 4).alias("quarter"),
        (sum((at(k) for k in (2, 4, 5, 7, 8, 10, 11)), at(1)) / 8).alias("other"), ranked.alias("ranked"), F.count("*").alias("k"),
    )
    j = stats.join(shape, "account")
    pattern = first_of([(F.col("sd") < 0.15, "none"), (F.col("dec") > 2.0, "annual"), (F.col("quarter") > 1.3 * F.col("other"), "quarterly"), (F.col("sd") > 0.4, "irregular")], "monthly")
    strength = F.least(F.greatest(1 - F.col("rvar") / F.col("var"), F.lit(0.0)), F.lit(1.0))
    months = lambda part, cond: F.array_join(F.transform(F.filter(part, cond), lambda x: x["month"].cast("string")), ",")
    return j.select(
        "account", pattern.alias("pattern"), rounded(F.col("mean"), 2).alias("trend"), rounded(F.when(F.col("var") > 0, strength).otherwise(0.0)).alias("strength"),
        months(F.slice("ranked", 1, 3), lambda x: x["neg"] < -1).alias("peaks"), months(F.expr("slice(ranked, greatest(cast(k as int) - 2, 1), 3)"), lambda x: x["neg"] > -1).alias("troughs"),
        rounded(F.sqrt("rvar"), 2).alias("residual_std"),
    )


def behavior_cluster(df: DataFrame, year: int) -> DataFrame:
    """Rule-based behavior of accounts with two or more active months."""
    v = F.abs("v")
    w = Window.partitionBy("account")
    m = active_months(df, year).withColumns({"mean": F.avg(v).over(w), "std": F.stddev_pop(v).over(w)})
    f = m.groupBy("account").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), (F.max(v) / F.sum(v) * 100).alias("concentration"), F.count_if(v > 0).alias("active"), F.count("*").alias("n"),
        F.abs(F.avg(F.try_divide(v - F.col("mean"), F.col("std")) ** 3)).alias("skew"),
    ).where("n >= 2")
    cv, c = ratio(F.col("std"), F.col("mean")) * 100, F.col("concentration")
    rules = [
        (F.col("active") <= 2, "dormant", 0.9), (c > 80, "concentrated", 0.85), (cv < 20, "stable", 0.8), (cv > 80, "volatile", 0.75),
        ((c > 30) & (c < 60) & (cv > 20) & (cv < 50), "seasonal", 0.7), (cv > 40, "volatile", 0.6),
    ]
    return f.select(
        "account", rounded(cv).alias("cv"), rounded(c).alias("concentration"), F.col("active").alias("active_months"), rounded(F.coalesce("skew", F.lit(0.0))).alias("skew"),
        first_of([(a, b) for a, b, _ in rules], "stable").alias("cluster"), first_of([(a, p) for a, _, p in rules], 0.5).alias("confidence"),
    )


def is_round(col: Column, multiples: tuple[int, ...] = (1000, 500, 100), tolerance: float = 0.01) -> Column:
    """Whether a nonzero amount is within tolerance (of the multiple) of one of the multiples."""
    a = F.abs(col.cast("double"))
    near = [(a >= m) & (F.least(a % m, m - a % m) <= tolerance * m) for m in multiples]
    out = near[0]
    for x in near[1:]:
        out = out | x
    return (a > 0) & out


def same_amount(df: DataFrame, least: int = 12, tolerance: float = 0.01) -> DataFrame:
    """(account, months, near, same): months of each account whose net is within tolerance of the median of all, and whether these are least or more.

    An account with fewer months, or with a median of 0, has none.
    """
    m = active_months(df, None)
    mid = m.groupBy("account").agg(F.percentile("v", 0.5).alias("median"), F.count("*").alias("months"))
    near = F.count_if((F.col("months") >= least) & (F.col("median") != 0) & (F.abs(F.col("v") - F.col("median")) <= tolerance * F.abs("median")))
    return m.join(mid, "account").groupBy("account", "months").agg(near.alias("near")).withColumn("same", F.col("near") >= least)


def dead_band(cv: Column) -> Column:
    return F.lit(1.5) + 2 * cv


def conformal(df: DataFrame, year: int, min_n: int = 6) -> DataFrame:
    """Last month of each family against its earlier ones: conformal p-value with min_n or more, else dead band on z.

    The score of a month is its distance from the median over the MAD; p = (1 + months
    at least as far)/(1 + n); with fewer than two earlier months p is 1.
    """
    m = active_months(df, year, "prefix_3").withColumnRenamed("prefix_3", "family")
    last = F.max("period").over(Window.partitionBy("family"))
    m = m.withColumn("new", F.col("period") == last)
    old = m.where(~F.col("new"))
    centre = old.groupBy("family").agg(F.percentile("v", 0.5).alias("median"), F.stddev_pop("v").alias("sd"), F.stddev_samp("v").alias("ss"), F.avg("v").alias("mean"), F.count("*").alias("n"))
    spread = old.join(centre, "family").groupBy("family").agg(F.percentile(F.abs(F.col("v") - F.col("median")), 0.5).alias("raw"))
    scale = F.when(F.col("raw") > 0, F.col("raw")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    j = m.join(centre, "family").join(spread, "family").withColumn("score", F.round(F.abs(F.col("v") - F.col("median")) / scale, 9))
    fresh = j.where("new").select("family", F.col("v").alias("value"), F.col("score").alias("s_new"), "n", "mean", "ss", "median", "period")
    counts = j.where("NOT new").select("family", "score").join(fresh.select("family", "s_new"), "family").groupBy("family").agg(F.count_if(F.col("score") >= F.col("s_new")).alias("far"))
    p = F.when(F.col("n") < 2, 1.0).otherwise((1 + F.col("far")) / (1 + F.col("n")))
    z = F.coalesce(F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("ss"))), F.lit(0.0))
    method = F.when(F.col("n") >= min_n, "conformal").otherwise("dead_band")
    return fresh.join(counts, "family").select("family", "period", rounded(F.col("median"), 3).alias("median"), rounded(F.col("value"), 2).alias("value"), rounded(F.col("s_new")).alias("score"), "n", rounded(p).alias("p_value"), rounded(z).alias("z"), method.alias("method"))


def bh_adjust(df: DataFrame, p: str = "p_value", key: str = "family") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values and ranks, by ranges of (p, key)."""
    ranked = running(df.withColumn("__one", F.lit(1)), [], [p, key], "__one").drop("__one")
    ranked = ranked.withColumn("rank", (F.col("before") + 1).cast("int")).withColumn("raw", F.col(p) * F.col("whole") / F.col("rank"))
    adjusted = least_ahead(ranked, [p, key], "raw", "p_adjusted")
    return adjusted.withColumn("p_adjusted", rounded(F.least("p_adjusted", F.lit(1.0)), 6)).drop("before", "whole", "raw")


def discord(df: DataFrame, year: int | None = None, window: int = 3) -> DataFrame:
    """The stretch of months whose mean is furthest from the family's median: start, score, count."""
    m = active_months(df, year, "prefix_3").withColumnRenamed("prefix_3", "family")
    w = Window.partitionBy("family").orderBy("period").rowsBetween(0, window - 1)
    s = m.withColumns({"avg": F.avg("v").over(w), "k": F.count("*").over(w)}).where(F.col("k") == window)
    centre = m.groupBy("family").agg(F.percentile("v", 0.5).alias("median"), F.count("*").alias("months"))
    j = s.join(centre, "family").withColumn("score", F.round(F.abs(F.col("avg") - F.col("median")), 4))
    return j.groupBy("family").agg(F.first("months").alias("months"), F.min_by("period", F.struct(-F.col("score"), F.col("period"))).alias("start"), F.max("score").alias("score"))


def matrix_profile(df: DataFrame, year: int | None = None, window: int = 3, key: str = "prefix_3") -> DataFrame:
    """(family, start, distance, nearest, p, is_discord): each stretch of active months against its nearest other one.

    Stretches are z-normalized; two constant ones are 0 apart, a constant and another one
    the root of window. A stretch doesn't meet those that start within a quarter of its
    length, rounded up; one that meets none has no distance. nearest is the first start at
    the least distance, p the share of the family's stretches that are farther from theirs,
    and the discord the first one with the largest distance. Families with a month more
    than the window, or more, take part; their stretches, no more than months, are joined
    within the family.
    """
    m = active_months(df, year, key).withColumnRenamed(key, "family")
    order = Window.partitionBy("family").orderBy("period")
    ahead = F.collect_list("v").over(order.rowsBetween(0, window - 1))
    w = m.withColumns({"at": F.row_number().over(order), "x": ahead, "months": F.count("*").over(Window.partitionBy("family"))})
    w = w.where((F.size("x") == window) & (F.col("months") > window))
    total_ = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    w = w.withColumn("mean", total_(F.col("x")) / window)
    w = w.withColumn("sd", F.sqrt(total_(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / window))
    flat = F.array_max("x") == F.array_min("x")
    w = w.withColumn("z", F.when(~flat, F.transform("x", lambda v: (v - F.col("mean")) / F.col("sd")))).select("family", "period", "at", "z")
    a, b = w.select("family", F.col("period").alias("start"), F.col("at").alias("i"), F.col("z").alias("za")), w.select("family", F.col("period").alias("other"), F.col("at").alias("j"), F.col("z").alias("zb"))
    gap = F.sqrt(total_(F.zip_with("za", "zb", lambda p, q: (p - q) * (p - q))))
    apart = F.when(F.col("za").isNull() & F.col("zb").isNull(), 0.0).when(F.col("za").isNull() | F.col("zb").isNull(), float(window) ** 0.5).otherwise(gap)
    pairs = a.join(b, "family").where(F.abs(F.col("i") - F.col("j")) > -(-window // 4)).withColumn("d", F.round(apart, 4))
    near = pairs.groupBy("family", "start").agg(F.min("d").alias("distance"), F.min_by("other", F.struct("d", "other")).alias("nearest"))
    near = a.select("family", "start").join(near, ["family", "start"], "left")
    every, first = Window.partitionBy("family"), Window.partitionBy("family").orderBy(F.desc_nulls_last("distance"), "start")
    farther = F.count("distance").over(every) - F.count("distance").over(every.orderBy("distance").rangeBetween(Window.unboundedPreceding, 0))
    return near.select(
        "family", "start", (F.col("distance") + 0.0).alias("distance"), "nearest", rounded(F.when(F.col("distance").isNotNull(), farther / F.count("distance").over(every))).alias("p"),
        (F.col("distance").isNotNull() & (F.row_number().over(first) == 1)).alias("is_discord"),
    )


def ranked_by(f: DataFrame, feature: str) -> DataFrame:
    """f with `le` and `ge`, the numbers of rows whose feature is no larger, or no smaller, and `whole`, that of all rows."""
    values = counted(f, [], F.col(feature).cast("double")).select(F.col("value").alias("__v"), (F.col("before") + F.col("n")).alias("le"), (F.col("whole") - F.col("before")).alias("ge"), "whole")
    return f.join(values, F.col(feature).cast("double") == F.col("__v")).drop("__v")


def ecod(df: DataFrame, year: int) -> DataFrame:
    """Tail probability of each account's entries and volume among all accounts, and their minimum."""
    made = df.where(F.col("year") == year).groupBy("account").agg(number(F.count("*")).alias("entries"), number(F.sum(F.abs("amount"))).alias("volume"))
    n = F.col("whole")
    for c in ("entries", "volume"):
        p = F.greatest(F.least(2 * F.least(F.col("le") / n, F.col("ge") / n), F.lit(1.0)), 1 / (n + 1))
        made = ranked_by(made, c).withColumn(f"p_{c}", p).drop("le", "ge", "whole")
    return made.select("account", rounded(F.col("p_entries")).alias("p_entries"), rounded(F.col("p_volume")).alias("p_volume"), rounded(F.least("p_entries", "p_volume")).alias("p"))


def ecod_outliers(f: DataFrame, key: str, features: list[str], threshold: float = 0.05) -> DataFrame:
    """(key, p_feature..., p): rows whose least tail probability among all other rows is below the threshold.

    A feature's probability is twice the smaller share of the others that are no larger, or
    no smaller, at least one part of all rows; nulls count as 0. Of fewer than three rows none
    is an outlier.
    """
    made = f.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    for c in features:
        others = F.col("whole") - 1
        p = F.greatest(2 * F.least((F.col("le") - 1) / others, (F.col("ge") - 1) / others), 1 / F.col("whole"))
        made = ranked_by(made, c).withColumn(f"p_{c}", F.when(others >= 2, p).otherwise(1.0)).drop("le", "ge", "whole")
    least = F.least(*[F.col(f"p_{c}") for c in features], F.lit(float("inf")))
    return made.withColumn("p", least).where(F.col("p") < threshold).select(key, *[rounded(F.col(f"p_{c}"), 6).alias(f"p_{c}") for c in features], rounded(F.col("p"), 6).alias("p"))
