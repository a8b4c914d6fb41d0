"""Run rate of the P&L: monthly grids, provisions, anomalies, breakdowns, two-year comparison, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from folio.functions.columns import MONEY, first_of, number, ratio, rounded, sum_if, total

MONTHS = 12
MIN_GAP = 2000
MIN_Z, MIN_GAP_PCT, MIN_STD = 1.5, 30, 100


def pnl(df: DataFrame, year: int) -> DataFrame:
    return df.where((F.col("year") == year) & F.col("class").isin("6", "7"))


def monthly(df: DataFrame, year: int, key: str = "account") -> DataFrame:
    """(key, period, value) for every key and every month present in the year, 0 where there is nothing.

    The grid crosses two small sets: the keys and at most twelve periods.
    """
    rows = pnl(df, year)
    sums = rows.groupBy(key, "period").agg(F.sum("pnl_amount").alias("value"))
    periods = F.broadcast(rows.select("period").distinct())
    grid = sums.select(key).distinct().crossJoin(periods)
    return grid.join(sums, [key, "period"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("decimal(28,2)"))


def december(year: int) -> Column:
    return F.col("period") == f"{year}-12"


def provisions(df: DataFrame, year: int, threshold: float = MIN_GAP, axis: str | None = None) -> DataFrame:
    """Charges whose December is away from the mean of the other months by threshold or more.

    run_rate is a twelfth of the total; impact is what brings December to it. With an
    axis the grid has, for each value, the months present for that value.
    """
    rows = pnl(df, year).where("class = '6'") if axis is None else pnl(df, year).where(F.col("class") == "6").where(F.col(axis).isNotNull())
    by = [axis] if axis else []
    sums = rows.groupBy(*by, "account", "period").agg(F.sum("pnl_amount").alias("value"))
    months = (rows if axis else pnl(df, year)).groupBy(*by).agg(F.count_distinct("period").alias("months"), F.max(december(year).cast("int")).alias("has_december"))
    facts = sums.groupBy(*by, "account").agg(total(F.col("value")).alias("total"), sum_if(F.col("value"), december(year)).alias("december"))
    joined = facts.join(months, by) if axis else facts.crossJoin(F.broadcast(months))
    others = F.col("months") - F.col("has_december")
    mean = ratio(F.col("total") - F.col("december"), others)
    run = number(F.col("total")) / MONTHS
    made = joined.withColumns({"mean_other": mean, "gap": number(F.col("december")) - mean, "run_rate": run, "impact": run - number(F.col("december"))})
    kept = made.where(F.abs("gap") >= threshold)
    return kept.select(*by, "account", "total", "december", *[rounded(F.col(c)).alias(c) for c in ("mean_other", "gap", "run_rate", "impact")])


def month_anomalies(df: DataFrame, year: int, min_z: float = MIN_Z, min_gap: float = MIN_GAP, min_pct: float = MIN_GAP_PCT) -> DataFrame:
    """Months of charges away from the account's mean over the grid, by z, amount and per cent."""
    w = Window.partitionBy("account")
    value = number(F.col("value"))
    g = monthly(df, year).where("account LIKE '6%'").withColumns({"v": value, "mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w)})
    g = g.where(F.col("std") >= MIN_STD).withColumns({"gap": F.col("v") - F.col("mean"), "z": F.try_divide(F.col("v") - F.col("mean"), F.col("std"))})
    g = g.withColumn("gap_pct", F.coalesce(F.try_divide(F.col("gap"), F.col("mean")) * 100, F.lit(0.0)))
    kept = g.where((F.abs("z") >= min_z) & (F.abs("gap") >= min_gap) & (F.abs("gap_pct") >= min_pct))
    kind = F.when(F.col("z") > 0, "EXCES").otherwise("DEFICIT")
    out = kept.withColumn("kind", kind)
    return out.select("account", "period", "value", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "z", "gap", "gap_pct")], "kind", anomaly_wording(F.col("kind"), F.col("gap_pct")).alias("wording"))


def anomaly_wording(kind: Column, pct: Column) -> Column:
    """Fixed wordings by kind and per cent."""
    return first_of(
        [
            ((kind == "EXCES") & (pct > 100), "Probable provision oubliée ou facture exceptionnelle"),
            ((kind == "EXCES") & (pct > 50), "Charge concentrée - vérifier la nature"),
            (kind == "EXCES", "Légèrement supérieur à la moyenne"),
            (pct < -50, "Probable sur-provisionnement antérieur ou reprise"),
            (pct < -30, "Charge sous moyenne - régularisation possible"),
        ],
        "Légèrement inférieur à la moyenne",
    )


def normalized_december(df: DataFrame, year: int, threshold: float = MIN_GAP) -> DataFrame:
    """One row: December's charges, products and result, gross and after the provisions' impact."""
    dec = pnl(df, year).where(december(year)).agg(
        sum_if(F.col("pnl_amount"), F.col("class") == "6").alias("gross_charges"), sum_if(F.col("pnl_amount"), F.col("class") == "7").alias("gross_products")
    )
    adjust = provisions(df, year, threshold).agg(rounded(F.coalesce(F.sum("impact"), F.lit(0.0)), 2).alias("adjustment"), F.count("*").alias("adjusted_accounts"))
    both = dec.crossJoin(adjust).withColumns({"c": number(F.col("gross_charges")), "p": number(F.col("gross_products"))})
    return both.select(
        F.lit(year).alias("year"), rounded(F.col("c"), 2).alias("gross_charges"), rounded(F.col("p"), 2).alias("gross_products"), rounded(F.col("p") - F.col("c"), 2).alias("gross_result"),
        "adjustment", "adjusted_accounts", rounded(F.col("c") + F.col("adjustment"), 2).alias("normalized_charges"), rounded(F.col("p"), 2).alias("normalized_products"),
        rounded(F.col("p") - F.col("c") - F.col("adjustment"), 2).alias("normalized_result"),
    )


def monthly_comparison(df: DataFrame, year: int) -> DataFrame:
    """Account × month with total, mean, sample deviation, December against the mean, run rate, impact."""
    g = monthly(df, year)
    v = number(F.col("value"))
    stats = g.groupBy("account").agg(
        *[F.coalesce(F.sum(F.when(F.col("period") == f"{year}-{m:02d}", v)), F.lit(0.0)).alias(f"m{m:02d}") for m in range(1, 13)],
        rounded(F.sum("value"), 2).alias("total"), F.avg(v).alias("mean"), rounded(F.stddev_samp(v)).alias("std"), F.max(december(year)).alias("has_december"),
    )
    gap = F.col("m12") - F.col("mean")
    return stats.select(
        "account", *[f"m{m:02d}" for m in range(1, 13)], "total", rounded(F.col("mean")).alias("mean"), "std", rounded(gap).alias("december_gap"),
        rounded(ratio(gap, F.abs("mean")) * 100).alias("december_gap_pct"), rounded(F.col("total") / MONTHS).alias("run_rate"), rounded(F.col("total") / MONTHS - F.col("m12")).alias("impact"),
    )


def by_axis(df: DataFrame, year: int, axis: str, class_: str = "6", account: str | None = None) -> DataFrame:
    """Totals by value of an axis: total, December, run rate, gap, share of all."""
    rows = pnl(df, year).where((F.col("class") == class_) & F.col(axis).isNotNull())
    rows = rows.where(F.col("account").startswith(account)) if account else rows
    sums = rows.groupBy(F.col(axis).alias("axis_value")).agg(total(F.col("pnl_amount")).alias("total"), sum_if(F.col("pnl_amount"), december(year)).alias("december"))
    every = F.sum("total").over(Window.partitionBy())
    run = number(F.col("total")) / MONTHS
    return sums.select("axis_value", "total", "december", rounded(run).alias("run_rate"), rounded(number(F.col("december")) - run).alias("gap"), rounded(ratio(F.col("total"), every) * 100).alias("share_pct"))


def axis_summary(df: DataFrame, year: int, axes: list[str]) -> DataFrame:
    """by_axis for several axes at once, in one pass."""
    rows = pnl(df, year).where("class = '6'")
    flat = rows.select("pnl_amount", "period", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("axis_value")) for a in axes])).alias("x")).where("x.axis_value IS NOT NULL")
    sums = flat.groupBy("x.axis", "x.axis_value").agg(F.count("*").alias("lines"), total(F.col("pnl_amount")).alias("total"), sum_if(F.col("pnl_amount"), december(year)).alias("december"))
    return sums.withColumn("run_rate", rounded(number(F.col("total")) / MONTHS))


def yearly_run_rate(df: DataFrame, year: int) -> DataFrame:
    """By class and two-digit prefix: absolute total, a twelfth of it, share of the class."""
    sums = pnl(df, year).groupBy("class", "prefix_2").agg(total(F.col("amount")).alias("net")).withColumn("total", F.abs("net"))
    every = F.sum("total").over(Window.partitionBy("class"))
    return sums.select("class", "prefix_2", "total", rounded(number(F.col("total")) / MONTHS).alias("run_rate"), rounded(ratio(F.col("total"), every) * 100).alias("share_pct"))


def describe_provisions(df: DataFrame, year: int) -> DataFrame:
    """Provisions with December's deviation from the mean of the other months in per cent."""
    p = provisions(df, year)
    return p.select("account", "december", "mean_other", rounded(ratio(F.col("gap"), F.abs("mean_other")) * 100, 2).alias("deviation_pct"))


def detect_year(df: DataFrame) -> DataFrame:
    """The year with most lines, the earliest on ties."""
    return df.groupBy("year").agg(F.count("*").alias("n")).agg(F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("year"))


def compare_years(df: DataFrame, year: int, before: int) -> DataFrame:
    """One row: both years' December results and their gross, normalized and artefact variation."""
    one = lambda y, n: normalized_december(df, y).select(*[F.col(c).alias(f"{c}_{n}") for c in ("gross_result", "normalized_result", "adjustment")])
    both = one(year, "n").crossJoin(one(before, "n1"))
    gross, normal = F.col("gross_result_n") - F.col("gross_result_n1"), F.col("normalized_result_n") - F.col("normalized_result_n1")
    return both.withColumns({"gross_variation": rounded(gross, 2), "normalized_variation": rounded(normal, 2), "artefact": rounded(gross - normal, 2)})


def reconciliation(df: DataFrame, year: int, before: int) -> DataFrame:
    """Eleven ordered lines from gross charges to the normalized result, N, N-1 and variation."""
    lines = ("gross_charges", "gross_products", "gross_result", "adjustment", "adjusted_accounts", "normalized_charges", "normalized_products", "normalized_result")
    one = lambda y, n: normalized_december(df, y).select(*[F.col(c).cast("double").alias(f"{c}_{n}") for c in lines])
    both = one(year, "n").crossJoin(one(before, "n1"))
    row = lambda i, name, a, b: F.struct(F.lit(i).alias("line"), F.lit(name).alias("name"), rounded(a, 2).alias("n"), rounded(b, 2).alias("n1"), rounded(a - b, 2).alias("variation"))
    plain = [row(i + 1, c, F.col(f"{c}_n"), F.col(f"{c}_n1")) for i, c in enumerate(lines)]
    share = lambda n: ratio(F.col(f"adjustment_{n}"), F.abs(F.col(f"gross_result_{n}"))) * 100
    change = lambda n: F.col(f"normalized_result_{n}") - F.col(f"gross_result_{n}")
    margin = lambda n: ratio(F.col(f"normalized_result_{n}"), F.col(f"normalized_products_{n}")) * 100
    extra = [row(9 + i, name, f("n"), f("n1")) for i, (name, f) in enumerate((("adjustment_pct", share), ("result_change", change), ("normalized_margin_pct", margin)))]
    return both.select(F.inline(F.array(*plain, *extra)))


def both_years(df: DataFrame, year: int, before: int) -> DataFrame:
    """Provisions and December anomalies of both years, stacked."""
    def one(y: int) -> DataFrame:
        p = provisions(df, y).select(F.lit(y).alias("year"), F.lit("PROVISION").alias("kind"), "account", rounded(F.col("december"), 2).alias("december"), F.col("gap").alias("gap"))
        a = month_anomalies(df, y).where(december(y)).select(F.lit(y).alias("year"), F.concat(F.lit("ANOMALIE_"), F.col("kind")).alias("kind"), "account", rounded(F.col("value"), 2).alias("december"), "gap")
        return p.unionByName(a)

    return one(year).unionByName(one(before))


# What is removed from an upper-case label before labels are compared.
LABEL_NOISE = (
    r"\d{2}/\d{2}/\d{4}", r"\d{4}-\d{2}-\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"n[°o]?\s*\d+", r"#\d+", r"\b\d{6,}\b", r"facture\s+\d+", r"fact\.?\s*\d+", r"\bdu\s+\d{2}/\d{2}",
    r"\b(janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\b", r"\b(jan|fev|mar|avr|mai|jun|jul|aou|sep|oct|nov|dec)\b", r"\b20\d{2}\b",
)


def normalize_label(col: Column) -> Column:
    """Upper case without dates, numbers, references and months; AUTRE when nothing is left."""
    bare = F.regexp_replace(F.trim(F.upper(F.coalesce(col, F.lit("")))), "(?iu)" + "|".join(LABEL_NOISE), "")
    tidy = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[.\-_/\\]+$", "")
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit("AUTRE"))


def bridge(df: DataFrame, year: int, before: int, min_change: float = 1.0) -> DataFrame:
    """(account, month, label, status, n, n1, variation, lines) for all P&L accounts and months at once."""
    keys = ["account", "month", "norm"]

    def one(y: int, n: str) -> DataFrame:
        return pnl(df, y).withColumn("norm", normalize_label(F.col("label"))).groupBy(*keys).agg(F.sum("pnl_amount").alias(f"amount_{n}"), F.count("*").alias(f"lines_{n}"))

    both = one(year, "n").join(one(before, "n1"), keys, "full_outer")
    diff = F.col("amount_n") - F.col("amount_n1")
    status = first_of([(F.col("amount_n1").isNull(), "NOUVELLE"), (F.col("amount_n").isNull(), "DISPARUE"), (F.abs(diff) >= min_change, "VARIEE")], "STABLE")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("amount_n", "amount_n1", "lines_n", "lines_n1")}
    return both.withColumn("status", status).withColumns(filled).withColumn("variation", (F.col("amount_n") - F.col("amount_n1")).cast(MONEY))


def bridge_check(b: DataFrame) -> DataFrame:
    """Per account and month: N-1 + new − gone + changed against N, within a cent."""
    part = lambda s: sum_if(F.col("variation"), F.col("status") == s)
    sums = b.groupBy("account", "month").agg(
        total(F.col("amount_n")).alias("n"), total(F.col("amount_n1")).alias("n1"), part("NOUVELLE").alias("new"), part("DISPARUE").alias("gone"), part("VARIEE").alias("changed")
    )
    gap = F.abs(F.col("n1") + F.col("new") + F.col("gone") + F.col("changed") - F.col("n"))
    return sums.withColumns({"gap": gap, "reconciled": gap < 0.01})


def top_variations(df: DataFrame, year: int, before: int, n: int = 10, class_: str = "6") -> DataFrame:
    """The n accounts of a class that vary most between the years."""
    rows = df.where(F.col("year").isin(year, before) & (F.col("class") == class_))
    sums = rows.groupBy("account").agg(sum_if(F.col("pnl_amount"), F.col("year") == year).alias("n"), sum_if(F.col("pnl_amount"), F.col("year") == before).alias("n1"))
    return sums.withColumn("variation", F.col("n") - F.col("n1")).orderBy(F.abs("variation").desc(), "account").limit(n)


def top_bridge(df: DataFrame, year: int, before: int, n: int = 10, class_: str = "6") -> DataFrame:
    """The bridge of the n accounts of a class that vary most."""
    top = top_variations(df, year, before, n, class_).select("account")
    return bridge(df, year, before).join(F.broadcast(top), "account", "left_semi")
