"""The canonical ledger table: parsing, derived columns, cleaning, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import MONEY, rounded, total
from folio.functions.ranks import quantiles

TEXT = ("account", "account_label", "journal", "voucher", "label", "axis_1", "axis_2", "axis_3", "site", "third_party")


def derive(df: DataFrame) -> DataFrame:
    """Add amount, year, month, period, class, prefixes and the signed P&L amount to typed columns.

    Charges (class 6) count debit less credit, products (class 7) credit less debit,
    other classes zero.
    """
    amount = (F.col("debit") - F.col("credit")).cast(MONEY)
    year, month = F.year("date"), F.month("date")
    # put together, which takes a fraction of a formatter's time
    period = F.when(year.between(1000, 9999), F.concat(year.cast("string"), F.when(month < 10, "-0").otherwise("-"), month.cast("string"))).otherwise(F.date_format("date", "yyyy-MM"))
    head = F.substring("account", 1, 1)
    return df.select(
        "*",
        amount.alias("amount"),
        year.alias("year"),
        month.alias("month"),
        period.alias("period"),
        head.alias("class"),
        F.substring("account", 1, 2).alias("prefix_2"),
        F.substring("account", 1, 3).alias("prefix_3"),
        F.when(head == "6", amount).when(head == "7", (-amount).cast(MONEY)).otherwise(F.lit(0).cast(MONEY)).alias("pnl_amount"),
    )


def parse_date(col: Column) -> Column:
    """Day first (dd/MM/yyyy, dd-MM-yyyy, dd.MM.yyyy) or ISO; anything else is null."""
    text = F.trim(col.cast("string"))
    plain = F.regexp_replace(text, r"[-.]", "/")
    forms = [F.try_to_timestamp(plain, F.lit(f)) for f in ("d/M/yyyy", "yyyy/M/d", "d/M/yy")]
    whole = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), *forms).cast("date")
    # the usual shapes without formats, each of which costs an exception where it doesn't fit
    part = lambda *at: F.concat_ws("-", *[F.substring(text, a, n) for a, n in at]).try_cast("date")
    day_first = F.when(text.rlike(r"^\d\d[-./]\d\d[-./](?!0000)\d{4}\z"), part((7, 4), (4, 2), (1, 2)))
    return day_first.when(text.rlike(r"^[1-9]\d{3}[-./]\d\d[-./]\d\d\z"), part((1, 4), (6, 2), (9, 2))).otherwise(whole)


def parse_number(col: Column) -> Column:
    """Number or 0 when it isn't one; a decimal point is expected."""
    return F.coalesce(F.trim(col.cast("string")).try_cast(MONEY), F.lit(0).cast(MONEY))


def parse_amount(col: Column) -> Column:
    """Amount as printed: euro sign, spaces, `1.234,56` or `1,234.56`; 0 when there is none."""
    bare = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[€\s  ]", "")
    comma_last = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
    both = bare.contains(",") & bare.contains(".")
    european = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(both & comma_last, european).when(both, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    # most need no patterns
    usual = F.when(~(col.cast("string").contains(",") & col.cast("string").contains(".")), F.replace(col.cast("string"), F.lit(","), F.lit(".")).try_cast(MONEY))
    return F.coalesce(usual, plain.try_cast(MONEY), F.lit(0).cast(MONEY))


def canonicalize(df: DataFrame, *kept: str) -> DataFrame:
    """Source columns under canonical names, as text, to the typed ledger: bad dates null, bad
    numbers 0, account trimmed, blank axes null; absent optional columns are null. Kept columns stay."""
    text = {c: (F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")) for c in TEXT}
    for axis in ("axis_1", "axis_2", "axis_3", "site", "third_party"):
        text[axis] = F.nullif(text[axis], F.lit(""))
    typed = df.select(parse_date(F.col("date")).alias("date"), *[c.alias(n) for n, c in text.items()], parse_number(F.col("debit")).alias("debit"), parse_number(F.col("credit")).alias("credit"), *kept)
    return derive(typed)


def clean(df: DataFrame) -> DataFrame:
    """Drop rows without account and rows with neither debit nor credit; trim labels, upper-case journals."""
    kept = df.where((F.trim("account") != "") & ((F.col("debit") != 0) | (F.col("credit") != 0)))
    return kept.withColumns({"label": F.trim(F.coalesce("label", F.lit(""))), "journal": F.upper(F.trim(F.coalesce("journal", F.lit(""))))})


def concatenate(ledgers: list[DataFrame], labels: list[str]) -> DataFrame:
    """Several ledgers as one, each row with its source label."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source", F.lit(n)) for d, n in zip(ledgers, labels)])


def summary(df: DataFrame) -> DataFrame:
    """One row: counts, period range, totals, balance, journals and the sites (first 20)."""
    return df.agg(
        F.count("*").alias("rows"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count_distinct("account").alias("accounts"),
        total(F.col("debit")).alias("debit"),
        total(F.col("credit")).alias("credit"),
        (F.abs(total(F.col("debit")) - total(F.col("credit"))) < 0.01).alias("balanced"),
        F.array_join(F.array_sort(F.collect_set("journal")), ",").alias("journals"),
        F.count_distinct("site").alias("sites"),
        F.array_join(F.slice(F.array_sort(F.collect_set("site")), 1, 20), ",").alias("site_values"),
    )


def load_v2(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, counts): rows without a date dropped and counted, decimal commas read, journal `OD` when missing."""
    raw = df.select(
        parse_date(F.col("date")).alias("date"), F.trim("account").alias("account"), F.coalesce(F.nullif(F.trim("journal"), F.lit("")), F.lit("OD")).alias("journal"),
        F.coalesce(F.col("label"), F.lit("")).alias("label"), parse_amount(F.col("debit")).alias("debit"), parse_amount(F.col("credit")).alias("credit"),
    )
    counts = raw.agg(F.count("*").alias("rows"), F.count_if(F.col("date").isNull()).alias("without_date"))
    return derive(raw.where(F.col("date").isNotNull())), counts


def split_account(df: DataFrame, sample: int = 100, share: float = 0.1) -> DataFrame:
    """Split accounts such as 601000SDV into account and site, when over share of the first
    sample accounts (in order) have that form: 5 to 8 digits, then 2 to 5 capitals."""
    form = r"^(\d{5,8})([A-Z]{2,5})$"
    head = df.select("account").distinct().orderBy("account").limit(sample).agg(F.avg(F.col("account").rlike(form).cast("int")).alias("__share"))
    hit = (F.col("__share") > share) & F.col("account").rlike(form)
    joined = df.crossJoin(F.broadcast(head)).withColumn("__hit", F.coalesce(hit, F.lit(False)))
    site = F.when(F.col("__hit"), F.regexp_extract("account", form, 2)).otherwise(F.col("site"))
    account = F.when(F.col("__hit"), F.regexp_extract("account", form, 1)).otherwise(F.col("account"))
    return joined.withColumns({"site": site, "account": account}).drop("__share", "__hit")


def site_policy(df: DataFrame, pnl_only: bool = True) -> DataFrame:
    """Keep the site on P&L lines only."""
    return df.withColumn("site", F.when(F.col("class").isin("6", "7"), F.col("site"))) if pnl_only else df


def guard(df: DataFrame, max_rows: int = 2_000_000, max_columns: int = 100, max_text: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(cleaned, verdict): text cut to max_text characters and freed of control characters; whether the limits hold."""
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cleaned = df.withColumns({c: F.regexp_replace(F.left(F.col(c), F.lit(max_text)), control, "") for c in texts})
    verdict = df.agg((F.count("*") <= max_rows).alias("rows_ok")).withColumn("columns_ok", F.lit(len(df.columns) <= max_columns))
    return cleaned, verdict


def unbalanced(df: DataFrame, gap: float = 0.01) -> DataFrame:
    """Vouchers whose debit and credit differ by gap or more."""
    sums = df.groupBy("voucher").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count("*").alias("lines"))
    return sums.withColumn("gap", F.abs(F.col("debit") - F.col("credit"))).where(F.col("gap") >= gap)


def balance(df: DataFrame, keys: list[str], gap: float = 0.01) -> DataFrame:
    """Debit, credit, vouchers, how many of them are unbalanced, and their gaps, by keys."""
    sums = df.groupBy(*keys, "voucher").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    off = F.abs(F.col("debit") - F.col("credit"))
    return sums.groupBy(*keys).agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count("*").alias("vouchers"), F.count_if(off >= gap).alias("unbalanced"), F.sum(off).alias("gap"))


def ledger_stats(df: DataFrame) -> DataFrame:
    """Entries, accounts, sites, journals, dates, and distinct (account, site) pairs."""
    return df.agg(
        F.count("*").alias("entries"), F.count_distinct("account").alias("accounts"), F.count_distinct("site").alias("sites"), F.count_distinct("journal").alias("journals"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("account", "site").alias("couples"),
    )


AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "nunique": F.count_distinct, "min": F.min, "max": F.max, "std": F.stddev_samp}


def groupby_agg(df: DataFrame, keys: list[str], spec: dict[str, str], order: str | None = None) -> DataFrame:
    """Group by keys; spec names one function per column, first and last go by order."""
    cols = []
    for c, f in spec.items():
        if f in ("first", "last"):
            cols.append((F.min_by if f == "first" else F.max_by)(c, order or c).alias(f"{c}_{f}"))
        else:
            cols.append(AGGREGATES[f](F.col(c).cast("double") if f in ("mean", "std") else F.col(c)).alias(f"{c}_{f}"))
    return df.groupBy(*keys).agg(*cols)


def pivot_table(df: DataFrame, index: str, column: str, values: list, measure: str, how: str = "sum", fill: float = 0) -> DataFrame:
    """index × values of column; cells without rows hold fill. The values are given, so that no extra job finds them."""
    made = df.groupBy(index).pivot(column, values).agg(AGGREGATES[how](measure))
    return made.fillna(fill)


def filter_rows(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that meet all: a list means membership, else equality."""
    for c, v in conditions.items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def compute_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: sum, mean, std (sample), min, max, median, count."""

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"), rounded(F.sum(c), 2).alias("sum"), rounded(F.avg(x)).alias("mean"), rounded(F.stddev_samp(x)).alias("std"),
            rounded(F.min(x)).alias("min"), rounded(F.max(x)).alias("max"), F.count(x).alias("count"),
        )

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    middle = quantiles(df.select(F.inline(cells)), ["column"], F.col("x"), [0.5]).select("column", rounded(F.get("q", F.lit(0))).alias("median"))
    rows = df.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))
    return rows.join(middle, "column", "left").select("column", "sum", "mean", "std", "min", "max", "median", "count")
