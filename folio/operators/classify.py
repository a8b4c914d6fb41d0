"""Classification of accounts, journals and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import first_of, matches_any, rounded, starts_with_any, total
from folio.sources import dims


def accounts_of(df: DataFrame) -> DataFrame:
    return df.select("account").distinct()


def classify_account(accounts: DataFrame) -> DataFrame:
    """Chart columns by longest prefix, three digits then two; null where none fits."""
    chart = dims.chart(accounts.sparkSession)
    of = lambda n: F.broadcast(chart.select(F.col("prefix").alias(f"p{n}"), F.struct("prefix", "chart_label", "category", "frequency", "behavior").alias(f"c{n}")))
    joined = accounts.join(of(3), F.substring("account", 1, 3) == F.col("p3"), "left").join(of(2), F.substring("account", 1, 2) == F.col("p2"), "left")
    c = F.coalesce("c3", "c2")
    return joined.withColumn("c", c).select(
        *accounts.columns, "c.chart_label", "c.category", "c.frequency", "c.behavior",
        F.coalesce(F.substring("c.prefix", 1, 2).isin("68", "78"), F.lit(False)).alias("is_provision"),
        F.coalesce(F.col("c.prefix").isin(*dims.TYPICAL_ACCRUALS), F.lit(False)).alias("is_typical_accrual"),
    )


def expected_behavior(accounts: DataFrame) -> DataFrame:
    """What to expect of each account; unknown ones: monthly, no spike, 50 % variation."""
    known = classify_account(accounts)
    unknown = F.col("chart_label").isNull()
    return known.select(
        "account",
        first_of([(unknown, True)], F.col("frequency") == "mensuelle").alias("monthly_expected"),
        F.coalesce(F.col("frequency").isin("annuelle", "exceptionnelle"), F.lit(False)).alias("year_end_spike_normal"),
        F.col("is_provision").alias("reversal_expected"),
        first_of([(F.col("behavior") == "saisonnier", dims.SEASONS["saisonnier"]), (F.col("frequency") == "annuelle", dims.SEASONS["annuelle"])]).alias("seasonal_months"),
        first_of([(unknown, 50.0), (F.col("behavior") == "regulier", 30.0), (F.col("behavior") == "saisonnier", 50.0)], 100.0).alias("tolerated_variation"),
    )


def analyze_accounts(df: DataFrame) -> DataFrame:
    """Ledger lines with chart columns, classified once per account."""
    return df.join(classify_account(accounts_of(df)), "account", "left")


def risk_accounts(df: DataFrame) -> DataFrame:
    return classify_account(accounts_of(df)).where("is_provision OR is_typical_accrual")


def classify_v2(accounts: DataFrame) -> DataFrame:
    """Class, nature, type, label, behavior and flags; class 0 where the first digit isn't 1 to 8."""
    spark, a = accounts.sparkSession, F.trim("account")
    classes = F.broadcast(spark.createDataFrame(dims.CLASS_ROWS, "c string, nature string, class_label string"))
    prefixes = F.broadcast(spark.createDataFrame(dims.PREFIX_ROWS, "p string, type string, prefix_label string, pattern string"))
    joined = accounts.join(classes, F.substring(a, 1, 1) == F.col("c"), "left").join(prefixes, F.substring(a, 1, 2) == F.col("p"), "left")
    known = F.col("c").isNotNull()
    flags = {
        "is_provision": dims.PROVISION_PREFIXES, "is_reversal": dims.REVERSAL_PREFIXES, "is_depreciation": dims.DEPRECIATION_PREFIXES,
        "is_exceptional": ("67", "77"), "is_income_tax": ("69",), "is_subscription": ("488",),
    }
    is_ = {k: known & starts_with_any(a, v) for k, v in flags.items()}
    behavior = first_of([(is_["is_depreciation"], "mensuel"), (is_["is_income_tax"], "annuel"), (is_["is_subscription"], "abt"), (F.col("pattern").isNotNull(), F.col("pattern"))], "variable")
    return joined.select(
        *accounts.columns, F.coalesce(F.col("c").cast("int"), F.lit(0)).alias("account_class"), F.coalesce("nature", F.lit("special")).alias("nature"),
        F.coalesce("type", F.lit("n/a")).alias("type"), F.coalesce("prefix_label", "class_label", F.lit("Compte non classifié")).alias("chart_label"), behavior.alias("behavior"),
        *[v.alias(k) for k, v in is_.items()],
    )


def enrich_account(df: DataFrame) -> DataFrame:
    """Family, nature and fiscal year of each line."""
    nature = first_of([(F.col("class") == "6", "CHARGE"), (F.col("class") == "7", "PRODUIT"), (F.col("class").isin("1", "2", "3", "4", "5"), "BILAN")], "AUTRE")
    return df.withColumns({"family": F.substring("account", 1, 3), "nature": nature, "fiscal_year": F.year("date")})


def fingerprint() -> Column:
    """12 hex digits of the MD5 of date, journal, account, label, debit, credit, voucher."""
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    parts = [F.date_format("date", "yyyy-MM-dd"), F.col("journal"), F.col("account"), F.col("label"), money("debit"), money("credit"), F.coalesce("voucher", F.lit(""))]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def with_counterpart(df: DataFrame) -> DataFrame:
    """P&L lines get the provision account of their (date, journal, voucher) group, if any.

    Among several, the smallest account counts. Lines without voucher stand alone.
    """
    group = ["date", "journal", "voucher"]
    hit = (~F.col("class").isin("6", "7")) & F.col("prefix_3").isin(*dims.PROVISION_COUNTERPARTS)
    found = df.where(hit & F.col("voucher").isNotNull()).groupBy(*group).agg(F.min("account").alias("counterpart"))
    names = F.create_map(*[F.lit(x) for pair in dims.PROVISION_COUNTERPARTS.items() for x in pair])
    joined = df.join(found, group, "left")
    pnl = F.col("class").isin("6", "7")
    return joined.withColumn("counterpart", F.when(pnl, F.col("counterpart"))).withColumn("provision_type", F.try_element_at(names, F.substring("counterpart", 1, 3)))


def classify_entries(df: DataFrame) -> DataFrame:
    """Counterpart, entry type and accrual flag of each line."""
    label, adjusting = F.lower(F.coalesce("label", F.lit(""))), F.upper("journal").isin(*dims.ADJUSTING_JOURNALS)
    accrual = matches_any(label, dims.ACCRUAL_PATTERNS)
    kind = first_of(
        [(matches_any(label, dims.ONE_SHOT_PATTERNS), "ONE_SHOT"), (F.col("counterpart").isNotNull() | accrual, "REGUL"), (adjusting, "ESTIMATIF")], "RUN_RATE"
    )
    return with_counterpart(df).withColumns({"entry_type": kind, "is_accrual": F.col("counterpart").isNotNull() | accrual | adjusting})


def provision_summary(entries: DataFrame) -> DataFrame:
    """By provision type and period: debit, credit, net, accounts."""
    return (
        entries.where(F.col("counterpart").isNotNull())
        .groupBy("provision_type", "period")
        .agg(total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"), total(F.col("amount")).alias("net"), F.count_distinct("account").alias("accounts"))
    )


def accrual_summary(entries: DataFrame) -> DataFrame:
    """By period and entry type, of accruals: lines, net and P&L amounts."""
    return entries.where("is_accrual").groupBy("period", "entry_type").agg(F.count("*").alias("lines"), total(F.col("amount")).alias("net"), total(F.col("pnl_amount")).alias("pnl"))


def classify_journal(journals: DataFrame) -> DataFrame:
    """journal -> journal_type: exact keyword, else the first keyword that contains the code or is contained in it, else `autre`."""
    code = F.upper(F.trim("journal"))
    words = F.broadcast(journals.sparkSession.createDataFrame(dims.KEYWORD_ROWS, "word string, kind string, rank int"))
    fits = code.contains(F.col("word")) | F.col("word").contains(code)
    # the last of equal exact keywords counts, the first of the others
    order = F.when(F.col("word") == code, -1).otherwise(F.col("rank"))
    found = journals.join(words, fits, "left").groupBy("journal").agg(F.min_by("kind", order).alias("journal_type"))
    return found.withColumn("journal_type", F.coalesce("journal_type", F.lit("autre")))


def journal_table(df: DataFrame) -> DataFrame:
    """Each journal's type, entries, totals, active months and share of December."""
    rows = df.groupBy("journal").agg(
        F.count("*").alias("entries"), total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"),
        F.array_join(F.array_sort(F.collect_set("month")).cast("array<string>"), ",").alias("months"), rounded(F.avg((F.col("month") == 12).cast("int"))).alias("december_ratio"),
    )
    return rows.join(classify_journal(df.select("journal").distinct()), "journal")


def od_spike(df: DataFrame, factor: float = 3.0) -> DataFrame:
    """One row: entries of adjusting journals in December, their mean over the other active months, ratio, spike."""
    od = F.broadcast(classify_journal(df.select("journal").distinct()).where("journal_type = 'od'").select("journal"))
    by_month = df.join(od, "journal").groupBy("month").agg(F.count("*").alias("n"))
    mean = F.avg(F.when(F.col("month") != 12, F.col("n")))
    december = F.coalesce(F.max(F.when(F.col("month") == 12, F.col("n"))), F.lit(0))
    rows = by_month.agg(december.alias("december"), rounded(mean).alias("other_mean"), rounded(F.coalesce(F.try_divide(december, mean), F.lit(0.0))).alias("ratio"))
    return rows.withColumn("spike", F.coalesce(F.col("december") > F.col("other_mean") * factor, F.lit(False)))


def counterparty_type_of(account: Column) -> Column:
    return first_of([(account.startswith(p), t) for p, t in dims.COUNTERPARTY_TYPES], "AUTRE")


def counterparty_type(df: DataFrame) -> DataFrame:
    """(voucher, side, counterparty_type): for the lines of a side, the type with the largest
    debit and credit on the opposite side of the voucher; ties go by the order of types."""
    side = F.when(F.col("debit") > 0, "D").otherwise("C")
    order = {t: i for i, (_, t) in reversed(list(enumerate(dims.COUNTERPARTY_TYPES)))}
    rows = df.select("voucher", side.alias("side"), counterparty_type_of(F.col("account")).alias("kind"), (F.col("debit") + F.col("credit")).alias("volume"))
    sums = rows.groupBy("voucher", "side", "kind").agg(F.sum("volume").alias("volume"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("kind")), F.lit(99))
    best = sums.groupBy("voucher", F.when(F.col("side") == "D", "C").otherwise("D").alias("side")).agg(F.max_by("kind", F.struct(F.col("volume"), -rank)).alias("counterparty_type"))
    return best



# Account family | expected types of counterparty.
EXPECTED_TYPES = """
641|PERSONNEL ORGANISMES BANQUE
645|ORGANISMES BANQUE
647|PERSONNEL BANQUE
606|FOURNISSEUR BANQUE
607|FOURNISSEUR BANQUE
611|FOURNISSEUR PROVISION
613|FOURNISSEUR PROVISION ETALEMENT
615|FOURNISSEUR
616|FOURNISSEUR ETALEMENT
617|FOURNISSEUR
618|FOURNISSEUR
622|FOURNISSEUR PERSONNEL
623|FOURNISSEUR
625|FOURNISSEUR PERSONNEL
626|FOURNISSEUR BANQUE
627|FOURNISSEUR BANQUE
631|ETAT
633|ETAT PROVISION
635|ETAT PROVISION
637|ETAT
661|BANQUE
666|BANQUE
681|PROVISION
686|PROVISION
687|PROVISION
706|CLIENT
707|CLIENT
708|CLIENT
709|CLIENT
781|PROVISION
786|PROVISION
787|PROVISION
"""
EXPECTED_TYPE_ROWS = [tuple(line.split("|")) for line in EXPECTED_TYPES.strip().splitlines()]


def type_conformity(df: DataFrame) -> DataFrame:
    """(family, counterparty_type, lines, conform): families without expected types, and lines without a counterparty, conform."""
    side = F.when(F.col("debit") > 0, "D").otherwise("C")
    lines = df.groupBy("voucher", side.alias("side"), F.substring("account", 1, 3).alias("family")).agg(F.count("*").alias("n"))
    typed = lines.join(counterparty_type(df), ["voucher", "side"], "left").groupBy("family", "counterparty_type").agg(F.sum("n").alias("lines"))
    expected = F.broadcast(df.sparkSession.createDataFrame(EXPECTED_TYPE_ROWS, "family string, types string"))
    ok = F.array_contains(F.split("types", " "), F.col("counterparty_type"))
    return typed.join(expected, "family", "left").withColumn("conform", F.coalesce(ok, F.lit(True))).drop("types")
