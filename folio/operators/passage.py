"""Subscriptions, provision couples, the passage table and its alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import first_of, number, ratio, rounded, sum_if, total
from folio.operators.classify import accounts_of, classify_v2
from folio.sources import dims

# Object of a subscription and its keywords, the first that occurs counts.
SUBSCRIPTION_KEYWORDS = {
    "CFE": ["CFE", "cotisation foncière", "cotis. foncière"],
    "CVAE": ["CVAE", "valeur ajoutée", "VA "],
    "TAXE_FONCIERE": ["taxe foncière", "taxe fonc", "foncier"],
    "PRUDHOMMES": ["prud'homme", "prudhomme", "prud homme", "CPH", "litige salarié"],
    "FORMATION": ["formation", "OPCO", "plan form"],
    "CAC": ["CAC", "commissaire aux comptes", "commiss", "audit légal"],
    "AGEFIPH": ["AGEFIPH", "handicap", "OETH"],
    "TAXE_APPRENTISSAGE": ["apprentissage", "taxe apprenti", "TA "],
    "ORGANIC": ["organic", "gestion agréé"],
    "C3S": ["C3S", "contribution sociale"],
    "PARTICIPATION": ["participation", "intéressement"],
    "CONGES_PAYES": ["congés payés", "CP ", "conges payes"],
    "BONUS": ["bonus", "prime", "gratification"],
    "ASSURANCE": ["assurance", "multirisque", "RC pro"],
    "LOYER": ["loyer", "bail", "location"],
}
SUBSCRIPTION, MAX_BALANCE = "488", 0.01
MONTHS = 12


def of_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.col("year") == year)


def subscriptions(df: DataFrame, year: int) -> DataFrame:
    """Accounts 488: movement, balance, monthly provision (January to November), months, entries; valid when they balance."""
    rows = of_year(df, year).where(F.col("account").startswith(SUBSCRIPTION))
    before = F.col("month") != 12
    g = rows.groupBy("account").agg(
        F.sum(F.col("debit") + F.col("credit")).alias("movement"), F.sum("amount").alias("balance"), sum_if(F.col("debit"), before).alias("d"),
        F.count_distinct(F.when(before, F.col("month"))).alias("m"), F.count_distinct("month").alias("months"), F.count("*").alias("entries"),
    )
    valid = F.coalesce(F.try_divide(F.abs(number(F.col("balance"))), number(F.col("movement"))) < MAX_BALANCE, F.lit(False))
    return g.select("account", "movement", "balance", rounded(ratio(F.col("d"), F.col("m"))).alias("monthly_provision"), "months", "entries", valid.alias("is_valid"))


def subscription_object(df: DataFrame, year: int) -> DataFrame:
    """The most frequent label (50 characters, first on ties) and the object it is about."""
    rows = of_year(df, year).where(F.col("account").startswith(SUBSCRIPTION))
    labels = rows.groupBy("account", F.left(F.trim("label"), F.lit(50)).alias("label50")).agg(F.count("*").alias("n"))
    best = labels.groupBy("account").agg(F.min_by("label50", F.struct(-F.col("n"), F.col("label50"))).alias("main_label"))
    up = F.upper("label")
    has = rows.select("account", "label").distinct().groupBy("account").agg(
        *[F.max(reduce(lambda a, b: a | b, [up.contains(w.upper()) for w in ws])).alias(k) for k, ws in SUBSCRIPTION_KEYWORDS.items()],
        F.min(F.nullif(F.regexp_extract(up, r"(?:ABT|PROV|PROVISION)[.\s]+([\w]+)", 1), F.lit(""))).alias("word"),
    )
    found = first_of([(F.col(k), k) for k in SUBSCRIPTION_KEYWORDS], F.coalesce("word", F.lit("NON_IDENTIFIE")))
    return best.join(has.select("account", found.alias("object")), "account")


def subscription_summary(df: DataFrame, year: int) -> DataFrame:
    return subscriptions(df, year).join(subscription_object(df, year), "account").groupBy("object", "is_valid").agg(F.count("*").alias("accounts"), F.sum("movement").alias("movement"), rounded(F.sum("monthly_provision"), 2).alias("monthly_provision"))


def couples(df: DataFrame, year: int) -> DataFrame:
    """Provision accounts with the reversal account of the same suffix: amounts, net, matched, type."""
    sums = of_year(df, year).where(F.col("account").rlike("^[67]8")).groupBy("account").agg(F.abs(F.sum("amount")).alias("a"))
    pairs = F.broadcast(df.sparkSession.createDataFrame(dims.COUPLES, "prefix string, reversal_prefix string, provision_type string"))
    p = sums.join(pairs, F.col("account").startswith(F.col("prefix"))).select(
        F.col("account").alias("provision_account"), F.col("a").alias("provision"), "provision_type", F.concat("reversal_prefix", F.expr("substring(account, length(prefix) + 1)")).alias("expected")
    )
    r = sums.select(F.col("account").alias("reversal_account"), F.col("a").alias("reversal"))
    j = p.join(r, F.col("expected") == F.col("reversal_account"), "left").withColumn("reversal", F.coalesce("reversal", F.lit(0)))
    return j.select("provision_account", "reversal_account", "provision", "reversal", (F.col("provision") - F.col("reversal")).alias("net"), (F.col("reversal_account").isNotNull() & (F.col("reversal") > 0)).alias("is_matched"), "provision_type")


def couple_detail(df: DataFrame, year: int) -> DataFrame:
    """Monthly amounts of provision and reversal accounts, zero months dropped, with the longest label (60 characters)."""
    rows = of_year(df, year)
    c = couples(df, year)
    ids = c.select(F.col("provision_account").alias("account"), F.lit("dotation").alias("kind")).unionByName(c.where("reversal_account IS NOT NULL").select(F.col("reversal_account").alias("account"), F.lit("reprise").alias("kind")))
    j = rows.join(ids.distinct(), "account")
    value = F.when(F.col("kind") == "reprise", -F.col("amount")).otherwise(F.col("amount"))
    months = j.groupBy("account", "kind", "month").agg(F.sum(value).alias("value")).where("value != 0")
    longest = j.groupBy("account").agg(F.left(F.min_by(F.trim("label"), F.struct(-F.length(F.trim("label")), F.trim("label"))), F.lit(60)).alias("main_label"))
    return months.join(longest, "account")


def couple_views(df: DataFrame, year: int) -> DataFrame:
    """By type: couples, totals, matched; reversals (78) that belong to no matched couple are of type `orpheline`."""
    c = couples(df, year)
    by = c.groupBy("provision_type").agg(F.count("*").alias("couples"), total(F.col("provision")).alias("provision"), total(F.col("reversal")).alias("reversal"), total(F.col("net")).alias("net"), F.count_if("is_matched").alias("matched"))
    o = orphan_reversals(df, year).agg(F.count("*").alias("couples"), total(F.col("reversal")).alias("reversal")).where("couples > 0")
    zero = F.lit(0).cast("decimal(18,2)")
    return by.unionByName(o.select(F.lit("orpheline").alias("provision_type"), "couples", zero.alias("provision"), "reversal", (-F.col("reversal")).alias("net"), F.lit(0).cast("long").alias("matched")))


def orphan_reversals(df: DataFrame, year: int) -> DataFrame:
    sums = of_year(df, year).where(F.col("account").startswith("78")).groupBy("account").agg(F.abs(F.sum("amount")).alias("reversal"))
    return sums.join(couples(df, year).where("is_matched").select(F.col("reversal_account").alias("account")), "account", "left_anti")


def adjustments(df: DataFrame, year: int) -> DataFrame:
    """(month, kind, account, gross, adjusted): income tax spread, exceptional items, subscription reversals, net provisions."""
    rows = of_year(df, year)
    net = lambda cond: F.abs(sum_if(F.col("amount"), cond))
    tax = F.col("prefix_2") == "69"
    row = lambda m, kind, account, gross, adjusted: [m.cast("int").alias("month"), F.lit(kind).alias("kind"), account.alias("account"), rounded(gross, 2).alias("gross"), rounded(adjusted, 2).alias("adjusted")]
    t = rows.where(tax).agg(net(F.col("month") == 12).alias("dec"), net(F.lit(True)).alias("all")).withColumn("share", number(F.col("all")) / MONTHS)
    is_ = t.where(number(F.col("dec")) > 2 * F.col("share")).select(*row(F.lit(12), "is", F.lit("695xxx"), F.col("dec"), number(F.col("dec")) - F.col("share")))
    e = rows.where(F.col("prefix_2").isin("67", "77")).groupBy("month").agg(net(F.col("prefix_2") == "67").alias("c"), net(F.col("prefix_2") == "77").alias("p")).withColumn("net", F.col("c") - F.col("p"))
    exc = e.where(F.abs("net") > 1000).select(*row(F.col("month"), "exceptionnel", F.lit("67/77"), F.col("net"), -number(F.col("net"))))
    s = subscriptions(df, year).where("is_valid").select("account", "monthly_provision")
    d = rows.where((F.col("month") == 12) & F.col("account").startswith(SUBSCRIPTION)).groupBy("account").agg(F.sum("amount").alias("a")).join(s, "account")
    abt = d.where(F.abs(number(F.col("a"))) > 2 * F.col("monthly_provision")).select(*row(F.lit(12), "abt", F.col("account"), F.col("a"), -number(F.col("a"))))
    dec = rows.where("month = 12").groupBy("account").agg(F.sum("amount").alias("dec"))
    c = couples(df, year).where("provision_type != 'amortissement' AND net > 10000").join(dec, F.col("account") == F.col("provision_account"))
    c = c.where((F.col("dec") != 0) & (number(F.col("dec")) > 0.5 * number(F.col("provision"))))
    prov = c.select(*row(F.lit(12), "provision_net", F.col("provision_account"), F.col("dec"), number(F.col("net")) / MONTHS - number(F.col("dec"))))
    return reduce(DataFrame.unionByName, [is_, exc, abt, prov])


def passage_monthly(df: DataFrame, year: int) -> DataFrame:
    """Twelve months: gross charges, products and result, adjustments, normalized values. Charges count debit less credit, products credit less debit."""
    p = F.col("pnl_amount")
    g = of_year(df, year).groupBy("month").agg(sum_if(p, F.col("class") == "6").alias("c"), sum_if(p, F.col("class") == "7").alias("p"))
    a = adjustments(df, year).groupBy("month").agg(F.sum("adjusted").alias("adj"))
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    zero = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
    j = months.join(g, "month", "left").join(a, "month", "left").select("month", F.abs(zero("c")).alias("c"), F.abs(zero("p")).alias("p"), (zero("p") - zero("c")).alias("res"), zero("adj").alias("adj"))
    up = F.col("adj") >= 0
    cols = {
        "gross_charges": F.col("c"), "gross_products": F.col("p"), "gross_result": F.col("res"), "adjustment": F.col("adj"), "normalized_charges": F.when(up, F.col("c") - F.col("adj")).otherwise(F.col("c")),
        "normalized_products": F.when(up, F.col("p")).otherwise(F.col("p") + F.col("adj")), "normalized_result": F.col("res") + F.col("adj"),
    }
    return j.select("month", *[rounded(v, 2).alias(k) for k, v in cols.items()])


def passage_annual(df: DataFrame, year: int) -> DataFrame:
    """One row: sums of the months, gap of the results and its share in per cent."""
    s = passage_monthly(df, year).agg(*[F.sum(c).alias(c) for c in ("gross_charges", "gross_products", "normalized_charges", "normalized_products")])
    gross, normal = F.col("gross_products") - F.col("gross_charges"), F.col("normalized_products") - F.col("normalized_charges")
    return s.select(*[rounded(F.col(c), 2).alias(c) for c in s.columns], rounded(gross, 2).alias("gross_result"), rounded(normal, 2).alias("normalized_result"), rounded(normal - gross, 2).alias("gap"), rounded(ratio(normal - gross, F.abs(gross)) * 100, 3).alias("gap_pct"))


def passage_run_rate(df: DataFrame, year: int) -> DataFrame:
    a = passage_annual(df, year)
    return a.select(*[rounded(F.col(c) / MONTHS, 3).alias(c) for c in ("gross_charges", "gross_products", "gross_result", "normalized_charges", "normalized_products", "normalized_result")], "gap_pct")


def adjustment_summary(df: DataFrame, year: int) -> DataFrame:
    """Adjustments of the year by kind."""
    return adjustments(df, year).groupBy("kind").agg(F.count("*").alias("items"), rounded(F.sum("gross"), 2).alias("gross"), rounded(F.sum("adjusted"), 2).alias("adjusted"))


def _alert(kind: str, amount: Column, priority: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.col("account"), number(amount).alias("amount"), priority.cast("int").alias("priority")]


def label_overlap(df: DataFrame, year: int, least: int = 2, letters: int = 3, subscription: str = SUBSCRIPTION) -> DataFrame:
    """Provision accounts that share least words or more of over so many letters with a subscription account."""
    rows = of_year(df, year)
    words = lambda d: d.select("account", "label").distinct().select("account", F.explode(F.split(F.upper("label"), r"\s+")).alias("word")).where(F.length("word") > letters).distinct()
    p = words(rows.where(F.col("account").rlike("^(6815|686|687)")))
    s = words(rows.where(F.col("account").startswith(subscription))).withColumnRenamed("account", "subscription")
    return p.join(s, "word").groupBy("account", "subscription").agg(F.count("*").alias("words")).where(F.col("words") >= least)


def alert_unbudgeted(df: DataFrame, year: int) -> DataFrame:
    rows = of_year(df, year).where(F.col("account").rlike("^(6815|686|687)"))
    g = rows.groupBy("account").agg(F.abs(F.sum("amount")).alias("a"), F.avg((F.col("month") == 12).cast("int")).alias("d")).where("a >= 5000 AND d > 0.5")
    kept = g.join(label_overlap(df, year).select("account"), "account", "left_anti")
    return kept.select(*_alert("PROVISION_NON_BUDGETEE", F.col("a"), F.when(F.col("a") > 20_000, 1).otherwise(2)))


def alert_orphan(df: DataFrame, year: int, least: int = 10_000) -> DataFrame:
    return orphan_reversals(df, year).where(F.col("reversal") >= least).select(*_alert("REPRISE_ORPHELINE", F.col("reversal"), F.lit(2)))


def alert_new_december(df: DataFrame, year: int) -> DataFrame:
    g = of_year(df, year).where("class IN ('6', '7')").groupBy("account").agg(F.abs(F.sum("amount")).alias("a"), F.max((F.col("month") != 12).cast("int")).alias("before"))
    return g.where("before = 0 AND a >= 5000").select(*_alert("COMPTE_NOUVEAU_DECEMBRE", F.col("a"), F.when(F.col("a") > 10_000, 2).otherwise(3)))


def alert_concentration(df: DataFrame, year: int) -> DataFrame:
    g = of_year(df, year).groupBy("account").agg(F.abs(F.sum("amount")).alias("a"), F.abs(sum_if(F.col("amount"), F.col("month") == 12)).alias("d"))
    info = classify_v2(accounts_of(of_year(df, year)))
    kept = g.join(info, "account").where("a >= 10000 AND behavior = 'mensuel' AND NOT is_income_tax AND NOT is_depreciation AND NOT is_exceptional AND NOT is_subscription")
    return kept.where(number(F.col("d")) / number(F.col("a")) > 0.6).select(*_alert("CONCENTRATION_ANORMALE", F.col("d"), F.lit(3)))


def alerts(df: DataFrame, year: int, n: int = 10) -> DataFrame:
    """All alerts from 5000 on, by priority, then amount; the first n."""
    every = reduce(DataFrame.unionByName, [f(df, year) for f in (alert_unbudgeted, alert_orphan, alert_new_december, alert_concentration)])
    kept = every.where((F.col("amount") >= 5000) & ~F.col("account").startswith(SUBSCRIPTION))
    return kept.orderBy("priority", F.desc("amount"), "account").limit(n)


