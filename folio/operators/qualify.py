"""From signals to anomalies: context in the ledger, business rules, pertinence, and the score of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import first_of, rounded
from folio.functions.tables import written
from folio.operators.signals import UNIVERSES, materiality

# Exclusion rule | column of the context that meets it. A rule is met where its column is true.
EXCLUSIONS = [
    ("EXC-ROUND", "is_round"), ("EXC-SAME12M", "same_12"), ("EXC-LABEL", "repeated_label"), ("EXC-ZERO", "zero_balance"),
    ("EXC-EXTOURNE", "reversed_in_time"), ("EXC-REGUL", "is_regularisation"), ("EXC-RECUR", "recurrent_variation"),
]
# Text in a family's list | rule that it names; the first text found counts.
RULE_TEXTS = [
    ("montant_rond", "EXC-ROUND"), ("round_amount", "EXC-ROUND"), ("meme_montant_12_mois", "EXC-SAME12M"), ("meme_montant_12m", "EXC-SAME12M"), ("same_amount_12m", "EXC-SAME12M"),
    ("label_identique", "EXC-LABEL"), ("repetitive_label", "EXC-LABEL"), ("solde_zero", "EXC-ZERO"), ("zero_balance", "EXC-ZERO"), ("extourne_dans_delai", "EXC-EXTOURNE"),
    ("extourne_ok", "EXC-EXTOURNE"), ("regularisation", "EXC-REGUL"), ("regul", "EXC-REGUL"), ("mensuel_recurrent", "EXC-RECUR"), ("monthly_recurrent", "EXC-RECUR"),
]
# Inclusion rule | column that meets it | points.
INCLUSIONS = [("INC-FIRST", "is_first", 15.0), ("INC-YEAREND", "year_end", 10.0), ("INC-HIGH", "is_high", 20.0), ("INC-JOURNAL", "unusual_journal", 15.0)]
# Adjusted p-value below | statistical score.
P_SCORES = [(0.001, 100.0), (0.005, 90.0), (0.01, 85.0), (0.02, 75.0), (0.05, 70.0), (0.10, 50.0)]
# Weights of the four parts of pertinence.
WEIGHTS = {"statistical": 0.35, "materiality": 0.30, "business": 0.25, "context": 0.10}
RISKY = ("CUT_OFF", "PONCTUEL", "INVENTAIRE")
LEVELS = [(80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM")]
PERTINENT, MOST_BOOST = 40.0, 30.0
ROUND_STEPS = (100, 500, 1000, 5000)
# Largest impact of an anomaly, number of account families, score level from.
MOST_IMPACT, FAMILIES = 15.0, 180.0
SCORE_LEVELS = [(90, "EXCELLENT"), (75, "BON"), (60, "ACCEPTABLE"), (40, "ATTENTION")]


def family_context(led: DataFrame) -> DataFrame:
    """(family, months, same_3, same_12, repeated_label, zero_balance) from all lines of each family.

    Monthly sums count as the same when each is within a thousandth of the first of the
    last 3 or 12 months. A label is repeated when the commonest one has over half of the
    lines, 3 at least.
    """
    by_month = led.groupBy(F.col("prefix_3").alias("family"), "period").agg(F.sum("amount").cast("double").alias("v"))
    months = by_month.groupBy("family").agg(F.count("*").alias("months"), F.transform(F.array_sort(F.collect_list(F.struct("period", "v"))), lambda x: x["v"]).alias("vs"))

    def same(k: int) -> Column:
        last = F.slice("vs", -k, k)
        alike = lambda x: F.when(last[0] == 0, x == 0).otherwise(F.abs(x - last[0]) < 0.001 * F.abs(last[0]))
        return F.when(F.col("months") >= k, F.forall(last, alike)).otherwise(False)

    label = F.lower(F.trim("label"))
    labels = led.where("label IS NOT NULL").groupBy(F.col("prefix_3").alias("family"), label.alias("l")).agg(F.count("*").alias("n"))
    named = F.when(F.col("l") != "", F.col("n"))
    repeated = labels.groupBy("family").agg(F.sum("n").alias("all"), F.sum(named).alias("named"), F.max(named).alias("top"))
    repeated = repeated.select("family", ((F.col("all") >= 3) & (F.col("top") >= 3) & (F.col("top") > 0.5 * F.col("named"))).alias("repeated_label"))
    zero = led.groupBy(F.col("prefix_3").alias("family")).agg((F.abs(F.sum("amount")) < 0.01).alias("zero_balance"))
    return months.select("family", "months", same(3).alias("same_3"), same(12).alias("same_12")).join(zero, "family").join(repeated, "family", "left").withColumn("repeated_label", F.coalesce("repeated_label", F.lit(False)))


def context(s: DataFrame, led: DataFrame) -> DataFrame:
    """Signals with what the rules look at. What a ledger can't say (reversed in time, first of its kind, ...) is false."""
    j = s.join(family_context(led), "family", "left")
    no = F.lit(False)
    metric = F.col("metric")
    is_round = F.lit(False)
    for step in ROUND_STEPS:
        is_round = is_round | (metric % step < 0.01 * step)
    calibration = F.when(F.col("method") == "conformal", F.col("months") - 1)
    return j.select(
        *s.columns, F.coalesce(calibration, F.lit(0)).alias("calibration"), ((metric > 0) & is_round).alias("is_round"), *[F.coalesce(c, no).alias(c) for c in ("same_3", "same_12", "repeated_label", "zero_balance")],
        no.alias("reversed_in_time"), no.alias("is_regularisation"), (F.coalesce(calibration >= 6, no) & (F.col("test") == "L2-VAR")).alias("recurrent_variation"),
        no.alias("is_first"), F.coalesce(F.col("period").endswith("12"), no).alias("year_end"), no.alias("is_high"), no.alias("unusual_journal"),
    )


def rule_of(text: Column) -> Column:
    """The rule that a text in a family's list names, else null."""
    plain = F.replace(F.lower(text), F.lit(" "), F.lit("_"))
    return first_of([(plain.contains(t), rule) for t, rule in RULE_TEXTS])


def exclusions(c: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """c with rules_checked, rules_matched and excluded.

    listed: (family, rules array<string>), one row a family. Only the rules that a family
    lists are checked for it; all of them where it lists none that is known.
    """
    if listed is None:
        j = c.withColumn("own", F.array().cast("array<string>"))
    else:
        own = listed.select("family", F.array_compact(F.transform("rules", rule_of)).alias("own"))
        j = c.join(own, "family", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    applies = lambda rule: (F.size("own") == 0) | F.array_contains("own", rule)
    checked = F.array_compact(F.array(*[F.when(applies(rule), rule) for rule, _ in EXCLUSIONS]))
    matched = F.array_compact(F.array(*[F.when(applies(rule) & F.col(col), rule) for rule, col in EXCLUSIONS]))
    return j.withColumns({"rules_checked": checked, "rules_matched": matched}).withColumn("excluded", F.size("rules_matched") > 0).drop("own")


def inclusions(c: DataFrame) -> DataFrame:
    """c with boost, the points of the inclusion rules that it meets, and their names."""
    boost = sum((F.when(F.col(col), points).otherwise(0.0) for _, col, points in INCLUSIONS), F.lit(0.0))
    return c.withColumns({"boost": boost, "boosted_by": F.array_compact(F.array(*[F.when(F.col(col), rule) for rule, col, _ in INCLUSIONS]))})


def pertinence(c: DataFrame) -> DataFrame:
    """c (with amount, limit, boost) with the four parts of pertinence, their weighted sum and its level."""
    p = F.when(F.coalesce("p_adjusted", F.lit(0.0)) != 0, F.col("p_adjusted")).otherwise(F.col("p_value"))
    far = 100 * F.greatest(F.lit(0.0), 0.5 - F.log10(p + 0.01) * 0.2)
    statistical = F.when(p.isNull(), F.least(F.lit(100.0), F.col("raw_score"))).otherwise(first_of([(p < t, v) for t, v in P_SCORES], far))
    q = F.col("amount") / F.col("limit")
    material = first_of([(F.col("limit") <= 0, 50.0), (q < 1, 50 * q), (q < 2, 50 + 20 * (q - 1)), (q < 5, 70 + 20 * (q - 2) / 3)], 100 * F.least(F.lit(1.0), 0.9 + 0.1 * F.log10(q / 5)))
    points = [(F.col("universe").isin(*RISKY), 10.0), (F.col("period").endswith("-12"), 5.0), (F.col("method").isin("matrix_profile", "conformal"), 5.0), (F.col("calibration") >= 12, 5.0)]
    around = F.least(F.lit(30.0), sum((F.when(cond, n).otherwise(0.0) for cond, n in points), F.lit(0.0)))
    parts = c.withColumns({"statistical": statistical, "material_part": material, "context": around})
    business = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("statistical") + F.col("material_part")) / 2 + F.least(F.lit(MOST_BOOST), F.col("boost"))))
    parts = parts.withColumn("business", business)
    final = WEIGHTS["statistical"] * F.col("statistical") + WEIGHTS["materiality"] * F.col("material_part") + WEIGHTS["business"] * F.col("business") + WEIGHTS["context"] * F.col("context")
    parts = parts.withColumn("pertinence", rounded(F.least(F.greatest(final, F.lit(0.0)), F.lit(100.0))))
    parts = parts.withColumns({x: rounded(F.col(x)) for x in ("statistical", "material_part", "business", "context")})
    return parts.withColumn("level", first_of([(F.col("pertinence") >= t, name) for t, name in LEVELS], "LOW"))


def qualify(s: DataFrame, led: DataFrame, listed: DataFrame | None = None, least: float = PERTINENT) -> DataFrame:
    """Every signal with its filter_reason; those that pass are anomalies and have a rank.

    A signal must reach its materiality, meet no exclusion rule, and have a pertinence of
    at least least. Ranks go by pertinence, ties by id.
    """
    s = written(s, "signals")
    m = materiality(s).select("id", "amount", "limit", "material")
    judged = pertinence(inclusions(exclusions(context(s, led), listed).join(m, "id")))
    reason = first_of([(~F.col("material"), "BELOW_MATERIALITY"), (F.col("excluded"), "EXCLUDED_BY_RULE"), (F.col("pertinence") < least, "LOW_PERTINENCE")], "PASSED")
    judged = judged.withColumn("filter_reason", reason)
    order = Window.partitionBy("filter_reason").orderBy(F.desc("pertinence"), "id")
    return judged.withColumn("rank", F.when(F.col("filter_reason") == "PASSED", F.row_number().over(order)))


def qualify_summary(q: DataFrame) -> DataFrame:
    """One row: signals, how many are left and why the others aren't, rules checked, and the share that went."""
    n = lambda reason: F.count_if(F.col("filter_reason") == reason)
    checked = F.coalesce(F.sum(F.when(F.col("filter_reason") != "BELOW_MATERIALITY", F.size("rules_checked"))), F.lit(0))
    return q.agg(
        F.count("*").alias("signals"), n("PASSED").alias("qualified"), n("BELOW_MATERIALITY").alias("below_materiality"), n("EXCLUDED_BY_RULE").alias("excluded_by_rule"), n("LOW_PERTINENCE").alias("low_pertinence"),
        checked.alias("rules_checked"), rounded(F.when(F.count("*") > 0, 1 - n("PASSED") / F.count("*")).otherwise(0.0)).alias("reduction"),
    )


def impact(q: DataFrame, keys: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Anomalies (the rows that passed) with their impact: pertinence by universe weight and share of all amounts at stake, of those with the same keys.

    keep: further columns to keep.
    """
    dim = F.broadcast(q.sparkSession.createDataFrame([(u, w) for u, _, w in UNIVERSES], "universe string, weight double"))
    passed = q.where("filter_reason = 'PASSED'").select(*keys, *keep, "id", "family", "universe", "test", "pertinence", "amount")
    every = F.sum("amount").over(Window.partitionBy(*keys or [F.lit(0)]))
    share = F.log10(1 + F.col("amount") / F.greatest(every, F.lit(1.0))) * 3 + 1
    factor = F.when((every > 0) & (F.col("amount") > 0), F.least(F.lit(2.0), F.greatest(F.lit(0.5), share))).otherwise(1.0)
    j = passed.withColumn("factor", factor).join(dim, "universe", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    base = F.col("pertinence") / 100 * MOST_IMPACT
    return j.select(
        *keys, *keep, "id", "family", "universe", "test", "pertinence", "amount", rounded(base).alias("base_impact"), "weight", rounded(F.col("factor")).alias("factor"),
        rounded(F.least(F.lit(MOST_IMPACT), base * F.col("weight") * F.col("factor"))).alias("impact"),
    )


def universe_scores(i: DataFrame) -> DataFrame:
    """100 less the impacts of each universe, those without anomalies included."""
    dim = i.sparkSession.createDataFrame([(u,) for u, _, _ in UNIVERSES], "universe string")
    sums = i.groupBy("universe").agg(F.count("*").alias("anomalies"), F.sum("impact").alias("t"), F.sum("amount").alias("a"))
    j = dim.join(sums, "universe", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("universe", F.coalesce("anomalies", F.lit(0)).alias("anomalies"), rounded(zero("t"), 3).alias("impact"), rounded(zero("a"), 2).alias("amount"), rounded(F.greatest(100 - zero("t"), F.lit(0.0)), 3).alias("score"))


def score(i: DataFrame, top: int = 5) -> DataFrame:
    """One row: score of the ledger, its level, the anomalies of most impact, and the families concerned of all; 100 without anomalies."""
    g = i.agg(F.count("*").alias("anomalies"), F.coalesce(F.sum("impact"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("a"), F.count_distinct("family").alias("families"))
    most = i.orderBy(F.desc("impact"), "id").limit(top).select((-F.col("impact")).alias("neg"), "id")
    first = most.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("neg", "id"))), lambda x: x["id"]), ",").alias("top"))
    value = rounded(F.greatest(100 - F.col("t"), F.lit(0.0)), 3)
    return g.crossJoin(first).select(
        value.alias("score"), first_of([(value >= t, name) for t, name in SCORE_LEVELS], "CRITIQUE").alias("level"), "anomalies", rounded(F.col("t"), 3).alias("impact"), rounded(F.col("a"), 2).alias("amount"),
        rounded(F.col("families") / FAMILIES).alias("coverage"), "top",
    )


def prepare_signals(led: DataFrame, raw_date: str = "date", least: float = 0.5) -> DataFrame:
    """(family, period, amount, journal, label): months of valid dates where over half of all are valid.

    Lines without one then get the commonest month (the first of equals). Otherwise all
    lines are in the one period AGG.
    """
    day = F.col(raw_date).try_cast("date")
    rows = led.select(F.col("account").alias("family"), F.date_format(day, "yyyy-MM").alias("period"), F.coalesce("amount", F.lit(0)).alias("amount"), "journal", "label")
    months = rows.groupBy("period").agg(F.count("*").alias("n"))
    usual = months.agg(
        (F.sum(F.when(F.col("period").isNotNull(), F.col("n")).otherwise(0)) > least * F.sum("n")).alias("dated"), F.min_by("period", F.when(F.col("period").isNotNull(), F.struct(-F.col("n"), F.col("period")))).alias("mode")
    )
    j = rows.crossJoin(F.broadcast(usual))
    return j.withColumn("period", F.when(F.col("dated"), F.coalesce("period", "mode")).otherwise("AGG")).drop("dated", "mode")


# Fixed values of the referential: universes that tell of anomalies, and one that doesn't.
SIGNAL_UNIVERSES, QUIET_UNIVERSES = ["EXCEPTIONNEL", "FISCAL", "TRESORERIE"], ["RECURRENT"]


def referential(couples: DataFrame) -> DataFrame:
    """What later steps know of each account, from its classified couples: the one with most entries speaks for it."""
    order = F.struct("entries", F.col("volume"), F.col("site"))
    g = couples.groupBy("account").agg(*[F.max_by(c, order).alias(c) for c in ("universe", "cv", "entries")])
    return g.select(
        "account", "universe", "cv", "entries", F.when(F.col("entries") > 10, 1000.0).otherwise(500.0).alias("materiality"), F.col("universe").isin(*SIGNAL_UNIVERSES).alias("is_signal_universe"),
        F.lit(",".join(SIGNAL_UNIVERSES)).alias("signal_if"), F.lit(",".join(QUIET_UNIVERSES)).alias("no_signal_if"),
    )
