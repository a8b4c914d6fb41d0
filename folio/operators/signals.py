"""Statistical signals by account family, their false-discovery control, and materiality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import first_of, ratio, rounded
from folio.operators.crystallinity import expected_universe
from folio.operators.robust import active_months, bh_adjust, conformal, discord

# Universe | materiality threshold | weight in the score.
UNIVERSES = [
    ("CRISTALLIN", 2000.0, 0.8), ("NOMINATIF_TIERS", 10000.0, 1.2), ("NOMINATIF_OPERATIONNEL", 5000.0, 1.0), ("PROCESSUS", 5000.0, 1.0), ("VENTILATION", 3000.0, 0.9),
    ("CUT_OFF", 5000.0, 1.3), ("TRESORERIE", 20000.0, 0.7), ("PONCTUEL", 10000.0, 1.4), ("INVENTAIRE", 15000.0, 1.1), ("COMPOSITE", 5000.0, 1.0),
]
TEST_FACTORS = {"L2-VAR": 1.0, "L2-DISCORD": 0.8, "L2-MISSING": 0.5, "L2-CONC": 1.2}
DEFAULT_THRESHOLD = 5000.0
MONTHS_EXPECTED, DEAD_BAND = 12, 3.5


def universe_of(family: Column) -> Column:
    """Expected universe of a family; those without a counterpart in the statistical list are COMPOSITE."""
    u = expected_universe(family)
    return F.when(u.isin(*[n for n, _, _ in UNIVERSES]), u).otherwise("COMPOSITE")


def family_series(df: DataFrame) -> DataFrame:
    """(family, period, v, universe) of families with two or more months."""
    m = active_months(df, None, "prefix_3").withColumnRenamed("prefix_3", "family").withColumn("n", F.count("*").over(Window.partitionBy("family")))
    return m.where("n >= 2").select("family", "period", rounded(F.col("v"), 2).alias("v"), universe_of(F.col("family")).alias("universe"))


def _signal(test: str, period: Column, metric: Column, threshold: Column, delta: Column, p: Column, method: Column) -> list[Column]:
    name = F.concat_ws("_", F.lit(test), F.col("family"), period)
    return [
        name.alias("id"), F.col("family"), universe_of(F.col("family")).alias("universe"), F.lit(test).alias("test"), period.cast("string").alias("period"),
        rounded(metric, 3).alias("metric"), rounded(threshold, 3).alias("threshold"), rounded(delta, 3).alias("delta"), p.cast("double").alias("p_value"), method.alias("method"),
    ]


def sig_var(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The last month against the earlier ones: conformal p-value below alpha, or outside the dead band."""
    c = conformal(df, None)
    hit = ((F.col("method") == "conformal") & (F.col("p_value") < alpha)) | ((F.col("method") == "dead_band") & (F.col("n") >= 2) & (F.col("z") > DEAD_BAND))
    p = F.when(F.col("method") == "conformal", F.col("p_value"))
    return c.where(hit).select(*_signal("L2-VAR", F.col("period"), F.col("value"), F.col("median"), F.abs(F.col("value") - F.col("median")), p, F.col("method")))


def sig_discord(df: DataFrame) -> DataFrame:
    """The oddest stretch of months of crystalline and process families with 6 months or more; its rank p-value is 0."""
    d = discord(df).where((F.col("months") >= 6) & universe_of(F.col("family")).isin("CRISTALLIN", "PROCESSUS"))
    m = active_months(df, None, "prefix_3").select(F.col("prefix_3").alias("family"), F.col("period").alias("start"), "v")
    mid = active_months(df, None, "prefix_3").groupBy(F.col("prefix_3").alias("family")).agg(F.percentile("v", 0.5).alias("median"))
    j = d.join(m, ["family", "start"]).join(mid, "family")
    return j.select(*_signal("L2-DISCORD", F.col("start"), F.col("v"), F.col("median"), F.col("score"), F.lit(0.0), F.lit("discord")))


def sig_missing(df: DataFrame) -> DataFrame:
    """Crystalline families with fewer than 12 months in a year in which they have two or more."""
    months = active_months(df, None, "prefix_3").groupBy(F.col("prefix_3").alias("family"), F.substring("period", 1, 4).alias("year"))
    n = months.agg(F.count("*").alias("k")).where((F.col("k") >= 2) & (F.col("k") < MONTHS_EXPECTED))
    gap = MONTHS_EXPECTED - F.col("k")
    p = F.when(gap >= 2, rounded(F.greatest(1 - gap / MONTHS_EXPECTED, F.lit(0.01))))
    return n.where(universe_of(F.col("family")) == "CRISTALLIN").select(*_signal("L2-MISSING", F.col("year"), F.col("k"), F.lit(MONTHS_EXPECTED), gap, p, F.lit("rule_based")))


def sig_conc(df: DataFrame, usual: float = 0.5, one_off: float = 0.8) -> DataFrame:
    """Families with 3 months or more of which one holds over half of the volume (80 % when PONCTUEL)."""
    w = Window.partitionBy("family")
    m = family_series(df).withColumn("s", F.round(ratio(F.abs("v"), F.sum(F.abs("v")).over(w)), 9)).withColumn("n", F.count("*").over(w)).where("n >= 3")
    c = m.groupBy("family").agg(F.percentile("s", 0.5).alias("median"), F.stddev_pop("s").alias("sd"), F.max("s").alias("top"), F.first("n").alias("n"), F.min_by("period", F.struct(-F.col("s"), F.col("period"))).alias("period"))
    j = m.select("family", "s").join(c, "family")
    spread = j.groupBy("family").agg(F.percentile(F.abs(F.col("s") - F.col("median")), 0.5).alias("mad"))
    j = j.join(spread, "family")
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    score = lambda x: F.round(F.abs(x - F.col("median")) / scale, 9)
    far = j.groupBy("family", "top", "period", "n").agg(F.count_if(score(F.col("s")) >= score(F.col("top"))).alias("far"))
    limit = F.when(universe_of(F.col("family")) == "PONCTUEL", one_off).otherwise(usual)
    p = rounded((1 + F.col("far")) / (1 + F.col("n")))
    return far.where((F.col("top") > limit) & (universe_of(F.col("family")) != "CUT_OFF")).select(*_signal("L2-CONC", F.col("period"), F.col("top"), limit, F.col("top") - limit, p, F.lit("conformal")))


def signals(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """All signals with raw score, severity, adjusted p-value (unknown ones count 1) and whether they stand."""
    every = reduce(DataFrame.unionByName, [sig_var(df, alpha), sig_discord(df), sig_missing(df), sig_conc(df)])
    adjusted = bh_adjust(every.withColumn("p", F.coalesce("p_value", F.lit(1.0))), "p", "id").drop("rank", "p")
    raw = F.least(F.lit(100.0), 50 * F.col("delta") / F.greatest("threshold", F.lit(0.01)))
    by_p = [(F.col("p_value") < t, s) for t, s in ((0.001, "CRITICAL"), (0.01, "HIGH"), (0.05, "MEDIUM"))]
    by_score = [(F.col("raw_score") >= t, s) for t, s in ((80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"))]
    level = F.when(F.col("p_value").isNotNull(), first_of(by_p, "LOW")).otherwise(first_of(by_score, "LOW"))
    return adjusted.withColumn("raw_score", rounded(F.greatest(raw, F.lit(0.0)), 3)).withColumns({"severity": level, "significant": F.col("p_adjusted") < alpha})


def materiality(s: DataFrame) -> DataFrame:
    """Amount at stake, threshold by universe and test, whether it is reached, and a score from 0 to 100."""
    dim = F.broadcast(s.sparkSession.createDataFrame([(u, t) for u, t, _ in UNIVERSES], "universe string, base double"))
    factor = first_of([(F.col("test") == t, f) for t, f in TEST_FACTORS.items()], 1.0)
    metric, delta, base = F.col("metric"), F.col("delta"), F.col("threshold")
    amount = first_of(
        [
            (metric > 100, F.abs(metric)), (F.col("test") == "L2-VAR", F.when(base > 0, F.abs(delta * base)).otherwise(F.abs(metric))), (F.col("test") == "L2-DISCORD", F.abs(metric)),
            (F.col("test") == "L2-MISSING", F.abs(metric * delta)), (F.col("test") == "L2-CONC", F.when(metric > 1, F.abs(metric)).otherwise(0.0)),
        ],
        F.greatest(F.abs(metric), F.abs(delta * base)),
    )
    j = s.join(dim, "universe", "left").withColumns({"amount": rounded(amount, 2), "limit": rounded(F.coalesce("base", F.lit(DEFAULT_THRESHOLD)) * factor, 2)})
    q = F.col("amount") / F.col("limit")
    score = F.when(q < 1, 50 * q).otherwise(F.least(50 + 50 * F.log10(1 + q) / F.log10(F.lit(11.0)), F.lit(100.0)))
    return j.select("id", "family", "universe", "test", "amount", "limit", (F.col("amount") >= F.col("limit")).alias("material"), rounded(score).alias("materiality_score"))


# Universe | share of the volume that is material | tolerated monthly variation.
CALIBRATION = [
    ("CRISTALLIN", 0.02, 0.05), ("NOMINATIF_TIERS", 0.05, 0.30), ("NOMINATIF_OPERATIONNEL", 0.05, 0.20), ("PROCESSUS", 0.03, 0.15), ("VENTILATION", 0.02, 0.10),
    ("CUT_OFF", 0.03, 0.50), ("TRESORERIE", 0.05, 0.50), ("PONCTUEL", 0.10, 1.00), ("INVENTAIRE", 0.05, 0.20), ("COMPOSITE", 0.08, 0.30),
]
FLOOR = 500.0


def calibrate(df: DataFrame, year: int) -> DataFrame:
    """Per family: variation of monthly nets, dead band (1.5 + 2 × variation), materiality (a share of the volume, 500 at least), tolerated variation."""
    v = F.abs("v")
    g = active_months(df, year, "prefix_3").groupBy(F.col("prefix_3").alias("family")).agg(ratio(F.stddev_pop(v), F.avg(v)).alias("cv"), F.sum(v).alias("volume"))
    dim = F.broadcast(df.sparkSession.createDataFrame(CALIBRATION, "universe string, share double, variation double"))
    j = g.withColumn("universe", universe_of(F.col("family"))).join(dim, "universe")
    return j.select("family", "universe", rounded(F.col("cv")).alias("cv"), rounded(1.5 + 2 * F.col("cv")).alias("dead_band"), rounded(F.greatest(F.col("volume") * F.col("share"), F.lit(FLOOR)), 3).alias("materiality"), "variation")


# Text in a family's list of exclusions | column of the metric's context that meets it.
LISTED = [("montant_rond", "is_round"), ("meme_montant_12_mois", "same_12"), ("label_identique", "repeated_label"), ("solde_zero", "zero_balance"), ("extourne_dans_delai", "reversed_in_time")]
BASE_BAND, BAND_PER_CV, USUAL_CV = 1.5, 2.0, 1.0


def make_signals(metrics: DataFrame, referential: DataFrame, test: str) -> DataFrame:
    """Signals of a universe test: threshold from the family's variation, what is above it, and which listed rules speak for and against.

    metrics: (family, period, site, metric, keywords array<string>, and a boolean for each
    context column of LISTED); referential: (family, cv, signal_if, no_signal_if), arrays of
    texts, one row a family; a family without one has the usual variation and no lists.
    """
    empty = F.array().cast("array<string>")
    j = metrics.join(referential.select("family", "cv", "signal_if", "no_signal_if"), "family", "left")
    threshold = rounded(BASE_BAND + BAND_PER_CV * F.coalesce("cv", F.lit(USUAL_CV)))
    meets = lambda text: first_of([(text.contains(t), F.coalesce(F.col(c), F.lit(False))) for t, c in LISTED], False)
    against = F.filter(F.coalesce("no_signal_if", empty), meets)
    speaks = lambda text: F.exists(F.coalesce("keywords", empty), lambda k: F.lower(text).contains(k))
    name = F.concat_ws("_", F.lit(test), "family", F.replace("period", F.lit("-"), F.lit("")), "site")
    return j.withColumn("threshold", threshold).select(
        name.alias("id"), "family", F.lit(test).alias("test"), "period", "site", "metric", "threshold", rounded(F.greatest(F.col("metric") - F.col("threshold"), F.lit(0.0))).alias("delta"),
        F.array_join(against, ",").alias("excluded_by"), F.array_join(F.filter(F.coalesce("signal_if", empty), speaks), ",").alias("supported_by"),
    )
