"""Regularity of (account, site) couples: entropies, ratios, and the composite index with its z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import correlation, first_of, number, ratio, rounded
from folio.functions.ranks import quantiles
from folio.functions.tables import written
from folio.operators.graph import sides

COUPLE = ["account", "site"]

# Universe | expected index | surprise threshold | weights of amounts, labels, time, journals, counterparties.
UNIVERSES = """
CRISTALLIN|0.10|0.15|0.25|0.00|0.35|0.20|0.20
NOMINATIF|0.20|0.20|0.30|0.00|0.25|0.20|0.25
INVENTAIRE|0.08|0.12|0.25|0.00|0.35|0.20|0.20
VENTILATION|0.30|0.25|0.25|0.15|0.20|0.20|0.20
COMPOSITE|0.65|0.15|0.20|0.25|0.15|0.20|0.20
NON_CLASSE|0.40|0.30|0.20|0.20|0.20|0.20|0.20
"""
UNIVERSE_ROWS = [(u, *map(float, rest)) for u, *rest in (line.split("|") for line in UNIVERSES.strip().splitlines())]

# Account families typical of a universe.
TYPICAL = {"CRISTALLIN": ["613", "616", "626"], "NOMINATIF": ["641", "706", "707"], "INVENTAIRE": ["681", "686", "281", "291"], "VENTILATION": ["791"], "COMPOSITE": ["618", "627", "471"]}

# Patterns of references to assets in upper-case labels.
ASSET_PATTERNS = (r"IMMO[\.:\-\s]?\d+", r"N[°O]?\s*\d{3,}", r"REF[\.:\-\s]?\d+", r"ACTIF\s*\d+", r"DOT\.\s*\d+")


def expected_universe(family: Column) -> Column:
    return first_of([(family.isin(*fs), u) for u, fs in TYPICAL.items()], "NON_CLASSE")


def _entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy in bits of each key's counts, with the number of distinct values."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("k"))


def monthly_volume(df: DataFrame) -> DataFrame:
    return df.groupBy(*COUPLE, "period").agg(number(F.sum(F.abs("amount"))).alias("v"))


def regularity(df: DataFrame) -> DataFrame:
    """1 less the variation of monthly volumes, a tenth more with 11 months, one half with one month."""
    g = monthly_volume(df).groupBy(*COUPLE).agg(F.count("*").alias("months"), ratio(F.stddev_pop("v"), F.avg("v")).alias("cv"))
    base = 1 - F.least(F.col("cv"), F.lit(1.0))
    return g.select(*COUPLE, "months", rounded(F.when(F.col("months") < 2, 0.5).when(F.col("months") >= 11, F.least(base + 0.1, F.lit(1.0))).otherwise(base)).alias("regularity"))


def cv_split(df: DataFrame) -> DataFrame:
    """Variation of amounts: total, between third parties, in time, and the rest. Nulls go with their amounts."""
    a = F.abs(number(F.col("amount")))
    rows = df.select(*COUPLE, a.alias("a"), "third_party", "period")
    base = rows.groupBy(*COUPLE).agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.stddev_pop("a").alias("sd"))
    third = rows.where("third_party IS NOT NULL").groupBy(*COUPLE, "third_party").agg(F.avg("a").alias("m")).groupBy(*COUPLE).agg(F.stddev_pop("m").alias("tsd"), F.count("*").alias("tn"))
    time = monthly_volume(df).groupBy(*COUPLE).agg(F.when(F.count("*") > 1, ratio(F.stddev_pop("v"), F.avg("v"))).otherwise(0.0).alias("t"))
    j = base.join(third, COUPLE, "left").join(time, COUPLE)
    some = F.col("n") >= 2
    total = F.when(some, ratio(F.col("sd"), F.col("mean"))).otherwise(0.0)
    between = F.when(some & (F.col("tn") > 1), ratio(F.col("tsd"), F.col("mean"))).otherwise(0.0)
    t = F.when(some, F.col("t")).otherwise(0.0)
    return j.select(*COUPLE, rounded(total).alias("cv_total"), rounded(between).alias("cv_third"), rounded(t).alias("cv_time"), rounded(F.greatest(total - between - t, F.lit(0.0))).alias("cv_rest"))


def token_entropy(df: DataFrame) -> DataFrame:
    """Entropy of label words of over 2 characters that aren't numbers: raw, over its maximum, distinct words."""
    labels = df.groupBy(*COUPLE, "label").agg(F.count("*").alias("n"))
    words = labels.select(*COUPLE, "n", F.explode(F.split(F.lower(F.trim("label")), r"\s+")).alias("w")).where(r"length(w) > 2 AND NOT w RLIKE '^\\d+$'")
    e = _entropy(words.groupBy(*COUPLE, "w").agg(F.sum("n").alias("n")), COUPLE)
    return e.select(*COUPLE, rounded(F.col("h")).alias("entropy_raw"), rounded(F.col("h") / F.when(F.col("k") > 1, F.log2("k")).otherwise(1.0)).alias("entropy_normalized"), F.col("k").alias("tokens"))


def temporal(df: DataFrame) -> DataFrame:
    """Variation and lag-one autocorrelation of monthly volumes, and a score from both; 0 with fewer than 3 months."""
    m = monthly_volume(df).withColumn("before", F.lag("v").over(Window.partitionBy(*COUPLE).orderBy("period")))
    g = m.groupBy(*COUPLE).agg(F.count("*").alias("months"), ratio(F.stddev_pop("v"), F.avg("v"), 1.0).alias("cv"), correlation("before", "v").alias("r"))
    r = F.when(F.isnan("r") | F.col("r").isNull(), 0.0).otherwise(F.col("r"))
    some = F.col("months") >= 3
    score = (1 - F.least(F.col("cv"), F.lit(2.0)) / 2) * 0.5 + (r + 1) / 2 * 0.5
    return g.select(*COUPLE, rounded(F.when(some, r).otherwise(0.0)).alias("autocorrelation"), rounded(F.when(some, F.col("cv")).otherwise(1.0)).alias("cv_month"), rounded(F.when(some, F.greatest(score, F.lit(0.0))).otherwise(0.0)).alias("time_score"))


def _herfindahl(counts: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.count("*").alias("k"), F.sum(F.col("p") * F.col("p")).alias("hhi"), F.max("p").alias("top"))


def journal_diversity(df: DataFrame) -> DataFrame:
    h = _herfindahl(df.groupBy(*COUPLE, "journal").agg(F.count("*").alias("n")), COUPLE)
    purity = first_of([(F.col("k") == 1, 1.0), (F.col("k") == 2, 0.7), (F.col("k") == 3, 0.4)], 0.1)
    return h.select(*COUPLE, F.col("k").alias("journals"), rounded(F.col("hhi")).alias("journal_hhi"), purity.alias("purity"))


def cp_concentration(df: DataFrame) -> DataFrame:
    """Concentration of the first counterparty (smallest opposite account of the voucher) of each line; 1 without any."""
    w = Window.partitionBy("voucher")
    of = lambda debited: F.when(F.col("debited") == debited, F.struct(F.col("account").isNull(), F.col("account").alias("cp")))
    first = F.when(F.col("debited"), F.min(of(False)).over(w)).otherwise(F.min(of(True)).over(w))
    own = sides(df, "site").where("debited IS NOT NULL").withColumn("first", first).where("first IS NOT NULL").withColumn("cp", F.col("first.cp")).groupBy(*COUPLE, "cp").agg(F.sum("lines").alias("n"))
    h = _herfindahl(own, COUPLE)
    j = df.select(*COUPLE).distinct().join(h, COUPLE, "left")
    return j.select(*COUPLE, F.coalesce("k", F.lit(0)).alias("counterparties"), rounded(F.coalesce("hhi", F.lit(1.0))).alias("cp_hhi"), rounded(F.coalesce("top", F.lit(1.0))).alias("cp_top"))


def icc(df: DataFrame) -> DataFrame:
    """Scores of the five axes and their weighted sum, 0 (amorphous) to 1 (crystalline), with family and expected universe."""
    parts = cv_split(df).join(token_entropy(df), COUPLE, "left").join(temporal(df), COUPLE).join(journal_diversity(df), COUPLE).join(cp_concentration(df), COUPLE)
    parts = parts.withColumn("family", F.substring("account", 1, 3)).withColumn("universe", expected_universe(F.col("family")))
    dim = F.broadcast(df.sparkSession.createDataFrame(UNIVERSE_ROWS, "universe string, expected double, threshold double, wa double, wl double, wt double, wj double, wc double"))
    j = parts.join(dim, "universe")
    sa, sl = 1 - F.least("cv_total", F.lit(2.0)) / 2, F.greatest(1 - F.coalesce("entropy_normalized", F.lit(0.0)), F.lit(0.0))
    index = F.round(F.least(F.greatest(F.col("wa") * sa + F.col("wl") * sl + F.col("wt") * F.col("time_score") + F.col("wj") * F.col("purity") + F.col("wc") * F.col("cp_hhi"), F.lit(0.0)), F.lit(1.0)), 6)
    level = first_of([(F.col("icc") >= 0.7, "crystalline"), (F.col("icc") >= 0.4, "vitreous")], "amorphous")
    return j.withColumn("icc", index).select(
        *COUPLE, "family", "universe", rounded(sa, 6).alias("amount_score"), rounded(sl).alias("label_score"), "time_score", "purity", "cp_hhi", "icc", level.alias("level"), "expected", "threshold"
    )


def icc_z(i: DataFrame) -> DataFrame:
    """z-score of the index within its family and within universe and family; groups of one get 0."""
    def z(*by: str) -> Column:
        w = Window.partitionBy(*by)
        return rounded(F.coalesce(F.try_divide(F.col("icc") - F.avg("icc").over(w), F.nullif(F.round(F.stddev_pop("icc").over(w), 9), F.lit(0.0))), F.lit(0.0)))

    return i.select(*COUPLE, "family", "universe", "icc", z("family").alias("z_family"), z("universe", "family").alias("z_universe_family"))


def icc_views(i: DataFrame) -> DataFrame:
    """Surprise of each couple against its universe's expected index, and whether it is an alert."""
    s = F.abs(F.col("icc") - F.col("expected"))
    return i.select(*COUPLE, "universe", "icc", rounded(s).alias("surprise"), (s > F.col("threshold")).alias("alert"))


def family_stats(i: DataFrame, least: int = 3) -> DataFrame:
    g = i.groupBy("family").agg(F.count("*").alias("couples"), rounded(F.avg("icc")).alias("mean"), rounded(F.stddev_pop("icc")).alias("std"), rounded(F.min("icc")).alias("min"), rounded(F.max("icc")).alias("max"))
    return g.where(F.col("couples") >= least)


AMORPHOUS, CRYSTALLINE = 0.4, 0.7


def icc_top(i: DataFrame, n: int = 20) -> DataFrame:
    """(view, rank, account, site, value): the n most amorphous, crystalline and surprising couples."""
    surprise = rounded(F.abs(F.col("icc") - F.col("expected")))
    views = [("amorphous", F.col("icc")), ("crystalline", -F.col("icc")), ("surprising", -surprise)]
    flat = i.select(*COUPLE, F.inline(F.array(*[F.struct(F.lit(v).alias("view"), key.alias("key"), (key if v == "amorphous" else -key).alias("value")) for v, key in views])))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("view").orderBy("key", *COUPLE)))
    return ranked.where(F.col("rank") <= n).select("view", "rank", *COUPLE, (F.col("value") + 0.0).alias("value"))


def heat_map(i: DataFrame) -> DataFrame:
    """(site, family, icc): the index of each site's family, that of its last account."""
    return i.where("site IS NOT NULL").groupBy("site", "family").agg(F.max_by("icc", "account").alias("icc"))


def icc_stats(i: DataFrame) -> DataFrame:
    """One row for each universe that has couples and one, ALL, for all: couples, mean, deviation and median of the index, crystalline, amorphous and surprising couples, families, sites."""
    # a row a couple, read twice
    i = written(i, "index")
    flat = i.select("*", F.explode(F.array(F.lit("ALL"), F.col("universe"))).alias("of"))
    middle = quantiles(flat, ["of"], F.col("icc"), [0.5]).select(F.col("of").alias("group"), rounded(F.get("q", F.lit(0)), 6).alias("median"))
    g = flat.groupBy("of").agg(
        F.count("*").alias("couples"), rounded(F.avg("icc")).alias("mean"), rounded(F.stddev_pop("icc")).alias("std"), F.count_if(F.col("icc") >= CRYSTALLINE).alias("crystalline"), F.count_if(F.col("icc") < AMORPHOUS).alias("amorphous"),
        F.count_if(F.abs(F.col("icc") - F.col("expected")) > F.col("threshold")).alias("surprising"), F.count_distinct("family").alias("families"), F.count_distinct("site").alias("sites"),
    )
    return g.join(middle, F.col("of") == F.col("group")).select(F.col("of").alias("universe"), "couples", "mean", "std", "median", "crystalline", "amorphous", "surprising", "families", "sites")


def family_z(i: DataFrame, least: int = 3, limit: float = -1.5) -> DataFrame:
    """(account, site, family, icc, z, alert): z-score within families of least couples or more, null in others, 0 where the deviation is below 0.01; alerts lie below the limit."""
    w = Window.partitionBy("family")
    sd = F.stddev_pop("icc").over(w)
    z = F.when(F.count("*").over(w) >= least, F.when(F.round(sd, 6) < 0.01, 0.0).otherwise(rounded((F.col("icc") - F.avg("icc").over(w)) / sd)))
    return i.select(*COUPLE, "family", "icc", z.alias("z")).withColumn("alert", F.coalesce(F.col("z") < limit, F.lit(False)))


def mahalanobis(i: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Distance of each couple's five scores from its family's mean; families are few rows each (couples, not lines)."""
    axes = ["amount_score", "label_score", "time_score", "purity", "cp_hhi"]

    def one(pdf):  # noqa: ANN001, ANN202
        import numpy as np

        x = pdf[axes].to_numpy(float)
        d = x - x.mean(axis=0)
        cov = (np.cov(x, rowvar=False) if len(x) > 1 else np.zeros((5, 5))) + ridge * np.eye(5)
        return pdf[[*COUPLE, "family"]].assign(distance=np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)).round(4))

    return i.groupBy("family").applyInPandas(one, "account string, site string, family string, distance double")

