"""Combined risk of ledger lines from the digit law, outlier models and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import correlation, first_of, number, rounded
from folio.functions.tables import written
from folio.operators import digits, labels, models

# Weight of each model; those that didn't run share theirs out.
WEIGHTS = {"benford": 0.15, "isolation": 0.20, "reconstruction": 0.20, "nlp": 0.20, "boosted": 0.25}
LEVELS = [(80, "CRITIQUE"), (60, "ELEVE"), (40, "MODERE"), (20, "FAIBLE")]


def combined(scores: DataFrame, active: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """scores with each active column brought to 0-100 over its range (a constant one to 50), their
    weighted sum over the active weights, its level, and the model that adds most (first on ties)."""
    weights = weights or WEIGHTS
    all_ = sum(weights[c] for c in active)
    ends = F.broadcast(scores.agg(*[F.min(c).alias(f"lo_{c}") for c in active], *[F.max(c).alias(f"hi_{c}") for c in active]))
    scaled = lambda c: F.coalesce(F.try_divide((F.col(c) - F.col(f"lo_{c}")) * 100, F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))), F.lit(50.0))
    j = scores.crossJoin(ends).withColumns({c: rounded(scaled(c)) for c in active}).drop(*[f"{p}_{c}" for p in ("lo", "hi") for c in active])
    part = {c: F.col(c) * (weights[c] / all_) for c in active}
    final: Column = sum(list(part.values())[1:], next(iter(part.values())))
    top = F.greatest(*part.values()) if len(active) > 1 else part[active[0]]
    return j.withColumn("risk", rounded(final)).withColumns({"level": first_of([(F.col("risk") >= t, n) for t, n in LEVELS], "MINIMAL"), "top_factor": first_of([(part[c] == top, c) for c in active])})


MODELS = ["benford", "isolation", "reconstruction", "nlp"]
EXPLAIN_OVER = 60


def line_risk(df: DataFrame, keep: tuple[str, ...] = ("date", "account", "voucher", "label", "amount")) -> DataFrame:
    """Lines with their combined risk from digits, isolation forest, reconstruction and label keywords.

    keep: columns of the ledger to keep. Both models are applied in one pass, and of lines only what is kept is written, once.
    """
    odd = F.broadcast(digits.benford(df).where("place = 1").select("digit", F.greatest(number(F.col("z")), F.lit(0.0)).alias("benford")))
    # written, so that its size is known, and before the filter, which would be asked of each line; what has no keyword counts 0
    said = written(labels.keyword_score(df).select("label", number(F.col("keyword_score")).alias("nlp")), "keywords").where("nlp <> 0")
    said = F.broadcast(said) if said.count() <= models.SENT else said
    lines = models.features(df)
    forest, parts = models.isolation_scores(lines), models.components(lines)

    def make() -> models.Scores:
        score, project = forest(), parts()
        return lambda x: np.column_stack([score(x), project(x)[:, :1]])

    rows = models.applied(lines, "__m", ["isolation", "reconstruction"], make).withColumn("digit", digits.digit(F.col("amount"), 1))
    rows = rows.join(odd, "digit", "left").join(said, "label", "left")
    made = rows.select(*keep, F.coalesce("benford", F.lit(0.0)).alias("benford"), F.col("__m.isolation").alias("isolation"), rounded(F.col("__m.reconstruction")).alias("reconstruction"), F.coalesce("nlp", F.lit(0.0)).alias("nlp"))
    return combined(written(made, "parts"), MODELS)


def risk_views(scored: DataFrame, active: list[str], level: str | None = None, least: float | None = None, top: int | None = None) -> DataFrame:
    """Lines of a level or of at least a risk, the top ones by risk, each with the models that explain it (over 60, the largest first)."""
    kept = scored
    if level is not None:
        kept = kept.where(F.col("level") == level)
    if least is not None:
        kept = kept.where(F.col("risk") >= least)
    why = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) > EXPLAIN_OVER, F.struct((-F.col(c)).alias("neg"), F.lit(c).alias("model"))) for c in active])))
    shown = kept.withColumn("explanation", F.array_join(F.transform(why, lambda x: x["model"]), ","))
    return shown.orderBy(F.desc("risk"), "date", "voucher", "account", "label").limit(top) if top else shown


def risk_summary(scored: DataFrame, active: list[str]) -> DataFrame:
    """One row: lines, mean, median and deviation of the risk, lines per level, correlation of each model with it."""
    level = [F.count_if(F.col("level") == n).alias(n.lower()) for _, n in [*LEVELS, (0, "MINIMAL")]]
    return scored.agg(F.count("*").alias("lines"), rounded(F.avg("risk")).alias("mean"), rounded(F.percentile_approx("risk", 0.5, models.ACCURACY)).alias("median"), rounded(F.stddev_samp("risk")).alias("std"), *level, *[rounded(correlation(c, "risk")).alias(f"corr_{c}") for c in active])
