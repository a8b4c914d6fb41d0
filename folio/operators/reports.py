"""Report tables: the comparison of two years and the passage table, ready to be written."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import first_of, rounded, total
from folio.functions.tables import written
from folio.operators import passage, qualify, runrate
from folio.operators.signals import UNIVERSES


def comparison_tables(df: DataFrame, year: int, before: int, top: int = 5) -> dict[str, DataFrame]:
    """Summary, reconciliation, provisions and anomalies, top changes per status, months."""
    bridge = runrate.bridge(df, year, before)
    by = bridge.groupBy("status", "account").agg(total(F.col("variation")).alias("variation"), F.count("*").alias("labels"))
    ranked = by.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.abs("variation").desc(), "account")))
    return {
        "summary": runrate.compare_years(df, year, before), "reconciliation": runrate.reconciliation(df, year, before), "findings": runrate.both_years(df, year, before),
        "drill_down": ranked.where(F.col("rank") <= top), "monthly": runrate.monthly_comparison(df, year),
    }


def passage_tables(df: DataFrame, year: int) -> dict[str, DataFrame]:
    """Synthesis, months with a TOTAL row, alerts, adjustments."""
    months = passage.passage_monthly(df, year)
    figures = [c for c in months.columns if c != "month"]
    monthly = months.rollup("month").agg(*[rounded(F.sum(c), 2).alias(c) for c in figures]).withColumn("month", F.coalesce(F.col("month").cast("string"), F.lit("TOTAL")))
    return {"synthesis": passage.passage_annual(df, year), "monthly": monthly, "alerts": passage.alerts(df, year), "adjustments": passage.adjustments(df, year)}


# Recommendations by level of the score, by weak universe, for the first anomaly; {0} anomalies, {1} amount.
URGENT = "URGENT: Mettre en place un plan d'action immédiat pour corriger les défaillances critiques."
SUPERVISE = "Renforcer les contrôles de supervision sur les écritures manuelles et exceptionnelles."
KEEP = "Maintenir le niveau de contrôle actuel et documenter les bonnes pratiques."
BY_UNIVERSE = [
    ("CUT_OFF", "Revoir les procédures de cut-off: {0} anomalie(s) détectée(s) pour une matérialité de {1}€."), ("PONCTUEL", "Renforcer la revue des opérations exceptionnelles: {0} écriture(s) à investiguer."),
    ("NOMINATIF_TIERS", "Analyser les écarts sur comptes auxiliaires: {0} anomalie(s) totalisant {1}€."), ("INVENTAIRE", "Vérifier les mouvements de stocks/immobilisations: {0} variation(s) anormale(s)."),
    ("CRISTALLIN", "Investiguer les charges fixes et récurrentes: {0} anomalie(s) détectée(s)."), ("NOMINATIF_OPERATIONNEL", "Investiguer les comptes de personnel et opérationnels: {0} anomalie(s) détectée(s)."),
    ("PROCESSUS", "Investiguer les processus d'achat et de vente: {0} anomalie(s) détectée(s)."), ("VENTILATION", "Investiguer les analytique et ventilation: {0} anomalie(s) détectée(s)."),
    ("TRESORERIE", "Investiguer les trésorerie et rapprochements: {0} anomalie(s) détectée(s)."), ("COMPOSITE", "Investiguer les écritures composites: {0} anomalie(s) détectée(s)."),
]
WEAK, STRONG, TO_MEND = 75, 90, 60


def whole(col: str) -> Column:
    """A number without decimals, thousands parted by commas."""
    return F.format_string("%,d", F.round(col).cast("long"))


def figure(col: Column) -> Column:
    """A double as money; where doubles no longer hold every hundredth, by its hundredfold, rounded, as the SQL casts it."""
    large = (F.round(col * 100).cast("long").cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")
    return F.when(F.abs(col) >= 2**53 / 100, large).otherwise(F.round(col, 2).cast("decimal(18,2)"))


def figure_of_product(col: Column) -> Column:
    """A double as money as DuckDB rounds it: the double nearest to its hundredfold, not its digits (70.475 is 70.47), and once more in the cast."""
    hundredfold = F.round(F.round(col * 100) / 100 * 100).cast("long")
    return (hundredfold.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def sums_in_order(i: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """(keys, anomalies, impact, amount, families) of impact()'s anomalies; doubles are added one by one, those last in order first.

    A sum of doubles hangs on its order, so an order that the shuffle leaves open gives other last digits each time.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = i.withColumns({"__n": F.count("*").over(w), **{f"__{c}": F.sum(c).over(w) for c in ("impact", "amount")}})
    return run.groupBy(*keys).agg(F.count("*").alias("anomalies"), *[F.max_by(f"__{c}", "__n").alias(c) for c in ("impact", "amount")], F.count_distinct("family").alias("families"))


def score_report(q: DataFrame) -> DataFrame:
    """(section, rank, name, value, text) of the report on qualify()'s anomalies: score, weak and strong universes, recommendations, first anomalies.

    Universes are few and of anomalies only the first are shown; at most 5 recommendations.
    """
    i = written(qualify.impact(q), "impact")
    universes, one = qualify.universe_scores(i), qualify.score(i)
    first = i.orderBy(F.desc("impact"), "id").limit(5).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("impact"), "id")))
    row = lambda df, section, rank, name, value, text: df.select(F.lit(section).alias("section"), rank.cast("int").alias("rank"), name.alias("name"), value.cast("double").alias("value"), text.alias("text"))
    low, high = Window.orderBy("score", "universe"), Window.orderBy(F.desc("score"), "universe")
    weak = universes.where((F.col("score") < WEAK) & (F.col("anomalies") > 0)).withColumn("rank", F.row_number().over(low)).where("rank <= 3")
    strong = universes.where(F.col("score") >= STRONG).withColumn("rank", F.row_number().over(high)).where("rank <= 3")
    dim = F.broadcast(q.sparkSession.createDataFrame(BY_UNIVERSE, "universe string, template string"))
    mend = universes.where((F.col("score") < TO_MEND) & (F.col("anomalies") > 0)).join(dim, "universe").withColumn("n", F.row_number().over(low)).where("n <= 3")
    said = F.replace(F.replace(F.col("template"), F.lit("{0}"), F.col("anomalies").cast("string")), F.lit("{1}"), whole("amount"))
    general = [(F.col("level") == "CRITIQUE", 1, URGENT), (F.col("level").isin("CRITIQUE", "ATTENTION"), 2, SUPERVISE), (F.col("level").isin("EXCELLENT", "BON"), 20, KEEP)]
    advice = one.select(F.inline(F.array(*[F.struct(F.when(cond, n).alias("n"), F.lit(text).alias("text")) for cond, n, text in general]))).where("n IS NOT NULL")
    advice = advice.unionByName(mend.select((F.col("n") + 2).alias("n"), said.alias("text")))
    top = first.where("rank = 1").select(F.lit(10).alias("n"), F.concat(F.lit("Priorité: Analyser l'anomalie ["), "family", F.lit("] "), "test", F.lit(", montant: "), whole("amount"), F.lit("€.")).alias("text"))
    advice = advice.unionByName(top).withColumn("rank", F.row_number().over(Window.orderBy("n"))).where("rank <= 5")
    no = F.lit("")
    parts = [
        row(one, "score", F.lit(1), F.col("level"), F.col("score"), F.col("top")), row(weak, "weak", F.col("rank"), F.col("universe"), F.col("score"), F.col("anomalies").cast("string")),
        row(strong, "strong", F.col("rank"), F.col("universe"), F.col("score"), F.col("anomalies").cast("string")), row(advice, "recommendation", F.col("rank"), no, F.lit(None), F.col("text")),
        row(first, "anomaly", F.col("rank"), F.col("id"), F.col("impact"), F.col("family")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_documents(q: DataFrame, keys: tuple[str, ...] = ("entity", "period"), order: tuple[str, ...] = ("id",), figure: Callable[[Column], Column] = figure) -> DataFrame:
    """(keys, document): for each group of qualify()'s anomalies its report as JSON, all groups in one pass.

    A document has the score and its level, the impact and amount, each universe's figures,
    the three weakest and strongest universes, up to five recommendations, and the five
    anomalies of most impact, all of the group. A group without anomalies has no document.

    order: columns by which impacts and amounts are summed up, the last first; ids end it, so that one order is left.
    figure: how doubles become money.
    """
    i = written(qualify.impact(q, tuple(keys), tuple(c for c in order if c != "id")), "impact")
    keys = list(keys)
    dim = F.broadcast(q.sparkSession.createDataFrame([(u,) for u, _, _ in UNIVERSES], "universe string"))
    sums = sums_in_order(i, [*keys, "universe"], order).drop("families")
    every = i.select(*keys).distinct().crossJoin(dim).join(sums, [*keys, "universe"], "left").fillna({"anomalies": 0, "impact": 0.0, "amount": 0.0})
    score_of = lambda t: rounded(F.greatest(100 - t, F.lit(0.0)), 3)
    templates = F.broadcast(q.sparkSession.createDataFrame(BY_UNIVERSE, "universe string, template string"))
    said = F.replace(F.replace(F.col("template"), F.lit("{0}"), F.col("anomalies").cast("string")), F.lit("{1}"), whole("amount"))
    parts = every.withColumn("score", score_of(F.col("impact"))).join(templates, "universe", "left").withColumn("advice", F.coalesce(said, F.lit("")))
    entry = F.struct("score", "universe", "anomalies", figure(F.col("impact")).alias("impact"), figure(F.col("amount")).alias("amount"), "advice")
    # ten universes a group
    universes = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("u"))
    most = Window.partitionBy(*keys).orderBy(F.desc("impact"), "id")
    first = i.withColumn("rank", F.row_number().over(most)).where("rank <= 5")
    shown = F.struct("rank", "id", "family", "test", "universe", figure(F.col("impact")).alias("impact"), figure(F.col("pertinence")).alias("pertinence"), figure(F.col("amount")).alias("amount"), whole("amount").alias("whole"))
    top = first.groupBy(*keys).agg(F.array_sort(F.collect_list(shown)).alias("t"))
    j = sums_in_order(i, keys, order).join(universes, keys).join(top, keys).withColumn("score", score_of(F.col("impact")))
    level = first_of([(F.col("score") >= t, name) for t, name in qualify.SCORE_LEVELS], "CRITIQUE")
    j = j.withColumn("level", level)
    brief = lambda rows: F.transform(rows, lambda x: F.struct(x["universe"].alias("universe"), figure(x["score"]).alias("score"), x["anomalies"].alias("anomalies")))
    weak = F.slice(F.filter("u", lambda x: (x["score"] < WEAK) & (x["anomalies"] > 0)), 1, 3)
    strong = F.slice(F.array_sort(F.transform(F.filter("u", lambda x: x["score"] >= STRONG), lambda x: F.struct((-x["score"]).alias("n"), x["universe"].alias("universe"), x["score"].alias("score"), x["anomalies"].alias("anomalies")))), 1, 3)
    mend = F.transform(F.slice(F.filter("u", lambda x: (x["score"] < TO_MEND) & (x["anomalies"] > 0) & (x["advice"] != "")), 1, 3), lambda x: x["advice"])
    t = F.get("t", F.lit(0))
    focus = F.concat(F.lit("Priorité: Analyser l'anomalie ["), t["family"], F.lit("] "), t["test"], F.lit(", montant: "), t["whole"], F.lit("€."))
    when = lambda text, *levels: F.when(F.col("level").isin(*levels), F.lit(text))
    advice = F.array_compact(F.concat(F.array(when(URGENT, "CRITIQUE"), when(SUPERVISE, "CRITIQUE", "ATTENTION")), mend, F.array(focus, when(KEEP, "EXCELLENT", "BON"))))
    document = F.struct(
        *keys, figure(F.col("score")).alias("score"), "level", "anomalies", figure(F.col("impact")).alias("impact"), figure(F.col("amount")).alias("amount"), "families",
        F.transform("u", lambda x: F.struct(x["universe"].alias("universe"), figure(x["score"]).alias("score"), x["anomalies"].alias("anomalies"), x["impact"].alias("impact"), x["amount"].alias("amount"))).alias("universes"),
        brief(weak).alias("weak"), brief(strong).alias("strong"), F.slice(advice, 1, 5).alias("recommendations"), F.transform("t", lambda x: x.dropFields("whole")).alias("top"),
    )
    return j.select(*keys, F.to_json(document).alias("document"))


def write_documents(documents: DataFrame, folder: str, keys: tuple[str, ...] = ("entity", "period")) -> None:
    """One folder for each group, with its document as a line of text."""
    documents.select(*keys, "document").write.mode("overwrite").partitionBy(*keys).text(folder)


def single_year_tables(df: DataFrame, year: int, columns: list[str]) -> dict[str, DataFrame]:
    """Summary, anomalies, accruals, notes and surprising couples of one year."""
    from folio.operators import crystallinity, detect, robust

    rows = detect.of_year(df, year)
    found, grade = detect.contextualize(df, year), robust.quality(rows, columns)
    all_ = detect.overall(found, detect.detection_summary(df, year), detect.accrual_risk(df, year), grade, rows)
    accruals = detect.accruals(df, year).select("accrual_type", "journal", "account", "label", "amount", "date", "confidence")
    summary = all_.crossJoin(rows.agg(F.count_distinct("account").alias("accounts"))).withColumn("year", F.lit(year))
    surprises = crystallinity.icc_views(crystallinity.icc(rows)).orderBy(F.desc("surprise"), "account", "site").limit(20)
    return {"summary": summary, "anomalies": found, "accruals": accruals, "notes": detect.recommendations(found), "surprises": surprises}


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).options(header=True).save(f"{folder}/{name}")
