"""Concentrations, round amounts, patterns, accruals and label content."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import any_of, contains_any, first_of, number, ratio, rounded, sum_if, total
from folio.functions.tables import written
from folio.operators.classify import accounts_of, classify_account
from folio.sources import dims

# Round amounts looked for, and the weight of a finding's severity.
ROUND_TARGETS = [(1000, "thousand"), (5000, "5k"), (10000, "10k"), (25000, "25k"), (50000, "50k"), (100000, "100k"), (250000, "250k"), (500000, "500k"), (1000000, "million")]
CONCENTRATION_WEIGHTS = {"CRITICAL": 0.25, "HIGH": 0.15, "MEDIUM": 0.08, "LOW": 0.03}
ROUND_WEIGHTS = {"HIGH": 0.10, "MEDIUM": 0.05, "LOW": 0.02}


def of_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.col("year") == year)


def severity(pct: Column) -> Column:
    return first_of([(pct > 90, "CRITICAL"), (pct > 70, "HIGH"), (pct > 50, "MEDIUM")], "LOW")


def _finding(kind: str, value: Column, amount: Column, pct: Column, level: Column, lines: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), value.alias("value"), amount.alias("amount"), rounded(pct).alias("pct"), level.alias("severity"), lines.alias("lines")]


def month_concentration(df: DataFrame, year: int, threshold: float = 50) -> DataFrame:
    m = of_year(df, year).groupBy("period").agg(F.abs(F.sum("amount")).alias("a"), F.count("*").alias("lines"))
    pct = ratio(F.col("a"), F.sum("a").over(Window.partitionBy())) * 100
    return m.withColumn("p", pct).where(F.col("p") > threshold).select(*_finding("month", F.col("period"), F.col("a"), F.col("p"), severity(F.col("p")), F.col("lines")))


def journal_concentration(df: DataFrame, year: int, threshold: float = 50) -> DataFrame:
    """Journals above the threshold (7 tenths of it for OD, AN, SIT), and the share of these journals in December above 40 %."""
    rows = of_year(df, year)
    od = F.upper("journal").isin("OD", "AN", "SIT")
    j = rows.groupBy("journal").agg(F.abs(F.sum("amount")).alias("a"), F.count("*").alias("lines"))
    j = j.withColumn("p", ratio(F.col("a"), F.sum("a").over(Window.partitionBy())) * 100).where(F.col("p") > F.when(od, 0.7 * threshold).otherwise(threshold))
    by_journal = j.select(*_finding("journal", F.col("journal"), F.col("a"), F.col("p"), severity(F.col("p")), F.col("lines")))
    dec = rows.where("month = 12").agg(F.count_if(od).alias("n"), F.count("*").alias("all"), sum_if(F.abs("amount"), od).alias("a")).withColumn("p", ratio(F.col("n"), F.col("all")) * 100).where("p > 40")
    return by_journal.unionByName(dec.select(*_finding("journal_december", F.lit("OD en décembre"), F.col("a"), F.col("p"), F.when(F.col("p") > 60, "HIGH").otherwise("MEDIUM"), F.col("n"))))


def account_concentration(df: DataFrame, year: int, minimum: float = 10_000, threshold: float = 80) -> DataFrame:
    """Months whose net is over the threshold of the account's volume."""
    rows = of_year(df, year)
    m = rows.groupBy("account", "period").agg(F.abs(F.sum("amount")).alias("a"), F.sum(F.abs("amount")).alias("v"), F.count("*").alias("lines"))
    m = m.withColumn("all", F.sum("v").over(Window.partitionBy("account"))).where(F.col("all") >= minimum).withColumn("p", ratio(F.col("a"), F.col("all")) * 100).where(F.col("p") > threshold)
    level = F.when(F.col("p") > 95, "CRITICAL").otherwise("HIGH")
    return m.select(*_finding("account", F.format_string("%s (%s)", "account", "period"), F.col("a"), F.col("p"), level, F.col("lines")))


def concentrations(df: DataFrame, year: int) -> DataFrame:
    return reduce(DataFrame.unionByName, [month_concentration(df, year), journal_concentration(df, year), account_concentration(df, year)])


def targets(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(ROUND_TARGETS, "target int, target_name string"))


def round_amounts(df: DataFrame, year: int, tolerance: float = 0.01, least: int = 2) -> DataFrame:
    """Lines within tolerance of a round target, by account and target, with up to three labels. Amounts are joined to nine targets."""
    rows = of_year(df, year)
    volume = rows.groupBy("account").agg(F.sum(F.abs("amount")).alias("volume"))
    a = F.abs("amount")
    near = (F.col("a") >= F.col("target") * (1 - tolerance)) & (F.col("a") <= F.col("target") * (1 + tolerance))
    # written, so that amounts meet the targets once
    hits = written(rows.groupBy("account", a.alias("a"), "label").agg(F.count("*").alias("n")).join(targets(df), near), "near")
    samples = first_few(hits.where("label IS NOT NULL"), ["account", "target"], "label", 3, "samples")
    found = hits.groupBy("account", "target", "target_name").agg(F.sum("n").alias("lines"), F.sum(F.col("a") * F.col("n")).alias("amount")).where(F.col("lines") >= least)
    j = found.join(volume, "account").join(samples, ["account", "target"], "left").withColumn("p", ratio(F.col("amount"), F.col("volume")) * 100)
    level = first_of([((F.col("p") > 50) | (F.col("lines") > 10), "HIGH"), ((F.col("p") > 30) | (F.col("lines") > 5), "MEDIUM")], "LOW")
    return j.select("account", "target", "target_name", "lines", number(F.col("amount")).alias("amount"), rounded(F.col("p")).alias("pct"), level.alias("severity"), F.coalesce("samples", F.lit("")).alias("samples"))


def repeated_amounts(df: DataFrame, year: int) -> DataFrame:
    """Signed amounts seen 3 times or more, over 1000, that aren't near a round target."""
    g = of_year(df, year).groupBy("amount").agg(F.count("*").alias("lines"), F.min("account").alias("account")).where((F.col("lines") >= 3) & (F.abs("amount") > 1000))
    near = F.abs(F.abs("amount") - F.col("target")) < F.col("target") * 0.01
    left = g.join(targets(df), near, "left_anti")
    return left.select("account", "amount", "lines", number(F.abs("amount") * F.col("lines")).alias("volume"), F.when(F.col("lines") > 5, "MEDIUM").otherwise("LOW").alias("severity"))


def detection_summary(df: DataFrame, year: int) -> DataFrame:
    """One row: findings by kind and the risk score, capped at 1."""
    weight = lambda table: first_of([(F.col("severity") == k, v) for k, v in table.items()], 0.0)
    c = concentrations(df, year).select("kind", weight(CONCENTRATION_WEIGHTS).alias("w"))
    r = round_amounts(df, year).select(F.lit("round").alias("kind"), weight(ROUND_WEIGHTS).alias("w"))
    p = repeated_amounts(df, year).select(F.lit("repeated").alias("kind"), weight(ROUND_WEIGHTS).alias("w"))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return reduce(DataFrame.unionByName, [c, r, p]).agg(
        n("month").alias("months"), n("journal", "journal_december").alias("journals"), n("account").alias("accounts"), n("round", "repeated").alias("round_amounts"), F.count("*").alias("findings"),
        rounded(F.least(F.coalesce(F.sum("w"), F.lit(0.0)), F.lit(1.0))).alias("risk"),
    )


def year_end_spikes(df: DataFrame, year: int, n: int = 5) -> DataFrame:
    """December over 5 times the eleventh of the other months and over 10 000; the first n accounts by amount."""
    s = of_year(df, year).groupBy("account").agg(F.abs(sum_if(F.col("amount"), F.col("month") == 12)).alias("december"), F.abs(sum_if(F.col("amount"), F.col("month") != 12)).alias("o"))
    s = s.withColumn("mean", number(F.col("o")) / 11).where((F.col("mean") > 0) & (F.col("december") > F.col("mean") * 5) & (F.col("december") > 10_000))
    q = number(F.col("december")) / F.col("mean")
    return s.select("account", "december", rounded(F.col("mean"), 2).alias("monthly_mean"), rounded(q).alias("ratio"), F.when(q > 10, "HIGH").otherwise("MEDIUM").alias("severity")).orderBy(F.desc("december"), "account").limit(n)


def round_numbers(df: DataFrame, year: int) -> DataFrame:
    """The five most frequent multiples of 10 000, when there are 3 or more lines over 50 000 in all."""
    a = F.abs("amount")
    rows = of_year(df, year).where((a >= 5000) & (a % 10_000 == 0)).groupBy(a.alias("value")).agg(F.count("*").alias("lines"))
    every = Window.partitionBy()
    sums = rows.withColumns({"all_lines": F.sum("lines").over(every), "all_amount": F.sum(F.col("value") * F.col("lines")).over(every)})
    return sums.where("all_lines >= 3 AND all_amount > 50000").orderBy(F.desc("lines"), F.desc("value")).limit(5).select("value", "lines", "all_lines", number(F.col("all_amount")).alias("all_amount"))


def class_concentration(df: DataFrame, year: int) -> DataFrame:
    """Per class 6 and 7, the largest account: its volume, share, and whether that is a finding (over 50 % and 100 000)."""
    s = of_year(df, year).where("class IN ('6', '7')").groupBy("class", "account").agg(F.sum(F.abs("amount")).alias("volume"))
    w = Window.partitionBy("class")
    s = s.withColumns({"all": F.sum("volume").over(w), "rn": F.row_number().over(w.orderBy(F.desc("volume"), "account"))}).where("rn = 1").withColumn("p", ratio(F.col("volume"), F.col("all")) * 100)
    return s.select("class", "account", "volume", F.col("all").alias("class_volume"), rounded(F.col("p")).alias("pct"), ((F.col("p") > 50) & (F.col("volume") > 100_000)).alias("found"), F.when(F.col("p") > 70, "HIGH").otherwise("MEDIUM").alias("severity"))


def ratio_anomalies(df: DataFrame, year: int) -> DataFrame:
    """Social charges to salaries (outside 0.30 to 0.70) and purchases to sales (over 0.85), both from 100 000 on."""
    v = lambda *p: sum_if(F.abs("amount"), F.col("prefix_3").isin(*p))
    s = of_year(df, year).agg(v("641", "642", "643").alias("salaries"), v("645", "646", "647").alias("social"), v("601", "602", "607").alias("purchases"), v("701", "702", "707").alias("sales"))
    row = lambda name, a, b, out: F.struct(F.lit(name).alias("ratio"), F.col(a).alias("numerator"), F.col(b).alias("denominator"), rounded(ratio(F.col(a), F.col(b))).alias("value"), ((F.col(b) > 100_000) & out(ratio(F.col(a), F.col(b)))).alias("found"))
    return s.select(F.inline(F.array(row("social_to_salaries", "social", "salaries", lambda x: (x < 0.30) | (x > 0.70)), row("purchases_to_sales", "purchases", "sales", lambda x: x > 0.85))))


def duplicate_amounts(df: DataFrame, year: int) -> DataFrame:
    """Of amounts over 1000 seen 5 times or more, the three most frequent, kept when over 5000."""
    g = of_year(df, year).groupBy(F.abs("amount").alias("value")).agg(F.count("*").alias("lines")).where("value > 1000 AND lines >= 5")
    return g.orderBy(F.desc("lines"), F.desc("value")).limit(3).where("value > 5000").select("value", "lines", number(F.col("value") * F.col("lines")).alias("volume"))


# Journals and keywords of accruals, with the weight of each keyword found.
ACCRUAL_JOURNALS = ("OD", "AN", "RAN", "SIT", "CLO", "INV", "JOD", "EXT", "REG")
ACCRUAL_KEYWORDS = [
    (0.15, "PROVISION", ["provision", "prov.", "dotation", "dot.", "reprise", "repr.", "amortissement", "amort.", "dépréciation", "depreciation"]),
    (
        0.12, None,
        ["régularisation", "regularisation", "regul", "rég.", "constaté d'avance", "constatée d'avance", "cca", "pca", "facture non parvenue", "fnp", "a recevoir", "à recevoir", "extourne", "contre-passation", "annulation"],
    ),
    (0.08, "INVENTAIRE", ["clôture", "cloture", "inventaire", "situation", "bilan", "arrêté", "arrete", "exercice"]),
    (0.10, "IMPOT", ["is ", "impôt", "impot", "taxe", "contribution", "cfe", "cvae", "cet"]),
]


def accrual_confidence(df: DataFrame) -> DataFrame:
    """Lines with accrual_type, confidence and the number of keywords found."""
    label, journal = F.lower(F.coalesce("label", F.lit(""))), F.upper("journal")
    p2, p3 = F.col("prefix_2"), F.col("prefix_3")
    account = [(p2.isin("68", "78"), 0.40, "PROVISION"), *[(p3 == k, 0.35, v) for k, v in dims.ACCRUAL_ACCOUNTS.items()], (p2 == "28", 0.35, "AMORTISSEMENT"), (p3.isin("695", "696", "699"), 0.35, "IMPOT")]
    score, kinds, found = F.lit(0.0), [(c, t) for c, _, t in account], F.lit(0)
    for weight, kind, words in ACCRUAL_KEYWORDS:
        n = reduce(lambda a, b: a + b, [F.when(label.contains(w), 1).otherwise(0) for w in words])
        score, found = score + weight * n, found + n
        if kind:
            kinds.append((n > 0, kind))
    base = first_of([(c, w) for c, w, _ in account], 0.0) + F.when(journal.isin(*ACCRUAL_JOURNALS), 0.25).otherwise(0.0) + F.least(score, F.lit(0.35)) + F.when(F.col("month") == 12, 0.10).otherwise(0.0)
    return df.withColumns({"accrual_type": first_of(kinds, "AUTRE"), "confidence": F.round(F.least(base, F.lit(1.0)), 4), "keywords": found})


def accruals(df: DataFrame, year: int, least: float = 0.25) -> DataFrame:
    return accrual_confidence(of_year(df, year)).where(F.col("confidence") >= least)


def journal_kind(journal: Column) -> Column:
    """Type by fixed parts of the code, the first that fits."""
    j = F.upper(journal)
    parts = [("achat", ["AC", "HA", "FOU"]), ("vente", ["VE", "VT", "CLI"]), ("banque", ["BQ", "BAN"]), ("caisse", ["CA", "CAI"]), ("paie", ["PA", "SAL"])]
    return first_of([(j.isin(*ACCRUAL_JOURNALS), "od"), *[(contains_any(j, ws), t) for t, ws in parts]], "autre")


def journal_screen(df: DataFrame, year: int) -> DataFrame:
    """Type, volume, shares, accruals of each journal; suspect: adjusting and over half in December."""
    rows = accrual_confidence(of_year(df, year))
    g = rows.groupBy("journal").agg(F.count("*").alias("lines"), F.sum(F.abs("amount")).alias("volume"), (F.avg((F.col("month") == 12).cast("int")) * 100).alias("d"), F.count_if(F.col("confidence") >= 0.25).alias("accruals"))
    share = ratio(F.col("lines"), F.sum("lines").over(Window.partitionBy())) * 100
    kind = journal_kind(F.col("journal"))
    return g.select("journal", kind.alias("journal_type"), "lines", "volume", rounded(F.col("d")).alias("december_pct"), rounded(share).alias("total_pct"), "accruals", ((kind == "od") & (F.col("d") > 50)).alias("suspect"))


def accrual_analysis(df: DataFrame, year: int) -> DataFrame:
    """By accrual type: lines, net impact, lines of December; of all lines, the share that are accruals."""
    a = accruals(df, year)
    return a.groupBy("accrual_type").agg(F.count("*").alias("lines"), total(F.col("amount")).alias("net"), F.count_if(F.col("month") == 12).alias("december_lines"), rounded(F.avg("confidence")).alias("mean_confidence"))


def accrual_risk(df: DataFrame, year: int) -> DataFrame:
    """One row: lines, accruals, net impact, suspect journals, certain accruals, and a risk from 0 to 1."""
    rows = accrual_confidence(of_year(df, year))
    kept = F.col("confidence") >= 0.25
    g = rows.agg(F.count("*").alias("lines"), F.count_if(kept).alias("accruals"), sum_if(F.col("amount"), kept).alias("impact"), F.count_if(F.col("confidence") > 0.7).alias("certain"))
    j = journal_screen(df, year).agg(F.count_if("suspect").alias("suspect_journals"))
    risk = F.least(2 * ratio(F.col("accruals"), F.col("lines")), F.lit(0.3)) + 0.15 * F.col("suspect_journals") + F.when(F.col("certain") > 10, 0.2).otherwise(0.0)
    return g.crossJoin(j).withColumn("risk", rounded(F.least(risk, F.lit(1.0))))


# Account prefixes whose entries come at the year's end anyway, and categories of the chart with round amounts.
ALLOWANCES, ACCRUAL_BALANCES, ROUND_CATEGORIES = ["68", "78"], ["486", "487", "408", "418", "428", "438", "448"], ["dotations", "reprises", "is", "taxes"]
MOST_ACCRUALS = 50
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def contextualize(df: DataFrame, year: int, threshold: float = 80, most: int = MOST_ACCRUALS) -> DataFrame:
    """Concentrated accounts, round amounts and the most certain accruals with what the chart says: expected or not, severity, what to do."""
    rows = of_year(df, year)
    chart = classify_account(accounts_of(rows))
    a2, a3, first = F.substring("account", 1, 2), F.substring("account", 1, 3), F.substring("account", 1, 1)

    c = account_concentration(df, year, threshold=threshold).select(F.regexp_extract("value", r"^(\d{5,})", 1).alias("account"), "amount", "pct").where("account != ''").join(chart, "account")
    usual = [
        (first.isin("1", "2"), "CONCENTRATION_EXPLIQUEE"), (a2.isin(*ALLOWANCES), "PROVISION_NORMALE"), (a3.isin(*ACCRUAL_BALANCES), "REGULARISATION_NORMALE"), (F.col("behavior") == "regularisation", "REGULARISATION_NORMALE"),
        (F.col("is_provision"), "PROVISION_NORMALE"), (F.col("frequency").isin("annuelle", "exceptionnelle"), "CONCENTRATION_EXPLIQUEE"),
    ]
    c = c.withColumn("category", first_of(usual, "CONCENTRATION_ANORMALE")).withColumn("expected", F.col("category") != "CONCENTRATION_ANORMALE")
    advice = first_of([(F.col("expected"), ""), (F.col("pct") > 80, "Vérifier si provision ou régularisation justifiée")], "Analyser la nature des écritures concentrées")
    c = c.select("account", F.lit("concentration").alias("kind"), "category", number(F.col("amount")).alias("amount"), "pct", "expected", first_of([(F.col("expected"), "LOW"), (F.col("pct") > 90, "HIGH")], "MEDIUM").alias("severity"), advice.alias("recommendation"))

    r = round_amounts(df, year).select("account", "target", "amount", "pct").join(chart, "account").withColumn("expected", F.coalesce(F.col("category").isin(*ROUND_CATEGORIES), F.lit(False)))
    r = r.select("account", F.lit("round_amount").alias("kind"), F.when(F.col("expected"), "MONTANT_ROND_JUSTIFIE").otherwise("MONTANT_ROND_SUSPECT").alias("category"), "amount", "pct", "expected",
                 F.when(F.col("expected"), "LOW").otherwise("MEDIUM").alias("severity"), F.when(F.col("expected"), "").otherwise("Vérifier la nature des écritures").alias("recommendation"))

    # equal lines are alike in every column that is shown, so it doesn't matter which of them are among the first
    g = accruals(df, year).orderBy(F.desc("confidence"), F.desc(F.abs("amount")), "voucher", "account", "accrual_type").limit(most).join(F.broadcast(chart.select("account", "is_typical_accrual")), "account")
    g = g.select("account", F.lower("accrual_type").alias("kind"), F.when(F.col("is_typical_accrual"), "REGULARISATION_NORMALE").otherwise("REGULARISATION_EXCESSIVE").alias("category"), number(F.col("amount")).alias("amount"),
                 rounded(F.col("confidence") * 100).alias("pct"), F.col("is_typical_accrual").alias("expected"), F.when(F.col("is_typical_accrual"), "LOW").otherwise("MEDIUM").alias("severity"), F.lit("").alias("recommendation"))
    return reduce(DataFrame.unionByName, [c, r, g])


# Grade of the data | what it takes from confidence.
GRADE_PENALTY = {"A": 0.0, "B": 0.1, "C": 0.2, "D": 0.4}


def overall(found: DataFrame, detection: DataFrame, accrual: DataFrame, grade: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: risk of the whole (detections, accruals, share of unexpected findings), confidence in it, findings, whether a warning is due.

    found: contextualize(); detection: detection_summary(); accrual: accrual_risk(); grade:
    quality(); lines: the ledger's lines.
    """
    f = found.agg(F.count("*").alias("findings"), F.count_if("expected").alias("expected"), F.count_if(~F.col("expected") & F.col("severity").isin("HIGH", "CRITICAL")).alias("unexplained"))
    j = f.crossJoin(detection.select(F.col("risk").alias("d"))).crossJoin(accrual.select(F.col("risk").alias("a"))).crossJoin(grade.select("grade")).crossJoin(lines.agg(F.count("*").alias("lines")))
    odd = ratio(F.col("findings") - F.col("expected"), F.col("findings"))
    risk = rounded(F.least(0.3 * F.col("d") + 0.3 * F.col("a") + 0.4 * odd, F.lit(1.0)))
    penalty = first_of([(F.col("grade") == g, v) for g, v in GRADE_PENALTY.items()], 0.3)
    confidence = rounded(F.greatest(1 - penalty - F.when(F.col("lines") < 1000, 0.1).otherwise(0.0), F.lit(0.1)))
    advice = first_of([(F.col("risk") > 0.7, "Risque élevé: audit approfondi recommandé"), (F.col("risk") > 0.4, "Risque modéré: vérifier les anomalies prioritaires")], "")
    return j.withColumn("risk", risk).select("risk", confidence.alias("confidence"), "lines", "findings", "expected", (F.col("findings") - F.col("expected")).alias("suspect"), "unexplained", "grade", advice.alias("advice"))


def recommendations(found: DataFrame, most: int = 10) -> DataFrame:
    """Distinct recommendations of unexpected findings, the gravest first, at most most of them."""
    order = first_of([(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)], len(SEVERITIES))
    g = found.where("recommendation != ''").groupBy("recommendation").agg(F.min(order).alias("order"), F.count("*").alias("findings"))
    return g.orderBy("order", F.desc("findings"), "recommendation").limit(most).select("recommendation", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("order") + 1).alias("severity"), "findings")


# Patterns searched in lower-cased labels, by group and category. A word
# boundary is written so that accented letters count as letters in every engine.
B, E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
PATTERNS = {
    "REGUL": {
        "REGUL": [f"{B}regul", f"{B}régul", "regularisation", "régularisation"],
        "EXTOURNE": ["extourne", "contre.?passation", "annulation"],
        "REPRISE": [f"{B}reprise{E}", "reprise provision", "reprise de provision"],
        "PROVISION": [f"{B}provision{E}", f"{B}dotation{E}", f"{B}prov{E}"],
        "FNP": [f"{B}fnp{E}", "facture.?non.?parvenue", "fact.*non.*parv"],
        "CCA": [f"{B}cca{E}", "charge.*constat.*avance", "charge.*d'avance"],
        "FAE": [f"{B}fae{E}", "facture.*à.*établir"],
        "A_NOUVEAU": ["à.?nouveau", "a.?nouveau", f"{B}an{E}", "report"],
    },
    "EXCEPTIONNEL": {
        "EXCEPTIONNEL": ["exceptionnel", "exception"],
        "DEGREVEMENT": ["dégrèvement", "degrevement", "dégrev"],
        "CONTENTIEUX": ["contentieux", "litige", "procès"],
        "AMENDE": ["amende", "pénalité", "penalite"],
        "CESSION": ["cession", "vente.*immob"],
        "RAPPEL": ["rappel", "arriéré", "arriere"],
        "REMBOURSEMENT": ["remboursement", "rembours"],
    },
    "RECURRENT": {
        "LOYER": [f"{B}loyer{E}", "location", "bail"],
        "SALAIRE": ["salaire", "paie", "remuneration"],
        "ASSURANCE": ["assurance", "prime.*assur"],
        "ENERGIE": ["électricité", "electricite", "gaz", "energie"],
        "TELECOM": ["téléphone", "telephone", "internet", "telecom"],
        "ABONNEMENT": ["abonnement", "abonn"],
    },
}
OD_JOURNALS = ("OD", "AN", "RAN", "EXT", "EXTOURNE")
CLOSING_JOURNALS = ("SIT", "SITUATION", "CLO", "CLOTURE", "BILAN", "BIL")


def has(low: Column, pattern: str) -> Column:
    """Whether a lower-case text has the pattern; its fixed parts are looked for first, as that is far cheaper."""
    core = pattern.removeprefix(B).removesuffix(E)
    parts = [low.contains(part) for part in re.split(r"\.[?*]", core)]
    fixed = reduce(lambda x, y: x & y, parts)
    return fixed if core == pattern and len(parts) == 1 else fixed & low.rlike(pattern)


def categories(low: Column, wanted: Callable[[str, str], bool] = lambda group, category: True) -> Column:
    """Array of the (wanted) categories whose patterns a lower-case label has."""
    found = [F.when(any_of(has(low, p) for p in ps), F.struct(F.lit(g).alias("pattern_group"), F.lit(c).alias("category"))) for g, cs in PATTERNS.items() for c, ps in cs.items() if wanted(g, c)]
    return F.array_compact(F.array(*found))


def lowered(df: DataFrame) -> DataFrame:
    return df.withColumn("low", F.lower(F.coalesce("label", F.lit(""))))


def first_few(df: DataFrame, keys: list[str], col: str, n: int, name: str) -> DataFrame:
    """(keys, name): the n first values of col by key in their order, joined by |."""
    few = df.select(*keys, col).distinct().withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(col))).where(F.col("rn") <= n)
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(col)), "|").alias(name))


def is_od(journal: Column) -> Column:
    return contains_any(F.upper(F.coalesce(journal, F.lit(""))), (*OD_JOURNALS, *CLOSING_JOURNALS))


def journals(df: DataFrame, year: int) -> DataFrame:
    """Entries, totals, accounts, flags and the five largest accounts by net amount of each journal."""
    rows = of_year(df, year)
    g = rows.groupBy("journal").agg(F.count("*").alias("lines"), total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"), F.count_distinct("account").alias("accounts"))
    net = rows.groupBy("journal", "account").agg(F.abs(F.sum("amount")).alias("net")).withColumn("rn", F.row_number().over(Window.partitionBy("journal").orderBy(F.desc("net"), "account"))).where("rn <= 5")
    top = net.groupBy("journal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "account"))), lambda x: x["account"]), ",").alias("top_accounts"))
    j = F.upper("journal")
    return g.join(top, "journal").withColumns({"is_od": contains_any(j, OD_JOURNALS), "is_closing": contains_any(j, CLOSING_JOURNALS)})


def journal_months(df: DataFrame, year: int) -> DataFrame:
    """Lines of each journal and month, and their share of the journal's."""
    g = of_year(df, year).groupBy("journal", "month").agg(F.count("*").alias("lines"))
    return g.withColumn("pct", rounded(F.col("lines") / F.sum("lines").over(Window.partitionBy("journal")) * 100))


def label_patterns(df: DataFrame, year: int) -> DataFrame:
    """Hits, totals, up to ten accounts and five labels of each category, the first in their order.

    Patterns are searched once per label and account.
    """
    rows = of_year(df, year).groupBy("label", "account").agg(F.count("*").alias("n"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    found = lowered(rows).withColumn("c", F.explode(categories(F.col("low")))).select("c.*", "label", "account", "n", "debit", "credit")
    keys = ["pattern_group", "category"]
    sums = found.groupBy(*keys).agg(F.sum("n").alias("hits"), total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"))
    return sums.join(first_few(found, keys, "account", 10, "accounts"), keys).join(first_few(found, keys, "label", 5, "examples"), keys)


def account_content(df: DataFrame, year: int) -> DataFrame:
    """For every account: volume, largest journal, share of adjusting journals, categorized lines, first category, lines from 5000 on, up to 20 labels."""
    rows = of_year(df, year).withColumn("v", F.abs("amount"))
    j = rows.groupBy("account", "journal").agg(F.sum("v").alias("v"), F.sum(F.when(is_od(F.col("journal")), F.col("v")).otherwise(0)).alias("od"))
    by = j.groupBy("account").agg(F.sum("v").alias("volume"), F.max_by("journal", F.struct("v", "journal")).alias("main_journal"), rounded(ratio(F.sum("od"), F.sum("v")) * 100).alias("od_pct"))
    labels = rows.groupBy("account", "label").agg(F.count("*").alias("n"), F.count_if(F.col("v") >= 5000).alias("large"))
    found = lowered(labels).withColumn("first", F.get(categories(F.col("low")), F.lit(0))["category"])
    c = found.groupBy("account").agg(F.coalesce(F.sum(F.when(F.col("first").isNotNull(), F.col("n"))), F.lit(0)).alias("categorized"), F.sum("large").alias("large_lines"), F.count("label").alias("labels"), F.min("first").alias("first_category"))
    return by.join(c, "account").join(first_few(labels, ["account"], "label", 20, "first_labels"), "account")


def od_concentration(df: DataFrame, year: int) -> DataFrame:
    """For each of 12 months: lines, lines and volume of adjusting journals, their share."""
    v, od = F.abs("amount"), is_od(F.col("journal"))
    g = of_year(df, year).groupBy("month").agg(F.count("*").alias("n"), F.count_if(od).alias("k"), total(v).alias("v"), sum_if(v, od).alias("w"))
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return months.join(g, "month", "left").select("month", zero("n").alias("lines"), zero("k").alias("od_lines"), number(zero("v")).alias("volume"), number(zero("w")).alias("od_volume"), rounded(ratio(zero("w"), zero("v")) * 100).alias("od_pct"))


def accrual_entries(df: DataFrame, year: int) -> DataFrame:
    """Lines of accrual categories, of tax relief or refunds, or of adjusting journals."""
    hit = categories(F.col("low"), lambda g, c: g == "REGUL" or c in ("DEGREVEMENT", "REMBOURSEMENT"))
    return lowered(of_year(df, year)).where(is_od(F.col("journal")) | (F.size(hit) > 0)).drop("low")


def content_summary(df: DataFrame, year: int) -> DataFrame:
    """One row: journals, adjusting ones, categories found, accrual lines, December's adjusting share."""
    j = journals(df, year).agg(F.count("*").alias("journals"), F.count_if("is_od").alias("od_journals"))
    p = label_patterns(df, year).agg(F.count("*").alias("categories"))
    a = accrual_entries(df, year).agg(F.count("*").alias("accrual_lines"))
    d = od_concentration(df, year).where("month = 12").select(F.col("od_pct").alias("december_od_pct"))
    return j.crossJoin(p).crossJoin(a).crossJoin(d)
