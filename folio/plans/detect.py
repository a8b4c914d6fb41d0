"""Queries of the detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import detect as o
from folio.operators import robust
from folio.plans.classification import CLASSIFIED
from folio.plans.registry import YEAR, case, in_list, query, r, values
from folio.sources import dims


def pnl(led: DataFrame) -> DataFrame:
    """P&L lines: over all lines, which balance, every net is zero."""
    return led.where("class IN ('6', '7')")


Y = f"y AS (SELECT * FROM ledger WHERE year = {YEAR})"
SEV = "CASE WHEN p > 90 THEN 'CRITICAL' WHEN p > 70 THEN 'HIGH' WHEN p > 50 THEN 'MEDIUM' ELSE 'LOW' END"
CON = f"""y AS (SELECT * FROM ledger WHERE year = {YEAR} AND class IN ('6', '7')),
mc AS (SELECT 'month' AS kind, period AS value, a AS amount, {r('p')} AS pct, {SEV} AS severity, lines FROM (SELECT *, coalesce(CAST(a AS DOUBLE) / nullif(CAST(sum(a) OVER () AS DOUBLE), 0), 0) * 100 AS p FROM (SELECT period, abs(sum(amount)) AS a, count(*) AS lines FROM y GROUP BY period)) WHERE p > 50),
jc AS (SELECT 'journal' AS kind, journal AS value, a AS amount, {r('p')} AS pct, {SEV} AS severity, lines FROM (SELECT *, coalesce(CAST(a AS DOUBLE) / nullif(CAST(sum(a) OVER () AS DOUBLE), 0), 0) * 100 AS p FROM (SELECT journal, abs(sum(amount)) AS a, count(*) AS lines FROM y GROUP BY journal))
  WHERE p > CASE WHEN upper(journal) IN ('OD', 'AN', 'SIT') THEN 35 ELSE 50 END
  UNION ALL SELECT 'journal_december', 'OD en décembre', a, {r('p')}, CASE WHEN p > 60 THEN 'HIGH' ELSE 'MEDIUM' END, n FROM (SELECT *, n / al * 100 AS p FROM (SELECT count(*) FILTER (journal IN ('OD', 'AN', 'SIT')) AS n, count(*) AS al, coalesce(sum(abs(amount)) FILTER (journal IN ('OD', 'AN', 'SIT')), 0) AS a FROM y WHERE month = 12)) WHERE p > 40),
ac AS (SELECT 'account' AS kind, account || ' (' || period || ')' AS value, a AS amount, {r('p')} AS pct, CASE WHEN p > 95 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, lines FROM
  (SELECT *, CAST(a AS DOUBLE) / CAST(al AS DOUBLE) * 100 AS p FROM (SELECT *, sum(v) OVER (PARTITION BY account) AS al FROM (SELECT account, period, abs(sum(amount)) AS a, sum(abs(amount)) AS v, count(*) AS lines FROM y GROUP BY ALL))) WHERE al >= 10000 AND p > 80),
{values('tg', 'target, target_name', o.ROUND_TARGETS)},
rd AS (SELECT account, target, target_name, lines, CAST(amount AS DOUBLE) AS amount, {r('p')} AS pct, CASE WHEN p > 50 OR lines > 10 THEN 'HIGH' WHEN p > 30 OR lines > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM
  (SELECT *, CAST(amount AS DOUBLE) / CAST(volume AS DOUBLE) * 100 AS p FROM (SELECT account, target, target_name, count(*) AS lines, sum(abs(amount)) AS amount FROM y JOIN tg ON abs(amount) >= target * 0.99 AND abs(amount) <= target * 1.01 GROUP BY ALL)
  JOIN (SELECT account, sum(abs(amount)) AS volume FROM y GROUP BY account) USING (account) WHERE lines >= 2)),
rp AS (SELECT account, amount, lines, CAST(abs(amount) * lines AS DOUBLE) AS volume, CASE WHEN lines > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT amount, count(*) AS lines, min(account) AS account FROM y GROUP BY amount)
  WHERE lines >= 3 AND abs(amount) > 1000 AND NOT EXISTS (SELECT 1 FROM tg WHERE abs(abs(amount) - target) < target * 0.01))"""
query("con01_month", "SELECT * FROM mc", CON.replace("GROUP BY period)) WHERE p > 50)", "GROUP BY period)) WHERE p > 5)"))(lambda led: o.month_concentration(pnl(led), YEAR, 5))
query("con02_journal", "SELECT * FROM jc", CON)(lambda led: o.journal_concentration(pnl(led), YEAR))
query("con03_account", "SELECT * FROM ac", CON.replace("al >= 10000 AND p > 80", "al >= 10000 AND p > 8"))(lambda led: o.account_concentration(pnl(led), YEAR, threshold=8))
query(
    "con04_round_amounts",
    "SELECT rd.*, coalesce(samples, '') AS samples FROM rd LEFT JOIN (SELECT account, target, array_to_string(list_sort(list(DISTINCT label))[1:3], '|') AS samples FROM y JOIN tg ON abs(amount) >= target * 0.99 AND abs(amount) <= target * 1.01 GROUP BY ALL) USING (account, target)", CON,
)(lambda led: o.round_amounts(pnl(led), YEAR))
query("con05_repeated", "SELECT * FROM rp", CON)(lambda led: o.repeated_amounts(pnl(led), YEAR))
W = lambda t: case([(f"severity = '{k}'", str(v)) for k, v in t.items()], "0")
DETECTION = (
    f"SELECT count(*) FILTER (kind = 'month') AS months, count(*) FILTER (kind IN ('journal', 'journal_december')) AS journals, count(*) FILTER (kind = 'account') AS accounts, count(*) FILTER (kind IN ('round', 'repeated')) AS round_amounts, "
    f"count(*) AS findings, {r('least(coalesce(sum(w), 0), 1)')} AS risk FROM (SELECT kind, {W(o.CONCENTRATION_WEIGHTS)} AS w FROM (SELECT kind, severity FROM mc UNION ALL SELECT kind, severity FROM jc UNION ALL SELECT kind, severity FROM ac WHERE pct > 80) "
    f"UNION ALL SELECT 'round', {W(o.ROUND_WEIGHTS)} FROM rd UNION ALL SELECT 'repeated', {W(o.ROUND_WEIGHTS)} FROM rp)"
)
query("con06_summary", DETECTION, CON)(lambda led: o.detection_summary(pnl(led), YEAR))
SPIKES = f"""{Y}, sp AS (SELECT account, december, {r('m', 2)} AS monthly_mean, {r('CAST(december AS DOUBLE) / m')} AS ratio, CASE WHEN CAST(december AS DOUBLE) / m > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM
  (SELECT account, abs(coalesce(sum(amount) FILTER (month = 12), 0)) AS december, CAST(abs(coalesce(sum(amount) FILTER (month <> 12), 0)) AS DOUBLE) / 11 AS m FROM y GROUP BY account) WHERE m > 0 AND december > m * 5 AND december > 10000)"""
query("pat01_year_end_spikes", "SELECT * FROM sp ORDER BY december DESC, account LIMIT 5", SPIKES)(lambda led: o.year_end_spikes(led, YEAR))
query(
    "pat02_round_numbers",
    "SELECT value, lines, all_lines, CAST(all_amount AS DOUBLE) AS all_amount FROM (SELECT *, sum(lines) OVER () AS all_lines, sum(value * lines) OVER () AS all_amount FROM (SELECT abs(amount) AS value, count(*) AS lines FROM y WHERE abs(amount) >= 5000 AND abs(amount) % 10000 = 0 GROUP BY 1)) WHERE all_lines >= 3 AND all_amount > 50000 ORDER BY lines DESC, value DESC LIMIT 5",
    Y,
)(lambda led: o.round_numbers(led, YEAR))
query(
    "pat03_class_concentration",
    f"SELECT class, account, volume, \"all\" AS class_volume, {r('p')} AS pct, p > 50 AND volume > 100000 AS found, CASE WHEN p > 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (SELECT *, sum(volume) OVER (PARTITION BY class) AS \"all\", CAST(volume AS DOUBLE) / CAST(sum(volume) OVER (PARTITION BY class) AS DOUBLE) * 100 AS p, row_number() OVER (PARTITION BY class ORDER BY volume DESC, account) AS rn "
    "FROM (SELECT class, account, sum(abs(amount)) AS volume FROM y WHERE class IN ('6', '7') GROUP BY ALL)) WHERE rn = 1",
    Y,
)(lambda led: o.class_concentration(led, YEAR))
VOL = lambda *p: f"coalesce(sum(abs(amount)) FILTER (prefix_3 IN {in_list(p)}), 0)"
query(
    "pat04_ratio_anomalies",
    f"SELECT 'social_to_salaries' AS ratio, so AS numerator, sa AS denominator, {r('coalesce(CAST(so AS DOUBLE) / nullif(CAST(sa AS DOUBLE), 0), 0)')} AS value, sa > 100000 AND (CAST(so AS DOUBLE) / CAST(sa AS DOUBLE) < 0.3 OR CAST(so AS DOUBLE) / CAST(sa AS DOUBLE) > 0.7) AS found FROM s "
    f"UNION ALL SELECT 'purchases_to_sales', pu, ve, {r('coalesce(CAST(pu AS DOUBLE) / nullif(CAST(ve AS DOUBLE), 0), 0)')}, ve > 100000 AND CAST(pu AS DOUBLE) / CAST(ve AS DOUBLE) > 0.85 FROM s",
    f"{Y}, s AS (SELECT {VOL('641', '642', '643')} AS sa, {VOL('645', '646', '647')} AS so, {VOL('601', '602', '607')} AS pu, {VOL('701', '702', '707')} AS ve FROM y)",
)(lambda led: o.ratio_anomalies(led, YEAR))
query(
    "pat05_duplicates",
    "SELECT value, lines, CAST(value * lines AS DOUBLE) AS volume FROM (SELECT abs(amount) AS value, count(*) AS lines FROM y GROUP BY 1 HAVING abs(amount) > 1000 AND count(*) >= 5 ORDER BY lines DESC, value DESC LIMIT 3) WHERE value > 5000", Y,
)(lambda led: o.duplicate_amounts(led, YEAR))


def accruals_sql() -> str:
    q = lambda s: s.replace("'", "''")
    counts = [" + ".join(f"CAST(contains(lb, '{q(w)}') AS INT)" for w in ws) for _, _, ws in o.ACCRUAL_KEYWORDS]
    acc = [("prefix_2 IN ('68', '78')", 0.40, "PROVISION"), *[(f"prefix_3 = '{k}'", 0.35, v) for k, v in dims.ACCRUAL_ACCOUNTS.items()], ("prefix_2 = '28'", 0.35, "AMORTISSEMENT"), ("prefix_3 IN ('695', '696', '699')", 0.35, "IMPOT")]
    kinds = [(c, f"'{t}'") for c, _, t in acc] + [(f"k{i} > 0", f"'{kind}'") for i, (_, kind, _) in enumerate(o.ACCRUAL_KEYWORDS) if kind]
    score = " + ".join(f"{w} * k{i}" for i, (w, _, _) in enumerate(o.ACCRUAL_KEYWORDS))
    return f"""{Y}, kw AS (SELECT *, {', '.join(f'{c} AS k{i}' for i, c in enumerate(counts))} FROM (SELECT *, lower(label) AS lb FROM y)),
conf AS (SELECT *, {case(kinds, "'AUTRE'")} AS accrual_type, k0 + k1 + k2 + k3 AS keywords, round(CAST(least({case([(c, str(w)) for c, w, _ in acc], '0')} + CASE WHEN journal IN {in_list(o.ACCRUAL_JOURNALS)} THEN 0.25 ELSE 0 END + least({score}, 0.35) + CASE WHEN month = 12 THEN 0.1 ELSE 0 END, 1) AS DOUBLE), 4) AS confidence FROM kw)"""


ACC = accruals_sql()
query("reg01_accruals", "SELECT account, accrual_type, confidence, count(*) AS lines, sum(keywords) AS keywords FROM conf WHERE confidence >= 0.25 GROUP BY ALL", ACC)(
    lambda led: o.accruals(led, YEAR).groupBy("account", "accrual_type", "confidence").agg(F.count("*").alias("lines"), F.sum("keywords").alias("keywords"))
)
JK = case([(f"journal IN {in_list(o.ACCRUAL_JOURNALS)}", "'od'"), *[("(" + " OR ".join(f"contains(journal, '{w}')" for w in ws) + ")", f"'{t}'") for t, ws in (("achat", ["AC", "HA", "FOU"]), ("vente", ["VE", "VT", "CLI"]), ("banque", ["BQ", "BAN"]), ("caisse", ["CA", "CAI"]), ("paie", ["PA", "SAL"]))]], "'autre'")
query(
    "reg02_journal_screen",
    f"SELECT journal, {JK} AS journal_type, lines, volume, {r('d')} AS december_pct, {r('lines / sum(lines) OVER () * 100')} AS total_pct, accruals, {JK} = 'od' AND d > 50 AS suspect FROM "
    "(SELECT journal, count(*) AS lines, sum(abs(amount)) AS volume, avg(CASE WHEN month = 12 THEN 1 ELSE 0 END) * 100 AS d, count(*) FILTER (confidence >= 0.25) AS accruals FROM conf GROUP BY journal)",
    ACC,
)(lambda led: o.journal_screen(led, YEAR))
query(
    "reg03_accrual_analysis",
    f"SELECT accrual_type, count(*) AS lines, sum(amount) AS net, count(*) FILTER (month = 12) AS december_lines, {r('avg(confidence)')} AS mean_confidence FROM conf WHERE confidence >= 0.25 GROUP BY accrual_type", ACC,
)(lambda led: o.accrual_analysis(led, YEAR))
CTX = f"""{CON.replace("al >= 10000 AND p > 80", "al >= 10000 AND p > 8")}, {ACC[len(Y) + 2:]}, {CLASSIFIED},
cc AS (SELECT *, CASE WHEN account[1] IN ('1', '2') THEN 'CONCENTRATION_EXPLIQUEE' WHEN account[1:2] IN {in_list(o.ALLOWANCES)} THEN 'PROVISION_NORMALE' WHEN account[1:3] IN {in_list(o.ACCRUAL_BALANCES)} OR behavior = 'regularisation' THEN 'REGULARISATION_NORMALE' WHEN is_provision THEN 'PROVISION_NORMALE'
  WHEN frequency IN ('annuelle', 'exceptionnelle') THEN 'CONCENTRATION_EXPLIQUEE' ELSE 'CONCENTRATION_ANORMALE' END AS kind_of FROM (SELECT regexp_extract(value, '^(\\d+)', 1) AS account, amount, pct FROM ac) WHERE_JOIN),
cr AS (SELECT *, coalesce(category IN {in_list(o.ROUND_CATEGORIES)}, false) AS e FROM rd JOIN cls USING (account)),
cg AS (SELECT conf.*, is_typical_accrual AS e FROM (SELECT * FROM conf WHERE confidence >= 0.25 ORDER BY confidence DESC, abs(amount) DESC, voucher, account, accrual_type LIMIT {o.MOST_ACCRUALS}) conf JOIN cls USING (account)),
ctx AS (SELECT account, 'concentration' AS kind, kind_of AS category, CAST(amount AS DOUBLE) AS amount, pct, kind_of <> 'CONCENTRATION_ANORMALE' AS expected, CASE WHEN kind_of <> 'CONCENTRATION_ANORMALE' THEN 'LOW' WHEN pct > 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN kind_of <> 'CONCENTRATION_ANORMALE' THEN '' WHEN pct > 80 THEN 'Vérifier si provision ou régularisation justifiée' ELSE 'Analyser la nature des écritures concentrées' END AS recommendation FROM cc
  UNION ALL SELECT account, 'round_amount', CASE WHEN e THEN 'MONTANT_ROND_JUSTIFIE' ELSE 'MONTANT_ROND_SUSPECT' END, amount, pct, e, CASE WHEN e THEN 'LOW' ELSE 'MEDIUM' END, CASE WHEN e THEN '' ELSE 'Vérifier la nature des écritures' END FROM cr
  UNION ALL SELECT account, lower(accrual_type), CASE WHEN e THEN 'REGULARISATION_NORMALE' ELSE 'REGULARISATION_EXCESSIVE' END, CAST(amount AS DOUBLE), {r('confidence * 100')}, e, CASE WHEN e THEN 'LOW' ELSE 'MEDIUM' END, '' FROM cg),
ar AS (SELECT *, {r('least(least(2 * coalesce(accruals / nullif(lines, 0), 0), 0.3) + 0.15 * suspect_journals + CASE WHEN certain > 10 THEN 0.2 ELSE 0 END, 1)')} AS risk FROM (SELECT count(*) AS lines, count(*) FILTER (confidence >= 0.25) AS accruals, coalesce(sum(amount) FILTER (confidence >= 0.25), 0) AS impact, count(*) FILTER (confidence > 0.7) AS certain FROM conf),
  (SELECT count(*) FILTER (k = 'od' AND d > 50) AS suspect_journals FROM (SELECT {JK} AS k, avg(CASE WHEN month = 12 THEN 1 ELSE 0 END) * 100 AS d FROM conf GROUP BY journal)))""".replace("WHERE_JOIN", "JOIN cls USING (account)")
query("reg03b_risk", "SELECT * FROM ar", CTX)(lambda led: o.accrual_risk(pnl(led), YEAR))
query("reg03c_provisions", "SELECT account, accrual_type, count(*) AS lines, sum(amount) AS net FROM conf WHERE confidence >= 0.25 AND accrual_type IN ('PROVISION', 'AMORTISSEMENT') GROUP BY ALL", ACC)(
    lambda led: o.accruals(led, YEAR).where("accrual_type IN ('PROVISION', 'AMORTISSEMENT')").groupBy("account", "accrual_type").agg(F.count("*").alias("lines"), F.sum("amount").alias("net"))
)
query("ctx01_contextualize", "SELECT * FROM ctx", CTX)(lambda led: o.contextualize(pnl(led), YEAR, 8))


def overall(led: DataFrame) -> DataFrame:
    rows = pnl(led)
    grade = robust.quality(led, ["account", "journal", "label", "third_party"])
    return o.overall(o.contextualize(rows, YEAR, 8), o.detection_summary(rows, YEAR), o.accrual_risk(rows, YEAR), grade, o.of_year(rows, YEAR))


NULLS = " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ("account", "journal", "label", "third_party"))
query(
    "ctx02_overall",
    f"SELECT risk, {r('greatest(1 - ' + case([(f"grade = '{g}'", str(v)) for g, v in o.GRADE_PENALTY.items()], '0.3') + ' - CASE WHEN lines < 1000 THEN 0.1 ELSE 0 END, 0.1)')} AS confidence, lines, findings, expected, findings - expected AS suspect, unexplained, grade, "
    "CASE WHEN risk > 0.7 THEN 'Risque élevé: audit approfondi recommandé' WHEN risk > 0.4 THEN 'Risque modéré: vérifier les anomalies prioritaires' ELSE '' END AS advice FROM "
    f"(SELECT *, {r('least(0.3 * d + 0.3 * a + 0.4 * coalesce((findings - expected) / nullif(findings, 0), 0), 1)')} AS risk FROM (SELECT count(*) AS findings, count(*) FILTER (expected) AS expected, count(*) FILTER (NOT expected AND severity IN ('HIGH', 'CRITICAL')) AS unexplained FROM ctx), "
    f"(SELECT risk AS d FROM ({{DETECTION}})), (SELECT risk AS a FROM ar), (SELECT CASE WHEN n < 2 THEN 'A' WHEN n < 5 THEN 'B' WHEN n < 10 THEN 'C' WHEN n < 20 THEN 'D' ELSE 'E' END AS grade FROM (SELECT {r(f'({NULLS}) / 4 * 100')} AS n FROM ledger)), (SELECT count(*) AS lines FROM y))".replace("{DETECTION}", DETECTION),
    CTX,
)(overall)
query(
    "ctx02b_recommendations",
    f"SELECT recommendation, min(severity) AS severity, count(*) AS findings FROM ctx WHERE recommendation <> '' GROUP BY recommendation ORDER BY min({case([(f"severity = '{x}'", str(i)) for i, x in enumerate(o.SEVERITIES)])}), findings DESC, recommendation LIMIT 10", CTX,
)(lambda led: o.recommendations(o.contextualize(pnl(led), YEAR, 8)))


def any_pattern(ps: list[str]) -> str:
    return "regexp_matches(lower(label), '" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") + "')"


CATS = [(g, c, any_pattern(ps)) for g, cs in o.PATTERNS.items() for c, ps in cs.items()]
PARTS = lambda words: "(" + " OR ".join(f"contains(journal, '{w}')" for w in words) + ")"
OD, CLOSING = PARTS(o.OD_JOURNALS), PARTS(o.CLOSING_JOURNALS)
CNT = f"""{Y}, cat AS ({' UNION ALL '.join(f"SELECT '{g}' AS pattern_group, '{c}' AS category, label FROM (SELECT DISTINCT label FROM y) WHERE {e}" for g, c, e in CATS)}),
jn AS (SELECT journal, lines, debit, credit, accounts, {OD} AS is_od, {CLOSING} AS is_closing, top_accounts FROM (SELECT journal, count(*) AS lines, sum(debit) AS debit, sum(credit) AS credit, count(DISTINCT account) AS accounts FROM y GROUP BY journal)
  JOIN (SELECT journal, string_agg(account, ',' ORDER BY rn) AS top_accounts FROM (SELECT journal, account, row_number() OVER (PARTITION BY journal ORDER BY abs(sum(amount)) DESC, account) AS rn FROM y GROUP BY journal, account) WHERE rn <= 5 GROUP BY journal) USING (journal)),
lp AS (SELECT pattern_group, category, count(*) AS hits, sum(debit) AS debit, sum(credit) AS credit, array_to_string(list_sort(list(DISTINCT account))[1:10], '|') AS accounts, array_to_string(list_sort(list(DISTINCT label))[1:5], '|') AS examples FROM y JOIN cat USING (label) GROUP BY ALL),
odc AS (SELECT CAST(m AS INT) AS month, coalesce(lines, 0) AS lines, coalesce(od_lines, 0) AS od_lines, CAST(coalesce(v, 0) AS DOUBLE) AS volume, CAST(coalesce(w, 0) AS DOUBLE) AS od_volume, {r('coalesce(CAST(w AS DOUBLE) / CAST(v AS DOUBLE), 0) * 100')} AS od_pct FROM (SELECT unnest(range(1, 13)) AS m)
  LEFT JOIN (SELECT month, count(*) AS lines, count(*) FILTER ({OD} OR {CLOSING}) AS od_lines, sum(abs(amount)) AS v, coalesce(sum(abs(amount)) FILTER ({OD} OR {CLOSING}), 0) AS w FROM y GROUP BY month) ON month = m),
ae AS (SELECT * FROM y WHERE {OD} OR {CLOSING} OR label IN (SELECT label FROM cat WHERE pattern_group = 'REGUL' OR category IN ('DEGREVEMENT', 'REMBOURSEMENT')))"""
query("cnt01_journals", "SELECT * FROM jn", CNT)(lambda led: o.journals(led, YEAR))
query("cnt01b_journal_months", f"SELECT journal, month, count(*) AS lines, {r('count(*) / sum(count(*)) OVER (PARTITION BY journal) * 100')} AS pct FROM y GROUP BY journal, month", Y)(lambda led: o.journal_months(led, YEAR))
query("cnt02_label_patterns", "SELECT * FROM lp", CNT)(lambda led: o.label_patterns(led, YEAR))
ORDER = case([(f"category = '{c}'", str(i)) for i, (_, c, _) in enumerate(CATS)])
query(
    "cnt03_account_content",
    f"SELECT account, volume, main_journal, {r('CAST(od AS DOUBLE) / CAST(volume AS DOUBLE) * 100')} AS od_pct, categorized, large_lines, labels, first_category, first_labels FROM (SELECT account, sum(v) AS volume, arg_max(journal, (v, journal)) AS main_journal, sum(CASE WHEN {OD} OR {CLOSING} THEN v ELSE 0 END) AS od FROM (SELECT account, journal, sum(abs(amount)) AS v FROM y GROUP BY ALL) GROUP BY account) "
    "JOIN (SELECT account, count(fc) AS categorized, count(*) FILTER (abs(amount) >= 5000) AS large_lines, count(DISTINCT label) AS labels, min(fc) AS first_category, array_to_string(list_sort(list(DISTINCT label))[1:20], '|') AS first_labels "
    f"FROM y LEFT JOIN (SELECT label, arg_min(category, {ORDER}) AS fc FROM cat GROUP BY label) USING (label) GROUP BY account) USING (account)",
    CNT,
)(lambda led: o.account_content(led, YEAR))
query("cnt04_od_concentration", "SELECT * FROM odc", CNT)(lambda led: o.od_concentration(led, YEAR))
query("cnt05_accrual_entries", "SELECT account, journal, count(*) AS lines, sum(amount) AS net FROM ae GROUP BY ALL", CNT)(
    lambda led: o.accrual_entries(led, YEAR).groupBy("account", "journal").agg(F.count("*").alias("lines"), F.sum("amount").alias("net"))
)
query(
    "cnt06_content_summary",
    "SELECT (SELECT count(*) FROM jn) AS journals, (SELECT count(*) FROM jn WHERE is_od) AS od_journals, (SELECT count(*) FROM lp) AS categories, (SELECT count(*) FROM ae) AS accrual_lines, (SELECT od_pct FROM odc WHERE month = 12) AS december_od_pct", CNT,
)(lambda led: o.content_summary(led, YEAR))
