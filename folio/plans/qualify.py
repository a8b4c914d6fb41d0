"""Queries of qualification and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import qualify as o
from folio.operators import signals
from folio.plans.registry import case, in_list, query, r, values
from folio.plans.signals import ALPHA, SIG

#: Rules that some families list: known texts, and one that is not.
LISTED = [("601", ["Montant rond", "Solde zero"]), ("611", ["label identique", "Mensuel recurrent"]), ("626", ["MEME MONTANT 12 MOIS"]), ("641", ["autre"]), ("645", ["montant_rond", "extourne dans delai"])]
OWN = [(family, rule) for family, texts in LISTED for rule in [next((rule for t, rule in o.RULE_TEXTS if t in text.lower().replace(" ", "_")), None) for text in texts] if rule]
ROUND = " OR ".join(f"metric - floor(metric / {x}) * {x} < {0.01 * x}" for x in o.ROUND_STEPS)
APPLIES = lambda rule: f"(NOT listed OR list_contains(own, '{rule}'))"
NAMED = lambda pairs: "array_to_string([x for x in [" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + "] if x IS NOT NULL], ',')"
MET = {"is_round": "is_round", "same_12": "same_12", "repeated_label": "repeated_label", "zero_balance": "zero_balance", "recurrent_variation": "recurrent"}
CONTEXT = f"""{SIG},
cm AS (SELECT prefix_3 AS family, period, CAST(sum(amount) AS DOUBLE) AS v, row_number() OVER (PARTITION BY prefix_3 ORDER BY period DESC) AS rn FROM ledger GROUP BY prefix_3, period),
cs AS (SELECT family, bool_and(CASE WHEN f3 = 0 THEN v = 0 ELSE abs(v - f3) < 0.001 * abs(f3) END) FILTER (rn <= 3) AND count(*) >= 3 AS same_3, bool_and(CASE WHEN f12 = 0 THEN v = 0 ELSE abs(v - f12) < 0.001 * abs(f12) END) FILTER (rn <= 12) AND count(*) >= 12 AS same_12, count(*) AS months
  FROM (SELECT *, max(v) FILTER (rn = 3) OVER (PARTITION BY family) AS f3, max(v) FILTER (rn = 12) OVER (PARTITION BY family) AS f12 FROM cm) GROUP BY family),
cl AS (SELECT family, sum(n) >= 3 AND coalesce(max(n) FILTER (l <> ''), 0) >= 3 AND max(n) FILTER (l <> '') > 0.5 * sum(n) FILTER (l <> '') AS repeated_label FROM (SELECT prefix_3 AS family, lower(trim(label)) AS l, count(*) AS n FROM ledger WHERE label IS NOT NULL GROUP BY ALL) GROUP BY family),
cb AS (SELECT prefix_3 AS family, abs(sum(amount)) < 0.01 AS zero_balance FROM ledger GROUP BY ALL),
cx AS (SELECT sg.*, CASE WHEN method = 'conformal' THEN coalesce(months, 1) - 1 ELSE 0 END AS calibration, metric > 0 AND ({ROUND}) AS is_round, coalesce(same_3, false) AS same_3, coalesce(same_12, false) AS same_12, coalesce(repeated_label, false) AS repeated_label,
  coalesce(zero_balance, false) AS zero_balance, method = 'conformal' AND coalesce(months, 1) - 1 >= 6 AND test = 'L2-VAR' AS recurrent, coalesce(ends_with(period, '12'), false) AS year_end FROM sg LEFT JOIN cs USING (family) LEFT JOIN cl USING (family) LEFT JOIN cb USING (family)),
{values('own_rules', 'family, rule', OWN)},
ex AS (SELECT *, {NAMED([(rule, APPLIES(rule)) for rule, _ in o.EXCLUSIONS])} AS rules_checked, {NAMED([(rule, f"{APPLIES(rule)} AND {MET[col]}") for rule, col in o.EXCLUSIONS if col in MET])} AS rules_matched
  FROM (SELECT cx.*, w.own, w.own IS NOT NULL AS listed FROM cx LEFT JOIN (SELECT family, list(rule) AS own FROM own_rules GROUP BY family) w USING (family))),
pe0 AS (SELECT ex.*, amount, "limit", CASE WHEN year_end THEN 10.0 ELSE 0 END AS boost, CASE WHEN coalesce(p_adjusted, 0) <> 0 THEN p_adjusted ELSE p_value END AS p, amount / "limit" AS q FROM ex JOIN qb USING (id)),
pe1 AS (SELECT *, CAST(CASE WHEN p IS NULL THEN least(100, raw_score) ELSE {case([(f"p < {t}", str(v)) for t, v in o.P_SCORES], 'greatest(0, 0.5 - log10(p + 0.01) * 0.2) * 100')} END AS DOUBLE) AS st,
  CAST(CASE WHEN "limit" <= 0 THEN 50 WHEN q < 1 THEN 50 * q WHEN q < 2 THEN 50 + 20 * (q - 1) WHEN q < 5 THEN 70 + 20 * (q - 2) / 3 ELSE 100 * least(1, 0.9 + 0.1 * log10(q / 5)) END AS DOUBLE) AS ma,
  least(30, CASE WHEN universe IN {in_list(o.RISKY)} THEN 10 ELSE 0 END + CASE WHEN coalesce(ends_with(period, '-12'), false) THEN 5 ELSE 0 END + CASE WHEN method IN ('matrix_profile', 'conformal') THEN 5 ELSE 0 END + CASE WHEN calibration >= 12 THEN 5 ELSE 0 END) AS co FROM pe0),
pe2 AS (SELECT *, greatest(0, least(100, (st + ma) / 2 + least(30, boost))) AS bu FROM pe1),
pe AS (SELECT *, {r('least(greatest(0.35 * st + 0.30 * ma + 0.25 * bu + 0.10 * co, 0), 100)')} AS pertinence FROM pe2),
ql0 AS (SELECT *, CASE WHEN amount < "limit" THEN 'BELOW_MATERIALITY' WHEN rules_matched <> '' THEN 'EXCLUDED_BY_RULE' WHEN pertinence < {o.PERTINENT} THEN 'LOW_PERTINENCE' ELSE 'PASSED' END AS filter_reason FROM pe),
ql AS (SELECT *, {case([(f"pertinence >= {t}", f"'{n}'") for t, n in o.LEVELS], "'LOW'")} AS level, CASE WHEN filter_reason = 'PASSED' THEN row_number() OVER (PARTITION BY filter_reason ORDER BY pertinence DESC, id) END AS rank FROM ql0),
{values('uw', 'universe, weight', [(u, w) for u, _, w in signals.UNIVERSES])},
im AS (SELECT id, family, universe, test, pertinence, amount, {r('pertinence / 100 * 15')} AS base_impact, CAST(coalesce(weight, 1) AS DOUBLE) AS weight, {r('f')} AS factor, {r('least(15, pertinence / 100 * 15 * coalesce(weight, 1) * f)')} AS impact
  FROM (SELECT *, CASE WHEN sum(amount) OVER () > 0 AND amount > 0 THEN least(2, greatest(0.5, log10(1 + amount / greatest(sum(amount) OVER (), 1)) * 3 + 1)) ELSE 1 END AS f FROM ql WHERE filter_reason = 'PASSED') LEFT JOIN uw USING (universe))"""


REDUCTION = "coalesce(1 - count(*) FILTER (filter_reason = 'PASSED') / nullif(count(*), 0), 0)"


def listed(led: DataFrame) -> DataFrame:
    return led.sparkSession.createDataFrame(LISTED, "family string, rules array<string>")


def judged(led: DataFrame) -> DataFrame:
    return o.qualify(signals.signals(led, ALPHA), led, listed(led))


query("qua02_context", "SELECT id, family, test, calibration, is_round, same_3, same_12, repeated_label, zero_balance, recurrent, year_end FROM cx", CONTEXT)(
    lambda led: o.context(signals.signals(led, ALPHA), led).select("id", "family", "test", "calibration", "is_round", "same_3", "same_12", "repeated_label", "zero_balance", F.col("recurrent_variation").alias("recurrent"), "year_end")
)
query("qua03_exclusions", "SELECT id, family, rules_checked, rules_matched, rules_matched <> '' AS excluded FROM ex", CONTEXT)(
    lambda led: o.exclusions(o.context(signals.signals(led, ALPHA), led), listed(led)).select("id", "family", *[F.array_join(c, ",").alias(c) for c in ("rules_checked", "rules_matched")], "excluded")
)
query("qua04_inclusions", "SELECT id, CASE WHEN year_end THEN 10 ELSE 0 END AS boost, CASE WHEN year_end THEN 'INC-YEAREND' ELSE '' END AS boosted_by FROM cx", CONTEXT)(
    lambda led: o.inclusions(o.context(signals.signals(led, ALPHA), led)).select("id", "boost", F.array_join("boosted_by", ",").alias("boosted_by"))
)
query("qua05_pertinence", f"SELECT id, {r('st')} AS statistical, {r('ma')} AS material_part, {r('bu')} AS business, {r('co')} AS context, pertinence, level FROM ql", CONTEXT)(
    lambda led: judged(led).select("id", "statistical", "material_part", "business", "context", "pertinence", "level")
)
query("qua06_qualify", 'SELECT id, family, universe, test, amount, "limit", filter_reason, rules_matched, pertinence, level, rank FROM ql', CONTEXT)(
    lambda led: judged(led).select("id", "family", "universe", "test", "amount", "limit", "filter_reason", F.array_join("rules_matched", ",").alias("rules_matched"), "pertinence", "level", "rank")
)
query(
    "qua06b_summary",
    "SELECT count(*) AS signals, count(*) FILTER (filter_reason = 'PASSED') AS qualified, count(*) FILTER (filter_reason = 'BELOW_MATERIALITY') AS below_materiality, count(*) FILTER (filter_reason = 'EXCLUDED_BY_RULE') AS excluded_by_rule, "
    "count(*) FILTER (filter_reason = 'LOW_PERTINENCE') AS low_pertinence, coalesce(sum(len(string_split(rules_checked, ','))) FILTER (filter_reason <> 'BELOW_MATERIALITY'), 0) AS rules_checked, "
    f"{r(REDUCTION)} AS reduction FROM ql", CONTEXT,
)(lambda led: o.qualify_summary(judged(led)))
query("sco01_impact", "SELECT * FROM im", CONTEXT)(lambda led: o.impact(judged(led)))
query("sco02_universe_scores", f"SELECT uw.universe, count(im.id) AS anomalies, {r('coalesce(sum(impact), 0)', 3)} AS impact, {r('coalesce(sum(amount), 0)', 2)} AS amount, {r('greatest(100 - coalesce(sum(impact), 0), 0)', 3)} AS score FROM uw LEFT JOIN im USING (universe) GROUP BY uw.universe", CONTEXT)(
    lambda led: o.universe_scores(o.impact(judged(led)))
)
query(
    "sco03_score",
    f"SELECT *, {case([(f'score >= {t}', chr(39) + n + chr(39)) for t, n in o.SCORE_LEVELS], chr(39) + 'CRITIQUE' + chr(39))} AS level FROM (SELECT {r('greatest(100 - coalesce(sum(impact), 0), 0)', 3)} AS score, count(*) AS anomalies, {r('coalesce(sum(impact), 0)', 3)} AS impact, {r('coalesce(sum(amount), 0)', 2)} AS amount, "
    f"{r('count(DISTINCT family) / 180')} AS coverage, coalesce(array_to_string(list(id ORDER BY impact DESC, id)[1:5], ','), '') AS top FROM im)", CONTEXT,
)(lambda led: o.score(o.impact(judged(led))))


def undated(led: DataFrame) -> DataFrame:
    """The ledger with dates as texts, those of one account unreadable."""
    return led.withColumn("text", F.when(F.col("account") == "512000", "n/a").otherwise(F.col("date").cast("string")))


PREPARED = "sum(amount) AS amount, count(*) AS lines, count(DISTINCT journal) AS journals FROM"
TEXTS = "td AS (SELECT account AS family, amount, journal, CASE WHEN account = '512000' THEN NULL ELSE strftime(date, '%Y-%m') END AS p FROM ledger)"
query("sco05_prepare", f"SELECT family, coalesce(p, (SELECT p FROM td WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)) AS period, {PREPARED} td GROUP BY ALL", TEXTS)(
    lambda led: o.prepare_signals(undated(led), "text").groupBy("family", "period").agg(F.sum("amount").alias("amount"), F.count("*").alias("lines"), F.count_distinct("journal").alias("journals"))
)
query("sco05b_prepare_undated", f"SELECT account AS family, 'AGG' AS period, {PREPARED} ledger GROUP BY ALL")(
    lambda led: o.prepare_signals(led.withColumn("text", F.concat(F.lit("le "), F.col("date").cast("string"))), "text").groupBy("family", "period").agg(F.sum("amount").alias("amount"), F.count("*").alias("lines"), F.count_distinct("journal").alias("journals"))
)
