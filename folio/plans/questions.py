"""Queries of questions, of the score report, and of universe tests made from metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import folio.plans.classification
import folio.plans.passage
import folio.plans.regularity
import folio.plans.runrate  # noqa: F401
from folio.operators import classify, qualify, reports, runrate, signals
from folio.operators import questions as o
from folio.plans import detect as plans
from folio.plans.core import dated
from folio.plans.qualify import CONTEXT, judged
from folio.plans.registry import ORACLES, QUERIES, YEAR, case, in_list, query, r, values



def table(name: str) -> str:
    """A registered query as a subquery."""
    return f"({ORACLES[name]})"


TEMPLATE = "replace(replace(replace(replace(template, '{0}', account), '{1}', format('{:,}', CAST(round(abs(amount)) AS BIGINT))), '{2}', coalesce(mn, '')), '{3}', CAST(coalesce(CAST(round(pct) AS BIGINT), 0) AS VARCHAR))"
ASKED = f"""an AS (SELECT * FROM {table('run03_month_anomalies')}), prov AS (SELECT * FROM {table('run02_provisions')}), {values('kinds', 'kind, base, template', o.KINDS)}, {values('mon', 'month, mn', list(enumerate(o.MONTHS, 1)))},
qs0 AS (SELECT account, 'zscore_eleve' AS kind, gap AS amount, CAST(period[6:7] AS INT) AS month, gap_pct AS pct FROM an UNION ALL SELECT account, CASE WHEN gap > 0 THEN 'provision_excessive' ELSE 'provision_insuffisante' END, gap, 12, NULL FROM prov),
qs1 AS (SELECT account, kind, CAST(amount AS DOUBLE) AS amount, CAST(month AS INT) AS month, CAST(CASE WHEN abs(amount) > {o.LARGE} THEN greatest(1, base - 1) WHEN abs(amount) < {o.SMALL} THEN least(3, base + 1) ELSE base END AS INT) AS priority, {TEMPLATE} AS question FROM qs0 JOIN kinds USING (kind) LEFT JOIN mon USING (month)),
qs AS (SELECT upper(kind[1:3]) || '-' || account || '-' || lpad(CAST(row_number() OVER (PARTITION BY account ORDER BY priority, abs(amount) DESC, kind, month, question) AS VARCHAR), 3, '0') AS id, * FROM qs1)"""


def asked(led: DataFrame) -> DataFrame:
    no = F.lit(None).cast("string")
    a = runrate.month_anomalies(led, YEAR).select("account", F.lit("z-score").alias("nature"), no.alias("source"), no.alias("journal"), F.col("gap").alias("amount"), F.substring("period", 6, 2).cast("int").alias("month"), F.col("gap_pct").alias("pct"), F.lit(0).alias("variation"))
    return o.questions(a, runrate.provisions(led, YEAR).select("account", "gap"))


query("qst01_questions", "SELECT id, kind, account, amount, month, priority, question FROM qs", ASKED)(asked)
def facts(led: DataFrame) -> DataFrame:
    """What is known of the months and provisions that are asked about, with the chart's name of the account."""
    names = classify.classify_account(classify.accounts_of(led)).select("account", F.col("chart_label").alias("account_label"))
    none = F.lit(None).cast("double")
    a = runrate.month_anomalies(led, YEAR).select("account", F.lit("zscore_eleve").alias("kind"), F.substring("period", 6, 2).cast("int").alias("month"), F.col("gap").alias("amount"), "mean", F.col("z").alias("zscore"), none.alias("run_rate"))
    gap = F.when(F.col("gap") > 0, "provision_excessive").otherwise("provision_insuffisante")
    p = runrate.provisions(led, YEAR).select("account", gap.alias("kind"), F.lit(12).alias("month"), F.col("december").cast("double").alias("amount"), none.alias("mean"), none.alias("zscore"), "run_rate")
    return a.unionByName(p).withColumn("expected", F.col("run_rate")).join(names, "account", "left")


FACTS = {"a": "account", "l": "coalesce(chart_label, '')", "t": "coalesce(mn, '')", "z": f"printf('%+.1f', {r('coalesce(zscore, 0)', 1)})", **{m: f"format('{{:,}}', CAST(round({e}) AS BIGINT))" for m, e in (("m", "abs(amount)"), ("g", "coalesce(mean, 0)"), ("r", "coalesce(run_rate, 0)"), ("x", "coalesce(run_rate, 0)"))}}
SAYING = "template"
for mark, fact in FACTS.items():
    SAYING = f"replace({SAYING}, '{{{mark}}}', {fact})"
query(
    "qst01b_contexts",
    f"SELECT account, kind, CAST(month AS INT) AS month, {SAYING} AS context, documents FROM fc JOIN cn USING (kind) LEFT JOIN mon USING (month) LEFT JOIN (SELECT account, chart_label FROM {table('cls01_classify_account')}) USING (account)",
    f"""{ASKED}, {values('cn', 'kind, template, documents', [(k, t, '|'.join(d)) for k, t, d in o.CONTEXTS])},
fc AS (SELECT account, 'zscore_eleve' AS kind, CAST(period[6:7] AS INT) AS month, gap AS amount, mean, z AS zscore, NULL AS run_rate FROM an UNION ALL SELECT account, CASE WHEN gap > 0 THEN 'provision_excessive' ELSE 'provision_insuffisante' END, 12, CAST(december AS DOUBLE), NULL, NULL, run_rate FROM prov)""",
)(lambda led: o.question_contexts(facts(led)).withColumn("documents", F.array_join("documents", "|")))
query("qst02_resolution", "SELECT id, kind, account, amount, month, priority, question, 'À traiter' AS status FROM qs", ASKED)(lambda led: o.resolution_sheet(asked(led)))
query(
    "qst02b_summary",
    f"SELECT count(*) AS points, count(*) FILTER (priority = 1) AS priority_1, count(*) FILTER (priority = 2) AS priority_2, count(*) FILTER (priority = 3) AS priority_3, {r('coalesce(sum(abs(amount)), 0)', 2)} AS amount FROM qs", ASKED,
)(lambda led: o.resolution_summary(asked(led)))

PATTERNS = f"""pt AS (SELECT 'year_end_spike' AS pattern, account AS subject, CAST(december AS DOUBLE) AS amount, CAST(ratio AS DOUBLE) AS value, severity FROM {table('pat01_year_end_spikes')}
  UNION ALL SELECT 'concentration', account, CAST(volume AS DOUBLE), pct, severity FROM {table('pat03_class_concentration')} WHERE found
  UNION ALL SELECT ratio, NULL, CAST(numerator AS DOUBLE), value, 'HIGH' FROM {table('pat04_ratio_anomalies')} WHERE found
  UNION ALL SELECT 'round_number', CAST(value AS VARCHAR), CAST(value * lines AS DOUBLE), lines, 'MEDIUM' FROM {table('pat02_round_numbers')}
  UNION ALL SELECT 'duplicate_amount', CAST(value AS VARCHAR), CAST(value AS DOUBLE), lines, 'MEDIUM' FROM {table('pat05_duplicates')}),
{values('drills', 'pattern, place, drill', o.DRILLS)}"""
query(
    "drl06_questions",
    f"SELECT pattern, subject, drill, CAST(place AS INT) AS place, {r('amount', 2)} AS amount, {r('value')} AS value, severity, CAST(least(10, {case([(f"severity = '{s}'", str(b)) for s, b in o.BASE.items()], '5')} + place) AS INT) AS priority FROM pt JOIN drills USING (pattern) WHERE NOT (pattern = 'social_to_salaries' AND place = 1 AND value >= {o.LOW_SOCIAL})",
    PATTERNS,
)(lambda led: o.drill_questions(o.patterns(led, YEAR)))

ASKED_FIRST = PATTERNS + f""", dq AS (SELECT pattern, subject, drill, place, {r('amount', 2)} AS amount, least(10, {case([(f"severity = '{s}'", str(b)) for s, b in o.BASE.items()], '5')} + place) AS priority FROM pt JOIN drills USING (pattern) WHERE NOT (pattern = 'social_to_salaries' AND place = 1 AND value >= {o.LOW_SOCIAL})),
aq AS (SELECT 'Q' || lpad(CAST(row_number() OVER (ORDER BY priority, amount DESC, pattern, subject NULLS FIRST, place) AS VARCHAR), 3, '0') AS question, drill, CASE WHEN pattern IN {in_list(o.OF_ACCOUNTS)} THEN subject[1:3] END AS p, CASE WHEN pattern IN {in_list(o.OF_ACCOUNTS)} THEN subject[1] ELSE '6' END AS c
  FROM dq QUALIFY row_number() OVER (ORDER BY priority, amount DESC, pattern, subject NULLS FIRST, place) <= 24),
y2 AS (SELECT * FROM ledger WHERE year = {YEAR}),
dt AS (SELECT question, drill, row_number() OVER (PARTITION BY question ORDER BY abs(amount) DESC, date, voucher, account, label) AS row, account AS name, strftime(date, '%Y-%m-%d') || '|' || voucher || '|' || label AS text, CAST(amount AS DOUBLE) AS v1,
  CAST(sum(debit) OVER (PARTITION BY question) AS DOUBLE) AS v2, CAST(sum(credit) OVER (PARTITION BY question) AS DOUBLE) AS v3, CAST(count(*) OVER (PARTITION BY question) AS DOUBLE) AS v4 FROM aq JOIN ledger ON prefix_3 = p WHERE drill = 'detail_view'),
tm AS (SELECT question, drill, period AS name, sum(amount) AS net, count(*) AS n FROM aq JOIN y2 ON p IS NULL OR prefix_3 = p WHERE drill = 'trend_analysis' GROUP BY ALL),
tr AS (SELECT question, drill, row_number() OVER (PARTITION BY question ORDER BY name) AS row, name, CAST(abs(net) = max(abs(net)) OVER (PARTITION BY question) AS VARCHAR) AS text, CAST(net AS DOUBLE) AS v1, n AS v2, {r('avg(CAST(net AS DOUBLE)) OVER (PARTITION BY question)')} AS v3, {r('stddev_samp(CAST(net AS DOUBLE)) OVER (PARTITION BY question)', 2)} AS v4 FROM tm),
hy AS (SELECT account, coalesce(sum(amount) FILTER (month <= 6), 0) AS s1, coalesce(sum(amount) FILTER (month > 6), 0) AS s2 FROM y2 GROUP BY account),
hf AS (SELECT question, drill, row_number() OVER (PARTITION BY question ORDER BY account) AS row, account AS name, NULL AS text, CAST(s1 AS DOUBLE) AS v1, CAST(s2 AS DOUBLE) AS v2, CAST(s2 - s1 AS DOUBLE) AS v3, {r('coalesce(CAST(s2 - s1 AS DOUBLE) / nullif(abs(CAST(s1 AS DOUBLE)), 0), 0) * 100', 2)} AS v4 FROM aq, hy WHERE drill = 'comparison'),
vo AS (SELECT DISTINCT question, drill, voucher FROM aq JOIN ledger ON p IS NULL OR prefix_3 = p WHERE drill = 'counterparty'),
cp AS (SELECT question, drill, third_party AS name, sum(abs(amount)) AS v, count(*) AS n FROM vo JOIN ledger USING (voucher) WHERE third_party IS NOT NULL GROUP BY ALL),
ct AS (SELECT question, drill, row_number() OVER (PARTITION BY question ORDER BY v DESC, name) AS row, name, NULL AS text, CAST(v AS DOUBLE) AS v1, n AS v2, NULL AS v3, NULL AS v4 FROM cp),
bk AS (SELECT question, drill, account AS name, prefix_2 AS text, sum(abs(amount)) AS v FROM aq JOIN y2 ON class = c WHERE drill = 'breakdown' GROUP BY ALL),
bd AS (SELECT question, drill, row_number() OVER (PARTITION BY question ORDER BY v DESC, name) AS row, name, text, CAST(v AS DOUBLE) AS v1, {r('CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY question) AS DOUBLE) * 100', 1)} AS v2, NULL AS v3, NULL AS v4 FROM bk),
al AS (SELECT * FROM dt WHERE row <= 50 UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM hf UNION ALL SELECT * FROM ct WHERE row <= 10 UNION ALL SELECT * FROM bd)"""
query(
    "drl06b_answers",
    "SELECT question, drill, CAST(row AS INT) AS row, name, text, v1, CAST(v2 AS DOUBLE) AS v2, CAST(v3 AS DOUBLE) AS v3, CAST(v4 AS DOUBLE) AS v4 FROM al UNION ALL SELECT question, drill, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM aq WHERE question NOT IN (SELECT question FROM al)", ASKED_FIRST,
)(lambda led: o.execute(led, o.patterns(led, YEAR), YEAR, 24))

SHORT = lambda x: f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN abs({x}) >= 1e6 THEN format('{{:,.1f}}M€', {r(f'{x} / 1e6', 1)}) WHEN abs({x}) >= 1e3 THEN format('{{:,.0f}}K€', {r(f'{x} / 1e3', 0)}) ELSE format('{{:,.0f}}€', {r(x, 0)}) END"
SAID = {
    "a": "coalesce(account, '')", "n": "coalesce(kind_name, '')", "m": SHORT("amount"), "w": SHORT("whole"), "i": case([(f"starts_with(coalesce(account, ''), '{p}')", "'" + t.replace("'", "''") + "'") for p, t in o.SPIKE_READINGS], "''"),
    "v": f"CASE pattern WHEN 'year_end_spike' THEN printf('%.1f', {r('value', 1)}) WHEN 'social_to_salaries' THEN printf('%.1f', {r('value * 100', 1)}) WHEN 'purchases_to_sales' THEN printf('%.1f', {r('(1 - value) * 100', 1)}) ELSE printf('%.0f', {r('value', 0)}) END",
    "c": case([(f"account[1] = '{c}'", f"'{n}'") for c, n in o.CLASS_NAMES.items()], "''"),
}
WORDED = "template"
for mark, said in SAID.items():
    WORDED = f"replace({WORDED}, '{{{mark}}}', {said})"
WHOLE = f"""{PATTERNS}, wh AS (SELECT 'year_end_spike' AS pattern, account AS subject, monthly_mean AS whole FROM {table('pat01_year_end_spikes')} UNION ALL SELECT 'concentration', account, CAST(class_volume AS DOUBLE) FROM {table('pat03_class_concentration')} UNION ALL SELECT ratio, NULL, CAST(denominator AS DOUBLE) FROM {table('pat04_ratio_anomalies')}),
{values('tx', 'pattern, place, template', o.DRILL_TEXTS)}, {values('kd', 'kind_of, kind_name', o.ACCOUNT_KINDS)},
tq AS (SELECT pt.*, place, drill, template, whole, CASE WHEN pt.pattern IN {in_list(o.OF_ACCOUNTS)} THEN pt.subject END AS account FROM pt JOIN drills USING (pattern) JOIN tx USING (pattern, place) LEFT JOIN wh ON wh.pattern = pt.pattern AND wh.subject IS NOT DISTINCT FROM pt.subject)"""
query(
    "drl06c_texts",
    f"SELECT pattern, subject, CAST(place AS INT) AS place, drill, {WORDED} AS question FROM tq LEFT JOIN kd ON account[1:2] = kind_of WHERE NOT (pattern = 'social_to_salaries' AND place = 1 AND value >= {o.LOW_SOCIAL})", WHOLE,
)(lambda led: o.drill_texts(o.patterns(led, YEAR)))

REPORT = f"""{CONTEXT},
us AS (SELECT uw.universe, count(im.id) AS anomalies, {r('coalesce(sum(amount), 0)', 2)} AS amount, {r('greatest(100 - coalesce(sum(impact), 0), 0)', 3)} AS score FROM uw LEFT JOIN im USING (universe) GROUP BY uw.universe),
tot AS (SELECT *, {case([(f"score >= {t}", f"'{n}'") for t, n in qualify.SCORE_LEVELS], "'CRITIQUE'")} AS level FROM (SELECT {r('greatest(100 - coalesce(sum(impact), 0), 0)', 3)} AS score, coalesce(array_to_string(list(id ORDER BY impact DESC, id)[1:5], ','), '') AS top FROM im)),
fst AS (SELECT *, row_number() OVER (ORDER BY impact DESC, id) AS rank FROM im),
{values('bu', 'universe, template', reports.BY_UNIVERSE)},
adv AS (SELECT 1 AS n, {"'" + reports.URGENT.replace("'", "''") + "'"} AS text FROM tot WHERE level = 'CRITIQUE' UNION ALL SELECT 2, '{reports.SUPERVISE}' FROM tot WHERE level IN ('CRITIQUE', 'ATTENTION') UNION ALL SELECT 20, '{reports.KEEP}' FROM tot WHERE level IN ('EXCELLENT', 'BON')
  UNION ALL SELECT n + 2, replace(replace(template, '{{0}}', CAST(anomalies AS VARCHAR)), '{{1}}', format('{{:,}}', CAST(round(amount) AS BIGINT))) FROM (SELECT *, row_number() OVER (ORDER BY score, universe) AS n FROM us JOIN bu USING (universe) WHERE score < 60 AND anomalies > 0) WHERE n <= 3
  UNION ALL SELECT 10, 'Priorité: Analyser l''anomalie [' || family || '] ' || test || ', montant: ' || format('{{:,}}', CAST(round(amount) AS BIGINT)) || '€.' FROM fst WHERE rank = 1)"""
query(
    "snk03_score_report",
    "SELECT 'score' AS section, 1 AS rank, level AS name, score AS value, top AS text FROM tot UNION ALL SELECT 'weak', row_number() OVER (ORDER BY score, universe), universe, score, CAST(anomalies AS VARCHAR) FROM us WHERE score < 75 AND anomalies > 0 QUALIFY row_number() OVER (ORDER BY score, universe) <= 3 "
    "UNION ALL SELECT 'strong', row_number() OVER (ORDER BY score DESC, universe), universe, score, CAST(anomalies AS VARCHAR) FROM us WHERE score >= 90 QUALIFY row_number() OVER (ORDER BY score DESC, universe) <= 3 "
    "UNION ALL SELECT 'recommendation', row_number() OVER (ORDER BY n), '', NULL, text FROM adv QUALIFY row_number() OVER (ORDER BY n) <= 5 UNION ALL SELECT 'anomaly', rank, id, impact, family FROM fst WHERE rank <= 5", REPORT,
)(lambda led: reports.score_report(judged(led)))

def material(q: DataFrame) -> DataFrame:
    """Of judged signals all that reach their materiality, as if they were anomalies: more groups to report on."""
    return q.withColumn("filter_reason", F.when(F.col("filter_reason") != "BELOW_MATERIALITY", "PASSED"))


FIG = lambda x: f"CAST(CAST(round({x}, 2) AS DECIMAL(18,2)) AS VARCHAR)"
BRIEF = f"""'{{"universe":"' || universe || '","score":' || {FIG('score')} || ',"anomalies":' || anomalies || '}}'"""
DOCUMENTS = f"""{CONTEXT},
gq AS (SELECT family[1] AS entity, coalesce(period[1:4], '') AS period, id, family, universe, test, pertinence, amount FROM ql WHERE filter_reason <> 'BELOW_MATERIALITY'),
gi AS (SELECT entity, period, id, family, universe, test, pertinence, amount, {r('least(15, pertinence / 100 * 15 * coalesce(weight, 1) * f)')} AS impact FROM (SELECT *, sum(amount) OVER w AS every, CASE WHEN sum(amount) OVER w > 0 AND amount > 0
  THEN least(2, greatest(0.5, log10(1 + amount / greatest(sum(amount) OVER w, 1)) * 3 + 1)) ELSE 1 END AS f FROM gq WINDOW w AS (PARTITION BY entity, period)) LEFT JOIN uw USING (universe)),
gt AS (SELECT entity, period, count(*) AS n, sum(impact) AS t, sum(amount) AS a, count(DISTINCT family) AS fam, {r('greatest(100 - sum(impact), 0)', 3)} AS score FROM gi GROUP BY ALL),
gl AS (SELECT *, {case([(f"score >= {t}", f"'{n}'") for t, n in qualify.SCORE_LEVELS], "'CRITIQUE'")} AS level FROM gt),
gs AS (SELECT entity, period, uw.universe, count(id) AS anomalies, coalesce(sum(impact), 0) AS t, coalesce(sum(amount), 0) AS a, {r('greatest(100 - coalesce(sum(impact), 0), 0)', 3)} AS score FROM (SELECT DISTINCT entity, period FROM gi) CROSS JOIN uw LEFT JOIN gi USING (entity, period, universe) GROUP BY ALL),
{values('bt', 'universe, template', reports.BY_UNIVERSE)},
gu AS (SELECT entity, period, string_agg('{{"universe":"' || universe || '","score":' || {FIG('score')} || ',"anomalies":' || anomalies || ',"impact":' || {FIG('t')} || ',"amount":' || {FIG('a')} || '}}', ',' ORDER BY score, universe) AS us FROM gs GROUP BY ALL),
gw AS (SELECT entity, period, string_agg({BRIEF}, ',' ORDER BY score, universe) AS weak FROM (SELECT * FROM gs WHERE score < {reports.WEAK} AND anomalies > 0 QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY score, universe) <= 3) GROUP BY ALL),
gg AS (SELECT entity, period, string_agg({BRIEF}, ',' ORDER BY score DESC, universe) AS strong FROM (SELECT * FROM gs WHERE score >= {reports.STRONG} QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY score DESC, universe) <= 3) GROUP BY ALL),
gf AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY impact DESC, id) AS rank FROM gi),
gp AS (SELECT entity, period, string_agg('{{"rank":' || rank || ',"id":"' || id || '","family":"' || family || '","test":"' || test || '","universe":"' || universe || '","impact":' || {FIG('impact')} || ',"pertinence":' || {FIG('pertinence')} || ',"amount":' || {FIG('amount')} || '}}', ',' ORDER BY rank) AS top FROM gf WHERE rank <= 5 GROUP BY ALL),
ga AS (SELECT entity, period, 1 AS n, {"'" + reports.URGENT.replace("'", "''") + "'"} AS text FROM gl WHERE level = 'CRITIQUE' UNION ALL SELECT entity, period, 2, '{reports.SUPERVISE}' FROM gl WHERE level IN ('CRITIQUE', 'ATTENTION') UNION ALL SELECT entity, period, 20, '{reports.KEEP}' FROM gl WHERE level IN ('EXCELLENT', 'BON')
  UNION ALL SELECT entity, period, n + 2, replace(replace(template, '{{0}}', CAST(anomalies AS VARCHAR)), '{{1}}', format('{{:,}}', CAST(round(a) AS BIGINT))) FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY score, universe) AS n FROM gs JOIN bt USING (universe) WHERE score < {reports.TO_MEND} AND anomalies > 0) WHERE n <= 3
  UNION ALL SELECT entity, period, 10, 'Priorité: Analyser l''anomalie [' || family || '] ' || test || ', montant: ' || format('{{:,}}', CAST(round(amount) AS BIGINT)) || '€.' FROM gf WHERE rank = 1),
gr AS (SELECT entity, period, string_agg('"' || text || '"', ',' ORDER BY n) AS advice FROM (SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY n) <= 5) GROUP BY ALL)"""
query(
    "snk03b_documents",
    f"""SELECT entity, period, '{{"entity":"' || entity || '","period":"' || period || '","score":' || {FIG('score')} || ',"level":"' || level || '","anomalies":' || n || ',"impact":' || {FIG('t')} || ',"amount":' || {FIG('a')} || ',"families":' || fam || ',"universes":[' || us || '],"weak":[' || coalesce(weak, '')
  || '],"strong":[' || coalesce(strong, '') || '],"recommendations":[' || advice || '],"top":[' || top || ']}}' AS document FROM gl JOIN gu USING (entity, period) LEFT JOIN gw USING (entity, period) LEFT JOIN gg USING (entity, period) JOIN gr USING (entity, period) JOIN gp USING (entity, period)""", DOCUMENTS,
)(lambda led: reports.report_documents(
    material(judged(led)).withColumns({"entity": F.substring("family", 1, 1), "period": F.coalesce(F.substring("period", 1, 4), F.lit("")), "p": F.coalesce("p_value", F.lit(1.0))}),
    order=("p", "id"),  # the order in which the SQL's signals leave the window of their adjusted p-values
    figure=reports.figure_of_product,
))

# report tables that other queries make, as they come out of the report
for name, of, key in (("snk01_summary", "cmp02_compare_years", "summary"), ("snk01_reconciliation", "cmp03_reconciliation", "reconciliation"), ("snk01_findings", "cmp04_both_years", "findings"), ("snk01_monthly", "run05_monthly_comparison", "monthly")):
    ORACLES[name] = ORACLES[of]
    query(name)(lambda led, key=key: reports.comparison_tables(led, YEAR, YEAR - 1)[key])
for name, of, key in (("snk02_synthesis", "pas03_annual", "synthesis"), ("snk02_alerts", "alr06_alerts", "alerts"), ("snk02_adjustments", "pas02_adjustments", "adjustments")):
    ORACLES[name] = ORACLES[of]
    query(name)(lambda led, key=key: reports.passage_tables(led, YEAR)[key])
for name, of, key in (("snk04_anomalies", "ctx01_contextualize", "anomalies"), ("snk04_notes", "ctx02b_recommendations", "notes")):
    query(name)(lambda led, key=key: reports.single_year_tables(plans.pnl(led), YEAR, ["account", "journal", "label"])[key])
    ORACLES[name] = ORACLES[of].replace("al >= 10000 AND p > 8)", "al >= 10000 AND p > 80)")

query("snk04_accruals", "SELECT accrual_type, journal, account, label, amount, strftime(date, '%Y-%m-%d') AS date, confidence FROM conf WHERE confidence >= 0.25", plans.ACC)(
    lambda led: dated(reports.single_year_tables(led, YEAR, ["account", "journal", "label"])["accruals"])
)
query(
    "snk04_surprises",
    f"SELECT * FROM {table('icc08_views').replace('FROM ledger', f'FROM (SELECT * FROM ledger WHERE year = {YEAR})')} ORDER BY surprise DESC, account, site LIMIT 20",
)(lambda led: reports.single_year_tables(led, YEAR, ["account", "journal", "label"])["surprises"])
query(
    "snk04_summary",
    f"SELECT *, (SELECT count(DISTINCT account) FROM ledger WHERE year = {YEAR} AND class IN ('6', '7')) AS accounts, {YEAR} AS year FROM {table('ctx02_overall').replace("al >= 10000 AND p > 8)", "al >= 10000 AND p > 80)").replace(" AS n FROM ledger)", f" AS n FROM ledger WHERE year = {YEAR} AND class IN ('6', '7'))")}",
)(lambda led: reports.single_year_tables(plans.pnl(led), YEAR, ["date", "account", "journal", "third_party"])["summary"])

#: A referential of some families, in place of one that a site would keep.
REFERENTIAL = [("601", 0.72, ["marge"], ["montant_rond", "solde_zero"]), ("613", 0.0, ["loyer", "bail"], ["label_identique", "meme_montant_12_mois"]), ("633", 0.4, ["abt cfe"], ["solde_zero"]), ("641", 0.1, [], ["montant_rond"])]
METRICS = "mt0 AS (SELECT prefix_3 AS family, period, site, CAST(count(*) AS DOUBLE) AS metric, sum(amount) AS s, bool_and(abs(amount) % 100 = 0) AS is_round, abs(sum(amount)) < 0.01 AS zero_balance, count(DISTINCT label) = 1 AS repeated_label, list_sort(list(DISTINCT lower(split_part(label, ' ', 1)))) AS keywords FROM ledger GROUP BY ALL)"
HIT = " OR ".join(f"(contains(x, '{t}') AND {c})" for t, c in signals.LISTED if c in ("is_round", "zero_balance", "repeated_label"))


def metrics(led: DataFrame) -> DataFrame:
    word = F.lower(F.substring_index("label", " ", 1))
    g = led.groupBy(F.col("prefix_3").alias("family"), "period", "site").agg(
        F.count("*").cast("double").alias("metric"), F.every(F.abs("amount") % 100 == 0).alias("is_round"), (F.abs(F.sum("amount")) < 0.01).alias("zero_balance"), (F.count_distinct("label") == 1).alias("repeated_label"), F.collect_set(word).alias("keywords")
    )
    return g.withColumns({"same_12": F.lit(False), "reversed_in_time": F.lit(False)})


LISTS = lambda i: case([(f"family = '{row[0]}'", "[" + ", ".join(f"'{x}'" for x in row[i]) + "]") for row in REFERENTIAL if row[i]], "[]")
query(
    "sig07_make_signals",
    f"SELECT concat_ws('_', 'L2-TEST', family, replace(period, '-', ''), site) AS id, family, 'L2-TEST' AS test, period, site, metric, threshold, {r('greatest(metric - threshold, 0)')} AS delta, array_to_string([x for x in against if {HIT}], ',') AS excluded_by, "
    "array_to_string([x for x in pro if len([k for k in keywords if contains(lower(x), k)]) > 0], ',') AS supported_by "
    f"FROM (SELECT *, {r('1.5 + 2 * ' + case([(f"family = '{row[0]}'", str(row[1])) for row in REFERENTIAL], '1.0'))} AS threshold, {LISTS(3)} AS against, {LISTS(2)} AS pro FROM mt0)", METRICS,
)(lambda led: signals.make_signals(metrics(led), led.sparkSession.createDataFrame(REFERENTIAL, "family string, cv double, signal_if array<string>, no_signal_if array<string>"), "L2-TEST"))
