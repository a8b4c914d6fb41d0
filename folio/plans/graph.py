"""Queries of the counterparty graph, circuits and topology."""

from __future__ import annotations

from folio.operators import graph as o
from folio.plans.registry import YEAR, case, query, r, values

PERIODS = (f"{YEAR}-05", f"{YEAR}-06")
LN = """ln AS (SELECT *, debit > 0 AS deb FROM ledger WHERE voucher IS NOT NULL),
pr AS (SELECT d.voucher, d.account AS source, c.account AS dest, d.site AS ds, d.period AS dp, c.site AS cs, c.period AS cp, abs(d.amount) AS da, abs(c.amount) AS ca FROM ln d JOIN ln c ON d.voucher = c.voucher AND d.deb AND NOT c.deb),
fl AS (SELECT site, period, source, dest, sum(v) AS volume, count(*) AS entries FROM (SELECT ds AS site, dp AS period, source, dest, da AS v FROM pr UNION ALL SELECT cs, cp, source, dest, ca FROM pr) GROUP BY ALL),
fm AS (SELECT period, source, dest, sum(volume) AS volume FROM fl GROUP BY ALL)"""
STEP = LN + """, ord AS (SELECT period, lead(period) OVER (ORDER BY period) AS nx FROM (SELECT DISTINCT period FROM fm)),
st AS (SELECT coalesce(n.period, b.period) AS period, coalesce(n.source, b.source) AS source, coalesce(n.dest, b.dest) AS dest, now, before FROM (SELECT period, source, dest, volume AS now FROM fm WHERE period IN (SELECT nx FROM ord)) n
  FULL JOIN (SELECT nx AS period, source, dest, volume AS before FROM fm JOIN ord USING (period) WHERE nx IS NOT NULL) b ON n.period = b.period AND n.source = b.source AND n.dest = b.dest)"""
query("gra01_arcs", "SELECT voucher, source, dest, count(*) AS pairs FROM pr GROUP BY ALL", LN, once=True)(o.arcs)
query("gra02_flow", "SELECT * FROM fl", LN, once=True)(o.flow)
query(
    "gra03_nodes",
    "SELECT account, CASE WHEN account[1] IN ('6', '7') THEN 'PNL' ELSE 'BILAN' END AS kind, count(DISTINCT o) AS degree_out, count(DISTINCT i) AS degree_in FROM (SELECT source AS account, dest AS o, NULL AS i FROM fl UNION ALL SELECT dest, NULL, source FROM fl) GROUP BY account", LN,
)(lambda led: o.nodes(o.flow(led)))
query(
    "gra04_signature",
    f"SELECT period, arcs, pnl_nodes, balance_nodes, CAST(flow AS DOUBLE) AS flow, {r('2 * arcs / (pnl_nodes + balance_nodes)')} AS mean_degree, {r('CAST(top AS DOUBLE) / CAST(flow AS DOUBLE)')} AS top5_share FROM "
    "(SELECT period, count(*) AS arcs, sum(volume) AS flow, sum(volume) FILTER (rn <= 5) AS top FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY volume DESC, source, dest) AS rn FROM fm) GROUP BY period) JOIN "
    "(SELECT period, count(*) FILTER (a[1] IN ('6', '7')) AS pnl_nodes, count(*) FILTER (a[1] NOT IN ('6', '7')) AS balance_nodes FROM (SELECT period, source AS a FROM fm UNION SELECT period, dest FROM fm) GROUP BY period) USING (period)",
    LN, once=True,
)(lambda led: o.signature(o.flow(led)))
query(
    "gra05_stability",
    f"SELECT period, {r('1 - count(*) FILTER (now IS NOT NULL AND before IS NOT NULL) / count(*)')} AS jaccard_distance, {r('sum(p * ln(p / q))')} AS kl_divergence FROM "
    "(SELECT *, coalesce(CAST(now AS DOUBLE), 0) / sum(coalesce(CAST(now AS DOUBLE), 0)) OVER (PARTITION BY period) + 1e-10 AS p, coalesce(CAST(before AS DOUBLE), 0) / sum(coalesce(CAST(before AS DOUBLE), 0)) OVER (PARTITION BY period) + 1e-10 AS q FROM st) GROUP BY period",
    STEP, once=True,
)(lambda led: o.stability(o.flow(led)))
RT = "CAST(now AS DOUBLE) / CAST(before AS DOUBLE)"
query(
    "gra07_mutations",
    f"SELECT period, source, dest, kind, coalesce(CAST(now AS DOUBLE), 0) AS now, coalesce(CAST(before AS DOUBLE), 0) AS before, {r(f'CASE kind WHEN {chr(39)}NEW_ARC{chr(39)} THEN 0.8 WHEN {chr(39)}DISAPPEARED{chr(39)} THEN 0.6 WHEN {chr(39)}VOLUME_SPIKE{chr(39)} THEN least(0.9, {RT} / 5) ELSE least(0.7, 1 / ({RT}) / 5) END')} AS score FROM "
    f"(SELECT *, CASE WHEN before IS NULL AND now >= 100 THEN 'NEW_ARC' WHEN now IS NULL AND before >= 100 THEN 'DISAPPEARED' WHEN {RT} > 2 THEN 'VOLUME_SPIKE' WHEN {RT} < 0.5 THEN 'VOLUME_DROP' END AS kind FROM st) WHERE kind IS NOT NULL AND NOT coalesce(now < 100 AND before < 100, false)",
    STEP, once=True,
)(lambda led: o.mutations(o.flow(led)))
TPL = LN + ", " + values("tpl", "family, template, prefixes", o.TEMPLATE_ROWS) + """,
cpt AS (SELECT family, cp AS counterparty, count(*) AS pairs FROM (SELECT source[1:3] AS family, dest AS cp FROM pr UNION ALL SELECT dest[1:3], source FROM pr) GROUP BY ALL),
jd AS (SELECT c.*, template, template IS NULL OR len(list_filter(string_split(prefixes, ' '), lambda p: starts_with(counterparty, p))) > 0 AS conform FROM cpt c LEFT JOIN tpl USING (family))"""
query("gra08_atypical", "SELECT family, counterparty, template, pairs FROM jd WHERE NOT conform", TPL, once=True)(o.atypical)
query(
    "gra09_conformity",
    f"SELECT family, sum(pairs) AS pairs, {r('coalesce(sum(pairs) FILTER (conform), 0) / sum(pairs)')} AS rate, string_agg(counterparty, ',' ORDER BY rn) FILTER (rn <= 5) AS top_counterparties FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pairs DESC, counterparty) AS rn FROM jd) GROUP BY family", TPL, once=True,
)(o.conformity)
query(
    "gra10_suggest",
    f"SELECT family, prefix, pairs, {r('share')} AS share FROM (SELECT *, pairs / sum(pairs) OVER (PARTITION BY family) AS share FROM (SELECT family, template, counterparty[1:3] AS prefix, conform, sum(pairs) AS pairs FROM jd GROUP BY ALL)) WHERE template IS NOT NULL AND NOT conform AND pairs >= 10 AND share >= 0.02", TPL, once=True,
)(lambda led: o.suggest(led, share=0.02))
KIND = case([("(" + " OR ".join(f"starts_with(account, '{p}')" for p in ps) + ")", f"'{k}'") for k, ps in o.CIRCUITS.items()])
CIR = LN + f""", ck AS (SELECT *, {KIND} AS kind FROM ln),
hits AS (SELECT b.account AS balance, b.site, p.account, count(*) AS hits FROM ck b JOIN ln p ON b.voucher = p.voucher AND b.deb <> p.deb AND p.class IN ('6', '7') WHERE b.kind IS NOT NULL GROUP BY ALL),
mn AS (SELECT balance, site, arg_min(account, (-hits, account)) AS pnl_account FROM hits GROUP BY ALL),
cs AS (SELECT kind, account AS balance, site, coalesce(sum(abs(amount)) FILTER (credit > 0), 0) AS pv, coalesce(sum(abs(amount)) FILTER (NOT credit > 0), 0) AS rv, count(DISTINCT period) FILTER (credit > 0) AS provision_months,
  stddev_pop(CAST(abs(amount) AS DOUBLE)) FILTER (credit > 0) / nullif(avg(CAST(abs(amount) AS DOUBLE)) FILTER (credit > 0), 0) AS cv FROM ck WHERE kind IS NOT NULL GROUP BY ALL),
paid AS (SELECT DISTINCT voucher, NOT deb AS deb FROM ln WHERE starts_with(account, '401') OR starts_with(account, '512')),
ac AS (SELECT ln.* FROM ln SEMI JOIN paid ON ln.voucher = paid.voucher AND ln.deb = paid.deb WHERE class IN ('6', '7')),
ci0 AS (SELECT kind, cs.balance, cs.site, mn.pnl_account, CAST(pv AS DOUBLE) AS provisions, CAST(rv AS DOUBLE) AS reversals, CAST(pv - rv AS DOUBLE) AS residual, CAST(coalesce(a, 0) AS DOUBLE) AS actual, coalesce(abs(CAST(pv - rv AS DOUBLE)) / nullif(CAST(pv + rv AS DOUBLE), 0) < 0.01, true) AS closed,
  coalesce((CAST(coalesce(a, 0) AS DOUBLE) - CAST(pv AS DOUBLE)) / nullif(CAST(pv AS DOUBLE), 0), 0) AS g, provision_months, {r('coalesce(cv, 0)')} AS provision_cv FROM cs JOIN mn ON cs.balance = mn.balance AND cs.site = mn.site
  LEFT JOIN (SELECT account, site, sum(abs(amount)) AS a FROM ac GROUP BY ALL) x ON x.account = mn.pnl_account AND x.site = cs.site),
ci AS (SELECT kind, balance, site, pnl_account, provisions, reversals, residual, actual, closed, {r('g')} AS gap, provision_months, provision_cv, CASE WHEN NOT closed AND abs(residual) > 1000 THEN 'alerte' WHEN abs(g) > 0.2 THEN 'attention' WHEN NOT closed THEN 'attention' ELSE 'ok' END AS severity FROM ci0)"""
query("cir01_circuits", "SELECT * FROM ci", CIR)(o.circuits)
query("cir02_actual_charges", "SELECT account, site, count(*) AS lines, sum(amount) AS net FROM ac GROUP BY ALL", CIR)(
    lambda led: o.actual_charges(led).groupBy("account", "site").agg(o.F.count("*").alias("lines"), o.F.sum("amount").alias("net"))
)
query(
    "cir04_circuit_summary",
    f"SELECT kind, severity, count(*) AS circuits, count(*) FILTER (NOT closed) AS open, count(*) FILTER (abs(gap) > 0.1) AS significant_gaps, {r('sum(residual)', 2)} AS residual FROM ci GROUP BY ALL", CIR,
)(lambda led: o.circuit_summary(o.circuits(led)))
query("emb01_matrix", "SELECT site, period, source, dest, volume FROM fl WHERE volume >= 1000", LN, once=True)(lambda led: o.matrix(led, 1000))
query("emb02_normalize", f"SELECT site, period, source, dest, volume, {r('CAST(volume AS DOUBLE) / CAST(sum(volume) OVER (PARTITION BY site, period, source) AS DOUBLE)', 6)} AS share FROM fl", LN, once=True)(lambda led: o.normalize(o.matrix(led), "row"))
query(
    "emb03_similarity",
    f"SELECT {r('sum(x * y) / sqrt(sum(x * x) * sum(y * y))', 6)} AS cosine, {r('sqrt(sum((x - y) * (x - y)))', 2)} AS frobenius, {r('count(*) FILTER (xx IS NOT NULL AND yy IS NOT NULL) / count(*)', 6)} AS jaccard FROM "
    f"(SELECT a.volume AS xx, b.volume AS yy, coalesce(CAST(a.volume AS DOUBLE), 0) AS x, coalesce(CAST(b.volume AS DOUBLE), 0) AS y FROM (SELECT * FROM fm WHERE period = '{PERIODS[0]}') a FULL JOIN (SELECT * FROM fm WHERE period = '{PERIODS[1]}') b ON a.source = b.source AND a.dest = b.dest)",
    LN,
)(lambda led: o.similarity(*[o.by_period(o.flow(led)).where(o.F.col("period") == p) for p in PERIODS]))
PREFIX = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))"
PX = LN + f""", pm AS (SELECT source, dest, sum(volume) AS v, sum(entries) AS n FROM fl WHERE source <> dest GROUP BY ALL),
tt AS (SELECT x, sum(v) AS t FROM (SELECT source AS x, v FROM pm UNION ALL SELECT dest, v FROM pm) GROUP BY x),
px AS (SELECT a, b, {r('1 - CAST(v AS DOUBLE) / greatest(CAST(ta.t AS DOUBLE), CAST(tb.t AS DOUBLE), 1)')} AS emergent, {r(f'1 - {PREFIX} / greatest(len(a), len(b))')} AS chart, arcs
  FROM (SELECT least(source, dest) AS a, greatest(source, dest) AS b, sum(v) AS v, sum(n) AS arcs FROM pm GROUP BY ALL) JOIN tt ta ON ta.x = a JOIN tt tb ON tb.x = b)"""
query("top01_proximity", "SELECT * FROM px", PX, once=True)(o.proximity)
query("top03_divergences", "SELECT a, b, emergent, chart, d AS divergence FROM (SELECT *, CASE WHEN emergent < 0.65 AND chart > 0.5 THEN 'COUPLAGE_INATTENDU' WHEN emergent > 0.7 AND chart < 0.65 THEN 'DECOUPLAGE' END AS d FROM px) WHERE d IS NOT NULL", PX, once=True)(
    lambda led: o.divergences(o.proximity(led), close=0.65)
)
query("top03b_proximity_stats", f"SELECT count(*) AS pairs, {r('avg(emergent)')} AS mean_emergent, {r('avg(chart)')} AS mean_chart, {r('coalesce(corr(emergent, chart), 0)')} AS correlation FROM px", PX, once=True)(lambda led: o.proximity_stats(o.proximity(led)))
query(
    "top04_expected_coupling",
    "SELECT a, b, emergent, arg_min(meaning, i) AS meaning FROM px JOIN cpl ON (starts_with(a, x) AND starts_with(b, y)) OR (starts_with(a, y) AND starts_with(b, x)) GROUP BY ALL",
    PX + ", " + values("cpl", "i, x, y, meaning", [(i, *c) for i, c in enumerate(o.COUPLINGS)]), once=True,
)(lambda led: o.expected_coupling(o.proximity(led)))
