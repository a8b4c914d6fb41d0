"""Queries of the regularity index, the digit law and drill-downs."""

from __future__ import annotations

from folio.operators import crystallinity as o
from folio.operators import digits, drill
from folio.plans.registry import YEAR, case, in_list, query, r, values

C = "account, site"
A = "abs(CAST(amount AS DOUBLE))"
MV = f"mv AS (SELECT {C}, period, CAST(sum(abs(amount)) AS DOUBLE) AS v FROM ledger GROUP BY ALL)"
query(
    "uni04_regularity",
    f"SELECT {C}, months, {r('CASE WHEN months < 2 THEN 0.5 WHEN months >= 11 THEN least(1 - least(cv, 1) + 0.1, 1) ELSE 1 - least(cv, 1) END')} AS regularity FROM (SELECT {C}, count(*) AS months, coalesce(stddev_pop(v) / nullif(avg(v), 0), 0) AS cv FROM mv GROUP BY ALL)", MV,
)(o.regularity)
UNI = case([(f"prefix_3 IN {in_list(fs)}", f"'{u}'") for u, fs in o.TYPICAL.items()], "'NON_CLASSE'")
query("uni08_expected_universe", f"SELECT DISTINCT account, {UNI} AS universe FROM ledger")(lambda led: led.select("account", o.expected_universe(o.F.col("prefix_3")).alias("universe")).distinct())
PARTS = f"""{MV},
cv0 AS (SELECT {C}, count(*) AS n, avg({A}) AS mean, stddev_pop({A}) AS sd FROM ledger GROUP BY ALL),
cv1 AS (SELECT {C}, stddev_pop(m) AS tsd, count(*) AS tn FROM (SELECT {C}, third_party, avg({A}) AS m FROM ledger WHERE third_party IS NOT NULL GROUP BY ALL) GROUP BY ALL),
cv2 AS (SELECT {C}, CASE WHEN count(*) > 1 THEN coalesce(stddev_pop(v) / nullif(avg(v), 0), 0) ELSE 0 END AS t FROM mv GROUP BY ALL),
cv3 AS (SELECT {C}, CASE WHEN n >= 2 THEN coalesce(sd / nullif(mean, 0), 0) ELSE 0 END AS total, CASE WHEN n >= 2 AND tn > 1 THEN coalesce(tsd / nullif(mean, 0), 0) ELSE 0 END AS third, CASE WHEN n >= 2 THEN t ELSE 0 END AS tm FROM cv0 LEFT JOIN cv1 USING (account, site) JOIN cv2 USING (account, site)),
cv AS (SELECT {C}, {r('total')} AS cv_total, {r('third')} AS cv_third, {r('tm')} AS cv_time, {r('greatest(total - third - tm, 0)')} AS cv_rest FROM cv3),
w AS (SELECT {C}, w, sum(n) AS n FROM (SELECT {C}, n, unnest(regexp_split_to_array(lower(trim(label)), '\\s+')) AS w FROM (SELECT {C}, label, count(*) AS n FROM ledger GROUP BY ALL)) WHERE length(w) > 2 AND NOT regexp_full_match(w, '\\d+') GROUP BY ALL),
te AS (SELECT {C}, {r('h')} AS entropy_raw, {r('h / CASE WHEN k > 1 THEN log2(k) ELSE 1 END')} AS entropy_normalized, k AS tokens FROM (SELECT {C}, -sum(p * log2(p)) AS h, count(*) AS k FROM (SELECT *, n / sum(n) OVER (PARTITION BY {C}) AS p FROM w) GROUP BY ALL)),
tp AS (SELECT {C}, {r('CASE WHEN months >= 3 THEN rr ELSE 0 END')} AS autocorrelation, {r('CASE WHEN months >= 3 THEN cv ELSE 1 END')} AS cv_month, {r('CASE WHEN months >= 3 THEN greatest((1 - least(cv, 2) / 2) * 0.5 + (rr + 1) / 2 * 0.5, 0) ELSE 0 END')} AS time_score FROM
  (SELECT {C}, count(*) AS months, coalesce(stddev_pop(v) / nullif(avg(v), 0), 1) AS cv, CASE WHEN isnan(corr(b, v)) THEN 0 ELSE coalesce(corr(b, v), 0) END AS rr FROM (SELECT *, lag(v) OVER (PARTITION BY {C} ORDER BY period) AS b FROM mv) GROUP BY ALL)),
jd AS (SELECT {C}, k AS journals, {r('hhi')} AS journal_hhi, CAST(CASE k WHEN 1 THEN 1 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS purity FROM (SELECT {C}, count(*) AS k, sum(p * p) AS hhi FROM (SELECT {C}, count(*) / sum(count(*)) OVER (PARTITION BY {C}) AS p FROM ledger GROUP BY {C}, journal) GROUP BY ALL)),
fc AS (SELECT voucher, NOT (debit > 0) AS deb, min(account) AS cp FROM ledger GROUP BY ALL),
cc AS (SELECT {C}, k AS counterparties, {r('hhi')} AS cp_hhi, {r('top')} AS cp_top FROM (SELECT {C}, count(*) AS k, sum(p * p) AS hhi, max(p) AS top FROM (SELECT {C}, cp, count(*) / sum(count(*)) OVER (PARTITION BY {C}) AS p FROM ledger l JOIN fc ON fc.voucher = l.voucher AND fc.deb = (l.debit > 0) GROUP BY {C}, cp) GROUP BY ALL)),
{values('dim', 'universe, expected, threshold, wa, wl, wt, wj, wc', o.UNIVERSE_ROWS)},
pa AS (SELECT cv.account, cv.site, cv.account[1:3] AS family, {UNI.replace('prefix_3', 'cv.account[1:3]')} AS universe, 1 - least(cv_total, 2) / 2 AS sa, greatest(1 - coalesce(entropy_normalized, 0), 0) AS sl, time_score, purity, cp_hhi
  FROM cv LEFT JOIN te USING (account, site) JOIN tp USING (account, site) JOIN jd USING (account, site) JOIN cc USING (account, site)),
ic AS (SELECT {C}, family, pa.universe, {r('sa', 6)} AS amount_score, {r('sl')} AS label_score, time_score, purity, cp_hhi, round(CAST(least(greatest(wa * sa + wl * sl + wt * time_score + wj * purity + wc * cp_hhi, 0), 1) AS DOUBLE), 6) AS icc, CAST(expected AS DOUBLE) AS expected, CAST(threshold AS DOUBLE) AS threshold FROM pa JOIN dim USING (universe))"""
for name, table, f in (("icc01_cv_split", "cv", o.cv_split), ("icc02_token_entropy", "te", o.token_entropy), ("icc03_temporal", "tp", o.temporal), ("icc04_journals", "jd", o.journal_diversity), ("icc05_counterparties", "cc", o.cp_concentration)):
    query(name, f"SELECT * FROM {table}", PARTS)(f)
query("icc06_index", "SELECT *, CASE WHEN icc >= 0.7 THEN 'crystalline' WHEN icc >= 0.4 THEN 'vitreous' ELSE 'amorphous' END AS level FROM ic", PARTS)(o.icc)
Z = lambda by: r(f"coalesce((icc - avg(icc) OVER (PARTITION BY {by})) / nullif(round(stddev_pop(icc) OVER (PARTITION BY {by}), 9), 0), 0)")
query("icc07_z", f"SELECT {C}, family, universe, icc, {Z('family')} AS z_family, {Z('universe, family')} AS z_universe_family FROM ic", PARTS)(lambda led: o.icc_z(o.icc(led)))
query("icc08_views", f"SELECT {C}, universe, icc, {r('abs(icc - expected)')} AS surprise, abs(icc - expected) > threshold AS alert FROM ic", PARTS)(lambda led: o.icc_views(o.icc(led)))
query("icc09_family_stats", f"SELECT family, count(*) AS couples, {r('avg(icc)')} AS mean, {r('stddev_pop(icc)')} AS std, {r('min(icc)')} AS min, {r('max(icc)')} AS max FROM ic GROUP BY family HAVING count(*) >= 3", PARTS)(lambda led: o.family_stats(o.icc(led)))
query(
    "icc08b_top",
    f"SELECT view, CAST(row_number() OVER (PARTITION BY view ORDER BY key, account, site) AS INT) AS rank, account, site, abs(key) AS value FROM (SELECT account, site, 'amorphous' AS view, icc AS key FROM ic UNION ALL SELECT account, site, 'crystalline', -icc FROM ic "
    f"UNION ALL SELECT account, site, 'surprising', -{r('abs(icc - expected)')} FROM ic) QUALIFY row_number() OVER (PARTITION BY view ORDER BY key, account, site) <= 20", PARTS,
)(lambda led: o.icc_top(o.icc(led)))
query("icc08c_heat_map", "SELECT site, family, arg_max(icc, account) AS icc FROM ic WHERE site IS NOT NULL GROUP BY site, family", PARTS)(lambda led: o.heat_map(o.icc(led)))
STATS = f"count(*) AS couples, {r('avg(icc)')} AS mean, {r('stddev_pop(icc)')} AS std, {r('quantile_cont(icc, 0.5)', 6)} AS median, count(*) FILTER (icc >= 0.7) AS crystalline, count(*) FILTER (icc < 0.4) AS amorphous, count(*) FILTER (abs(icc - expected) > threshold) AS surprising, count(DISTINCT family) AS families, count(DISTINCT site) AS sites FROM ic"
query("icc08d_stats", f"SELECT 'ALL' AS universe, {STATS} UNION ALL SELECT universe, {STATS} GROUP BY universe", PARTS)(lambda led: o.icc_stats(o.icc(led)))
query(
    "icc09b_family_z",
    f"SELECT account, site, family, icc, z, coalesce(z < -1.5, false) AS alert FROM (SELECT account, site, family, icc, CASE WHEN n >= 3 THEN CASE WHEN round(sd, 6) < 0.01 THEN 0 ELSE {r('(icc - mean) / nullif(sd, 0)')} END END AS z "
    "FROM (SELECT *, count(*) OVER w AS n, stddev_pop(icc) OVER w AS sd, avg(icc) OVER w AS mean FROM ic WINDOW w AS (PARTITION BY family)))", PARTS,
)(lambda led: o.family_z(o.icc(led)))
query("icc10_mahalanobis")(lambda led: o.mahalanobis(o.icc(led)))

PLAIN = "ltrim(replace(CAST(abs(amount) AS VARCHAR), '.', ''), '0') || '0'"
BEN = f"""{values('law', 'place, digit, expected', [(p, d, e) for p, t in ((1, digits.FIRST), (2, digits.SECOND)) for d, e in t.items()])},
dg AS (SELECT place, digit, count(*) AS count FROM (SELECT 1 AS place, CAST(({PLAIN})[1] AS INT) AS digit FROM ledger WHERE amount <> 0 UNION ALL SELECT 2, CAST(({PLAIN})[2] AS INT) FROM ledger WHERE amount <> 0) GROUP BY ALL),
b0 AS (SELECT law.place, law.digit, coalesce(count, 0) AS count, CAST(expected AS DOUBLE) AS e, al, coalesce(count, 0) / al AS o FROM law LEFT JOIN dg ON law.place = dg.place AND law.digit = dg.digit, (SELECT count(*) AS al FROM ledger WHERE amount <> 0)),
bf AS (SELECT CAST(place AS INT) AS place, CAST(digit AS INT) AS digit, count, {r('o * 100')} AS observed_pct, {r('e * 100')} AS expected_pct, {r('(o - e) * 100')} AS deviation, {r('(o - e) / sqrt(e * (1 - e) / al)')} AS z, abs((o - e) / sqrt(e * (1 - e) / al)) > 2 AS suspicious FROM b0 WHERE al >= 100)"""
query("ben01_digits", "SELECT * FROM bf", BEN)(digits.benford)
LEVEL = case([(f"mad <= {t}", f"'{n}'") for t, n in digits.LIMITS], "'Non-conforming'")
query(
    "ben02_test",
    f"SELECT place, amounts, {r('chi', 1)} AS chi_square, {r('mad', 5)} AS mad, {LEVEL} AS conformity FROM (SELECT place, sum(count) AS amounts, sum((observed_pct / 100 - expected_pct / 100) * (observed_pct / 100 - expected_pct / 100) / (expected_pct / 100)) * sum(count) AS chi, avg(abs(observed_pct / 100 - expected_pct / 100)) AS mad FROM bf GROUP BY place)", BEN,
)(digits.benford_test)
query(
    "ben03_entries",
    f"SELECT value, digit, lines, accounts FROM (SELECT abs(amount) AS value, CAST(({PLAIN})[1] AS INT) AS digit, count(*) AS lines, count(DISTINCT account) AS accounts FROM ledger WHERE amount <> 0 GROUP BY 1, 2) WHERE digit IN (SELECT digit FROM bf WHERE place = 1 AND suspicious) ORDER BY lines DESC, value DESC LIMIT 100", BEN,
)(digits.benford_entries)
query(
    "ben04_round",
    " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS step, c AS count, {r('c / n * 100')} AS pct, c / n * 100 > {300 / s} AS suspicious FROM (SELECT count(*) FILTER (abs(amount) >= {s} AND abs(amount) % {s} = 0) AS c, count(*) FILTER (amount <> 0) AS n FROM ledger)" for s in (100, 1000, 10000)),
)(digits.benford_round)

query(
    "drl01_detail",
    "SELECT CAST(date AS VARCHAR) AS date, account, voucher, label, amount, all_debit, all_credit, all_lines, all_debit - all_credit AS balance FROM (SELECT * FROM ledger WHERE starts_with(account, '613') ORDER BY abs(amount) DESC, date, voucher, account, label LIMIT 50), "
    "(SELECT sum(debit) AS all_debit, sum(credit) AS all_credit, count(*) AS all_lines FROM ledger WHERE starts_with(account, '613'))",
)(lambda led: drill.detail(led, "613200"))
query(
    "drl02_trend",
    f"SELECT period, net, lines, {r('avg(CAST(net AS DOUBLE)) OVER ()')} AS mean, {r('stddev_samp(CAST(net AS DOUBLE)) OVER ()', 2)} AS std, abs(net) = max(abs(net)) OVER () AS largest FROM (SELECT period, sum(amount) AS net, count(*) AS lines FROM ledger WHERE year = {YEAR} AND starts_with(account, '613') GROUP BY period)",
)(lambda led: drill.trend(led, "613200", YEAR))
query(
    "drl03_half_year",
    f"SELECT account, s1, s2, s2 - s1 AS variation, {r('coalesce(CAST(s2 - s1 AS DOUBLE) / nullif(abs(CAST(s1 AS DOUBLE)), 0), 0) * 100', 2)} AS variation_pct FROM (SELECT account, coalesce(sum(amount) FILTER (month <= 6), 0) AS s1, coalesce(sum(amount) FILTER (month > 6), 0) AS s2 FROM ledger WHERE year = {YEAR} GROUP BY account)",
)(lambda led: drill.half_year(led, YEAR))
query(
    "drl04_counterparties",
    "SELECT third_party, sum(abs(amount)) AS volume, count(*) AS lines FROM ledger WHERE third_party IS NOT NULL AND voucher IN (SELECT voucher FROM ledger WHERE starts_with(account, '613')) GROUP BY third_party ORDER BY volume DESC, third_party LIMIT 10",
)(lambda led: drill.counterparties(led, "613200"))
query(
    "drl05_breakdown",
    f"SELECT prefix_2, account, volume, {r('CAST(volume AS DOUBLE) / CAST(sum(volume) OVER () AS DOUBLE) * 100', 1)} AS share_pct FROM (SELECT prefix_2, account, sum(abs(amount)) AS volume FROM ledger WHERE year = {YEAR} AND class = '6' GROUP BY ALL)",
)(lambda led: drill.breakdown(led, YEAR))
