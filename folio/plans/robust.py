"""Queries of the profiling and robust-statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import robust as o
from folio.plans.registry import YEAR, query, r


def months(key: str = "account", year: int | None = YEAR, name: str = "m") -> str:
    return f"{name} AS (SELECT {key}, period, month, CAST(sum(amount) AS DOUBLE) AS v FROM ledger {f'WHERE year = {year}' if year else ''} GROUP BY ALL)"


X = "CAST({c} AS DOUBLE)"
query(
    "prf01_profile_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", {r(f'avg({x})', 2)} AS mean, {r(f'stddev_samp({x})', 2)} AS std, {r(f'min({x})', 2)} AS min, {r(f'max({x})', 2)} AS max, "
        f"{r(f'quantile_cont({x}, 0.25)')} AS q1, {r(f'quantile_cont({x}, 0.5)')} AS q2, {r(f'quantile_cont({x}, 0.75)')} AS q3, {r(f'skewness({x})', 3)} AS skew, {r(f'kurtosis({x})', 3)} AS kurtosis, NULL AS mode FROM ledger"
        for c in ("debit", "amount") for x in (X.format(c=c),)
    )
    + "".join(
        f" UNION ALL SELECT '{c}', count({c}), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT {c} FROM ledger WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) FROM ledger"
        for c in ("journal", "third_party")
    ),
)(lambda led: o.profile_columns(led, ["debit", "amount"], ["journal", "third_party"]))
query(
    "prf02_profile_accounts",
    f"""SELECT account, entries, active_months, debit, credit, {r('m', 6)} AS mean, median, std, min, max, {r('mm', 6)} AS monthly_mean, {r('ms', 2)} AS monthly_std, {r('cv')} AS monthly_cv, min_month, max_month, {r('rg')} AS monthly_range,
  {r('dec')} AS december_pct, {r('season')} AS seasonality, {r('greatest(1 - season, 0)')} AS regularity,
  CASE WHEN greatest(1 - season, 0) > 0.7 THEN 'regulier' WHEN season > 0.5 THEN 'saisonnier' WHEN active_months <= 2 THEN 'ponctuel' ELSE 'irregulier' END AS behavior,
  {r('least((CASE WHEN dec > 50 THEN 0.4 ELSE 0 END) + (CASE WHEN season > 0.6 THEN 0.3 ELSE 0 END) + (CASE WHEN active_months < 6 THEN 0.3 ELSE 0 END), 1)')} AS risk FROM both_""",
    months()
    + f""", l AS (SELECT account, count(*) AS entries, sum(debit) AS debit, sum(credit) AS credit, avg(abs(CAST(amount AS DOUBLE))) AS m, {r('quantile_cont(abs(CAST(amount AS DOUBLE)), 0.5)')} AS median, {r('stddev_samp(abs(CAST(amount AS DOUBLE)))', 2)} AS std,
  {r('min(abs(amount))')} AS min, {r('max(abs(amount))')} AS max FROM ledger WHERE year = {YEAR} GROUP BY account),
mo AS (SELECT account, count(*) AS active_months, avg(abs(v)) AS mm, stddev_samp(abs(v)) AS ms, arg_min(period, (abs(v), period)) AS min_month, arg_min(period, (-abs(v), period)) AS max_month, max(abs(v)) - min(abs(v)) AS rg,
  coalesce(sum(abs(v)) FILTER (month = 12), 0) / sum(abs(v)) * 100 AS dec FROM m GROUP BY account),
both_ AS (SELECT *, round(coalesce(ms / mm * 100, 0), 6) AS cv, least(round(coalesce(ms / mm * 100, 0), 6) / 100, 1) AS season FROM l JOIN mo USING (account))""",
)(lambda led: o.profile_accounts(led, YEAR))
query(
    "prf03_baseline",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS lines, sum(amount) AS net, count(DISTINCT account) AS accounts FROM ledger WHERE year = {YEAR} GROUP BY {c}"
        for d, c in (("month", "period"), ("class", "class"), ("journal", "journal"), ("total", "year"))
    ),
)(lambda led: o.baseline(led, YEAR))
query(
    "prf04_prefix_thresholds", f"SELECT prefix_2, {r('CASE WHEN coalesce(stddev_samp(v), 0) > 0 THEN 2 * stddev_samp(v) ELSE 1000 END')} AS threshold FROM m GROUP BY prefix_2 HAVING count(*) > 2", months("prefix_2")
)(lambda led: o.prefix_thresholds(led, YEAR))
QUALITY = ("date", "account", "journal", "label", "third_party")
query(
    "prf05_quality",
    "SELECT null_pct, warned, CASE WHEN null_pct < 2 THEN 'A' WHEN null_pct < 5 THEN 'B' WHEN null_pct < 10 THEN 'C' WHEN null_pct < 20 THEN 'D' ELSE 'E' END AS grade FROM (SELECT "
    + r("(" + " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100" for c in QUALITY) + f") / {len(QUALITY)}")
    + " AS null_pct, concat_ws(',', " + ", ".join(f"CASE WHEN avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100 > 1 THEN '{c}' END" for c in QUALITY) + ") AS warned FROM ledger)",
)(lambda led: o.quality(led, list(QUALITY)))
#: Lines without a date or an account, as an export has them, so that there is something to warn of.
HOLES = "hl AS (SELECT * REPLACE (CASE WHEN journal = 'SAL' THEN NULL ELSE date END AS date, CASE WHEN journal = 'AN' AND debit > 0 THEN NULL ELSE credit END AS credit) FROM ledger)"
NULLS = " UNION ALL ".join(
    f"SELECT 'warning' AS kind, {i} AS rank, 'Colonne critique ''{c}'' a ' || printf('%.1f', {r('p', 1)}) || '% de valeurs manquantes' AS text FROM (SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100 AS p FROM hl) WHERE p > 1" for i, c in enumerate(o.CRITICAL, 1)
)
query(
    "prf05b_advice",
    f"{NULLS} UNION ALL SELECT 'warning', 5, n || ' comptes identifiés à haut risque d''anomalie' FROM ct WHERE n > 0 UNION ALL SELECT 'recommendation', 6, 'Vérifier en priorité les comptes: ' || named FROM ct WHERE n > 0 UNION ALL SELECT 'recommendation', 7, h || ' comptes avec >80% de mouvement en décembre' FROM ct WHERE h > 0",
    f"""{HOLES}, pf AS (SELECT account, coalesce(sum(abs(v)) FILTER (month = 12), 0) / sum(abs(v)) * 100 AS dec, round(coalesce(stddev_samp(abs(v)) / nullif(avg(abs(v)), 0) * 100, 0), 6) AS cv, count(*) AS n FROM (SELECT account, month, CAST(sum(amount) AS DOUBLE) AS v FROM ledger WHERE year = {YEAR} GROUP BY ALL) GROUP BY account),
pr AS (SELECT account, {r('dec')} AS dec, {r('least((CASE WHEN dec > 50 THEN 0.4 ELSE 0 END) + (CASE WHEN least(cv / 100, 1) > 0.6 THEN 0.3 ELSE 0 END) + (CASE WHEN n < 6 THEN 0.3 ELSE 0 END), 1)')} AS risk FROM pf),
ct AS (SELECT count(*) FILTER (risk > {o.HIGH_RISK}) AS n, count(*) FILTER (dec > {o.DECEMBER_HEAVY}) AS h, array_to_string(list_sort(list(account) FILTER (risk > {o.HIGH_RISK}))[1:5], ', ') AS named FROM pr)""",
)(lambda led: o.profile_advice(led.withColumn("date", F.when(F.col("journal") != "SAL", F.col("date"))).withColumn("credit", F.when((F.col("journal") != "AN") | (F.col("debit") <= 0), F.col("credit"))), YEAR))
MAD = months() + """, c AS (SELECT account, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS sd FROM m GROUP BY account HAVING count(*) >= 3),
sp AS (SELECT account, quantile_cont(abs(v - median), 0.5) AS raw FROM m JOIN c USING (account) GROUP BY account),
sc AS (SELECT account, period, median, CASE WHEN raw = 0 THEN sd / 0.6745 ELSE raw END AS mad, coalesce(abs(0.6745 * (v - median) / nullif(CASE WHEN raw = 0 THEN sd / 0.6745 ELSE raw END, 0)), 0) AS score FROM m JOIN c USING (account) JOIN sp USING (account)),
""" + f"mad AS (SELECT account, {r('any_value(median)', 6)} AS median, {r('any_value(mad)', 6)} AS mad, {r('max(score)', 3)} AS score, max(score) > 3 AS is_anomaly, coalesce(string_agg(period, ',' ORDER BY period) FILTER (score > 3), '') AS months FROM sc GROUP BY account)"
IQR = """q0 AS (SELECT account, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY account HAVING count(*) >= 4),
q AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q0),
""" + f"iqr AS (SELECT account, {', '.join(f'{r(c, 6)} AS {c}' for c in ('q1', 'q3', 'iqr', 'lower', 'upper'))}, coalesce(string_agg(period, ',' ORDER BY period) FILTER (v < q.lower), '') AS low_months, coalesce(string_agg(period, ',' ORDER BY period) FILTER (v > q.upper), '') AS high_months FROM m JOIN q USING (account) GROUP BY account, q1, q3, iqr, q.lower, q.upper)"
query("sta01_mad", "SELECT * FROM mad", MAD)(lambda led: o.mad(led, YEAR))
query("sta02_iqr", "SELECT * FROM iqr", months() + ", " + IQR)(lambda led: o.iqr(led, YEAR))
IDX = lambda k: f"coalesce(max(i) FILTER (month = {k}), 1)"
query(
    "sta03_seasonality",
    f"""SELECT account, CASE WHEN sd < 0.15 THEN 'none' WHEN dec > 2 THEN 'annual' WHEN quarter > 1.3 * other THEN 'quarterly' WHEN sd > 0.4 THEN 'irregular' ELSE 'monthly' END AS pattern, {r('mean', 2)} AS trend,
  {r('CASE WHEN var > 0 THEN least(greatest(1 - rvar / var, 0), 1) ELSE 0 END')} AS strength, peaks, troughs, {r('sqrt(rvar)', 2)} AS residual_std FROM st JOIN sh USING (account)""",
    months(year=None)
    + f""", s AS (SELECT *, avg(v) OVER (PARTITION BY account) AS mean, count(*) OVER (PARTITION BY account) AS n FROM m),
idx AS (SELECT account, month, avg(v) / any_value(mean) AS i FROM s WHERE n >= 6 AND round(mean, 6) <> 0 GROUP BY ALL),
st AS (SELECT account, any_value(mean) AS mean, var_pop(v) AS var, var_pop(v - mean * i) AS rvar FROM s JOIN idx USING (account, month) GROUP BY account),
rk AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY -round(i, 9), month) AS rn, count(*) OVER (PARTITION BY account) AS k FROM idx),
sh AS (SELECT account, stddev_pop(i) AS sd, {IDX(12)} AS dec, ({' + '.join(IDX(k) for k in (3, 6, 9, 12))}) / 4 AS quarter, ({' + '.join(IDX(k) for k in (1, 2, 4, 5, 7, 8, 10, 11))}) / 8 AS other,
  coalesce(string_agg(CAST(month AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3 AND round(i, 9) > 1), '') AS peaks, coalesce(string_agg(CAST(month AS VARCHAR), ',' ORDER BY rn) FILTER (rn > greatest(k - 3, 0) AND round(i, 9) < 1), '') AS troughs FROM rk GROUP BY account)""",
)(o.seasonality)
query(
    "sta04_behavior_cluster",
    f"""SELECT account, {r('cv')} AS cv, {r('c')} AS concentration, active AS active_months, {r('coalesce(skew, 0)')} AS skew,
  CASE WHEN active <= 2 THEN 'dormant' WHEN c > 80 THEN 'concentrated' WHEN cv < 20 THEN 'stable' WHEN cv > 80 THEN 'volatile' WHEN c > 30 AND c < 60 AND cv > 20 AND cv < 50 THEN 'seasonal' WHEN cv > 40 THEN 'volatile' ELSE 'stable' END AS cluster,
  CAST(CASE WHEN active <= 2 THEN 0.9 WHEN c > 80 THEN 0.85 WHEN cv < 20 THEN 0.8 WHEN cv > 80 THEN 0.75 WHEN c > 30 AND c < 60 AND cv > 20 AND cv < 50 THEN 0.7 WHEN cv > 40 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM f""",
    months()
    + """, s AS (SELECT *, avg(abs(v)) OVER (PARTITION BY account) AS mean, stddev_pop(abs(v)) OVER (PARTITION BY account) AS std FROM m),
f AS (SELECT account, any_value(std) / any_value(mean) * 100 AS cv, max(abs(v)) / sum(abs(v)) * 100 AS c, count(*) FILTER (abs(v) > 0) AS active, abs(avg(CASE WHEN std > 0 THEN power((abs(v) - mean) / std, 3) END)) AS skew FROM s GROUP BY account HAVING count(*) >= 2)""",
)(lambda led: o.behavior_cluster(led, YEAR))
query(
    "sta05_robust",
    "SELECT account, 'mad' AS method, months FROM mad WHERE is_anomaly UNION ALL SELECT account, 'iqr', array_to_string(list_sort(list_filter(string_split(low_months, ',') || string_split(high_months, ','), lambda x: x <> '')), ',') FROM iqr WHERE low_months <> '' OR high_months <> ''",
    MAD + ", " + IQR,
)(lambda led: o.robust(led, YEAR))
NEAR = " OR ".join(f"(a >= {k} AND least(fmod(a, {k}), {k} - fmod(a, {k})) <= {0.01 * k})" for k in (1000, 500, 100))
query("sta07_is_round", f"SELECT account, count(*) AS lines, count(*) FILTER (a > 0 AND ({NEAR})) AS round_lines FROM (SELECT account, abs(CAST(amount AS DOUBLE)) AS a FROM ledger) GROUP BY account")(
    lambda led: led.groupBy("account").agg(F.count("*").alias("lines"), F.count_if(o.is_round(F.col("amount"))).alias("round_lines"))
)
query(
    "sta07b_same_amount",
    "SELECT account, months, near, near >= 3 AS same FROM (SELECT account, months, count(*) FILTER (months >= 3 AND median <> 0 AND abs(v - median) <= 0.1 * abs(median)) AS near FROM m JOIN (SELECT account, quantile_cont(v, 0.5) AS median, count(*) AS months FROM m GROUP BY account) USING (account) GROUP BY account, months)",
    months(year=None),
)(lambda led: o.same_amount(led, 3, 0.1))
CONF = months("prefix_3 AS family", None) + f""", w AS (SELECT *, period = max(period) OVER (PARTITION BY family) AS new FROM m),
c AS (SELECT family, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS sd, stddev_samp(v) AS ss, avg(v) AS mean, count(*) AS n FROM w WHERE NOT new GROUP BY family),
sp AS (SELECT family, quantile_cont(abs(v - median), 0.5) AS raw FROM w JOIN c USING (family) WHERE NOT new GROUP BY family),
j AS (SELECT w.*, c.n, c.mean, c.ss, c.median, round(abs(v - median) / (CASE WHEN raw > 0 THEN raw WHEN sd > 0 THEN sd ELSE 1 END), 9) AS score FROM w JOIN c USING (family) JOIN sp USING (family)),
conf AS (SELECT a.family, any_value(a.period) AS period, {r('any_value(a.median)', 3)} AS median, {r('any_value(a.v)', 2)} AS value, {r('any_value(a.score)')} AS score, any_value(a.n) AS n, {r('CASE WHEN any_value(a.n) < 2 THEN 1 ELSE (1 + count(*) FILTER (b.score >= a.score)) / (1 + any_value(a.n)) END')} AS p_value,
  {r('coalesce(abs((any_value(a.v) - any_value(a.mean)) / nullif(any_value(a.ss), 0)), 0)')} AS z, CASE WHEN any_value(a.n) >= 6 THEN 'conformal' ELSE 'dead_band' END AS method FROM j a JOIN j b ON a.family = b.family AND NOT b.new WHERE a.new GROUP BY a.family)"""
query("sta09_conformal", "SELECT * FROM conf", CONF)(lambda led: o.conformal(led, None))
query(
    "sta11_bh_adjust",
    f"SELECT family, period, median, value, score, n, p_value, z, method, CAST(rank AS INT) AS rank, {r('least(min(p_value * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 1)', 6)} AS p_adjusted FROM (SELECT *, row_number() OVER (ORDER BY p_value, family) AS rank, count(*) OVER () AS m FROM conf)",
    CONF,
)(lambda led: o.bh_adjust(o.conformal(led, None)))
query(
    "sta12_discord",
    "SELECT family, any_value(months) AS months, arg_min(period, (-score, period)) AS start, max(score) AS score FROM s JOIN c USING (family) , LATERAL (SELECT round(abs(a - median), 4) + 0 AS score) WHERE k = 3 GROUP BY family",
    months("prefix_3 AS family", None)
    + ", s AS (SELECT family, period, avg(v) OVER w AS a, count(*) OVER w AS k FROM m WINDOW w AS (PARTITION BY family ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), c AS (SELECT family, quantile_cont(v, 0.5) AS median, count(*) AS months FROM m GROUP BY family)",
)(o.discord)
MP = months("prefix_3 AS family", None) + """, w0 AS (SELECT family, period AS start, row_number() OVER o AS i, [v, lead(v) OVER o, lead(v, 2) OVER o] AS x, count(*) OVER (PARTITION BY family) AS months FROM m WINDOW o AS (PARTITION BY family ORDER BY period)),
w1 AS (SELECT *, list_avg(x) AS mean, list_max(x) = list_min(x) AS flat FROM w0 WHERE months > 3 AND x[3] IS NOT NULL),
w AS (SELECT *, sqrt(list_avg(list_transform(x, lambda e: (e - mean) * (e - mean)))) AS sd FROM w1),
pr AS (SELECT a.family, a.start, b.start AS other, round(CASE WHEN a.flat AND b.flat THEN 0 WHEN a.flat OR b.flat THEN sqrt(3) ELSE sqrt(pow((a.x[1] - a.mean) / a.sd - (b.x[1] - b.mean) / b.sd, 2)
  + pow((a.x[2] - a.mean) / a.sd - (b.x[2] - b.mean) / b.sd, 2) + pow((a.x[3] - a.mean) / a.sd - (b.x[3] - b.mean) / b.sd, 2)) END, 4) + 0 AS d FROM w a JOIN w b ON a.family = b.family AND abs(a.i - b.i) > 1),
nr AS (SELECT family, start, min(d) AS distance, arg_min(other, (d, other)) AS nearest FROM pr GROUP BY ALL),
np AS (SELECT family, start, distance, nearest FROM w LEFT JOIN nr USING (family, start))"""
query(
    "sta12b_matrix_profile",
    f"SELECT a.family, a.start, a.distance, a.nearest, {r('CASE WHEN a.distance IS NOT NULL THEN count(*) FILTER (b.distance > a.distance) / count(b.distance) END')} AS p, "
    "a.distance IS NOT NULL AND a.start = arg_min(b.start, (-b.distance, b.start)) FILTER (b.distance IS NOT NULL) AS is_discord FROM np a JOIN np b USING (family) GROUP BY a.family, a.start, a.distance, a.nearest",
    MP,
)(o.matrix_profile)
TAIL = "greatest(least(2 * least(cume_dist() OVER (ORDER BY {c}), cume_dist() OVER (ORDER BY {c} DESC)), 1), 1 / (count(*) OVER () + 1))"
query(
    "sta13_ecod",
    f"SELECT account, {r('pe')} AS p_entries, {r('pv')} AS p_volume, {r('least(pe, pv)')} AS p FROM (SELECT account, {TAIL.format(c='entries')} AS pe, {TAIL.format(c='volume')} AS pv FROM (SELECT account, count(*) AS entries, sum(abs(amount)) AS volume FROM ledger WHERE year = {YEAR} GROUP BY account))",
)(lambda led: o.ecod(led, YEAR))
FEATURES = ("entries", "volume", "largest")
LEFT_OUT = lambda c: f"greatest(2 * least((count(*) OVER (ORDER BY {c}) - 1) / (count(*) OVER () - 1), (count(*) OVER (ORDER BY {c} DESC) - 1) / (count(*) OVER () - 1)), 1 / count(*) OVER ())"
query(
    "sta13b_ecod_outliers",
    f"SELECT account, {', '.join(r(f'p_{c}', 6) + f' AS p_{c}' for c in FEATURES)}, {r('least(p_entries, p_volume, p_largest)', 6)} AS p FROM (SELECT account, {', '.join(f'{LEFT_OUT(c)} AS p_{c}' for c in FEATURES)} "
    f"FROM (SELECT account, CAST(count(*) AS DOUBLE) AS entries, CAST(sum(abs(amount)) AS DOUBLE) AS volume, CAST(max(abs(amount)) AS DOUBLE) AS largest FROM ledger GROUP BY account)) WHERE least(p_entries, p_volume, p_largest) < 0.15",
)(lambda led: o.ecod_outliers(led.groupBy("account").agg(F.count("*").alias("entries"), F.sum(F.abs("amount")).alias("volume"), F.max(F.abs("amount")).alias("largest")), "account", list(FEATURES), 0.15))
query(
    "prf01b_top_values",
    " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INT) AS rank, CAST({c} AS VARCHAR) AS value, count(*) AS lines FROM ledger WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) <= 10)" for c in ("journal", "third_party", "label", "account")),
)(lambda led: o.top_values(led, ["journal", "third_party", "label", "account"]))
