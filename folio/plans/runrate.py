"""Queries of the run-rate, comparison and bridge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import runrate as o
from folio.plans.registry import BEFORE, ORACLES, YEAR, query, r


def grid(y: int, n: str = "") -> str:
    return f"""p{n} AS (SELECT * FROM ledger WHERE year = {y} AND class IN ('6', '7')),
g{n} AS (SELECT a.account, m.period, coalesce(v, 0) AS value FROM (SELECT DISTINCT account FROM p{n}) a CROSS JOIN (SELECT DISTINCT period FROM p{n}) m
  LEFT JOIN (SELECT account, period, sum(pnl_amount) AS v FROM p{n} GROUP BY ALL) s ON s.account = a.account AND s.period = m.period)"""


def prov(y: int, n: str = "") -> str:
    return (
        grid(y, n)
        + f""",
f{n} AS (SELECT account, sum(value) AS total, sum(value) FILTER (period = '{y}-12') AS december, CAST(avg(CAST(value AS DOUBLE)) FILTER (period <> '{y}-12') AS DOUBLE) AS mean_other FROM g{n} WHERE account[1] = '6' GROUP BY account),
prov{n} AS (SELECT account, total, december, {r('mean_other')} AS mean_other, {r('december - mean_other')} AS gap, {r('CAST(total AS DOUBLE) / 12')} AS run_rate, {r('CAST(total AS DOUBLE) / 12 - december')} AS impact
  FROM f{n} WHERE abs(CAST(december AS DOUBLE) - mean_other) >= 2000)"""
    )


def norm(y: int, n: str = "") -> str:
    return (
        prov(y, n)
        + f""",
d{n} AS (SELECT CAST(coalesce(sum(pnl_amount) FILTER (class = '6'), 0) AS DOUBLE) AS c, CAST(coalesce(sum(pnl_amount) FILTER (class = '7'), 0) AS DOUBLE) AS p FROM p{n} WHERE period = '{y}-12'),
a{n} AS (SELECT round(coalesce(sum(impact), 0), 2) AS adj, count(*) AS k FROM prov{n}),
norm{n} AS (SELECT CAST({y} AS INT) AS year, {r('c', 2)} AS gross_charges, {r('p', 2)} AS gross_products, {r('p - c', 2)} AS gross_result, adj + 0 AS adjustment, k AS adjusted_accounts,
  {r('c + adj', 2)} AS normalized_charges, {r('p', 2)} AS normalized_products, {r('p - c - adj', 2)} AS normalized_result FROM d{n}, a{n})"""
    )


def anomalies(y: int, n: str = "") -> str:
    return f"""s{n} AS (SELECT account, period, value, CAST(value AS DOUBLE) AS v, avg(CAST(value AS DOUBLE)) OVER (PARTITION BY account) AS mean, stddev_pop(CAST(value AS DOUBLE)) OVER (PARTITION BY account) AS std FROM g{n} WHERE account[1] = '6'),
z{n} AS (SELECT *, v - mean AS gap, (v - mean) / std AS z, CASE WHEN mean = 0 THEN 0 ELSE (v - mean) / mean * 100 END AS pct FROM s{n} WHERE std >= 100),
an{n} AS (SELECT account, period, value, {r('mean')} AS mean, {r('std')} AS std, {r('z')} AS z, {r('gap')} AS gap, {r('pct')} AS gap_pct, CASE WHEN z > 0 THEN 'EXCES' ELSE 'DEFICIT' END AS kind,
  CASE WHEN z > 0 AND pct > 100 THEN 'Probable provision oubliée ou facture exceptionnelle' WHEN z > 0 AND pct > 50 THEN 'Charge concentrée - vérifier la nature' WHEN z > 0 THEN 'Légèrement supérieur à la moyenne'
    WHEN pct < -50 THEN 'Probable sur-provisionnement antérieur ou reprise' WHEN pct < -30 THEN 'Charge sous moyenne - régularisation possible' ELSE 'Légèrement inférieur à la moyenne' END AS wording
  FROM z{n} WHERE abs(z) >= 1.5 AND abs(gap) >= 2000 AND abs(pct) >= 30)"""


query("run01_monthly", "SELECT account, period, value FROM g", grid(YEAR))(lambda led: o.monthly(led, YEAR))
query("run02_provisions", "SELECT * FROM prov", prov(YEAR))(lambda led: o.provisions(led, YEAR))
query("run03_month_anomalies", "SELECT * FROM an", grid(YEAR) + ", " + anomalies(YEAR))(lambda led: o.month_anomalies(led, YEAR))
query("run04_normalized_december", "SELECT * FROM norm", norm(YEAR))(lambda led: o.normalized_december(led, YEAR))
V = "CAST(value AS DOUBLE)"
M12 = f"coalesce(sum({V}) FILTER (period = '{YEAR}-12'), 0)"
query(
    "run05_monthly_comparison",
    "SELECT account, " + ", ".join(f"coalesce(sum({V}) FILTER (period = '{YEAR}-{m:02d}'), 0) AS m{m:02d}" for m in range(1, 13))
    + f", {r('sum(value)', 2)} AS total, {r(f'avg({V})')} AS mean, {r(f'stddev_samp({V})')} AS std, {r(f'{M12} - avg({V})')} AS december_gap, "
    f"{r(f'CASE WHEN avg({V}) = 0 THEN 0 ELSE ({M12} - avg({V})) / abs(avg({V})) * 100 END')} AS december_gap_pct, {r('CAST(sum(value) AS DOUBLE) / 12')} AS run_rate, {r(f'CAST(sum(value) AS DOUBLE) / 12 - {M12}')} AS impact FROM g GROUP BY account",
    grid(YEAR),
)(lambda led: o.monthly_comparison(led, YEAR))
DEC = f"coalesce(sum(pnl_amount) FILTER (period = '{YEAR}-12'), 0)"
query(
    "run06_by_axis",
    f"SELECT site AS axis_value, sum(pnl_amount) AS total, {DEC} AS december, {r('CAST(sum(pnl_amount) AS DOUBLE) / 12')} AS run_rate, {r(f'CAST({DEC} AS DOUBLE) - CAST(sum(pnl_amount) AS DOUBLE) / 12')} AS gap, "
    f"{r('CAST(sum(pnl_amount) AS DOUBLE) / CAST(sum(sum(pnl_amount)) OVER () AS DOUBLE) * 100')} AS share_pct FROM ledger WHERE year = {YEAR} AND class = '6' GROUP BY site",
)(lambda led: o.by_axis(led, YEAR, "site"))
query(
    "run07_axis_summary",
    " UNION ALL ".join(
        f"SELECT '{a}' AS axis, {a} AS axis_value, count(*) AS lines, sum(pnl_amount) AS total, {DEC} AS december, {r('CAST(sum(pnl_amount) AS DOUBLE) / 12')} AS run_rate FROM ledger WHERE year = {YEAR} AND class = '6' GROUP BY {a}"
        for a in ("site", "journal")
    ),
)(lambda led: o.axis_summary(led, YEAR, ["site", "journal"]))
query(
    "run08_provisions_by_axis",
    f"SELECT site, account, total, december, {r('mo')} AS mean_other, {r('december - mo')} AS gap, {r('CAST(total AS DOUBLE) / 12')} AS run_rate, {r('CAST(total AS DOUBLE) / 12 - december')} AS impact "
    "FROM (SELECT site, account, total, december, CASE WHEN months = hd THEN 0 ELSE CAST(total - december AS DOUBLE) / (months - hd) END AS mo FROM t JOIN m USING (site)) WHERE abs(CAST(december AS DOUBLE) - mo) >= 2000",
    f"t AS (SELECT site, account, sum(pnl_amount) AS total, {DEC} AS december FROM ledger WHERE year = {YEAR} AND class = '6' GROUP BY ALL), "
    f"m AS (SELECT site, count(DISTINCT period) AS months, max(CASE WHEN period = '{YEAR}-12' THEN 1 ELSE 0 END) AS hd FROM ledger WHERE year = {YEAR} AND class = '6' GROUP BY site)",
)(lambda led: o.provisions(led, YEAR, axis="site"))
query(
    "run09_yearly_run_rate",
    f"SELECT class, prefix_2, abs(sum(amount)) AS total, {r('CAST(abs(sum(amount)) AS DOUBLE) / 12')} AS run_rate, {r('CAST(abs(sum(amount)) AS DOUBLE) / CAST(sum(abs(sum(amount))) OVER (PARTITION BY class) AS DOUBLE) * 100')} AS share_pct "
    f"FROM ledger WHERE year = {YEAR} AND class IN ('6', '7') GROUP BY class, prefix_2",
)(lambda led: o.yearly_run_rate(led, YEAR))
query(
    "run10_describe",
    f"SELECT account, december, mean_other, {r('CASE WHEN mean_other = 0 THEN 0 ELSE gap / abs(mean_other) * 100 END', 2)} AS deviation_pct FROM prov", prov(YEAR),
)(lambda led: o.describe_provisions(led, YEAR))
query("cmp01_detect_year", "SELECT year FROM (SELECT year, count(*) AS n FROM ledger GROUP BY year) ORDER BY n DESC, year LIMIT 1")(o.detect_year)
BOTH = norm(YEAR, "1") + ", " + norm(BEFORE, "0")
query(
    "cmp02_compare_years",
    "SELECT a.gross_result AS gross_result_n, a.normalized_result AS normalized_result_n, a.adjustment AS adjustment_n, b.gross_result AS gross_result_n1, b.normalized_result AS normalized_result_n1, b.adjustment AS adjustment_n1, "
    f"{r('a.gross_result - b.gross_result', 2)} AS gross_variation, {r('a.normalized_result - b.normalized_result', 2)} AS normalized_variation, "
    f"{r('(a.gross_result - b.gross_result) - (a.normalized_result - b.normalized_result)', 2)} AS artefact FROM norm1 a, norm0 b",
    BOTH,
)(lambda led: o.compare_years(led, YEAR, BEFORE))
LINES = ("gross_charges", "gross_products", "gross_result", "adjustment", "adjusted_accounts", "normalized_charges", "normalized_products", "normalized_result")
EXTRA = [
    ("adjustment_pct", "CASE WHEN {t}.gross_result = 0 THEN 0 ELSE {t}.adjustment / abs({t}.gross_result) * 100 END"),
    ("result_change", "{t}.normalized_result - {t}.gross_result"),
    ("normalized_margin_pct", "CASE WHEN {t}.normalized_products = 0 THEN 0 ELSE {t}.normalized_result / {t}.normalized_products * 100 END"),
]
ROWS = [(c, "{t}." + c) for c in LINES] + EXTRA
query(
    "cmp03_reconciliation",
    " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INT) AS line, '{name}' AS name, {r(e.format(t='a'), 2)} AS n, {r(e.format(t='b'), 2)} AS n1, {r(e.format(t='a') + ' - (' + e.format(t='b') + ')', 2)} AS variation FROM norm1 a, norm0 b"
        for i, (name, e) in enumerate(ROWS)
    ),
    BOTH,
)(lambda led: o.reconciliation(led, YEAR, BEFORE))
query(
    "cmp04_both_years",
    " UNION ALL ".join(
        f"SELECT CAST({y} AS INT) AS year, 'PROVISION' AS kind, account, {r('december', 2)} AS december, gap FROM prov{n} UNION ALL "
        f"SELECT CAST({y} AS INT), 'ANOMALIE_' || kind, account, {r('value', 2)}, gap FROM an{n} WHERE period = '{y}-12'"
        for y, n in ((YEAR, "1"), (BEFORE, "0"))
    ),
    ", ".join([prov(YEAR, "1"), anomalies(YEAR, "1"), prov(BEFORE, "0"), anomalies(BEFORE, "0")]),
)(lambda led: o.both_years(led, YEAR, BEFORE))
WORD = r"(^|[^\p{L}\p{N}_])"
NOISE = "|".join(o.LABEL_NOISE).replace("'", "''")
NORM = rf"regexp_replace(trim(regexp_replace(regexp_replace(trim(upper(label)), '(?i){NOISE}', '', 'g'), '\s+', ' ', 'g')), '[.\-_/\\]+$', '')"
BRIDGE = f"""b AS (SELECT account, month, coalesce(nullif({NORM}, ''), 'AUTRE') AS norm, year, pnl_amount FROM ledger WHERE year IN ({YEAR}, {BEFORE}) AND class IN ('6', '7')),
br0 AS (SELECT account, month, norm, sum(pnl_amount) FILTER (year = {YEAR}) AS a, sum(pnl_amount) FILTER (year = {BEFORE}) AS b, count(*) FILTER (year = {YEAR}) AS ln, count(*) FILTER (year = {BEFORE}) AS lb FROM b GROUP BY ALL),
br AS (SELECT account, month, norm, coalesce(a, 0) AS amount_n, ln AS lines_n, coalesce(b, 0) AS amount_n1, lb AS lines_n1,
  CASE WHEN lb = 0 THEN 'NOUVELLE' WHEN ln = 0 THEN 'DISPARUE' WHEN abs(a - b) >= 1 THEN 'VARIEE' ELSE 'STABLE' END AS status, coalesce(a, 0) - coalesce(b, 0) AS variation FROM br0)"""
query("brg01_normalize_label", f"SELECT DISTINCT label, coalesce(nullif({NORM}, ''), 'AUTRE') AS norm FROM ledger")(
    lambda led: led.select("label").distinct().select("label", o.normalize_label(F.col("label")).alias("norm"))
)
query("brg02_bridge", "SELECT * FROM br", BRIDGE)(lambda led: o.bridge(led, YEAR, BEFORE))
PARTS = ", ".join(f"coalesce(sum(variation) FILTER (status = '{s}'), 0) AS {n}" for s, n in (("NOUVELLE", "new"), ("DISPARUE", "gone"), ("VARIEE", "changed")))
query(
    "brg03_bridge_check",
    "SELECT *, abs(n1 + new + gone + changed - n) AS gap, abs(n1 + new + gone + changed - n) < 0.01 AS reconciled FROM "
    f"(SELECT account, month, sum(amount_n) AS n, sum(amount_n1) AS n1, {PARTS} FROM br GROUP BY ALL)",
    BRIDGE,
)(lambda led: o.bridge_check(o.bridge(led, YEAR, BEFORE)))
query(
    "brg04_top_variations",
    f"SELECT *, n - n1 AS variation FROM (SELECT account, coalesce(sum(pnl_amount) FILTER (year = {YEAR}), 0) AS n, coalesce(sum(pnl_amount) FILTER (year = {BEFORE}), 0) AS n1 FROM ledger WHERE year IN ({YEAR}, {BEFORE}) AND class = '6' GROUP BY account) ORDER BY abs(n - n1) DESC, account LIMIT 10",
)(lambda led: o.top_variations(led, YEAR, BEFORE))
query("brg04b_top_bridge", f"SELECT * FROM br WHERE account IN (SELECT account FROM ({ORACLES['brg04_top_variations']}))", BRIDGE)(lambda led: o.top_bridge(led, YEAR, BEFORE))
