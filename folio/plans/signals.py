"""Queries of the statistical signals."""

from __future__ import annotations

from folio.operators import signals as o
from folio.operators.crystallinity import TYPICAL
from folio.plans.registry import YEAR, case, in_list, query, r, values
from folio.plans.robust import CONF, months

KNOWN = [u for u, _, _ in o.UNIVERSES]
U = case([(f"family IN {in_list(fs)}", f"'{u if u in KNOWN else 'COMPOSITE'}'") for u, fs in TYPICAL.items()], "'COMPOSITE'")
ROW = "id, family, universe, test, period, metric, threshold, delta, p_value, method"


def signal(test: str, period: str, metric: str, threshold: str, delta: str, p: str, method: str) -> str:
    return (
        f"SELECT concat_ws('_', '{test}', family, {period}) AS id, family, {U} AS universe, '{test}' AS test, CAST({period} AS VARCHAR) AS period, {r(metric, 3)} AS metric, {r(threshold, 3)} AS threshold, "
        f"{r(delta, 3)} AS delta, CAST({p} AS DOUBLE) AS p_value, {method} AS method"
    )


ALPHA = 0.2
SIG = f"""{CONF}, fs AS (SELECT family, period, {r('v', 2)} AS v, {U} AS universe FROM (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM m) WHERE n >= 2),
s1 AS ({signal('L2-VAR', 'period', 'value', 'median', 'abs(value - median)', "CASE WHEN method = 'conformal' THEN p_value END", 'method')} FROM conf WHERE (method = 'conformal' AND p_value < {ALPHA}) OR (method = 'dead_band' AND n >= 2 AND z > 3.5)),
dm AS (SELECT family, quantile_cont(v, 0.5) AS median, count(*) AS months FROM m GROUP BY family),
dw AS (SELECT family, period, avg(v) OVER w AS a, count(*) OVER w AS k FROM m WINDOW w AS (PARTITION BY family ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
ds AS (SELECT family, any_value(median) AS median, any_value(months) AS months, arg_min(period, (-score, period)) AS start, max(score) AS score FROM (SELECT family, period, median, months, k, round(abs(a - median), 4) AS score FROM dw JOIN dm USING (family)) WHERE k = 3 GROUP BY family),
s2 AS ({signal('L2-DISCORD', 'start', 'v', 'median', 'score', '0.0', "'discord'")} FROM (SELECT ds.*, m.v FROM ds JOIN m ON m.family = ds.family AND m.period = ds.start) WHERE months >= 6 AND {U} IN ('CRISTALLIN', 'PROCESSUS')),
s3 AS ({signal('L2-MISSING', 'y', 'k', '12', '12 - k', f"CASE WHEN 12 - k >= 2 THEN {r('greatest(1 - (12 - k) / 12, 0.01)')} END", "'rule_based'")} FROM (SELECT family, period[1:4] AS y, count(*) AS k FROM m GROUP BY ALL) WHERE k >= 2 AND k < 12 AND {U} = 'CRISTALLIN'),
sh AS (SELECT * FROM (SELECT family, period, round(coalesce(abs(v) / nullif(sum(abs(v)) OVER (PARTITION BY family), 0), 0), 9) AS s, count(*) OVER (PARTITION BY family) AS n FROM fs) WHERE n >= 3),
sc AS (SELECT family, quantile_cont(s, 0.5) AS median, stddev_pop(s) AS sd, max(s) AS top, any_value(n) AS n, arg_min(period, (-s, period)) AS period FROM sh GROUP BY family),
sm AS (SELECT family, quantile_cont(abs(s - median), 0.5) AS mad FROM sh JOIN sc USING (family) GROUP BY family),
sf AS (SELECT sc.family, sc.top, sc.period, sc.n, count(*) FILTER (round(abs(s - median) / (CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END), 9) >= round(abs(top - median) / (CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END), 9)) AS far
  FROM sh JOIN sc USING (family) JOIN sm USING (family) GROUP BY sc.family, sc.top, sc.period, sc.n),
s4 AS ({signal('L2-CONC', 'period', 'top', 'lim', 'top - lim', r('(1 + far) / (1 + n)'), "'conformal'")} FROM (SELECT *, CASE WHEN {U} = 'PONCTUEL' THEN 0.8 ELSE 0.5 END AS lim FROM sf) WHERE top > lim AND {U} <> 'CUT_OFF'),
sg0 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
sg1 AS (SELECT *, coalesce(p_value, 1) AS pv, row_number() OVER (ORDER BY coalesce(p_value, 1), id) AS rank, count(*) OVER () AS mm FROM sg0),
sg2 AS (SELECT *, {r('least(min(pv * mm / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 1)', 6)} AS p_adjusted, {r('greatest(least(100, 50 * delta / greatest(threshold, 0.01)), 0)', 3)} AS raw_score FROM sg1),
sg AS (SELECT {ROW}, p_adjusted, raw_score, CASE WHEN p_value IS NOT NULL THEN CASE WHEN p_value < 0.001 THEN 'CRITICAL' WHEN p_value < 0.01 THEN 'HIGH' WHEN p_value < 0.05 THEN 'MEDIUM' ELSE 'LOW' END
  ELSE CASE WHEN raw_score >= 80 THEN 'CRITICAL' WHEN raw_score >= 60 THEN 'HIGH' WHEN raw_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END END AS severity, p_adjusted < {ALPHA} AS significant FROM sg2),
{values('mt', 'universe, base', [(u, t) for u, t, _ in o.UNIVERSES])},
qa AS (SELECT *, CAST(coalesce(base, 5000) * {case([(f"test = '{t}'", str(f)) for t, f in o.TEST_FACTORS.items()], '1')} AS DOUBLE) AS lim,
  CASE WHEN metric > 100 THEN abs(metric) WHEN test = 'L2-VAR' THEN CASE WHEN threshold > 0 THEN abs(delta * threshold) ELSE abs(metric) END WHEN test = 'L2-DISCORD' THEN abs(metric) WHEN test = 'L2-MISSING' THEN abs(metric * delta) WHEN test = 'L2-CONC' THEN CASE WHEN metric > 1 THEN abs(metric) ELSE 0 END ELSE greatest(abs(metric), abs(delta * threshold)) END AS am FROM sg LEFT JOIN mt USING (universe)),
qb AS (SELECT id, family, universe, test, {r('am', 2)} AS amount, {r('lim', 2)} AS "limit" FROM qa)"""
query("sig01_family_series", "SELECT * FROM fs", SIG)(o.family_series)
query("sig02_var", "SELECT * FROM s1", SIG)(lambda led: o.sig_var(led, ALPHA))
query("sig03_discord", "SELECT * FROM s2", SIG)(o.sig_discord)
query("sig04_missing", f"SELECT {ROW} FROM s3", SIG)(o.sig_missing)
query("sig05_conc", "SELECT * FROM s4", SIG)(o.sig_conc)
# no family of the test ledger reaches the usual limits: its candidates at lower ones
query("sig05b_conc_low", "SELECT * FROM s4", SIG.replace("THEN 0.8 ELSE 0.5 END AS lim", "THEN 0.04 ELSE 0.02 END AS lim"))(lambda led: o.sig_conc(led, 0.02, 0.04))
query("sig06_signals", "SELECT * FROM sg", SIG)(lambda led: o.signals(led, ALPHA))
query(
    "qua01_materiality",
    f'SELECT *, amount >= "limit" AS material, {r("""CASE WHEN amount / "limit" < 1 THEN 50 * amount / "limit" ELSE least(50 + 50 * log10(1 + amount / "limit") / log10(11), 100) END""")} AS materiality_score FROM qb', SIG,
)(lambda led: o.materiality(o.signals(led, ALPHA)))
query(
    "sta06_calibrate",
    f"SELECT family, universe, {r('cv')} AS cv, {r('1.5 + 2 * cv')} AS dead_band, {r('greatest(volume * share, 500)', 3)} AS materiality, CAST(variation AS DOUBLE) AS variation FROM (SELECT *, {U} AS universe FROM g) JOIN cal USING (universe)",
    months("prefix_3 AS family", YEAR) + ", g AS (SELECT family, coalesce(stddev_pop(abs(v)) / nullif(avg(abs(v)), 0), 0) AS cv, sum(abs(v)) AS volume FROM m GROUP BY family), " + values("cal", "universe, share, variation", o.CALIBRATION),
)(lambda led: o.calibrate(led, YEAR))
