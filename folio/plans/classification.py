"""Queries of the classification operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import classify as c
from folio.plans.registry import case, in_list, query, r, values
from folio.sources import dims

CHART = values("chart", "prefix, chart_label, category, frequency, behavior", dims.CHART_ROWS)
CLASSIFIED = CHART + """,
cls AS (SELECT account, coalesce(c3.chart_label, c2.chart_label) AS chart_label, coalesce(c3.category, c2.category) AS category, coalesce(c3.frequency, c2.frequency) AS frequency,
  coalesce(c3.behavior, c2.behavior) AS behavior, coalesce(coalesce(c3.prefix, c2.prefix)[1:2] IN ('68', '78'), false) AS is_provision,
  coalesce(coalesce(c3.prefix, c2.prefix) IN ('631', '695', '696', '713', '747'), false) AS is_typical_accrual
  FROM (SELECT DISTINCT account FROM ledger) a LEFT JOIN chart c3 ON c3.prefix = account[1:3] LEFT JOIN chart c2 ON c2.prefix = account[1:2])"""
CLASSES = values("classes", "c, nature, class_label", dims.CLASS_ROWS)
PREFIXES = values("prefixes", "p, type, prefix_label, pattern", dims.PREFIX_ROWS)


def starts(col: str, prefixes) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in prefixes) + ")"


V2 = f"""{CLASSES}, {PREFIXES}, v2 AS (SELECT account, CAST(coalesce(c, '0') AS INT) AS account_class, coalesce(nature, 'special') AS nature, coalesce(type, 'n/a') AS type,
  coalesce(prefix_label, class_label, 'Compte non classifié') AS chart_label,
  {case([(starts('account', dims.DEPRECIATION_PREFIXES), "'mensuel'"), (starts('account', ['69']), "'annuel'"), (starts('account', ['488']), "'abt'"), ('pattern IS NOT NULL', 'pattern')], "'variable'")} AS behavior,
  {starts('account', dims.PROVISION_PREFIXES)} AS is_provision, {starts('account', dims.REVERSAL_PREFIXES)} AS is_reversal, {starts('account', dims.DEPRECIATION_PREFIXES)} AS is_depreciation,
  {starts('account', ['67', '77'])} AS is_exceptional, {starts('account', ['69'])} AS is_income_tax, {starts('account', ['488'])} AS is_subscription
  FROM (SELECT DISTINCT account FROM ledger) LEFT JOIN classes ON c = account[1] LEFT JOIN prefixes ON p = account[1:2])"""
COUNTERPART = f"""cp AS (SELECT date, journal, voucher, min(account) AS counterpart FROM ledger WHERE class NOT IN ('6', '7') AND prefix_3 IN {in_list(dims.PROVISION_COUNTERPARTS)} GROUP BY ALL),
{values('ptypes', 'pt, provision_type', list(dims.PROVISION_COUNTERPARTS.items()))},
ent0 AS (SELECT l.*, CASE WHEN class IN ('6', '7') THEN cp.counterpart END AS counterpart,
  regexp_matches(lower(label), '{"|".join(dims.ACCRUAL_PATTERNS)}') AS acc, regexp_matches(lower(label), '{"|".join(dims.ONE_SHOT_PATTERNS)}') AS once,
  upper(l.journal) IN {in_list(dims.ADJUSTING_JOURNALS)} AS adj FROM ledger l LEFT JOIN cp ON l.date = cp.date AND l.journal = cp.journal AND l.voucher = cp.voucher),
ent AS (SELECT *, CASE WHEN once THEN 'ONE_SHOT' WHEN counterpart IS NOT NULL OR acc THEN 'REGUL' WHEN adj THEN 'ESTIMATIF' ELSE 'RUN_RATE' END AS entry_type,
  counterpart IS NOT NULL OR acc OR adj AS is_accrual FROM ent0 LEFT JOIN ptypes ON pt = counterpart[1:3])"""
JOURNALS = values("words", "word, kind, rank", dims.KEYWORD_ROWS) + """,
jt AS (SELECT journal, coalesce(arg_min(kind, CASE WHEN word = upper(trim(journal)) THEN -1 ELSE rank END), 'autre') AS journal_type
  FROM (SELECT DISTINCT journal FROM ledger) LEFT JOIN words ON contains(upper(trim(journal)), word) OR contains(word, upper(trim(journal))) GROUP BY journal)"""

query("cls01_classify_account", "SELECT * FROM cls", CLASSIFIED)(lambda led: c.classify_account(c.accounts_of(led)))
query(
    "cls02_expected_behavior",
    "SELECT account, coalesce(frequency = 'mensuelle', true) AS monthly_expected, coalesce(frequency IN ('annuelle', 'exceptionnelle'), false) AS year_end_spike_normal, is_provision AS reversal_expected, "
    "CASE WHEN behavior = 'saisonnier' THEN '1,4,7,10' WHEN frequency = 'annuelle' THEN '12' END AS seasonal_months, "
    "CASE WHEN chart_label IS NULL OR behavior = 'saisonnier' THEN 50.0 WHEN behavior = 'regulier' THEN 30.0 ELSE 100.0 END::DOUBLE AS tolerated_variation FROM cls",
    CLASSIFIED,
)(lambda led: c.expected_behavior(c.accounts_of(led)))
query(
    "cls03_analyze_accounts", "SELECT category, frequency, behavior, is_provision, count(*) AS n, sum(amount) AS amount FROM ledger JOIN cls USING (account) GROUP BY ALL", CLASSIFIED
)(lambda led: c.analyze_accounts(led).groupBy("category", "frequency", "behavior", "is_provision").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")))
query("cls04_risk_accounts", "SELECT * FROM cls WHERE is_provision OR is_typical_accrual", CLASSIFIED)(c.risk_accounts)
query("cls05_classify_v2", "SELECT * FROM v2", V2)(lambda led: c.classify_v2(c.accounts_of(led)))
query(
    "cls06_enrich_account",
    "SELECT prefix_3 AS family, CASE WHEN class = '6' THEN 'CHARGE' WHEN class = '7' THEN 'PRODUIT' WHEN class IN ('1', '2', '3', '4', '5') THEN 'BILAN' ELSE 'AUTRE' END AS nature, year AS fiscal_year, count(*) AS n FROM ledger GROUP BY ALL",
)(lambda led: c.enrich_account(led).groupBy("family", "nature", "fiscal_year").agg(F.count("*").alias("n")))
query(
    "cls07_fingerprint",
    "SELECT account, substr(md5(concat_ws('|', CAST(date AS VARCHAR), journal, account, label, printf('%.2f', CAST(debit AS DOUBLE)), printf('%.2f', CAST(credit AS DOUBLE)), coalesce(voucher, ''))), 1, 12) AS hash FROM ledger",
)(lambda led: led.select("account", c.fingerprint().alias("hash")))
query(
    "cls08_counterpart", "SELECT account, counterpart, provision_type, count(*) AS n FROM ent WHERE counterpart IS NOT NULL GROUP BY ALL", COUNTERPART
)(lambda led: c.with_counterpart(led).where("counterpart IS NOT NULL").groupBy("account", "counterpart", "provision_type").agg(F.count("*").alias("n")))
query("cls09_entry_type", "SELECT account, entry_type, count(*) AS n FROM ent GROUP BY ALL", COUNTERPART)(lambda led: c.classify_entries(led).groupBy("account", "entry_type").agg(F.count("*").alias("n")))
query("cls10_is_accrual", "SELECT journal, is_accrual, count(*) AS n FROM ent GROUP BY ALL", COUNTERPART)(lambda led: c.classify_entries(led).groupBy("journal", "is_accrual").agg(F.count("*").alias("n")))
query("cls11_pnl_amount", "SELECT account, period, sum(pnl_amount) AS pnl FROM ledger GROUP BY ALL")(lambda led: led.groupBy("account", "period").agg(F.sum("pnl_amount").alias("pnl")))
query(
    "cls12_provision_summary",
    "SELECT provision_type, period, sum(debit) AS debit, sum(credit) AS credit, sum(amount) AS net, count(DISTINCT account) AS accounts FROM ent WHERE counterpart IS NOT NULL GROUP BY ALL", COUNTERPART,
)(lambda led: c.provision_summary(c.classify_entries(led)))
query(
    "cls13_accrual_summary", "SELECT period, entry_type, count(*) AS lines, sum(amount) AS net, sum(pnl_amount) AS pnl FROM ent WHERE is_accrual GROUP BY ALL", COUNTERPART
)(lambda led: c.accrual_summary(c.classify_entries(led)))
query("cls14_classify_journal", "SELECT * FROM jt", JOURNALS)(lambda led: c.classify_journal(led.select("journal").distinct()))
query(
    "cls15_journal_table",
    f"SELECT journal, journal_type, count(*) AS entries, sum(debit) AS debit, sum(credit) AS credit, string_agg(DISTINCT CAST(month AS VARCHAR), ',' ORDER BY lpad(CAST(month AS VARCHAR), 2, '0')) AS months, {r('avg(CASE WHEN month = 12 THEN 1 ELSE 0 END)')} AS december_ratio FROM ledger JOIN jt USING (journal) GROUP BY ALL".replace(
        "string_agg(DISTINCT CAST(month AS VARCHAR), ',' ORDER BY lpad(CAST(month AS VARCHAR), 2, '0'))", "array_to_string(list_sort(list(DISTINCT month)), ',')"
    ),
    JOURNALS,
)(c.journal_table)
query(
    "cls16_od_spike",
    f"SELECT december, {r('m')} AS other_mean, {r('coalesce(december / m, 0)')} AS ratio, coalesce(december > m * 3, false) AS spike FROM (SELECT coalesce(max(n) FILTER (month = 12), 0) AS december, avg(n) FILTER (month <> 12) AS m "
    "FROM (SELECT month, count(*) AS n FROM ledger JOIN jt USING (journal) WHERE journal_type = 'od' GROUP BY month))",
    JOURNALS,
)(c.od_spike)
KIND = case([(f"starts_with(account, '{p}')", f"'{t}'") for p, t in dims.COUNTERPARTY_TYPES], "'AUTRE'")
RANK = case([(f"kind = '{t}'", str(i)) for i, (_, t) in enumerate(dims.COUNTERPARTY_TYPES)], "99")
query(
    "cls17_counterparty_type",
    "SELECT voucher, side, kind AS counterparty_type FROM (SELECT *, row_number() OVER (PARTITION BY voucher, side ORDER BY v DESC, rk) AS rn FROM s) WHERE rn = 1",
    f"k AS (SELECT voucher, CASE WHEN debit > 0 THEN 'C' ELSE 'D' END AS side, {KIND} AS kind, debit + credit AS volume FROM ledger), "
    f"s AS (SELECT voucher, side, kind, sum(volume) AS v, {RANK} AS rk FROM k GROUP BY ALL)",
)(c.counterparty_type)
CT = (
    f"k AS (SELECT voucher, CASE WHEN debit > 0 THEN 'C' ELSE 'D' END AS side, {KIND} AS kind, debit + credit AS volume FROM ledger), "
    f"s AS (SELECT voucher, side, kind, sum(volume) AS v, {RANK} AS rk FROM k GROUP BY ALL), "
    "ct AS (SELECT voucher, side, kind AS counterparty_type FROM (SELECT *, row_number() OVER (PARTITION BY voucher, side ORDER BY v DESC, rk) AS rn FROM s) WHERE rn = 1), " + values("ex", "family, types", c.EXPECTED_TYPE_ROWS)
)
query(
    "cls18_type_conformity",
    "SELECT family, counterparty_type, lines, coalesce(list_contains(string_split(types, ' '), counterparty_type), true) AS conform FROM "
    "(SELECT prefix_3 AS family, counterparty_type, count(*) AS lines FROM ledger l LEFT JOIN ct ON ct.voucher = l.voucher AND ct.side = CASE WHEN l.debit > 0 THEN 'D' ELSE 'C' END GROUP BY ALL) LEFT JOIN ex USING (family)",
    CT,
)(c.type_conformity)
