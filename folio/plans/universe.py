"""Queries of the semantic universes and of the referential that follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import qualify
from folio.operators import universe as o
from folio.operators.crystallinity import ASSET_PATTERNS
from folio.plans.registry import case, in_list, query, r

C = "account, site"
BARE = r"regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g')".format
WORDS = r"[x for x in regexp_split_to_array({}, '\s+') if x <> '']".format


def masked(label: str) -> str:
    text = f"upper({label})"
    for pattern, mask in o.MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


KNOWN = in_list(o.VOCABULARY)
NAMES = f"CASE WHEN regexp_matches(label, '[A-Z][a-z]') THEN len([w for w in {WORDS('upper(label)')} if length({BARE('w')}) > 3 AND {BARE('w')} NOT IN {KNOWN}]) ELSE 0 END"
MASKED = f"array_to_string([CASE WHEN length({BARE('w')}) > 4 AND {BARE('w')} <> lower({BARE('w')}) AND {BARE('w')} NOT IN {KNOWN} THEN '{o.ENTITY}' ELSE w END for w in {WORDS('t')}], ' ')"
FEATURES = f"""lc AS (SELECT *, {MASKED} AS masked, {NAMES} AS names, len({WORDS('upper(label)')}) AS words, CASE WHEN regexp_matches(upper(label), '{'|'.join(ASSET_PATTERNS)}') THEN 1 ELSE 0 END AS asset
  FROM (SELECT {C}, label, n, {masked('label')} AS t FROM (SELECT {C}, label, count(*) AS n FROM ledger WHERE label IS NOT NULL AND label <> '' GROUP BY ALL))),
he AS (SELECT {C}, {r('-sum(p * log2(p))')} AS entropy, count(*) AS labels FROM (SELECT {C}, n / sum(n) OVER (PARTITION BY {C}) AS p FROM lc) GROUP BY {C}),
hm AS (SELECT {C}, {r('-sum(p * log2(p))')} AS entropy_masked FROM (SELECT {C}, sum(n) / sum(sum(n)) OVER (PARTITION BY {C}) AS p FROM lc GROUP BY {C}, masked) GROUP BY {C}),
ra AS (SELECT {C}, {r('coalesce(nn / nullif(ww, 0), 0)')} AS name_ratio, {r('coalesce(aa / nullif(ll, 0), 0)')} AS asset_ratio, {r('CASE WHEN lines >= 2 THEN twice / lines ELSE 0 END')} AS mirror_ratio
  FROM (SELECT {C}, sum(n) AS lines, sum(CASE WHEN n >= 2 AND v > 0 THEN n ELSE 0 END) AS twice FROM (SELECT {C}, abs(amount) AS v, count(*) AS n FROM ledger GROUP BY ALL) GROUP BY ALL)
  LEFT JOIN (SELECT {C}, sum(names * n) AS nn, sum(words * n) AS ww, sum(asset * n) AS aa, sum(n) AS ll FROM lc GROUP BY ALL) USING (account, site)),
cp AS (SELECT a.account, a.site, count(DISTINCT b.account) AS counterparties FROM (SELECT DISTINCT {C}, voucher, debit > 0 AS deb FROM ledger) a JOIN (SELECT DISTINCT account, voucher, debit > 0 AS deb FROM ledger) b ON a.voucher = b.voucher AND a.deb <> b.deb GROUP BY ALL),
rg AS (SELECT {C}, months, {r('CASE WHEN months < 2 THEN 0.5 WHEN months >= 11 THEN least(1 - least(cv, 1) + 0.1, 1) ELSE 1 - least(cv, 1) END')} AS regularity
  FROM (SELECT {C}, count(*) AS months, coalesce(stddev_pop(v) / nullif(avg(v), 0), 0) AS cv FROM (SELECT {C}, period, CAST(sum(abs(amount)) AS DOUBLE) AS v FROM ledger GROUP BY ALL) GROUP BY ALL)),
ba AS (SELECT {C}, count(*) AS entries, sum(abs(amount)) AS volume, count(DISTINCT journal) AS journals, avg(abs(CAST(amount AS DOUBLE))) AS mean, stddev_pop(abs(CAST(amount AS DOUBLE))) AS sd FROM ledger GROUP BY ALL),
cf AS (SELECT {C}, account[1] AS class, account[1:3] AS family, entries, {r('volume', 2)} AS volume, coalesce(entropy, 0) AS entropy, coalesce(entropy_masked, 0) AS entropy_masked, {r('coalesce(entropy, 0) - coalesce(entropy_masked, 0)')} AS entropy_drop, journals,
  coalesce(counterparties, 0) AS counterparties, coalesce(labels, 0) AS labels, {r('coalesce(sd / nullif(mean, 0), 0)')} AS cv, {r('mean', 2)} AS mean, months, regularity, mirror_ratio, name_ratio, asset_ratio
  FROM ba JOIN rg USING (account, site) JOIN ra USING (account, site) LEFT JOIN he USING (account, site) LEFT JOIN hm USING (account, site) LEFT JOIN cp USING (account, site)),
cu AS (SELECT *, {case([(rule[3], f"'{rule[0]}'") for rule in o.RULES], "'NON_CLASSE'")} AS universe, {r(case([(rule[3], rule[1]) for rule in o.RULES], '0.3'))} AS confidence, {case([(rule[3], f"'{rule[2]}'") for rule in o.RULES], "'no clear profile'")} AS reason FROM cf WHERE entries >= 3)"""
query("uni01_masked_labels", "SELECT label, masked, sum(n) AS lines FROM lc GROUP BY ALL", FEATURES)(lambda led: o.label_counts(led).groupBy("label", "masked").agg(F.sum("n").alias("lines")))
query("uni02_entropy", "SELECT * FROM he JOIN hm USING (account, site)", FEATURES)(o.entropies)
query("uni03_label_ratios", "SELECT * FROM ra", FEATURES)(o.ratios)
query("uni05_features", "SELECT * FROM cf", FEATURES)(o.couple_features)
query("uni06_universe", f"SELECT {C}, universe, confidence, reason FROM cu", FEATURES)(lambda led: o.classify_couples(led).select("account", "site", "universe", "confidence", "reason"))
query(
    "uni07_summary",
    f"SELECT u AS universe, count(cu.account) AS couples, {r('count(cu.account) / (SELECT count(*) FROM cu)')} AS couples_share, coalesce(sum(entries), 0) AS entries, {r('coalesce(sum(entries), 0) / (SELECT sum(entries) FROM cu)')} AS entries_share, {r('coalesce(sum(volume), 0)', 2)} AS volume, "
    f"{r('coalesce(sum(volume), 0) / (SELECT sum(volume) FROM cu)')} AS volume_share, {r('coalesce(avg(confidence), 0)')} AS confidence, count(*) FILTER (confidence < 0.5) AS unsure FROM (SELECT unnest([{', '.join(chr(39) + u + chr(39) for u in o.UNIVERSES)}]) AS u) LEFT JOIN cu ON universe = u GROUP BY u", FEATURES,
)(lambda led: o.universe_summary(o.classify_couples(led)))
query("uni07b_unsure", f"SELECT {C}, universe, confidence FROM cu WHERE confidence < 0.86", FEATURES)(lambda led: o.unsure(o.classify_couples(led), 0.86).select("account", "site", "universe", "confidence"))
query(
    "sco04_referential",
    f"SELECT account, universe, cv, entries, CAST(CASE WHEN entries > 10 THEN 1000 ELSE 500 END AS DOUBLE) AS materiality, universe IN {in_list(qualify.SIGNAL_UNIVERSES)} AS is_signal_universe, '{','.join(qualify.SIGNAL_UNIVERSES)}' AS signal_if, '{','.join(qualify.QUIET_UNIVERSES)}' AS no_signal_if "
    "FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY entries DESC, volume DESC, site DESC) AS rn FROM cu) WHERE rn = 1", FEATURES,
)(lambda led: qualify.referential(o.classify_couples(led)))
