"""Queries on labels, features and outlier models."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.columns import rounded
from folio.operators import entities, fuzzy, models, risk, similarity
from folio.operators import labels as o
from folio.plans.core import dated
from folio.plans.qualify import judged
from folio.plans.registry import case, query, r

q = lambda s: s.replace("'", "''")
NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce(label, '')), '[^a-zàâäéèêëïîôùûüç0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
HIT = {c: "regexp_matches(t, '" + q("|".join(f"(?:{p})" for p in ps)) + "')" for c, _, ps in o.KEYWORDS}
KW = f"""kw AS (SELECT label, concat_ws(',', {', '.join(f"CASE WHEN {h} THEN '{c}' END" for c, h in HIT.items())}) AS categories, CAST(least({' + '.join(f'CASE WHEN {HIT[c]} THEN {w} ELSE 0 END' for c, w, _ in o.KEYWORDS)}, 100) AS INT) AS keyword_score FROM (SELECT DISTINCT label, {NORM} AS t FROM ledger)),
coh AS (SELECT account, label, {case([(f"account[1] = '{c}'", '(' + ' OR '.join(f"contains(t, '{w}')" for w in ws) + ')') for c, ws in o.EXPECTED.items()], 'true')} AS coherent FROM (SELECT DISTINCT account, label, {NORM} AS t FROM ledger))"""
query("nlp01_keyword_score", "SELECT * FROM kw", KW)(o.keyword_score)
query("nlp02_coherence", "SELECT * FROM coh", KW)(o.coherence)
query(
    "nlp04_risk",
    f"SELECT account, label, keyword_score, coherent, {r('risk')} AS risk FROM (SELECT *, least(0.5 * keyword_score + CASE WHEN coherent THEN 0 ELSE 20 END + CASE WHEN (length(label) - mean) / std > 2 THEN 10 ELSE 0 END, 100) AS risk FROM coh JOIN kw USING (label), (SELECT avg(length(label)) AS mean, stddev_samp(length(label)) AS std FROM ledger)) WHERE risk >= 30", KW,
)(o.nlp_risk)
query(
    "nlp04b_keyword_stats",
    f"SELECT category, lines, {r('lines / al * 100')} AS pct FROM (SELECT category, count(*) AS lines FROM (SELECT unnest(string_split(categories, ',')) AS category FROM ledger JOIN kw USING (label)) WHERE category <> '' GROUP BY category), (SELECT count(*) AS al FROM ledger)", KW,
)(o.keyword_stats)
query(
    "nlp05_duplicate_labels",
    f"SELECT norm, min(label) AS example, count(*) AS lines, sum(amount) AS net, {r('CAST(sum(amount) AS DOUBLE) / count(*)', 6)} AS mean FROM (SELECT *, {NORM} AS norm FROM ledger WHERE class IN ('6', '7')) GROUP BY norm HAVING count(*) >= 5 AND abs(sum(amount)) >= 1000",
)(lambda led: o.duplicate_labels(led.where("class IN ('6', '7')")))


def heaviest(table: list, name: str, default: str) -> tuple[str, str]:
    kinds = list(dict.fromkeys(n for n, _, _ in table))
    best = {n: "greatest(" + ", ".join(f"CASE WHEN regexp_matches(upper(label), '{q(p)}') THEN {w} ELSE 0 END" for k, p, w in table if k == n) + ")" for n in kinds}
    found = case([(f"i_{n} = top", f"'{n}'") for n in kinds])
    sql = f"SELECT label, CASE WHEN top >= 0.5 THEN {found} ELSE '{default}' END AS {name}, {r('CASE WHEN top >= 0.5 THEN top ELSE 0.5 END')} AS confidence FROM (SELECT *, greatest({', '.join(f'i_{n}' for n in kinds)}) AS top FROM lb)"
    return sql, f"lb AS (SELECT label, {', '.join(f'{e} AS i_{n}' for n, e in best.items())} FROM (SELECT DISTINCT label FROM ledger))"


query("lab03_intent", *heaviest(o.INTENTS, "intent", "STANDARD"))(o.intent)
query("lab03b_operation", *heaviest(o.OPERATIONS, "operation", "INCONNU"))(o.operation)
FOUND = [f"regexp_matches(upper(label), '{q(p)}')" for p, _ in o.RECURRING]
query(
    "lab04_recurring",
    f"SELECT label, m >= 0.7 OR n >= 2 AS recurring, {r('m')} AS weight FROM (SELECT label, n, coalesce(w / nullif(n, 0), 0) AS m FROM (SELECT label, {' + '.join(f'CAST({f} AS INT)' for f in FOUND)} AS n, CAST({' + '.join(f'CASE WHEN {f} THEN {w} ELSE 0 END' for f, (_, w) in zip(FOUND, o.RECURRING))} AS DOUBLE) AS w FROM (SELECT DISTINCT label FROM ledger)))",
)(o.recurring)
query(
    "lab02_known_parties",
    "SELECT DISTINCT label, third_party FROM (SELECT DISTINCT label || ' ' || coalesce(third_party, '') AS label FROM ledger) JOIN (SELECT DISTINCT third_party FROM ledger WHERE third_party IS NOT NULL) ON contains(upper(label), upper(third_party))",
)(lambda led: o.known_parties(led.withColumn("label", F.concat("label", F.lit(" "), F.coalesce("third_party", F.lit(""))))))

#: Known names for the similarity join: the last two words of labels, turned round and with a letter too many.
NAME = "([a-z]+) ([a-z]+)$"
SORTED = lambda c: f"array_to_string(list_sort(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')), ' ')"
FUZZY = f"""nm AS (SELECT DISTINCT regexp_extract(label, '{NAME}', 2) || 'x ' || regexp_extract(label, '{NAME}', 1) AS third_party FROM ledger WHERE regexp_matches(label, '{NAME}')),
nk AS (SELECT min(third_party) AS third_party, other, len(other) AS m, (1::HUGEINT << len(other)) - 1 AS every FROM (SELECT third_party, {SORTED('third_party')} AS other FROM nm) GROUP BY other),
lw AS (SELECT label, list_filter(string_split_regex(label, '\\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT label FROM ledger)),
li AS (SELECT label, w, unnest(range(1, len(w) + 1)) AS i FROM lw), lk AS (SELECT label, w, i, unnest(range(i, least(i + {fuzzy.MOST_WORDS}, len(w) + 1))) AS j FROM li),
sg AS (SELECT DISTINCT label, array_to_string(w[i:j], ' ') AS segment FROM lk WHERE len(array_to_string(w[i:j], ' ')) >= {fuzzy.LEAST_CHARS}), sk AS (SELECT label, segment, {SORTED('segment')} AS key FROM sg),
cd AS (SELECT key, len(key) AS n, other, m, every, third_party FROM (SELECT DISTINCT key FROM sk) JOIN nk ON 5 * levenshtein(key, other) <= len(key) + len(other)),
cc AS (SELECT *, m - bit_count(list_reduce(list_prepend(every, list_transform(string_split(key, ''), lambda c: list_sum(list_transform(range(m), lambda i: CASE WHEN other[i + 1] = c THEN 1::HUGEINT << CAST(i AS INT) ELSE 0::HUGEINT END)))),
  lambda v, k: ((v + (v & k)) | (v - (v & k))) & every)) AS c FROM cd),
bs AS (SELECT key, 2 * c / (n + m) AS score, third_party FROM cc WHERE 200 * c >= 80 * (n + m) QUALIFY row_number() OVER (PARTITION BY key ORDER BY 2 * c / (n + m) DESC, third_party) = 1)"""
query("lab02b_similar_parties", f"SELECT label, segment, third_party, CAST(instr(label, segment) - 1 AS INT) AS start, {r('score')} AS confidence FROM sk JOIN bs USING (key)", FUZZY)(
    lambda led: fuzzy.similar_parties(led, led.select(F.concat(F.regexp_extract("label", NAME, 2), F.lit("x "), F.regexp_extract("label", NAME, 1)).alias("third_party"), F.col("label").rlike(NAME).alias("named")).where("named"))
)

A = "abs(CAST(amount AS DOUBLE))"
FD = "CASE WHEN amount <> 0 THEN CAST(CAST(CAST(floor(abs(amount)) AS BIGINT) AS VARCHAR)[1] AS INT) ELSE 0 END"
FT = f"""ba AS (SELECT account, avg({A}) AS account_mean, stddev_samp({A}) AS account_std, count(*) AS account_lines FROM ledger GROUP BY account), bd AS (SELECT date, count(*) AS day_lines FROM ledger GROUP BY date),
ft AS (SELECT account, voucher, amount, {A} AS a, (isodow(date) - 1) AS weekday, day(date) AS day, (month = 12 AND day(date) >= 20) AS year_end, {FD} AS first_digit, account_lines, day_lines, ({A} - account_mean) / CASE WHEN coalesce(account_std, 1) = 0 THEN 1 ELSE coalesce(account_std, 1) END AS z,
  journal IN ('OD', 'AN', 'RAN', 'EXT', 'EXTOURNE') AS od, {A} >= 10000 AND abs(amount) % 10000 = 0 AS r4 FROM ledger JOIN ba USING (account) JOIN bd USING (date))"""
query(
    "ml01_features", f"SELECT account, voucher, amount, CAST(weekday AS INT) AS weekday, CAST(day AS INT) AS day, first_digit, day_lines, account_lines, {r('ln(1 + a)')} AS log_amount, {r('z')} AS z_account, CAST(od AS INT) AS is_od, CAST(r4 AS INT) AS round_10000 FROM ft", FT
)(lambda led: models.features(led).select("account", "voucher", "amount", "weekday", "day", "first_digit", "day_lines", "account_lines", rounded(F.col("log_amount")).alias("log_amount"), rounded(F.col("z_account")).alias("z_account"), "is_od", "round_10000"))
query(
    "ml03_weak_labels",
    "SELECT account, count(*) AS lines, sum(CASE WHEN (od AND year_end AND a > p99) OR (r4 AND account_lines < 5) OR abs(z) > 4 OR (weekday >= 5 AND a > p95) OR (nines > 0.1 AND first_digit = 9) THEN 1 ELSE 0 END) AS flagged "
    "FROM ft, (SELECT quantile_cont(a, 0.95) AS p95, quantile_cont(a, 0.99) AS p99, avg(CASE WHEN first_digit = 9 THEN 1 ELSE 0 END) AS nines FROM ft) GROUP BY account",
    FT,
)(lambda led: models.weak_labels(led).groupBy("account").agg(F.count("*").alias("lines"), F.sum("weak_label").alias("flagged")))
query(
    "ml01b_decimals",
    "SELECT journal, CAST(dense_rank() OVER (ORDER BY journal) - 1 AS INT) AS journal_index, decimals, lines FROM (SELECT journal, CAST(CASE WHEN amount % 1 = 0 THEN 0 WHEN amount * 10 % 1 = 0 THEN 1 ELSE 2 END AS INT) AS decimals, count(*) AS lines FROM ledger GROUP BY ALL)",
)(lambda led: models.features(led).join(models.journal_index(led), "journal").groupBy("journal", "journal_index", "decimals").agg(F.count("*").alias("lines")))
query("ml02b_isolation_top")(lambda led: models.isolation_top(led, models.isolation(led, keep=models.MODEL_COLUMNS, most=20)))
query("ml05b_latent")(lambda led: models.latent_views(models.reconstruction_errors(led).select("account", "voucher", "label", "amount", "error", F.transform("latent", lambda v: F.round(v, 3)).alias("latent"))).select("account", "voucher", "label", "amount", "error", "percentile", "latent"))
query("lab06b_attach_to_anomalies")(lambda led: entities.attach_to_anomalies(judged(led).where("filter_reason = 'PASSED'").select("id", "family", "test", "amount"), led))
query("ml02_isolation")(lambda led: dated(models.isolation(led)))
query("ml05_reconstruction")(lambda led: dated(models.reconstruction(led)))
query("rsk01_line_risk")(lambda led: dated(risk.line_risk(led)))
query("rsk02_risk_views")(lambda led: dated(risk.risk_views(risk.line_risk(led), risk.MODELS, least=40)))
query("rsk03_risk_summary")(lambda led: risk.risk_summary(risk.line_risk(led, ()), risk.MODELS))

TERMS = f"""wl AS (SELECT coalesce(label, '') AS label, count(*) AS lines FROM ledger GROUP BY 1),
ww AS (SELECT label, lines, regexp_extract_all({NORM.format('label')}, '{similarity.TOKEN}') AS ws FROM wl),
tm AS (SELECT label, lines, term, count(*) AS tf FROM (SELECT label, lines, unnest(ws) AS term FROM ww UNION ALL SELECT label, lines, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) FROM ww WHERE len(ws) > 1) GROUP BY ALL),
kn AS (SELECT term, df FROM (SELECT term, sum(lines) AS df, sum(tf * lines) AS c FROM tm GROUP BY term) WHERE df >= {similarity.LEAST_LINES} ORDER BY c DESC, term LIMIT {similarity.MOST_TERMS}),
rw AS (SELECT label, lines, term, idf, tf * idf AS x FROM tm JOIN (SELECT term, 1 + ln((1 + (SELECT sum(lines) FROM wl)) / (1 + df)) AS idf FROM kn) USING (term)),
wt AS (SELECT label, lines, term, idf, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS w FROM rw),
ce AS (SELECT term, sum(w * lines) / (SELECT sum(lines) FROM wl) AS c FROM wt GROUP BY term),
di AS (SELECT wl.label, wl.lines, {r('sqrt(greatest(coalesce(ww, 0) - 2 * coalesce(wc, 0) + (SELECT coalesce(sum(c * c), 0) FROM ce), 0))', 6)} AS distance FROM wl LEFT JOIN (SELECT label, sum(w * c) AS wc, 1 AS ww FROM wt JOIN ce USING (term) GROUP BY label) USING (label))"""
query("nlp03_lexical_distance", f"SELECT label, lines, distance, {r('(distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER () + 1e-10) * 50')} AS score FROM di", TERMS)(similarity.lexical_distance)
ASKED = "regul provision extourne fnp"
query(
    "nlp06_similar_labels",
    f"SELECT label, {r('sum(w * q)', 6)} AS similarity FROM wt JOIN (SELECT term, x / sqrt(sum(x * x) OVER ()) AS q FROM (SELECT term, any_value(idf) * count(*) AS x FROM (SELECT unnest({['regul', 'provision', 'extourne', 'fnp', 'regul provision', 'provision extourne', 'extourne fnp']}) AS term) JOIN (SELECT DISTINCT term, idf FROM wt) USING (term) GROUP BY term)) USING (term) GROUP BY label ORDER BY similarity DESC, label LIMIT 10", TERMS,
)(lambda led: similarity.similar_labels(led, ASKED))

query("lab01_entities", once=True)(lambda led: entities.entities(led).select("label", F.inline("entities")))
query("lab05_features")(entities.label_features)
query("lab06_attach")(lambda led: entities.attach_labels(led).groupBy("account", "reference", "period_ref", "intent", "recurring").agg(F.count("*").alias("lines"), F.sum("amount").alias("net")))
