"""Queries on the canonical ledger, generic operators and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.tables import shared_path
from folio.plans.registry import query, r
from folio.sources import canonical, readers

LINE = "CAST(date AS VARCHAR) AS date, account, journal, voucher, label, site, third_party, debit, credit, amount, year, month, period, class, prefix_2, prefix_3, pnl_amount"


def dated(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as ISO text."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns or ("date",)})


def exported(led: DataFrame) -> DataFrame:
    """The ledger as an export in ISO-8859-1 with accents in headers and labels, read back."""
    path = shared_path(led.sparkSession, "export")
    columns = {"Date écriture": F.date_format("date", "dd/MM/yyyy"), "N° COMPTE": F.col("account"), "Code Journal": F.col("journal"), "N° pièce": F.col("voucher"), "Libellé écriture": F.concat(F.lit("Écriture "), "label"), "DÉBIT": F.col("debit"), "Crédit": F.col("credit"), "Section analytique": F.col("site")}
    led.select(*[c.alias(name) for name, c in columns.items()]).write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return readers.read_delimited(led.sparkSession, path)


@query("src01_read_delimited", "SELECT journal AS code, count(*) AS lines, sum(debit) AS debit, count(*) AS accented FROM ledger GROUP BY journal", once=True)
def src01(led: DataFrame) -> DataFrame:
    df = exported(led)
    return df.groupBy(F.col("`Code Journal`").alias("code")).agg(F.count("*").alias("lines"), F.sum(F.col("DÉBIT").cast("decimal(18,2)")).alias("debit"), F.count_if(F.col("`Libellé écriture`").startswith("Écriture ")).alias("accented"))


#: Journals whose lines are exported to files of their own layout and encoding.
MIXED = ("ACH", "BQ", "OD")


@query(
    "src05b_load_many",
    f"SELECT CASE WHEN journal IN ('{MIXED[0]}', '{MIXED[1]}') THEN 'A' ELSE 'B' END AS source, account, period, count(*) AS lines, sum(amount) AS net, min('Écriture ' || label) AS label FROM ledger WHERE journal IN {MIXED} GROUP BY ALL",
)
def src05b(led: DataFrame) -> DataFrame:
    """The ledger's lines as exports of three layouts, delimiters and encodings in two folders, loaded at once."""
    spark, path = led.sparkSession, shared_path(led.sparkSession, "exports")
    label = F.concat(F.lit("Écriture "), "label")
    shapes = [
        ("A/one", ";", "UTF-8", "dd/MM/yyyy", ["Date écriture", "N° Compte", "Code journal", "N° Pièce", "Libellé écriture", "Débit", "Crédit"]), ("A/two", ",", "ISO-8859-1", "yyyy-MM-dd", ["DATECPT", "NUMCPT", "CODEJAL", "PIECE", "LIBELLE", "MTDEBIT", "MTCREDIT"]),
        ("B", "\t", "ISO-8859-1", "dd/MM/yyyy", ["Date", "Compte", "Journal", "Pièce", "Libellé", "Débit", "Crédit"]),
    ]
    for journal, (folder, sep, encoding, form, headers) in zip(MIXED, shapes):
        cells = [F.date_format("date", form), F.col("account"), F.col("journal"), F.col("voucher"), label, F.col("debit"), F.col("credit")]
        led.where(F.col("journal") == journal).select(*[c.alias(h) for c, h in zip(cells, headers)]).write.csv(f"{path}/{folder}", sep=sep, header=True, encoding=encoding)
    found = readers.load_many(spark, [f"{path}/A/one", f"{path}/A/two", f"{path}/B"], ["A", "A", "B"])
    return found.groupBy("source", "account", "period").agg(F.count("*").alias("lines"), F.sum("amount").alias("net"), F.min("label").alias("label"))


@query("src02_to_canonical", "SELECT account, period, journal, site AS axis_1, count(*) AS lines, sum(amount) AS net, min('Écriture ' || label) AS label FROM ledger GROUP BY ALL", once=True)
def src02(led: DataFrame) -> DataFrame:
    return readers.to_canonical(exported(led)).groupBy("account", "period", "journal", "axis_1").agg(F.count("*").alias("lines"), F.sum("amount").alias("net"), F.min("label").alias("label"))


@query("src03_canonicalize", f"SELECT {LINE}, CAST(NULL AS VARCHAR) AS account_label, CAST(NULL AS VARCHAR) AS axis_1, CAST(NULL AS VARCHAR) AS axis_2, CAST(NULL AS VARCHAR) AS axis_3 FROM ledger")
def src03(led: DataFrame) -> DataFrame:
    raw = led.select(F.date_format("date", "dd/MM/yyyy").alias("date"), "account", "journal", "voucher", "label", F.col("debit").cast("string").alias("debit"), F.col("credit").cast("string").alias("credit"), "site", "third_party")
    return dated(canonical.canonicalize(raw))


@query("src04_clean", f"SELECT {LINE.replace('label', 'trim(label) AS label', 1)} FROM ledger WHERE account <> '411000' AND amount <> 0")
def src04(led: DataFrame) -> DataFrame:
    messy = led.withColumns({"account": F.when(F.col("account") == "411000", " ").otherwise(F.col("account")), "journal": F.concat(F.lit(" "), F.lower("journal"))})
    return dated(canonical.clean(messy))


@query(
    "src05_load_many",
    "SELECT source, account, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM (SELECT CASE WHEN year = 2000 THEN 'N' ELSE 'N-1' END AS source, account, amount FROM ledger WHERE year IN (1999, 2000)) GROUP BY ALL",
)
def src05(led: DataFrame) -> DataFrame:
    both = canonical.concatenate([led.where("year = 2000"), led.where("year = 1999").drop("third_party")], ["N", "N-1"])
    return both.groupBy("source", "account").agg(F.count("*").alias("n"), canonical.total(F.col("amount")).cast(canonical.MONEY).alias("amount"))


@query(
    "src06_summary",
    "SELECT count(*) AS rows, min(period) AS first_period, max(period) AS last_period, count(DISTINCT account) AS accounts, sum(debit) AS debit, sum(credit) AS credit, "
    "abs(sum(debit) - sum(credit)) < 0.01 AS balanced, string_agg(DISTINCT journal, ',' ORDER BY journal) AS journals, count(DISTINCT site) AS sites, string_agg(DISTINCT site, ',' ORDER BY site) AS site_values FROM ledger",
    once=True,
)
def src06(led: DataFrame) -> DataFrame:
    return canonical.summary(led)


@query(
    "src07_load_v2",
    "SELECT year, journal, count(*) AS n, CAST(sum(debit) AS DECIMAL(18,2)) AS debit FROM (SELECT * REPLACE (CASE WHEN journal = 'AN' THEN 'OD' ELSE journal END AS journal) FROM ledger WHERE month <> 2) GROUP BY ALL",
    once=True,
)
def src07(led: DataFrame) -> DataFrame:
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    raw = led.select(
        F.when(F.col("month") == 2, "?").otherwise(F.date_format("date", "dd/MM/yyyy")).alias("date"), "account", F.nullif("journal", F.lit("AN")).alias("journal"), "label",
        comma("debit").alias("debit"), comma("credit").alias("credit"),
    )
    rows, _ = canonical.load_v2(raw)
    return rows.groupBy("year", "journal").agg(F.count("*").alias("n"), F.sum("debit").cast(canonical.MONEY).alias("debit"))


@query("src08_parse_amount", "SELECT account, CAST(sum(debit) AS DECIMAL(18,2)) AS debit, CAST(sum(credit) AS DECIMAL(18,2)) AS credit FROM ledger GROUP BY account")
def src08(led: DataFrame) -> DataFrame:
    french = lambda c: F.concat(F.translate(F.format_number(c, 2), ",.", " ,"), F.lit(" €"))
    parsed = led.select("account", canonical.parse_amount(french("debit")).alias("debit"), canonical.parse_amount(F.format_number("credit", 2)).alias("credit"))
    return parsed.groupBy("account").agg(*[F.sum(c).cast(canonical.MONEY).alias(c) for c in ("debit", "credit")])


@query("src09_split_account", "SELECT account, site, count(*) AS n FROM (SELECT account, 'AB' || chr(CAST(65 + CAST(site[2:] AS INT) AS INT)) AS site FROM ledger) GROUP BY ALL")
def src09(led: DataFrame) -> DataFrame:
    letter = F.char(F.lit(65) + F.substring("site", 2, 1).cast("int"))
    fused = led.withColumns({"account": F.concat("account", F.lit("AB"), letter), "site": F.lit(None).cast("string")})
    return canonical.split_account(fused).groupBy("account", "site").agg(F.count("*").alias("n"))


@query("src10_site_policy", "SELECT class, CASE WHEN class IN ('6', '7') THEN site END AS site, count(*) AS n FROM ledger GROUP BY ALL")
def src10(led: DataFrame) -> DataFrame:
    return canonical.site_policy(led).groupBy("class", "site").agg(F.count("*").alias("n"))


@query("src11_guard", "SELECT label[1:10000] AS label, count(*) AS n FROM ledger GROUP BY ALL")
def src11(led: DataFrame) -> DataFrame:
    dirty = led.select(F.concat(F.substring("label", 1, 3), F.char(F.lit(1)), F.expr("substring(label, 4)")).alias("label"))
    return canonical.guard(dirty)[0].groupBy("label").agg(F.count("*").alias("n"))


@query(
    "src12_unbalanced",
    "SELECT journal, period, sum(debit) AS debit, sum(credit) AS credit, count(*) AS vouchers, count(*) FILTER (abs(debit - credit) >= 0.01) AS unbalanced, sum(abs(debit - credit)) AS gap "
    "FROM (SELECT journal, period, voucher, sum(debit) AS debit, sum(credit) AS credit FROM ledger GROUP BY ALL) GROUP BY ALL",
)
def src12(led: DataFrame) -> DataFrame:
    """By journal and month: a voucher that is posted to several dates may be open in one of them."""
    return canonical.balance(led, ["journal", "period"])


@query(
    "src13_ledger_stats",
    "SELECT count(*) AS entries, count(DISTINCT account) AS accounts, count(DISTINCT site) AS sites, count(DISTINCT journal) AS journals, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(DISTINCT (account, site)) AS couples FROM ledger",
)
def src13(led: DataFrame) -> DataFrame:
    return dated(canonical.ledger_stats(led), "first_date", "last_date")


@query(
    "gen01_groupby",
    "SELECT account, year, sum(debit) AS debit_sum, round(avg(CAST(amount AS DOUBLE)), 4) + 0 AS amount_mean, count(DISTINCT journal) AS journal_nunique, arg_min(period, period) AS period_first, "
    "arg_max(period, period) AS period_last, count(label) AS label_count FROM ledger GROUP BY account, year",
)
def gen01(led: DataFrame) -> DataFrame:
    spec = {"debit": "sum", "amount": "mean", "journal": "nunique", "label": "count"}
    first = canonical.groupby_agg(led, ["account", "year"], spec)
    ends = led.groupBy("account", "year").agg(F.min("period").alias("period_first"), F.max("period").alias("period_last"))
    return first.join(ends, ["account", "year"]).withColumn("amount_mean", F.round("amount_mean", 4) + F.lit(0.0))


@query(
    "gen02_pivot",
    "SELECT account, " + ", ".join(f'coalesce(sum(amount) FILTER (month = {m}), 0) AS "{m}"' for m in range(1, 13)) + " FROM ledger WHERE year = 2000 GROUP BY account",
)
def gen02(led: DataFrame) -> DataFrame:
    return canonical.pivot_table(led.where("year = 2000"), "account", "month", list(range(1, 13)), "amount")


@query("gen03_filter", f"SELECT {LINE} FROM ledger WHERE account = '601000' AND journal IN ('OD', 'ACH')")
def gen03(led: DataFrame) -> DataFrame:
    return dated(canonical.filter_rows(led, {"account": "601000", "journal": ["OD", "ACH"]}))


@query(
    "gen04_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'sum({c})', 2)} AS sum, {r(f'avg(CAST({c} AS DOUBLE))')} AS mean, {r(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r(f'min({c})')} AS min, "
        f"{r(f'max({c})')} AS max, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median, count({c}) AS count FROM ledger"
        for c in ("debit", "credit", "amount")
    ),
)
def gen04(led: DataFrame) -> DataFrame:
    return canonical.compute_stats(led, ["debit", "credit", "amount"])
