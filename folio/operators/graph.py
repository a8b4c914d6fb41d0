"""Counterparty graph, its monthly changes, circuits, and topology.

Lines move once, to the place of their voucher, and are summed there by (voucher, account,
side). Each side meets the accounts opposite and its amount is multiplied by the number of
their lines, which gives every flow of the line-by-line product without making that product.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import MONEY, any_of, correlation, first_of, number, ratio, rounded, sum_if
from folio.functions.tables import written

# Account family, kind of template, expected prefixes of counterparties.
TEMPLATE_ROWS = [
    ("641", "paie", "421 425 431 437 442 512"),
    ("645", "charges_sociales", "431 437 438 512"),
    ("647", "charges_sociales", "437 438 512"),
    ("601", "achats", "401 408 512"),
    ("602", "achats", "401 408 512"),
    ("604", "achats", "401 408 512"),
    ("606", "achats", "401 512"),
    ("607", "achats", "401 408 512"),
    ("611", "services", "401 408 488"),
    ("613", "charge_recurrente", "401 486 488"),
    ("614", "charge_recurrente", "401 488"),
    ("615", "services", "401 408 512"),
    ("616", "charge_recurrente", "401 486 488"),
    ("617", "services", "401 408"),
    ("618", "services", "401 512"),
    ("622", "honoraires", "401 421 431 512"),
    ("623", "services", "401 512"),
    ("625", "frais", "401 421 512"),
    ("626", "services", "401 512"),
    ("627", "frais_bancaires", "512"),
    ("631", "taxes", "442 447 512"),
    ("633", "taxes", "447 488 512"),
    ("635", "taxes", "447 488 512"),
    ("661", "financier", "164 512 518"),
    ("666", "financier", "512"),
    ("681", "dotation", "28 29 39 49 15"),
    ("686", "dotation", "29 49 15"),
    ("687", "dotation", "15"),
    ("706", "facturation_client", "411 419 487"),
    ("707", "facturation_client", "411 419"),
    ("708", "facturation_client", "411 512"),
    ("781", "reprise", "28 29 39 49 15"),
    ("786", "reprise", "29 49 15"),
    ("787", "reprise", "15"),
    ("791", "transfert", "6"),
]

# Kind of circuit and prefixes of its balance-sheet accounts.
CIRCUITS = {"488": ["488"], "486": ["486"], "487": ["487"], "408": ["408"], "481": ["481", "15"]}

# Account prefixes that are expected to be coupled, and the meaning.
COUPLINGS = [
    ("641", "421", "Salaires → Personnel à payer"),
    ("641", "431", "Salaires → URSSAF"),
    ("641", "437", "Salaires → Autres organismes sociaux"),
    ("645", "431", "Charges sociales → URSSAF"),
    ("645", "437", "Charges sociales → Autres organismes"),
    ("601", "401", "Achats → Fournisseurs"),
    ("606", "401", "Fournitures → Fournisseurs"),
    ("607", "401", "Marchandises → Fournisseurs"),
    ("706", "411", "Prestations → Clients"),
    ("707", "411", "Ventes → Clients"),
    ("681", "28", "Dotations → Amortissements"),
    ("681", "15", "Dotations → Provisions"),
    ("781", "28", "Reprises → Amortissements"),
    ("781", "15", "Reprises → Provisions"),
    ("6", "488", "Charges → Charges à payer (ABT)"),
    ("661", "512", "Intérêts → Banque"),
    ("627", "512", "Frais bancaires → Banque"),
]
NEW_SCORE, GONE_SCORE, MIN_VOLUME, SPIKE = 0.8, 0.6, 100, 2.0


#: Hundredths are summed in two parts, above and below this many, as longs: exact, and far cheaper than wide decimals.
PART = 10**9


def at_vouchers(df: DataFrame, *columns: Column | str) -> DataFrame:
    """(voucher, columns, debited) of the lines, those of a voucher in one place: the one shuffle of lines."""
    return df.where("voucher IS NOT NULL").select("voucher", *columns, (F.col("debit") > 0).alias("debited")).repartition("voucher")


def sides(df: DataFrame, *by: str) -> DataFrame:
    """(voucher, by, account, debited, lines), in the voucher's place."""
    return at_vouchers(df, *by, "account").groupBy("voucher", *by, "account", "debited").agg(F.count("*").alias("lines"))


def opposed(s: DataFrame) -> DataFrame:
    """Each row of sides with each account on the other side of its voucher (other) and that one's lines (n).

    The rows are in their voucher's place and are sorted there by it; a voucher's accounts are held as two lists.
    """
    w, entry = Window.partitionBy("voucher"), F.struct(F.col("account").alias("other"), F.col("lines").alias("n"))
    both = s.where("debited IS NOT NULL").withColumns({"debits": F.collect_list(F.when(F.col("debited"), entry)).over(w), "credits": F.collect_list(F.when(~F.col("debited"), entry)).over(w)})
    return both.select(*s.columns, F.inline(F.when(F.col("debited"), F.col("credits")).otherwise(F.col("debits"))))


def arcs(df: DataFrame) -> DataFrame:
    """(voucher, source, dest, pairs): debit account × credit account of each voucher, with the number of line pairs."""
    return opposed(sides(df)).where("debited").select("voucher", F.col("account").alias("source"), F.col("other").alias("dest"), (F.col("lines") * F.col("n")).alias("pairs"))


def flow(df: DataFrame) -> DataFrame:
    """(site, period, source, dest, volume, entries): each line's amount counted once for each opposite line of its voucher."""
    cents = (F.abs("amount").cast(MONEY) * 100).cast("long")
    lines = at_vouchers(df, "site", "period", "account", cents.alias("cents"))
    high, low = F.expr(f"cents div {PART}"), F.col("cents") % PART
    s = lines.groupBy("voucher", "site", "period", "account", "debited").agg(F.count("*").alias("lines"), F.sum(high).alias("high"), F.sum(low).alias("low"))
    j = opposed(s)
    source, dest = F.when(F.col("debited"), F.col("account")).otherwise(F.col("other")), F.when(F.col("debited"), F.col("other")).otherwise(F.col("account"))
    g = j.groupBy("site", "period", source.alias("source"), dest.alias("dest")).agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("high", "low", "lines")])
    whole = F.col("high").cast("decimal(20,0)") * F.lit(Decimal(PART // 100)) + F.col("low").cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    return g.select("site", "period", "source", "dest", whole.cast("decimal(28,2)").alias("volume"), F.col("lines").alias("entries"))


def by_period(f: DataFrame) -> DataFrame:
    return f.groupBy("period", "source", "dest").agg(F.sum("volume").alias("volume"))


def nodes(f: DataFrame) -> DataFrame:
    """(account, kind, degree_out, degree_in): P&L and balance-sheet accounts with their numbers of neighbours."""
    ends = f.select(F.col("source").alias("account"), F.col("dest").alias("o"), F.lit(None).cast("string").alias("i")).unionByName(f.select(F.col("dest").alias("account"), F.lit(None).cast("string").alias("o"), F.col("source").alias("i")))
    kind = F.when(F.substring("account", 1, 1).isin("6", "7"), "PNL").otherwise("BILAN")
    return ends.groupBy("account").agg(F.count_distinct("o").alias("degree_out"), F.count_distinct("i").alias("degree_in")).withColumn("kind", kind)


def signature(f: DataFrame) -> DataFrame:
    """Per month: arcs, nodes of both kinds, flow, mean degree, share of the five largest arcs."""
    m = written(by_period(f), "arcs")
    ranked = m.withColumn("rn", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("volume"), "source", "dest")))
    g = ranked.groupBy("period").agg(F.count("*").alias("arcs"), F.sum("volume").alias("flow"), F.sum(F.when(F.col("rn") <= 5, F.col("volume"))).alias("top"))
    n = m.select("period", F.explode(F.array("source", "dest")).alias("account")).distinct()
    pnl = F.substring("account", 1, 1).isin("6", "7")
    k = n.groupBy("period").agg(F.count_if(pnl).alias("pnl_nodes"), F.count_if(~pnl).alias("balance_nodes"))
    return g.join(k, "period").select("period", "arcs", "pnl_nodes", "balance_nodes", number(F.col("flow")).alias("flow"), rounded(2 * F.col("arcs") / (F.col("pnl_nodes") + F.col("balance_nodes"))).alias("mean_degree"), rounded(ratio(F.col("top"), F.col("flow"))).alias("top5_share"))


def steps(f: DataFrame) -> DataFrame:
    """Arcs of each month against the month present before it: (period, source, dest, before, now)."""
    m = written(by_period(f), "arcs")
    order = m.select("period").distinct().select("period", F.lead("period").over(Window.orderBy("period")).alias("next"), F.lag("period").over(Window.orderBy("period")).alias("last"))
    seen = F.array(
        F.struct(F.when(F.col("last").isNotNull(), F.col("period")).alias("period"), F.col("volume").alias("now"), F.lit(None).cast("decimal(38,2)").alias("before")),
        F.struct(F.col("next").alias("period"), F.lit(None).cast("decimal(38,2)").alias("now"), F.col("volume").alias("before")),
    )
    e = m.join(F.broadcast(order), "period").select("source", "dest", F.explode(seen).alias("e")).select("source", "dest", "e.*").where("period IS NOT NULL")
    return e.groupBy("period", "source", "dest").agg(F.max("before").alias("before"), F.max("now").alias("now"))


def stability(f: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """Per month: Jaccard distance of the arc sets and Kullback-Leibler divergence of the volume shares to the month before."""
    w = Window.partitionBy("period")
    s = steps(f).withColumns({"p": F.coalesce(number(F.col("now")), F.lit(0.0)), "q": F.coalesce(number(F.col("before")), F.lit(0.0))})
    s = s.withColumns({"p": F.col("p") / F.sum("p").over(w) + epsilon, "q": F.col("q") / F.sum("q").over(w) + epsilon})
    both = F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull())
    return s.groupBy("period").agg(rounded(1 - both / F.count("*")).alias("jaccard_distance"), rounded(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl_divergence"))


def mutations(f: DataFrame) -> DataFrame:
    """New, gone, swollen and shrunken arcs, with scores; arcs below 100 on both sides are left out."""
    s = steps(f)
    r = number(F.col("now")) / number(F.col("before"))
    kind = first_of([(F.col("before").isNull() & (F.col("now") >= MIN_VOLUME), "NEW_ARC"), (F.col("now").isNull() & (F.col("before") >= MIN_VOLUME), "DISAPPEARED"),
                     (r > SPIKE, "VOLUME_SPIKE"), (r < 1 / SPIKE, "VOLUME_DROP")])
    both_small = (F.col("now") < MIN_VOLUME) & (F.col("before") < MIN_VOLUME)
    score = first_of([(F.col("kind") == "NEW_ARC", NEW_SCORE), (F.col("kind") == "DISAPPEARED", GONE_SCORE), (F.col("kind") == "VOLUME_SPIKE", F.least(F.lit(0.9), r / 5))], F.least(F.lit(0.7), 1 / r / 5))
    zero = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
    return s.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~F.coalesce(both_small, F.lit(False))).select("period", "source", "dest", "kind", zero("now").alias("now"), zero("before").alias("before"), rounded(score).alias("score"))


def templates(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(TEMPLATE_ROWS, "family string, template string, prefixes string").withColumn("prefixes", F.split("prefixes", " ")))


def counterparties(df: DataFrame) -> DataFrame:
    """(family, counterparty, pairs): line pairs of each account family with opposite accounts."""
    return opposed(sides(df)).groupBy(F.substring("account", 1, 3).alias("family"), F.col("other").alias("counterparty")).agg(F.sum(F.col("lines") * F.col("n")).alias("pairs"))


def judged(df: DataFrame) -> DataFrame:
    fits = F.exists("prefixes", lambda p: F.col("counterparty").startswith(p))
    return counterparties(df).join(templates(df), "family", "left").withColumn("conform", F.coalesce(fits, F.lit(True)))


def atypical(df: DataFrame) -> DataFrame:
    """Pairs that a template of the family doesn't expect."""
    return judged(df).where("NOT conform").select("family", "counterparty", "template", "pairs")


def conformity(df: DataFrame) -> DataFrame:
    """Share of conforming pairs per family and its five most frequent counterparties."""
    j = judged(df).withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("pairs"), "counterparty")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "counterparty")))), lambda x: x["counterparty"]), ",")
    return j.groupBy("family").agg(F.sum("pairs").alias("pairs"), rounded(F.sum(F.when(F.col("conform"), F.col("pairs")).otherwise(0)) / F.sum("pairs")).alias("rate"), top.alias("top_counterparties"))


def suggest(df: DataFrame, least: int = 10, share: float = 0.1) -> DataFrame:
    """Unexpected counterparties (3 digits) frequent enough to join the template."""
    j = judged(df).groupBy("family", "template", F.substring("counterparty", 1, 3).alias("prefix"), "conform").agg(F.sum("pairs").alias("pairs"))
    j = j.withColumn("share", F.col("pairs") / F.sum("pairs").over(Window.partitionBy("family")))
    return j.where(F.col("template").isNotNull() & ~F.col("conform") & (F.col("pairs") >= least) & (F.col("share") >= share)).select("family", "prefix", "pairs", rounded(F.col("share")).alias("share"))


def circuit_kind(account: Column) -> Column:
    return first_of([(any_of(account.startswith(p) for p in ps), k) for k, ps in CIRCUITS.items()])


def circuits(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per balance account and site: its P&L account, provisions (credits), reversals (debits), actual charges, status, severity.

    The P&L account is the most frequent counterparty (smallest on ties). Actual charges are the
    P&L account's lines of the site in vouchers with a 401 or 512 account on the opposite side.
    """
    rows = df.withColumn("kind", circuit_kind(F.col("account"))).where("kind IS NOT NULL")
    s = sides(df, "site")
    own = s.withColumn("kind", circuit_kind(F.col("account"))).where("kind IS NOT NULL").select("voucher", "debited", F.col("account").alias("balance"), "site", F.col("lines").alias("n"))
    pnl = s.where(F.substring("account", 1, 1).isin("6", "7")).select("voucher", (~F.col("debited")).alias("debited"), "account", F.col("lines").alias("k"))
    hits = own.join(pnl, ["voucher", "debited"]).groupBy("balance", "site", "account").agg(F.sum(F.col("n") * F.col("k")).alias("hits"))
    main = hits.groupBy("balance", "site").agg(F.min_by("account", F.struct(-F.col("hits"), F.col("account"))).alias("pnl_account"))
    c, d = F.col("credit") > 0, F.abs("amount")
    sums = rows.groupBy("kind", F.col("account").alias("balance"), "site").agg(
        sum_if(d, c).alias("provisions"), sum_if(d, ~c).alias("reversals"), F.count_distinct(F.when(c, F.col("period"))).alias("provision_months"),
        F.try_divide(F.stddev_pop(F.when(c, number(d))), F.avg(F.when(c, number(d)))).alias("cv"),
    )
    paid = s.where(F.col("account").startswith("401") | F.col("account").startswith("512")).select("voucher", (~F.col("debited")).alias("debited")).distinct()
    actual = df.where(F.col("class").isin("6", "7")).withColumn("debited", F.col("debit") > 0).join(paid, ["voucher", "debited"], "left_semi")
    actual = actual.groupBy(F.col("account").alias("pnl_account"), "site").agg(F.sum(F.abs("amount")).alias("actual"))
    j = sums.join(main, ["balance", "site"]).join(actual, ["pnl_account", "site"], "left")
    bal = F.col("provisions") - F.col("reversals")
    real = F.coalesce("actual", F.lit(0))
    closed = F.coalesce(F.try_divide(F.abs(number(bal)), number(F.col("provisions") + F.col("reversals"))) < tolerance, F.lit(True))
    gap = ratio(number(real) - number(F.col("provisions")), F.col("provisions"))
    level = first_of([(~closed & (F.abs(bal) > 1000), "alerte"), (F.abs(gap) > 0.2, "attention"), (~closed, "attention")], "ok")
    return j.select("kind", "balance", "site", "pnl_account", number(F.col("provisions")).alias("provisions"), number(F.col("reversals")).alias("reversals"), number(bal).alias("residual"), number(real).alias("actual"),
                    closed.alias("closed"), rounded(gap).alias("gap"), "provision_months", rounded(F.coalesce("cv", F.lit(0.0))).alias("provision_cv"), level.alias("severity"))


def circuit_summary(c: DataFrame, gap: float = 0.1) -> DataFrame:
    return c.groupBy("kind", "severity").agg(F.count("*").alias("circuits"), F.count_if(~F.col("closed")).alias("open"), F.count_if(F.abs("gap") > gap).alias("significant_gaps"), rounded(F.sum("residual"), 2).alias("residual"))


def actual_charges(df: DataFrame) -> DataFrame:
    """Lines of P&L accounts with a 401 or 512 account on the opposite side of the voucher, each once."""
    paid = sides(df).where(F.col("account").startswith("401") | F.col("account").startswith("512")).select("voucher", (~F.col("debited")).alias("d")).distinct()
    rows = df.where(F.col("class").isin("6", "7")).withColumn("d", F.col("debit") > 0)
    return rows.join(paid, ["voucher", "d"], "left_semi").drop("d")


def matrix(df: DataFrame, least: float = 0) -> DataFrame:
    """Sparse flow matrix: (site, period, source, dest, volume) of at least least."""
    return flow(df).where(F.col("volume") >= least).select("site", "period", "source", "dest", "volume")


def normalize(m: DataFrame, how: str = "total") -> DataFrame:
    """Cells over the sum of their matrix, row or column."""
    by = {"total": [], "row": ["source"], "column": ["dest"]}[how]
    return m.withColumn("share", rounded(ratio(F.col("volume"), F.sum("volume").over(Window.partitionBy("site", "period", *by))), 6))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cosine, Frobenius distance and Jaccard index of two sparse matrices (source, dest, volume)."""
    x, y = F.coalesce(number(F.col("x")), F.lit(0.0)), F.coalesce(number(F.col("y")), F.lit(0.0))
    j = a.select("source", "dest", F.col("volume").alias("x")).join(b.select("source", "dest", F.col("volume").alias("y")), ["source", "dest"], "full_outer")
    return j.agg(
        rounded(F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y)), 6).alias("cosine"), rounded(F.sqrt(F.sum((x - y) * (x - y))), 2).alias("frobenius"),
        rounded(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*"), 6).alias("jaccard"),
    )


def chart_distance(a: Column, b: Column) -> Column:
    """1 − length of the common prefix over the longer length."""
    n = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    same = F.when(a == b, F.length(a)).otherwise(F.least(same, F.length(a), F.length(b)))
    return 1 - same / n


def proximity(df: DataFrame) -> DataFrame:
    """(a, b, emergent, chart, arcs): of accounts with flow between them, 1 − flow both ways over the larger total, and the chart distance."""
    m = flow(df).groupBy("source", "dest").agg(F.sum("volume").alias("v"), F.sum("entries").alias("n")).where("source != dest")
    m = written(m, "arcs")
    ends = m.select(F.col("source").alias("x"), "v").unionByName(m.select(F.col("dest").alias("x"), "v")).groupBy("x").agg(F.sum("v").alias("t"))
    pairs = m.groupBy(F.least("source", "dest").alias("a"), F.greatest("source", "dest").alias("b")).agg(F.sum("v").alias("v"), F.sum("n").alias("arcs"))
    of = lambda k: ends.select(F.col("x").alias(k), F.col("t").alias(f"t_{k}"))
    j = pairs.join(of("a"), "a").join(of("b"), "b")
    return j.select("a", "b", rounded(1 - number(F.col("v")) / F.greatest(number(F.col("t_a")), number(F.col("t_b")), F.lit(1.0))).alias("emergent"), rounded(chart_distance(F.col("a"), F.col("b"))).alias("chart"), "arcs")


def divergences(p: DataFrame, close: float = 0.3, far: float = 0.5, apart: float = 0.7) -> DataFrame:
    """Pairs close in flow but far in the chart, or the reverse."""
    kind = first_of([((F.col("emergent") < close) & (F.col("chart") > far), "COUPLAGE_INATTENDU"), ((F.col("emergent") > apart) & (F.col("chart") < close), "DECOUPLAGE")])
    return p.withColumn("divergence", kind).where("divergence IS NOT NULL").select("a", "b", "emergent", "chart", "divergence")


def proximity_stats(p: DataFrame) -> DataFrame:
    return p.agg(F.count("*").alias("pairs"), rounded(F.avg("emergent")).alias("mean_emergent"), rounded(F.avg("chart")).alias("mean_chart"), rounded(F.coalesce(correlation("emergent", "chart"), F.lit(0.0))).alias("correlation"))


def expected_coupling(p: DataFrame) -> DataFrame:
    """Pairs that match an expected coupling in either direction, with its meaning (the first in order)."""
    rows = [(i, x, y, t) for i, (x, y, t) in enumerate(COUPLINGS)]
    e = F.broadcast(p.sparkSession.createDataFrame(rows, "i int, x string, y string, meaning string"))
    fits = (F.col("a").startswith(F.col("x")) & F.col("b").startswith(F.col("y"))) | (F.col("a").startswith(F.col("y")) & F.col("b").startswith(F.col("x")))
    return p.join(e, fits).groupBy("a", "b", "emergent").agg(F.min_by("meaning", "i").alias("meaning"))

