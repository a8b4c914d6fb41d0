"""Drill-down views of an account."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import number, ratio, rounded, sum_if, total


def detail(df: DataFrame, prefix: str, n: int = 50) -> DataFrame:
    """Lines of the account's three-digit prefix, the largest first, with totals of all of them."""
    rows = df.where(F.col("account").startswith(prefix[:3]))
    sums = rows.agg(total(F.col("debit")).alias("all_debit"), total(F.col("credit")).alias("all_credit"), F.count("*").alias("all_lines"))
    top = rows.orderBy(F.abs("amount").desc(), "date", "voucher", "account", "label").limit(n)
    return top.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "account", "voucher", "label", "amount").crossJoin(F.broadcast(sums)).withColumn("balance", F.col("all_debit") - F.col("all_credit"))


def trend(df: DataFrame, prefix: str, year: int) -> DataFrame:
    """Total and lines per month, mean and sample deviation of the months, and whether a month is the largest."""
    m = df.where((F.col("year") == year) & F.col("account").startswith(prefix[:3])).groupBy("period").agg(total(F.col("amount")).alias("net"), F.count("*").alias("lines"))
    w = Window.partitionBy()
    v = number(F.col("net"))
    return m.select("period", "net", "lines", rounded(F.avg(v).over(w)).alias("mean"), rounded(F.stddev_samp(v).over(w), 2).alias("std"), (F.abs("net") == F.max(F.abs("net")).over(w)).alias("largest"))


def half_year(df: DataFrame, year: int) -> DataFrame:
    """Net of the first and second half-year by account, and the change in per cent."""
    g = df.where(F.col("year") == year).groupBy("account").agg(sum_if(F.col("amount"), F.col("month") <= 6).alias("s1"), sum_if(F.col("amount"), F.col("month") > 6).alias("s2"))
    return g.select("account", "s1", "s2", (F.col("s2") - F.col("s1")).alias("variation"), rounded(ratio(F.col("s2") - F.col("s1"), F.abs("s1")) * 100, 2).alias("variation_pct"))


def counterparties(df: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """Third parties with the largest volume on the other side of the account's vouchers."""
    v = df.where(F.col("account").startswith(prefix[:3])).select("voucher").distinct()
    rows = df.where("third_party IS NOT NULL").join(v, "voucher", "left_semi")
    return rows.groupBy("third_party").agg(F.sum(F.abs("amount")).alias("volume"), F.count("*").alias("lines")).orderBy(F.desc("volume"), "third_party").limit(n)


def breakdown(df: DataFrame, year: int, class_: str = "6") -> DataFrame:
    """Volume by account of a class and its share in per cent, to one place."""
    g = df.where((F.col("year") == year) & (F.col("class") == class_)).groupBy("prefix_2", "account").agg(F.sum(F.abs("amount")).alias("volume"))
    return g.withColumn("share_pct", rounded(ratio(F.col("volume"), F.sum("volume").over(Window.partitionBy())) * 100, 1))


ANSWER = ["name", "text", "v1", "v2", "v3", "v4"]


def answers(df: DataFrame, asked: DataFrame, lines: int = 50, parties: int = 10) -> DataFrame:
    """(question, drill, row, name, text, v1, v2, v3, v4): the answers to all questions, each kind in one pass over the ledger.

    asked: (question, drill, account, year). The parameters are a table that is joined to the
    ledger, so the passes don't grow with the questions. By kind of drill-down, the rows are those of
    detail_view: detail() (account; date, voucher and label; amount, debit, credit and number of all lines),
    trend_analysis: trend() (month; whether it is the largest; net, lines, mean, deviation),
    comparison: half_year() (account; both halves, change, change in per cent),
    counterparty: counterparties() (third party; volume, lines),
    breakdown: breakdown() (account; two-digit prefix; volume, share), of the class of the account, or 6.
    Without an account, trends and third parties are those of the whole ledger. A question
    that has no answer, such as a detail without an account, has one row with number 0.
    """
    q = asked.select("question", "drill", F.substring("account", 1, 3).alias("p"), "year", F.coalesce(F.substring("account", 1, 1), F.lit("6")).alias("c"))
    of = lambda drill, *cols: q.where((F.col("drill") == drill)).select(*cols).distinct()
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")

    def shaped(rows: DataFrame, drill: str, keys: list[str], *cols: Column) -> DataFrame:
        values = [*cols, *[no_value] * (6 - len(cols))]
        named = rows.select(F.lit(drill).alias("drill"), *[F.col(k).alias(f"k_{k}") for k in keys], F.col("row").cast("int").alias("row"), *[(c.cast("double") if i > 1 else c.cast("string")).alias(n) for i, (n, c) in enumerate(zip(ANSWER, values))])
        return q.join(named.withColumnRenamed("drill", "d"), (F.col("drill") == F.col("d")) & _same(keys)).select("question", "drill", "row", *ANSWER)

    def numbered(rows: DataFrame, keys: list[str], *order: Column | str, most: int | None = None) -> DataFrame:
        made = rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return made.where(F.col("row") <= most) if most else made

    # lines of an account
    rows = df.join(of("detail_view", "p").where("p IS NOT NULL"), F.col("prefix_3") == F.col("p"))
    sums = rows.groupBy("p").agg(total(F.col("debit")).alias("all_debit"), total(F.col("credit")).alias("all_credit"), F.count("*").alias("all_lines"))
    top = numbered(rows, ["p"], F.abs("amount").desc(), "date", "voucher", "account", "label", most=lines).join(sums, "p")
    line = F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), "voucher", "label")
    out = [shaped(top, "detail_view", ["p"], F.col("account"), line, F.col("amount"), F.col("all_debit"), F.col("all_credit"), F.col("all_lines"))]

    # months, of accounts and of all
    months = df.join(of("trend_analysis", "year"), "year", "left_semi").groupBy("prefix_3", "year", "period").agg(total(F.col("amount")).alias("net"), F.count("*").alias("lines"))
    wanted = of("trend_analysis", "p", "year")
    own = months.join(wanted.withColumnRenamed("year", "y"), (F.col("prefix_3") == F.col("p")) & (F.col("year") == F.col("y"))).select("p", "year", "period", "net", "lines")
    every = months.join(wanted.where("p IS NULL"), "year", "left_semi").groupBy("year", "period").agg(F.sum("net").alias("net"), F.sum("lines").alias("lines"))
    trend_ = own.unionByName(every.withColumn("p", no_text))
    w, v = Window.partitionBy("p", "year"), number(F.col("net"))
    trend_ = trend_.withColumns({"mean": rounded(F.avg(v).over(w)), "std": rounded(F.stddev_samp(v).over(w), 2), "largest": F.abs("net") == F.max(F.abs("net")).over(w)})
    out.append(shaped(numbered(trend_, ["p", "year"], "period"), "trend_analysis", ["p", "year"], F.col("period"), F.col("largest"), F.col("net"), F.col("lines"), F.col("mean"), F.col("std")))

    # halves of the year
    g = df.join(of("comparison", "year"), "year", "left_semi").groupBy("account", "year").agg(sum_if(F.col("amount"), F.col("month") <= 6).alias("s1"), sum_if(F.col("amount"), F.col("month") > 6).alias("s2"))
    change = F.col("s2") - F.col("s1")
    out.append(shaped(numbered(g, ["year"], "account"), "comparison", ["year"], F.col("account"), no_text, F.col("s1"), F.col("s2"), change, rounded(ratio(change, F.abs("s1")) * 100, 2)))

    # third parties of the vouchers of accounts, and of all
    wanted = of("counterparty", "p")
    vouchers = df.join(wanted.where("p IS NOT NULL"), F.col("prefix_3") == F.col("p")).select("p", "voucher").distinct()
    party = df.where("third_party IS NOT NULL").select("voucher", "third_party", "amount")
    sums = lambda rows, *keys: rows.groupBy(*keys, "third_party").agg(F.sum(F.abs("amount")).alias("volume"), F.count("*").alias("lines"))
    every = sums(party).join(wanted.where("p IS NULL"), F.lit(True), "left_semi").withColumn("p", no_text)
    both = sums(party.join(vouchers, "voucher"), "p").unionByName(every.select("p", "third_party", "volume", "lines"))
    out.append(shaped(numbered(both, ["p"], F.desc("volume"), "third_party", most=parties), "counterparty", ["p"], F.col("third_party"), no_text, F.col("volume"), F.col("lines")))

    # accounts of a class
    g = df.join(of("breakdown", "c", "year").withColumnRenamed("year", "y"), (F.col("class") == F.col("c")) & (F.col("year") == F.col("y"))).groupBy("c", "year", "prefix_2", "account").agg(F.sum(F.abs("amount")).alias("volume"))
    share = rounded(ratio(F.col("volume"), F.sum("volume").over(Window.partitionBy("c", "year"))) * 100, 1)
    g = numbered(g.withColumn("share", share), ["c", "year"], F.desc("volume"), "account")
    out.append(shaped(g, "breakdown", ["c", "year"], F.col("account"), F.col("prefix_2"), F.col("volume"), F.col("share")))

    found = reduce(DataFrame.unionByName, out)
    none = q.join(found, ["question"], "left_anti").select("question", "drill", F.lit(0).alias("row"), no_text.alias("name"), no_text.alias("text"), *[no_value.alias(c) for c in ANSWER[2:]])
    return found.unionByName(none)


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
