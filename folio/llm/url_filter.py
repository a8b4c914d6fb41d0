"""URL filters: longest rules first, then trust and distrust over the host link graph.

Trust is a personalised PageRank from hosts with allowed pages along links; distrust
is one from hosts with blocked pages against the links, so that it reaches those who
link there. Ranks are whole numbers (parts of 10^12), which makes results equal on
every run. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize

#: (verdict, host and path of the rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"
UNIT = 10**12
DAMPING = 85
#: Rounds that the SQL writes out; ranks here go on until they settle.
ROUNDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null; of equally long ones the last in code point order."""
    found = []
    for verdict, rule in rules:
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links from pages of one host to another, counted."""
    linked = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    pairs = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src != '' AND src != dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, rank) of the personalised PageRank from seeds (host, seed), when no rank changes any more.

    edges: (src, dst, share, whole), share of whole of a rank goes along. An edge's
    part is rounded down; ranks without edges onward are not handed back. Ranks are whole
    numbers that start at their least and only grow, so an equal total means equal ranks.
    """
    own = F.expr(f"{100 - DAMPING} * seed div 100")
    ranks, before = materialize(seeds.select("host", own.alias("rank")).where("rank > 0"), "ranks"), None
    total = lambda r: r.agg(F.sum(F.col("rank").cast("decimal(38,0)"))).first()[0]
    now = total(ranks)
    while now != before:
        for _ in range(4):
            part = F.expr("(CAST(rank AS DECIMAL(20,0)) * CAST(share AS DECIMAL(18,0))) div CAST(whole AS DECIMAL(20,0))")
            got = edges.join(ranks, edges["src"] == ranks["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(part).alias("got"))
            mixed = F.expr(f"({100 - DAMPING} * coalesce(seed, 0) + {DAMPING} * coalesce(got, 0)) div 100")
            ranks = seeds.join(got, "host", "full_outer").select("host", mixed.alias("rank")).where("rank > 0")
        ranks = materialize(ranks, "ranks")
        before, now = now, total(ranks)
    return ranks


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row.

    A url that is null or without `://` has an empty host and path, fits no rule and
    is allowed. Seeds: each host's share of all allowed and of all blocked pages. Pages
    without a rule are blocked where their host's distrust exceeds threshold times its
    trust, else allowed. Null html has no links. Repeated rows count as often as they
    come; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    counts = rows.groupBy("host").agg(*[F.count_if(F.col("best.verdict") == v).alias(v) for v in ("allow", "block")])
    counts = materialize(counts.where("host != '' AND allow + block > 0"), "seeds")
    total = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    edges = materialize(host_edges(pages, url_col, html_col), "links")
    outward = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("whole")), "src").select("src", "dst", F.col("weight").alias("share"), "whole")
    inward = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("whole")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("share"), "whole")

    def seeds(kind: str) -> DataFrame:
        part = F.expr(f"(CAST({UNIT} AS DECIMAL(20,0)) * CAST(`{kind}` AS DECIMAL(18,0))) div CAST({total[kind] or 1} AS DECIMAL(20,0))")
        return counts.where(F.col(kind) > 0).select("host", part.alias("seed"))

    trust = spread(outward, seeds("allow")).withColumnRenamed("rank", "trust")
    distrust = spread(inward, seeds("block")).withColumnRenamed("rank", "distrust")
    known = trust.join(distrust, "host", "full_outer").select("host", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust")])
    joined = rows.join(known, "host", "left")
    method = F.when(F.coalesce("distrust", F.lit(0)) > threshold * F.coalesce("trust", F.lit(0)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
