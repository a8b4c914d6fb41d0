"""Line features, weak labels, and outlier models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import number, rounded
from folio.functions.ranks import counted, quantiles, running
from folio.functions.tables import written

OD = ("OD", "AN", "RAN", "EXT", "EXTOURNE")
CLOSING = ("SIT", "SITUATION", "CLO", "CLOTURE", "BIL", "BILAN")
#: Quantiles over all lines are right to within one of so many parts of them.
ACCURACY = 10_000
MODEL_COLUMNS = ("log_amount", "month", "weekday", "day", "month_end", "weekend", "round_100", "round_1000", "z_account", "is_od", "day_lines")


def first_digit(amount: Column) -> Column:
    whole = F.floor(F.abs(amount)).cast("long").cast("string")
    return F.when(amount != 0, F.substring(whole, 1, 1).cast("int")).otherwise(0)


def features(df: DataFrame) -> DataFrame:
    """Calendar, amount, account and journal features of each line; Monday is 0.

    What is known of accounts and days is written first, so that its size is: lines don't move to it unless it is large.
    """
    a = number(F.abs("amount"))
    by_account = written(df.groupBy("account").agg(F.avg(a).alias("account_mean"), F.stddev_samp(a).alias("account_std"), F.count("*").alias("account_lines")), "accounts")
    by_day = written(df.groupBy("date").agg(F.count("*").alias("day_lines")), "days")
    day, weekday = F.dayofmonth("date"), F.weekday("date")
    std = F.when(F.coalesce("account_std", F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce("account_std", F.lit(1.0)))
    flag = lambda c: c.cast("int")
    cols = {
        "weekday": weekday, "day": day, "quarter": F.quarter("date"), "month_end": flag(day >= 25), "month_start": flag(day <= 5), "weekend": flag(weekday >= 5), "year_end": flag((F.col("month") == 12) & (day >= 20)),
        "log_amount": F.log1p(a), "sign": F.signum("amount").cast("int"), **{f"round_{b}": flag((a >= b) & (F.abs("amount") % b == 0)) for b in (10, 100, 1000, 10000)}, "first_digit": first_digit(F.col("amount")),
        "decimals": F.when(F.col("amount") % 1 == 0, 0).when(F.col("amount") * 10 % 1 == 0, 1).otherwise(2), "z_account": (a - F.col("account_mean")) / std, "is_od": flag(F.coalesce(F.upper("journal").isin(*OD), F.lit(False))), "is_closing": flag(F.coalesce(F.upper("journal").isin(*CLOSING), F.lit(False))),
    }
    return df.join(by_account, "account").join(by_day, "date").withColumns(cols)


def journal_index(df: DataFrame) -> DataFrame:
    """(journal, journal_index): the place of each journal among all in order, from 0; lines without one have none."""
    one = df.where("journal IS NOT NULL").select("journal").distinct().withColumn("one", F.lit(1))
    return running(one, [], ["journal"], "one").select("journal", F.col("before").cast("int").alias("journal_index"))


def isolation_top(df: DataFrame, scored: DataFrame, most: int = 20, influences: int = 3) -> DataFrame:
    """(rank, account, voucher, label, amount, score, influence): the first outliers, with the features that are farthest from their mean in deviations, as name=z.

    scored: isolation() of df, with the model's columns kept, of most lines at least.
    """
    means = features(df).agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in MODEL_COLUMNS for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    order = Window.orderBy(F.desc("score"), F.desc(F.abs("amount")), "voucher", "account", "label")
    # no more rows than most
    first = scored.where("is_outlier").orderBy(F.desc("score"), F.desc(F.abs("amount")), "voucher", "account", "label").limit(most).withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(means))
    z = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0))
    far = F.array_sort(F.array(*[F.struct((-F.round(F.abs(z(c)), 6)).alias("n"), F.lit(c).alias("c"), F.round(z(c), 2).alias("z")) for c in MODEL_COLUMNS]))
    named = F.array_join(F.transform(F.slice(far, 1, influences), lambda x: F.format_string("%s=%.2f", x["c"], x["z"])), ", ")
    return first.select("rank", "account", "voucher", "label", "amount", "score", named.alias("influence"))


def weak_labels(df: DataFrame) -> DataFrame:
    """features with weak_label 1 where one of five rules holds: large adjusting entries at the year's end, very round
    amounts on rare accounts, far from the account's mean, large at a weekend, first digit 9 when these are over 10 %."""
    f, a = features(df), number(F.abs("amount"))
    nines = df.agg(F.avg((first_digit(F.col("amount")) == 9).cast("int")).alias("nines"))
    s = quantiles(df, [], a, [0.95, 0.99]).select(F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99")).crossJoin(nines)
    rules = (
        ((F.col("is_od") == 1) & (F.col("year_end") == 1) & (a > F.col("p99"))) | ((F.col("round_10000") == 1) & (F.col("account_lines") < 5)) | (F.abs("z_account") > 4)
        | ((F.col("weekend") == 1) & (a > F.col("p95"))) | ((F.col("nines") > 0.1) & (F.col("first_digit") == 9))
    )
    return f.crossJoin(F.broadcast(s)).withColumn("weak_label", rules.cast("int")).drop("p95", "p99", "nines")


def usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of a leaf in a tree of n rows."""
    m = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0)


def forest_depths(forest: list[np.ndarray], columns: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from rows to their mean depth in the trees, node tables (column or -1, at, left, right, size).

    A tree isn't walked: for each column and each range of values between the forest's cuts
    there is a set of the tree's leaves that such values may reach, as bits; the one leaf that is
    in the sets of all columns is the row's.
    """
    cuts = [np.unique(np.concatenate([t[t[:, 0] == c, 1] for t in forest] or [np.zeros(0)])) for c in range(columns)]

    def table(t: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
        depths, far, parts = [], usual_depth(t[:, 4]), []

        def walk(i: int, depth: int) -> None:
            first = len(depths)
            if t[i, 0] < 0:
                depths.append(depth + far[i])
                return
            walk(int(t[i, 2]), depth + 1)
            middle = len(depths)
            walk(int(t[i, 3]), depth + 1)
            parts.append((int(t[i, 0]), t[i, 1], first, middle, len(depths)))

        walk(0, 0)
        words = -(-len(depths) // 64)
        bits = lambda a, b: np.array([(((1 << b) - (1 << a)) >> 64 * w) & (2**64 - 1) for w in range(words)], np.uint64)[:, None]
        sets: list[np.ndarray | None] = [None] * columns
        for c, at, first, middle, last in parts:
            if sets[c] is None:
                sets[c] = np.full((words, len(cuts[c]) + 1), 2**64 - 1, np.uint64)
            k = int(np.searchsorted(cuts[c], at)) + 1
            sets[c][:, k:] &= ~bits(first, middle)
            sets[c][:, :k] &= ~bits(middle, last)
        value = np.zeros((words, 65))
        for i, d in enumerate(depths):
            value[i // 64, i % 64] = d
        return sets, value

    tables = [table(t) for t in forest]
    def mean_depth(x: np.ndarray) -> np.ndarray:
        # how many cuts a value has reached; what is no number has reached all
        rank = [np.searchsorted(cuts[c], x[:, c], side="right") for c in range(columns)]
        # columns of few values are looked up once for each combination that a batch has
        few = [c for c in range(columns) if np.count_nonzero(np.bincount(rank[c])) <= 32]
        rest = [c for c in range(columns) if c not in few]
        code = np.zeros(len(x), np.int64)
        for c in few:
            code = np.unique(code, return_inverse=True)[1] * (len(cuts[c]) + 1) + rank[c]
        _, at, of = np.unique(code, return_index=True, return_inverse=True)
        combined = {c: rank[c][at] for c in few}
        depth = np.zeros(len(x))
        for sets, value in tables:
            found = np.zeros(len(x))
            for w in range(len(value)):
                # leaves that no column has cut off; bits beyond the last leaf have none
                left = np.full(len(at), 2**64 - 1, np.uint64)
                for c in few:
                    if sets[c] is not None:
                        left &= sets[c][w].take(combined[c])
                left = left.take(of)
                for c in rest:
                    if sets[c] is not None:
                        left &= sets[c][w].take(rank[c])
                found += value[w].take(np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)))
            depth += found
        return depth / max(1, len(forest))

    return mean_depth


Scores = Callable[[np.ndarray], np.ndarray]


def applied(lines: DataFrame, name: str, fields: list[str], make: Callable[[], Scores]) -> DataFrame:
    """lines with a struct of doubles, which a function that each task makes gives for the model's columns of a batch.

    In Python: as expressions beside the features these make a method that the JVM no longer compiles.
    """

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        made = make()
        for columns in batches:
            yield pd.DataFrame(made(np.stack([c.to_numpy(float) for c in columns], axis=1)), columns=fields)

    return lines.withColumn(name, run(*[F.col(c).cast("double") for c in MODEL_COLUMNS]))


def isolation_scores(lines: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> Callable[[], Scores]:
    """Makes the function from rows to their isolation-forest scores, one column.

    Each tree is built by a task on about sample lines, chosen for it by a hash (the forest's
    documented bound). The forest is broadcast: at most trees × 2 × sample nodes.
    """
    cols = list(MODEL_COLUMNS)
    n = max(1, lines.count())
    key = F.xxhash64("voucher", "account", "label", "amount", "date")
    share = min(1.0, trees * sample / n)
    picked = lines.where(F.pmod(key, F.lit(1_000_000)) < int(1_000_000 * share) + 1).select(*[F.col(c).cast("double").alias(c) for c in cols], F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(trees)).alias("tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
        x = pdf[cols].to_numpy()
        x = x[np.lexsort(x.T)]
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int) -> int:
            i = len(nodes)
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if len(rows) > 1 and depth < np.ceil(np.log2(sample)) and len(open_):
                c = int(rng.choice(open_))
                at = rng.uniform(low[c], high[c])
                left = x[rows, c] < at
                nodes[i][:2] = [c, at]
                nodes[i][2], nodes[i][3] = split(rows[left], depth + 1), split(rows[~left], depth + 1)
            return i

        split(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["column", "at", "left", "right", "size"]).assign(tree=int(pdf["tree"].iloc[0]), node=range(len(nodes)))

    forest = picked.groupBy("tree").applyInPandas(grow, "column double, at double, left double, right double, size double, tree long, node long").toPandas()
    grown = [t.sort_values("node")[["column", "at", "left", "right", "size"]].to_numpy() for _, t in forest.groupby("tree")]
    shared = lines.sparkSession.sparkContext.broadcast(grown)

    def make() -> Scores:
        mean_depth, usual = forest_depths(shared.value, len(cols)), usual_depth(np.array([float(sample)]))[0]
        return lambda x: np.round(2.0 ** (-mean_depth(x) / usual), 6)[:, None]

    return make


def isolation(df: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42, keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Lines with their isolation-forest score (higher is odder) and whether it is among the top share.

    keep: columns of features() to keep. most: how many of the first lines are wanted: only of
    those that may be among them, ties included, other columns than the score are kept and written.
    All lines are scored. The limit of the share is a quantile to within 1 / ACCURACY of the lines.
    """
    lines = features(df)
    scores = isolation_scores(lines, trees, sample, seed)

    def make() -> Scores:
        score = scores()

        def run(x: np.ndarray) -> np.ndarray:
            s = score(x)
            # a line below the first ones of its batch is below the first of all
            near = np.ones_like(s) if most is None or len(s) <= most else s >= np.partition(s[:, 0], -most)[-most]
            return np.column_stack([s, near])

        return run

    shown = ["date", "account", "voucher", "label", "amount", *keep]
    made = applied(lines, "__s", ["score", "near"], make)
    kept = [F.col(c) if most is None else F.when(F.col("__s.near") > 0, F.col(c)).alias(c) for c in shown]
    scored = written(made.select(*kept, F.col("__s.score").alias("score")), "scores")
    limit = F.broadcast(scored.agg(F.percentile_approx("score", 1 - contamination, ACCURACY).alias("limit")))
    return scored.crossJoin(limit).select(*shown, "score", (F.col("score") > F.col("limit")).alias("is_outlier"))


def components(lines: DataFrame, k: int = 4) -> Callable[[], Scores]:
    """Makes the function from rows to the error of their linear reconstruction from k components, and their places along these.

    The components are those of the columns' correlations, a matrix that one pass over the
    lines sums up and the driver takes apart.
    """
    x = {c: F.col(c).cast("double") for c in MODEL_COLUMNS}
    n, *moments = lines.agg(F.count("*"), *[f(x[c]) for c in MODEL_COLUMNS for f in (F.avg, F.stddev_samp)]).first()
    mean, std = ([float(v or 0) for v in moments[i::2]] for i in (0, 1))
    z = [f"__z{i}" for i in range(len(x))]
    rows = lines.withColumns({name: (x[c] - m) / s if s > 0 else F.lit(0.0) for name, c, m, s in zip(z, MODEL_COLUMNS, mean, std)})
    pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
    sums = rows.agg(*[F.sum(F.col(z[i]) * F.col(z[j])) for i, j in pairs]).first()
    cov = np.zeros((len(z), len(z)))
    for (i, j), v in zip(pairs, sums):
        cov[i, j] = cov[j, i] = (v or 0.0) / max(1, n - 1)
    main = np.linalg.svd(cov)[0][:, :k]
    centre, scale = np.array(mean), np.array([1 / s if s > 0 else 0.0 for s in std])

    def project(rows: np.ndarray) -> np.ndarray:
        v = (rows - centre) * scale
        latent = v @ main
        # components are orthonormal, so the error is the squared length that they leave
        left = np.maximum((v * v).sum(axis=1) - (latent * latent).sum(axis=1), 0.0)
        return np.column_stack([left, latent])

    return lambda: project


def reconstruction_errors(df: DataFrame, k: int = 4) -> DataFrame:
    """Line features with the error of their linear reconstruction from k components, and their places along these."""
    lines = features(df)
    y = [f"__y{i}" for i in range(k)]
    made = applied(lines, "__p", ["error", *y], components(lines, k))
    return made.select(*lines.columns, rounded(F.col("__p.error")).alias("error"), F.array(*[F.col(f"__p.{c}") for c in y]).alias("latent"))


#: So many distinct errors at most are sent to all tasks, about 30 bytes each; beyond that lines move to them.
SENT = 1_000_000


def latent_views(errors: DataFrame) -> DataFrame:
    """reconstruction_errors() with percentile, the share of lines whose error is no larger, in per cent; errors are ranked by ranges.

    errors is written, so give the columns that are wanted only.
    """
    errors = written(errors, "errors")
    ranked = counted(errors, [], F.col("error")).select(F.col("value").alias("e"), rounded((F.col("before") + F.col("n")) / F.col("whole") * 100).alias("percentile"))
    ranked = written(ranked, "percentiles")
    return errors.join(F.broadcast(ranked) if ranked.count() <= SENT else ranked, F.col("error") == F.col("e")).drop("e")


def reconstruction(df: DataFrame, k: int = 4, share: float = 0.95) -> DataFrame:
    """Lines with their reconstruction error and whether it is above the quantile (to within 1 / ACCURACY of the lines)."""
    errors = written(reconstruction_errors(df, k).select("date", "account", "voucher", "label", "amount", "error"), "errors")
    limit = F.broadcast(errors.agg(F.percentile_approx("error", share, ACCURACY).alias("limit")))
    return errors.crossJoin(limit).select("date", "account", "voucher", "label", "amount", "error", (F.col("error") > F.col("limit")).alias("is_outlier"))
