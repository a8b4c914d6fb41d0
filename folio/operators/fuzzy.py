"""Edit-similarity join: known third parties that parts of a label are nearly equal to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import rounded
from folio.functions.tables import written

#: Words of a segment at most, and its characters at least.
MOST_WORDS, LEAST_CHARS = 4, 3
#: Strings of so many characters have their common subsequence counted in the bits of a long.
BITS = 61


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sorted_words(text: Column) -> Column:
    """The words of a text in order, with one blank between them."""
    return F.array_join(F.array_sort(words_of(text)), " ")


def segments(labels: DataFrame) -> DataFrame:
    """(label, segment, key): runs of one to MOST_WORDS words of each distinct label, and the same with sorted words."""
    rows = labels.select("label").where("label IS NOT NULL").distinct().withColumn("w", words_of(F.col("label")))
    n = F.size("w")
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), n - i + 1)), lambda k: F.array_join(F.slice("w", i, k), " "))))
    cut = rows.select("label", F.explode(F.array_distinct(runs)).alias("segment")).where(F.length("segment") >= LEAST_CHARS)
    return cut.withColumn("key", sorted_words(F.col("segment")))


def grams(keys: DataFrame) -> DataFrame:
    """(key, gram): pairs of neighbouring characters, the ends marked, each with the number of its like before it."""
    whole = F.concat(F.lit("\x02"), F.col("key"), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(whole, i, F.lit(2)))
    # few keys have a pair twice: only these are numbered
    numbered = F.transform("pairs", lambda g, i: F.concat(g, F.size(F.filter(F.slice("pairs", F.lit(1), i), lambda x: x == g)).cast("string")))
    made = keys.select("key", pairs.alias("pairs"))
    plain = F.size(F.array_distinct("pairs")) == F.size("pairs")
    return made.select("key", F.explode(F.when(plain, F.transform("pairs", lambda g: F.concat(g, F.lit("0")))).otherwise(numbered)).alias("gram"))


def prefixes(keys: DataFrame, rarity: DataFrame, threshold: int) -> DataFrame:
    """(key, gram): the rarest grams of each key, as many as two keys so alike must have one of in common.

    Strings of n and m characters whose longest common subsequence has c share 3 c + 1 - n - m
    grams at least; at the threshold c is half of (n + m) * threshold / 100, and m no smaller
    than what c itself allows.
    """
    half = threshold / 200
    n = F.length("key")
    shared = F.ceil(1 + (3 * half - 1) * (n + F.ceil(n * half / (1 - half) - 1e-9)) - 1e-9)
    flat = grams(keys).join(rarity, "gram")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("keys", "gram"))
    return flat.withColumn("r", rank).where(F.col("r") <= n + 2 - shared).select("key", "gram")


def _bits(b: Column) -> Column:
    """Map of the characters of a string to the bits of their places."""
    chars = F.split(b, "")
    bit = lambda i: F.pow(F.lit(2.0), i).cast("long")
    places = lambda c: F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, bit(i)).otherwise(0)), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, places(c))))


def _common_bits(a: Column, bits: Column, m: Column) -> Column:
    """Length of the longest common subsequence of a and a string of m <= BITS characters, a bit for each of these."""
    full = F.pow(F.lit(2.0), m).cast("long") - 1

    def step(v: Column, c: Column) -> Column:
        u = v.bitwiseAND(F.coalesce(F.element_at(bits, c), F.lit(0).cast("long")))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    return m - F.bit_count(F.aggregate(F.split(a, ""), full, step))


def _common_rows(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the table of prefixes."""
    chars, n = F.split(b, ""), F.length(b)

    def row(before: Column, c: Column) -> Column:
        cell = lambda made, j: F.array_append(made, F.when(F.get(chars, j - 1) == c, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.element_at(made, -1))))
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), n + 1), row), -1)


def similar_keys(left: DataFrame, right: DataFrame, threshold: int = 80) -> DataFrame:
    """(key, other, score): pairs of a left and a right key (column key) with 200 * common / (length of both) >= threshold.

    common is the longest common subsequence. Pairs meet by the rarest grams that such keys
    must share, in an equality join with a bound on the lengths, so a gram that most keys have
    is met only where a key has no rarer ones; candidates are told by their edit distance,
    which is no larger than what is not common, then counted exactly. threshold: over 67 to 100.
    """
    if not 200 / 3 < threshold <= 100:
        raise ValueError("grams find pairs above a threshold of two thirds only")
    half = threshold / 200
    left, right = (written(d.where("key != ''").select("key").distinct(), "keys") for d in (left, right))
    rarity = grams(left.union(right)).groupBy("gram").agg(F.count("*").alias("keys"))
    rarity = written(rarity, "grams")
    a, b = prefixes(left, rarity, threshold), prefixes(right, rarity, threshold).withColumnRenamed("key", "other")
    n, m = F.length("key"), F.length("other")
    met = a.join(b, "gram").where(half * (n + m) <= F.least(n, m) + 1e-9).select("key", "other").distinct()
    most = F.floor((n + m) * (1 - threshold / 100) + 1e-9).cast("int")
    close = met.where(F.levenshtein("key", "other") <= most).join(_with_bits(right), "other")
    common = F.when(m <= BITS, _common_bits(F.col("key"), F.col("bits"), m)).otherwise(_common_rows(F.col("key"), F.col("other")))
    told = close.withColumn("common", common).where(200 * F.col("common") >= threshold * (n + m))
    return told.select("key", "other", (2 * F.col("common") / (n + m)).alias("score"))


def _with_bits(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("key").alias("other"), F.when(F.length("key") <= BITS, _bits(F.col("key"))).alias("bits"))


def similar_parties(labels: DataFrame, names: DataFrame, threshold: int = 80) -> DataFrame:
    """(label, segment, third_party, start, confidence): for each segment of a distinct label the known name it is most like.

    labels: (label); names: (third_party). Segments are runs of up to MOST_WORDS words with
    LEAST_CHARS characters or more; words are sorted before they are compared, case counts.
    Of equally similar names the first in the alphabet is given; start is the first place of
    the segment in the label, counted from 0, -1 where blanks part its words otherwise.
    Null labels and names have no part; an empty table gives an empty result.
    """
    cut = written(segments(labels), "segments")
    known = names.select("third_party").where("third_party IS NOT NULL").distinct().withColumn("key", sorted_words(F.col("third_party")))
    first = known.groupBy("key").agg(F.min("third_party").alias("third_party")).withColumnRenamed("key", "other")
    best = similar_keys(cut, known, threshold).join(first, "other")
    best = best.groupBy("key").agg(F.min_by(F.struct("third_party", "score"), F.struct((-F.col("score")).alias("s"), "third_party")).alias("hit"))
    found = cut.join(best, "key")
    return found.select("label", "segment", "hit.third_party", (F.instr("label", F.col("segment")) - 1).alias("start"), rounded(F.col("hit.score")).alias("confidence"))
