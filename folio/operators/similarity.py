"""Lexical distance of labels by weighted words and word pairs, and the labels nearest to a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import rounded
from folio.functions.tables import written
from folio.operators.labels import normalized

TOKEN = "[a-zàâäéèêëïîôùûüç0-9]{2,}"
MOST_TERMS, LEAST_LINES, SCALE = 1000, 2, 50


def terms_of(label: Column) -> Column:
    """Words of two characters or more of the normalized label, and its pairs of neighbouring words."""
    words = F.regexp_extract_all(normalized(label), F.lit(f"({TOKEN})"), F.lit(1))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def weights(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, lines), and (label, term, idf, w): term weights of unit length per distinct label.

    The MOST_TERMS terms most frequent over all lines that LEAST_LINES lines have; a term's
    weight is its count times 1 + ln((1 + lines) / (1 + lines that have it)).
    """
    labels = written(df.groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("lines")), "labels")
    tf = labels.select("label", "lines", F.explode(terms_of(F.col("label"))).alias("term")).groupBy("label", "lines", "term").agg(F.count("*").alias("tf"))
    tf = written(tf, "terms")
    known = tf.groupBy("term").agg(F.sum("lines").alias("df"), F.sum(F.col("tf") * F.col("lines")).alias("count")).where(F.col("df") >= LEAST_LINES)
    # bounded by MOST_TERMS
    known = known.orderBy(F.desc("count"), "term").limit(MOST_TERMS)
    idf = F.broadcast(known.crossJoin(labels.agg(F.sum("lines").alias("n"))).select("term", (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))).alias("idf")))
    raw = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label")))
    return labels, raw.select("label", "lines", "term", "idf", (F.col("x") / norm).alias("w"))


def lexical_distance(df: DataFrame) -> DataFrame:
    """(label, lines, distance, score): distance of each label from the mean of all lines, and that over its range, 0 to 50."""
    labels, w = weights(df)
    w = written(w, "weights")
    centre = w.groupBy("term").agg(F.sum(F.col("w") * F.col("lines")).alias("s")).crossJoin(labels.agg(F.sum("lines").alias("n"))).select("term", (F.col("s") / F.col("n")).alias("c"))
    square = centre.agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("cc"))
    dots = w.join(F.broadcast(centre), "term").groupBy("label").agg(F.sum(F.col("w") * F.col("c")).alias("wc"), F.lit(1.0).alias("ww"))
    j = labels.join(dots, "label", "left").crossJoin(F.broadcast(square))
    d = F.sqrt(F.greatest(F.coalesce("ww", F.lit(0.0)) - 2 * F.coalesce("wc", F.lit(0.0)) + F.col("cc"), F.lit(0.0)))
    found = written(j.select("label", "lines", rounded(d, 6).alias("distance")), "distances")
    ends = F.broadcast(found.agg(F.min("distance").alias("low"), F.max("distance").alias("high")))
    score = (F.col("distance") - F.col("low")) / (F.col("high") - F.col("low") + 1e-10) * SCALE
    return found.crossJoin(ends).select("label", "lines", "distance", rounded(score).alias("score"))


def similar_labels(df: DataFrame, text: str, top: int = 10) -> DataFrame:
    """The top labels by cosine of their term weights to those of a text, ties in order of labels."""
    _, w = weights(df)
    idf = w.select("term", "idf").distinct()
    asked = df.sparkSession.createDataFrame([(text,)], "text string").select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    asked = asked.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    asked = asked.select("term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(F.lit(0))))).alias("q"))
    cosine = w.join(F.broadcast(asked), "term").groupBy("label").agg(rounded(F.sum(F.col("w") * F.col("q")), 6).alias("similarity"))
    return cosine.orderBy(F.desc("similarity"), "label").limit(top)
