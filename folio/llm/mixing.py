"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in hashed order, form a line that is cut into
blocks of equal size. The mix needs an exact number of blocks of each source; a
binary tree splits these quotas among the output shards, each split a draw from the
multivariate hypergeometric distribution, so every shard gets the right number of
blocks and the quotas are met to the last one. Each shard then takes its own range
of a keyed permutation of each source's blocks, disjoint from all others, and puts
its blocks in random order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import fresh, materialize, plain

WEIGHTS = (5, 2, 1)
#: The sampler takes populations below 10^9; blocks grow with the total to stay below.
MOST_BLOCKS = 250_000_000
#: Rows of a bucket of hashed rows, about.
BUCKET = 4_000


def targets(sizes: list[int], weights: list[int], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Weights share share * sum(sizes); what exceeds most * size is shared again by weight."""
    out, open_, pool = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = pool / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        pool -= sum(most * sizes[i] for i in full)
        open_ -= full
    return out


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, count) of each source for one shard: a walk from the root.

    The draw at a node depends on the node alone, so all shards agree on it.
    """
    total = int(quotas.sum())
    edge = [0, shards]
    first, have = np.zeros_like(quotas), quotas.copy()
    while edge[1] - edge[0] > 1:
        mid = sum(edge) // 2
        size = mid * total // shards - edge[0] * total // shards
        rng = np.random.default_rng([seed, *edge])
        left = rng.multivariate_hypergeometric(have, size, method="marginals")
        if shard < mid:
            have, edge = left, [edge[0], mid]
        else:
            first, have, edge = first + left, have - left, [mid, edge[1]]
    return first, have


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(n), element by element: four Feistel rounds on the
    smallest even number of bits, walked until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right, m, h = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], half[todo]
        for r in range(4):
            mix = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mix = (mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mix ^ mix >> np.uint64(32)) & m
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


#: Two hashes that tell rows apart by id, source and text.
ROW = ("r1", "r2")


def with_row(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with ROW: rows equal in id, source and text are equal, others have 128 bits to differ."""
    i, s, t = (F.col(f"`{c}`") for c in (id_col, source_col, text_col))
    return docs.select("*", F.xxhash64(i, s, s.isNull(), t).alias("r1"), F.xxhash64(t, i, i.isNull(), s).alias("r2"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, r1, r2, size) per row: size is the words of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.encode("utf-8", "surrogatepass").split()) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], ["doc_id", "source", *ROW, "size"])

    rows = with_row(plain(docs, id_col, source_col, text=text_col).toDF("doc_id", "source", "text"), "doc_id", "text", "source").select("doc_id", "source", *ROW, "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, r1 long, r2 long, size long")


def _lined(sizes: DataFrame, seed: int) -> DataFrame:
    """sizes with at: words of the source before the row, in hashed order.

    Rows are bucketed by the leading bits of the hash, more buckets for more rows, so
    that no window holds a whole source: first sums by bucket, then sums within.
    """
    n = sizes.count()
    bits = max(4, (n // BUCKET).bit_length() + 1)
    rows = sizes.withColumn("h", F.xxhash64(F.lit(seed), *ROW)).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", *ROW).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select("doc_id", *ROW, "source", "size", (F.col("base") + F.col("inner")).alias("at"))
    )


def mix(sizes: DataFrame, plan: dict[str | None, float], block: int = 256, least_blocks: int = 1000, shard_blocks: int = 4096, seed: int = 7, whole: bool = False) -> DataFrame:
    """(doc_id, r1, r2, source, shard, position, pass, first_word, words): what the mix takes.

    sizes: what sized() gives, source null or not. plan: words to take of each
    source, one entry a source, so it fits the driver; others are not taken. A source
    has blocks of about block words, smaller ones where that gives fewer than
    least_blocks. Passes over a source take each block once; the last one takes the
    number of blocks nearest to the rest, so the words taken differ from the plan by
    less than a block. With whole, a block holds the documents that start in it,
    uncut, and differences are in proportion to the lengths of documents.
    Documents of size 0 are never taken. position orders the blocks of a shard.
    Everything is a function of the rows and the seed: reruns agree.
    """
    have = {r["source"]: int(r["words"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = [s for s in sorted(have, key=lambda s: (s is None, s or "")) if have[s] and round(plan.get(s, 0))]
    words = np.array([have[s] for s in names], np.int64)
    want = np.array([round(plan[s]) for s in names], np.int64)
    block = max(block, int(want.sum()) // MOST_BLOCKS)
    blocks = np.maximum(-(-words // block), np.minimum(words, least_blocks))
    passes, rest = np.divmod(want, np.maximum(words, 1))
    quotas = passes * blocks + np.rint(rest * (blocks / np.maximum(words, 1))).astype(np.int64)
    shards = max(1, -(-int(quotas.sum()) // shard_blocks))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                first, count = leaf(quotas, shards, shard, seed)
                s = np.repeat(np.arange(len(names)), count)
                rank = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count) + first[s]
                turn, at = np.divmod(rank, blocks[s])
                took = permuted(at, blocks[s], (s * 1_000_003 + turn * 7_919 + seed).astype(np.uint64))
                position = np.random.default_rng([seed, shards, shard]).permutation(len(s))
                cols = [pa.array(c.astype(np.int64)) for c in (np.full(len(s), shard), position, turn, took)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([names[i] for i in s], pa.string())], ["shard", "position", "pass", "block", "source"])

    drawn = sizes.sparkSession.range(shards if names else 0).mapInArrow(draw, "shard long, position long, pass long, block long, source string")
    of = {s: (int(w), int(n)) for s, w, n in zip(names, words, blocks)}
    lines = _lined(sizes.where("size > 0"), seed).select("*", *[_chosen(of, i).alias(c) for i, c in enumerate(("total", "blocks"))]).where("total > 0")
    # word w is in block floor(w * blocks / total), in decimals as the product may pass 64 bits
    place = lambda w: F.floor(w.cast("decimal(19,0)") * F.col("blocks").cast("decimal(19,0)") / F.col("total").cast("decimal(19,0)")).cast("long")
    edge = lambda j: F.ceil(j.cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)") / F.col("blocks").cast("decimal(19,0)")).cast("long")
    end = F.col("at") + F.col("size")
    if whole:
        spans = lines.select("doc_id", *ROW, "source", place(F.col("at")).alias("block"), F.lit(0).cast("long").alias("first_word"), F.col("size").alias("words"))
    else:
        cut = lines.withColumn("block", F.explode(F.sequence(place(F.col("at")), place(end - 1))))
        low, high = F.greatest("at", edge(F.col("block"))), F.least(end, edge(F.col("block") + 1))
        spans = cut.select("doc_id", *ROW, "source", "block", (low - F.col("at")).alias("first_word"), (high - low).alias("words"))
    spans = spans.select("doc_id", *ROW, F.col("source").alias("s"), F.col("block").alias("b"), "first_word", "words")
    # the planner can't know how many rows a shard draws and would broadcast them
    taken = drawn.join(spans.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return taken.select("doc_id", *ROW, "source", "shard", "position", "pass", "first_word", "words").where("words > 0")


def _chosen(of: dict[str | None, tuple[int, ...]], i: int) -> Column:
    """The i-th figure of each row's source, 0 for sources that aren't in of."""
    known = [(k, v[i]) for k, v in of.items() if k is not None]
    null = F.lit(of[None][i] if None in of else 0)
    if not known:
        return F.when(F.col("source").isNull(), null).otherwise(F.lit(0)).cast("long")
    table = F.create_map(*[F.lit(x) for pair in known for x in pair])
    return F.when(F.col("source").isNull(), null).otherwise(F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0))).cast("long")


def weighed(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> list[tuple[str | None, int, float]]:
    """(source, its words, its target) in code point order, null last; weights repeat."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    words = [int(r["words"]) for r in rows]
    return [(r["source"], w, t) for r, w, t in zip(rows, words, targets(words, [weights[i % len(weights)] for i in range(len(rows))], share))]


def mix_by_weight(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, seed: int = 7, whole: bool = False) -> tuple[DataFrame, DataFrame, list]:
    """(sizes, taken, sources): sizes of all rows, what mix() takes, and weighed().

    A null text counts as empty, a null source is a source of its own. Repeated rows
    are documents of their own with one id. Empty tables give empty results.
    """
    sizes = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    sources = weighed(sizes, share=share)
    return sizes, mix(sizes, {s: t for s, _, t in sources}, seed=seed, whole=whole), sources


def taken_of(sizes: DataFrame, taken: DataFrame) -> DataFrame:
    """(doc_id, source, size, taken, shard, position) for every row of sizes.

    taken: words the mix takes of the row, rows equal in id, source and text share what
    is taken of them; shard and position of the first block that holds some of them,
    null where none does.
    """
    words = taken.groupBy(*ROW).agg(F.sum("words").alias("all"), F.min(F.struct("shard", "position")).alias("first"))
    rows = sizes.groupBy("doc_id", "source", "size", *ROW).agg(F.count("*").alias("copies"))
    each = rows.join(words, [*ROW], "left").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i"))
    share = F.expr("coalesce(all, 0) div copies") + F.when(F.col("i") <= F.coalesce("all", F.lit(0)) % F.col("copies"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", share.alias("taken"), "first.shard", "first.position")


def mixed_documents(docs: DataFrame, share: float = 1.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as mixed: each whole document as often as the mix takes it, from 0 to 2 times.

    Rows come shard by shard in the order of the mix. Of rows equal in id, source and
    text each takes its part of what the mix takes of them.
    """
    _, taken, _ = mix_by_weight(docs, id_col, text_col, source_col, share, seed, whole=True)
    r1, r2, text, source, places_, n, i, place = fresh(docs, "r1", "r2", "text", "source", "places", "n", "i", "place")
    places = taken.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("shard", "position")))).toDF(r1, r2, places_)
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text), F.col(f"`{source_col}`").cast("string").alias(source))
    keyed = with_row(named, id_col, text, source).toDF(*docs.columns, text, source, r1, r2).drop(text, source)
    same = Window.partitionBy(r1, r2)
    joined = keyed.join(places.hint("merge"), [r1, r2])
    numbered = joined.withColumn(n, F.count("*").over(same)).withColumn(i, F.row_number().over(same.orderBy(F.lit(0))))
    mine = F.filter(places_, lambda _, j: j % F.col(n) == F.col(i) - 1)
    each = numbered.withColumn(place, F.explode(mine))
    mixed = each.repartition(F.col(f"{place}.shard")).sortWithinPartitions(f"{place}.shard", f"{place}.position", r1, r2)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])
