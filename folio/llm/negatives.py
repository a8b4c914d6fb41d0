"""Hard negatives by best-first search of STR-packed R-trees.

Rows are packed sort-tile-recursively: Spark range-sorts them by label and first coordinate
into tiles of bounded size, and the task of a tile goes on with the next coordinates down
to leaves of LEAF rows. Every node has the minimum bounding box of its rows, and with it an
interval of inner products for each anchor, the sum of the intervals of the coordinates. A
queue gives the node with the highest upper end first; a node whose interval misses an
anchor's window of scores, whose labels are of no use, or whose upper end is strictly below
the anchor's worst kept score isn't opened for that anchor. Anchors go in blocks, tiles in
blocks, and only the anchors of a block that a tile's box can serve travel to the tile.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialize, partitions

#: Rows of a tile at most, of a leaf, and children of an inner node.
TILE, LEAF, FAN = 1 << 16, 64, 16
#: Anchors that are searched for together, and tiles whose boxes are looked at together.
BLOCK = 1024
#: Hits that are sorted at a time.
HITS = 1 << 16
#: Whole doubles below this are exact.
EXACT = 2.0**53
POINTS, ASKED = 0, 1
HIT = "anchor_id long, slot int, vec_id long, score long"


def cleaned(rows: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q): whole-number vectors of the rows that take part, one row for each id.

    Rows with a null id, label or vector or a null or non-finite component take no part. Of
    rows that share an id that with the smallest label, then vector, does. Vectors shorter
    than the longest count as followed by zeros.
    """
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & finite)
    label = F.col(f"`{label_col}`")
    if shift_every:
        label = F.when(F.col(f"`{id_col}`") % shift_every == 0, (label + 1) % labels).otherwise(label)
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    made = kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), q.alias("q")).alias("row"))
    return made.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q")


def tiled(points: DataFrame) -> DataFrame:
    """points with their tile: range-sorted by label and first coordinate, of TILE rows at most on average, written."""
    spark = points.sparkSession
    points = materialize(points, "points")
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    padded = points.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))) if width else points
    tiles = max(1, -(-n // TILE), min(2 * partitions(spark), -(-n // BLOCK)))
    first = F.get("q", F.lit(0))
    return materialize(padded.repartitionByRange(tiles, "label", first, "vec_id").withColumn("tile", F.spark_partition_id()), "tiles")


def boxes_of(vectors: np.ndarray, labels: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lows, highs, smallest label, largest label) of the stretches of rows that begin at cuts."""
    return np.minimum.reduceat(vectors, cuts), np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(labels, cuts), np.maximum.reduceat(labels, cuts)


def packed_order(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which each leaf is a stretch: sorted by label, then tile by tile along one coordinate after the other."""
    leaves = max(1, -(-len(vectors) // leaf))
    depth = max(1, min(vectors.shape[1], int(np.ceil(np.log2(leaves) / 3)))) if vectors.shape[1] else 1
    order = np.argsort(labels, kind="stable")
    slab = np.zeros(len(order), np.int64)
    size = len(vectors)
    for c in range(min(depth, vectors.shape[1])):
        # c + 1 .. depth share what is left: slabs of whole leaves
        parts = max(1, round((size / leaf) ** (1 / (depth - c))))
        keys = [vectors[order, c]] + ([labels[order]] if c == 0 else []) + [slab]
        order = order[np.lexsort(keys)]
        slab = np.sort(slab, kind="stable")
        begin = np.searchsorted(slab, slab)
        end = np.searchsorted(slab, slab, side="right")
        step = np.maximum(leaf, -(-(end - begin) // parts // leaf) * leaf)
        slab = np.unique(slab * (len(order) + 1) + (np.arange(len(order)) - begin) // step, return_inverse=True)[1]
        size = max(1, -(-size // parts))
    return order


class Tree:
    """An R-tree over rows in packed order: level 0 has the leaves, each level above FAN nodes a node."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        order = packed_order(vectors, labels, leaf)
        self.vectors, self.labels, self.ids, self.leaf, self.fan = vectors[order], labels[order], ids[order], leaf, fan
        self.levels = [boxes_of(self.vectors, self.labels, np.arange(0, len(order), leaf))]
        while len(self.levels[-1][2]) > 1:
            low, high, least, most = self.levels[-1]
            cuts = np.arange(0, len(least), fan)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) ends of the inner products of each anchor with each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where no inner product or part of one leaves the whole doubles, else as 64-bit integers.

    Products must fit 64 bits; where they can't, Python's integers take over.
    """
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if most < EXACT else np.int64 if most < 2.0**62 else object
    return a.astype(kind), b.astype(kind)


class Block:
    """Anchors that are searched for together, with one or more slots of wanted rows each.

    least and most (anchors, slots): bounds of the scores, both included; slots with least above
    most want nothing. same: rows of the anchor's label are wanted, or of other labels. Kept are
    the k first rows of each slot, higher scores first, then smaller ids.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool, k: int) -> None:
        self.ids, self.labels, self.vectors, self.most, self.same, self.k = ids, labels, vectors, most, same, k
        self.worst = least.copy()
        self.kept = [np.empty(0, np.int64) for _ in range(4)]
        self.held: list[list[np.ndarray]] = []

    def wants(self, lower: np.ndarray, upper: np.ndarray, least_label: np.ndarray, most_label: np.ndarray) -> np.ndarray:
        """Which anchors a box with these intervals and labels can serve; arrays of (anchors) or (anchors, boxes)."""
        mine = self.labels if lower.ndim == 1 else self.labels[:, None]
        useful = (least_label <= mine) & (mine <= most_label) if self.same else (least_label != mine) | (most_label != mine)
        fits = np.zeros(lower.shape, bool)
        for s in range(self.worst.shape[1]):
            worst, most = (self.worst[:, s], self.most[:, s]) if lower.ndim == 1 else (self.worst[:, s, None], self.most[:, s, None])
            fits |= (upper >= worst) & (lower <= most) & (worst <= most)
        return useful & fits

    def take(self, who: np.ndarray, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        """Rows of a leaf with their scores for the anchors who."""
        open_ = self.worst[who] <= self.most[who]
        floor = np.where(open_, self.worst[who], np.iinfo(np.int64).max).min(axis=1)
        top = np.where(open_, self.most[who], np.iinfo(np.int64).min).max(axis=1)
        hit = (scores >= floor[:, None]) & (scores <= top[:, None]) & ((labels == self.labels[who][:, None]) == self.same)
        a, r = np.nonzero(hit)
        if not len(a):
            return
        score, a_id, r_id = scores[a, r].astype(np.int64), who[a], ids[r]
        other = self.ids[a_id] != r_id
        score, a_id, r_id = score[other], a_id[other], r_id[other]
        for s in range(self.worst.shape[1]):
            fits = (score >= self.worst[a_id, s]) & (score <= self.most[a_id, s])
            if fits.any():
                self.held.append([a_id[fits], np.full(int(fits.sum()), s), r_id[fits], score[fits]])
        if len(self.kept[0]) == 0 or sum(len(h[0]) for h in self.held) > min(HITS, len(self.ids) * self.k):
            self.settle()

    def settle(self) -> None:
        """Keeps the first k rows of each slot and raises its worst score."""
        if not self.held:
            return
        a, s, r, score = (np.concatenate([self.kept[i], *[h[i] for h in self.held]]) for i in range(4))
        self.held = []
        order = np.lexsort([r, -score, s, a])
        a, s, r, score = a[order], s[order], r[order], score[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        rank = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        full = rank == self.k - 1
        self.worst[a[full], s[full]] = np.maximum(self.worst[a[full], s[full]], score[full])
        self.kept = [x[rank < self.k] for x in (a, s, r, score)]

    def search(self, tree: Tree) -> tuple[np.ndarray, ...]:
        """(anchor, slot, row id, score) of what the tree has for the block."""
        q, rows = exact(self.vectors, tree.vectors)
        q_up = np.maximum(q, 0)
        q_down = np.minimum(q, 0)
        top = len(tree.levels) - 1
        queue: list[tuple] = [(0, 0, top, 0, np.ones(len(q), bool))]
        made = 1
        while queue:
            _, _, level, node, who = heapq.heappop(queue)
            low, high, least, most = (x[node] for x in tree.levels[level])
            if level < top:
                lower, upper = q_up @ low.astype(q.dtype) + q_down @ high.astype(q.dtype), q_up @ high.astype(q.dtype) + q_down @ low.astype(q.dtype)
                who = who & self.wants(lower, upper, least, most)
            if not who.any():
                continue
            if level == 0:
                part = slice(node * tree.leaf, (node + 1) * tree.leaf)
                who = np.flatnonzero(who)
                self.take(who, q[who] @ rows[part].T, tree.labels[part], tree.ids[part])
                continue
            low, high, least, most = (x[node * tree.fan : (node + 1) * tree.fan] for x in tree.levels[level - 1])
            lower, upper = q_up @ low.T.astype(q.dtype) + q_down @ high.T.astype(q.dtype), q_up @ high.T.astype(q.dtype) + q_down @ low.T.astype(q.dtype)
            fits = self.wants(lower, upper, least[None, :], most[None, :]) & who[:, None]
            for i in np.flatnonzero(fits.any(axis=0)).tolist():
                heapq.heappush(queue, (-int(upper[fits[:, i], i].max()), made, level - 1, node * tree.fan + i, fits[:, i]))
                made += 1
        self.settle()
        return tuple(self.kept)


def frozen(block: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **block)
    return out.getvalue()


def stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy().reshape(len(column), width)


def best_rows(anchors: DataFrame, tiles: DataFrame, boxes: DataFrame, same: bool, k: int, home: bool = False) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the first k rows of each slot of each anchor.

    anchors: (vec_id, label, q, tile, least, most) with arrays of bounds, one for each slot.
    Only tiles whose boxes can serve an anchor are searched, or its own tile alone (home).
    """
    spark = anchors.sparkSession
    hits = anchors.select("vec_id", "label", "q", "least", "most", "tile")
    if home:
        routes = hits.repartition(partitions(spark), "tile").sortWithinPartitions("tile").select("tile", *[c for c in hits.columns if c != "tile"]).mapInArrow(_own_tile, "tile int, asked binary")
    else:
        # the anchors of a tile lie close together and are looked at with the boxes of BLOCK tiles at a time
        blocks = max(1, -(-boxes.count() // BLOCK))
        numbers = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        tile_ids = boxes.select(F.col("tile").alias("a"))
        left = hits.withColumnRenamed("tile", "a").withColumn("b", numbers)
        right = tile_ids.withColumn("b", numbers).join(boxes.withColumn("b", F.pmod("tile", F.lit(blocks))), "b")
        routes = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_routes(same), "tile int, asked binary")
    points = tiles.select("tile", F.lit(POINTS).alias("kind"), "vec_id", "label", "q")
    both = points.unionByName(routes.withColumn("kind", F.lit(ASKED)), allowMissingColumns=True)
    met = both.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "kind")
    found = met.mapInArrow(_search(same, k), HIT)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(t: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t
    one = {n: t[n].combine_chunks() for n in ("vec_id", "label", "q", "least", "most")}
    return {"ids": one["vec_id"].to_numpy(), "labels": one["label"].to_numpy(), **{n: stacked(one[n]) for n in ("q", "least", "most")}}


def _own_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        for s, e in zip(cuts, [*cuts[1:], len(at)]):
            for a in range(s, e, BLOCK):
                part = b.slice(a, min(e, a + BLOCK) - a)
                yield pa.RecordBatch.from_arrays([pa.array([int(at[s])], pa.int32()), pa.array([frozen(_block(part))], pa.binary())], ["tile", "asked"])


def _routes(same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def route(anchors: pa.Table, boxes: pa.Table) -> pa.Table:
        tiles, asked = [], []
        if len(anchors) and len(boxes):
            whole = _block(anchors)
            low, high = (stacked(boxes[c].combine_chunks()) for c in ("low", "high"))
            q, ends = exact(whole["q"], np.concatenate([low, high]))
            least, most = boxes["least_label"].to_numpy()[None, :], boxes["most_label"].to_numpy()[None, :]
            for s in range(0, len(q), BLOCK):
                block = {n: x[s : s + BLOCK] for n, x in whole.items()}
                lower, upper = intervals(q[s : s + BLOCK], ends[: len(low)], ends[len(low) :])
                fits = Block(block["ids"], block["labels"], q[s : s + BLOCK], block["least"], block["most"], same, 1).wants(lower, upper, least, most)
                for i in np.flatnonzero(fits.any(axis=0)).tolist():
                    tiles.append(boxes["tile"][i].as_py())
                    asked.append(frozen({n: x[fits[:, i]] for n, x in block.items()}))
        return pa.table([pa.array(tiles, pa.int32()), pa.array(asked, pa.binary())], ["tile", "asked"])

    return route


def _search(same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for b in (b for b in batches if len(b)):
            at = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for s, e in zip(cuts, [*cuts[1:], len(at)]):
                if at[s] != now:
                    now, held, tree = at[s], [], None
                part = b.slice(s, e - s)
                rows_to = int(np.searchsorted(part.column(1).to_numpy(), ASKED))
                if rows_to:
                    held.append(part.slice(0, rows_to))
                for blob in part.column(5).slice(rows_to).to_pylist():
                    if tree is None:
                        ids, labels = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (2, 3))
                        tree = Tree(np.concatenate([stacked(h.column(4)) for h in held]), labels, ids)
                    one = np.load(io.BytesIO(blob))
                    block = Block(one["ids"], one["labels"], one["q"], one["least"], one["most"], same, k)
                    a, slot, row, score = block.search(tree)
                    cols = [pa.array(block.ids[a]), pa.array(slot.astype(np.int32)), pa.array(row), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(cols, ["anchor_id", "slot", "vec_id", "score"])

    return run


def hard_negatives(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), **cleaning: str | int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Rows and their labels are those of cleaned(). Anchors are rows whose id is divisible by
    anchor_every. A score is the whole-number inner product with the anchor, which must fit 64
    bits; higher ones come first, then smaller ids. An anchor's positives are its first other
    rows of its label (all, if fewer), its negatives for a positive the first rows of other
    labels with share[0] * positive <= share[1] * negative <= share[1] * positive. All is
    exact, ties included. A positive without negatives gives no row, an empty table an
    empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    tiles = tiled(cleaned(rows, **cleaning))

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One box for each batch of a tile; joined below."""
        for b in (b for b in batches if len(b)):
            at = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            low, high, least, most = boxes_of(stacked(b.column(2)), b.column(1).to_numpy(), cuts)
            frame = pd.DataFrame({"tile": at[cuts], "low": list(low), "high": list(high), "least_label": least, "most_label": most})
            yield pa.RecordBatch.from_pandas(frame, schema=BOX, preserve_index=False)

    parts = tiles.select("tile", "label", "q").mapInArrow(box, "tile int, low array<long>, high array<long>, least_label long, most_label long")
    # a tile has few batches: their boxes are joined coordinate by coordinate
    lists = parts.groupBy("tile").agg(
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high"), F.min("least_label").alias("least_label"), F.max("most_label").alias("most_label")
    )
    lowest, highest = (
        F.reduce(F.slice(n, 2, F.size(n)), F.get(n, F.lit(0)), lambda x, y: F.zip_with(x, y, lambda a, b: F.least(a, b) if n == "low" else F.greatest(a, b))) for n in ("low", "high")
    )
    boxes = materialize(lists.select("tile", lowest.alias("low"), highest.alias("high"), "least_label", "most_label"), "boxes")

    low, high = F.lit(-(2**63) + 1).cast("long"), F.lit(2**63 - 1).cast("long")
    anchors = materialize(tiles.where(F.col("vec_id") % anchor_every == 0), "anchors")
    asked = anchors.withColumn("least", F.array(low)).withColumn("most", F.array(high))
    # the anchor's own tile gives a score that its k-th positive has at least
    near = best_rows(asked, tiles, boxes, True, positives, home=True).where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = asked.join(near, "vec_id", "left").withColumn("least", F.array(F.coalesce("floor", low))).drop("floor")
    good = materialize(best_rows(asked, tiles, boxes, True, positives), "positives")

    # 80 p <= 100 n <= 100 p in whole numbers: n from ceil(80 p / 100) to p; nothing where p is negative
    a, b = share
    least_score = -F.floor(-(F.col("score").cast("decimal(38,0)") * a) / F.lit(b).cast("decimal(38,0)")).cast("long")
    slots = good.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", least_score.alias("least")))).alias("s"))
    pick = lambda field, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("s", i)[field], none))
    windows = slots.select(F.col("anchor_id").alias("vec_id"), pick("least", F.lit(1).cast("long")).alias("least"), pick("score", F.lit(0).cast("long")).alias("most"))
    bad = best_rows(anchors.join(windows, "vec_id"), tiles, boxes, False, negatives)
    named = good.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(named, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


BOX = pa.schema([("tile", pa.int32()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("least_label", pa.int64()), ("most_label", pa.int64())])
