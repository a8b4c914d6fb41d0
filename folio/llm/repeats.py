"""Removal of repeated passages by enhanced suffix arrays over sampled positions.

Two equal strings of 100 bytes have equal minimizers: the 50-byte grams with the
smallest hash in them. So the suffixes that start at minimizers (anchors, about one
in 26 bytes) stand for all repeats. They are dealt by the hash of their gram; among
suffixes with one gram, those with equal surroundings (50 bytes before, 100 from the
anchor on) form a class, of which only the first occurrence can be new. Where a gram
has several classes, their first occurrences are sorted as suffixes; a stack scan of
the common-prefix lengths gives the interval tree, and in each interval the classes
are grouped by how far they agree to the left: where left extensions differ, a
maximal repeat ends, and it is reported with all its occurrences. All grams of a task
are in one array, and all its intervals are worked through together. A gram with more
than HOT classes never meets in one task: its classes are parted by each string of
100 bytes round the anchor, and only the first of each string and task moves on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import discard, materialize, partitions

LENGTH = 100
GRAM = 50
SPAN = LENGTH - GRAM
WIDTH = SPAN + LENGTH
PIECE = 1 << 18
MARGIN = 2 * LENGTH
GATHER = 8 << 20
#: Classes of one gram that one task sorts; above, a gram is parted by its strings of LENGTH bytes.
HOT = 4096
#: Members of intervals that are compared at a time.
BLOCK = 1 << 17
ODD = 0x9E3779B97F4A7C15
TOP = np.uint64(2**64 - 1)

ANCHOR = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("left", "u1"), ("size", "u1")])
SPANS = np.dtype([("doc", "<i8"), ("lo", "<i8"), ("hi", "<i8")])
ASK = np.dtype([("doc", "<i8"), ("at", "<i8"), ("gram", "<u8"), ("hot", "u1")])
STRING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("lo", "<i8")])
CONTEXT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("left", "u1"), ("size", "u1"), ("bytes", f"({WIDTH},)u1")])
ROWS = "kind int, bucket int, data binary"
ANCHORS, SPAN_ROWS, ASK_ROWS, STRING_ROWS, TEXT_ROWS = 0, 1, 2, 3, 4

_power: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_power.get("up", ())) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _power[name] = np.multiply.accumulate(table)
    return _power["up"][:n], _power["down"][:n]


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def sliding(a: np.ndarray, width: int, best: np.ufunc, neutral: np.uint64) -> np.ndarray:
    """best over a[i : i + width] for each i; beyond the end counts as neutral."""
    rows = -(-len(a) // width) + 1
    table = np.full(rows * width, neutral, np.uint64)
    table[: len(a)] = a
    table = table.reshape(rows, width)
    ahead = best.accumulate(table, axis=1).ravel()
    behind = best.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: len(a)], ahead[width - 1 : width - 1 + len(a)])


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, prefix sums, end of text by position) of the texts in data, one after the other."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    gram = np.full(n, TOP)
    gram[: n - GRAM + 1] = stirred((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    gram[room < GRAM] = TOP
    least = sliding(gram, SPAN + 1, np.minimum, TOP)
    least[room < LENGTH] = 0
    most = sliding(np.concatenate([np.zeros(SPAN, np.uint64), least]), SPAN + 1, np.maximum, np.uint64(0))[:n]
    at = np.flatnonzero((gram == most) & (gram != TOP) & (room >= GRAM))
    return at, gram[at], sums, room


def _pieces(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lots of (row, from, to, low, high): anchors of [from, to) of a text are found in its bytes [low, high)."""
    lot, size = [], 0
    for row in np.flatnonzero(np.diff(offsets) >= LENGTH):
        n = int(offsets[row + 1] - offsets[row])
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            lot.append((int(row), a, b, max(0, a - MARGIN), min(n, b + MARGIN)))
            size += lot[-1][4] - lot[-1][3]
            if size >= PIECE:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def batch_anchors(doc: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """ANCHOR records of a batch of texts, lot by lot."""
    for lot in _pieces(offsets):
        row, frm, to, low, high = np.array(lot, np.int64).T
        begin = offsets[row]
        joined = np.concatenate([data[s + a : s + b] for s, a, b in zip(begin, low, high)]) if len(lot) > 1 else data[begin[0] + low[0] : begin[0] + high[0]]
        sizes = high - low
        if len(joined) < GRAM:
            continue
        at, gram, sums, _ = anchors(joined, sizes)
        first = np.cumsum(sizes) - sizes
        piece = np.searchsorted(first, at, side="right") - 1
        pos = at - first[piece] + low[piece]
        mine = (pos >= frm[piece]) & (pos < to[piece])
        at, gram, piece, pos = at[mine], gram[mine], piece[mine], pos[mine]
        n = offsets[row[piece] + 1] - begin[piece]
        left = np.minimum(pos, SPAN)
        size = left + np.minimum(n - pos, LENGTH)
        out = np.empty(len(at), ANCHOR)
        down = powers(len(joined) + 1)[1]
        around = (sums[at - left + size] - sums[at - left]) * down[at - left]
        out["around"] = stirred(around + (left * 256 + size).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out["gram"], out["doc"], out["at"], out["left"], out["size"] = gram, doc[row[piece]], pos, left, size
        yield out[size >= LENGTH]


def by_class(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """found sorted by (gram, class, doc, position), and the index of the first of each one's class."""
    found = found[np.lexsort((found["at"], found["doc"], found["around"], found["gram"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["gram"][1:] != found["gram"][:-1]) | (found["around"][1:] != found["around"][:-1])
    return found, np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))


def later(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (found["doc"] != found["doc"][first]) | (found["at"] != found["at"][first])


def spans_of(found: np.ndarray) -> np.ndarray:
    out = np.empty(len(found), SPANS)
    out["doc"], out["lo"] = found["doc"], found["at"] - found["left"]
    out["hi"] = out["lo"] + found["size"]
    return merged(out)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans sorted by document, those that overlap or touch made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["doc"]))]
    same = np.concatenate([[False], spans["doc"][1:] == spans["doc"][:-1]])
    group = np.cumsum(~same)
    # the running maximum of hi within a document
    shift = int(spans["hi"].max()) + 1
    reach = np.maximum.accumulate(spans["hi"] + group * shift) - group * shift if int(group[-1]) * shift < 2**62 else _reach(spans["hi"], same)
    new = ~same
    new[1:] |= spans["lo"][1:] > reach[:-1]
    start = np.flatnonzero(new)
    out = np.empty(len(start), SPANS)
    out["doc"], out["lo"], out["hi"] = spans["doc"][start], spans["lo"][start], np.maximum.reduceat(spans["hi"], start)
    return out


def _reach(hi: np.ndarray, same: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum.accumulate(part) for part in np.split(hi, np.flatnonzero(~same)[1:])])


def prime_from(n: int) -> int:
    """The first prime from n on: documents are dealt by id modulo a prime."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def dealt(kind: int, rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, its records as bytes."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, np.int64)
    blobs = [part.tobytes() for part in np.split(rows, cut[1:])] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(cut), pa.int32()), pa.array(bucket[cut], pa.int32()), pa.array(blobs, pa.binary())], ["kind", "bucket", "data"])


def lcp(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b have in common from the front, at most most."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def intervals(heights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height, parent, leaf) of the common-prefix interval tree by a stack over the prefix lengths of neighbours.

    height and parent of each interval of at least least, parent -1 at a root; leaf is
    the innermost interval of each suffix, -1 for none.
    """
    height: list[int] = []
    parent: list[int] = []
    leaf = np.full(len(heights) + 1, -1, np.int64)
    stack: list[int] = []
    entered: list[tuple[int, int]] = []
    for i, h in enumerate([*heights.tolist(), -1]):
        last = -1
        while stack and height[stack[-1]] > h:
            if last >= 0:
                parent[last] = stack[-1]
            last = stack.pop()
        if h >= least:
            if not stack or height[stack[-1]] < h:
                stack.append(len(height))
                height.append(h)
                parent.append(-1)
            entered.append((i, stack[-1]))
        if last >= 0 and stack:
            parent[last] = stack[-1]
    at = np.array(entered, np.int64).reshape(-1, 2)
    # the suffix before a neighbour pair and the one after it: the higher of their intervals is the inner one
    tall = np.array(height, np.int64)
    leaf[at[:, 0]] = at[:, 1]
    after = at[:, 0] + 1
    higher = (leaf[after] < 0) | (tall[at[:, 1]] > tall[leaf[after]]) if len(at) else np.zeros(0, bool)
    leaf[after[higher]] = at[higher, 1]
    return tall, np.array(parent, np.int64), leaf


def big_endian(rows: np.ndarray) -> np.ndarray:
    """Byte rows as columns of big-endian words, first word first."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64).T


class Side:
    """The enhanced suffix array of CONTEXT records to one side of their anchors, gram by gram."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, gram: np.ndarray) -> None:
        self.rows, self.sizes = np.ascontiguousarray(rows), sizes
        # a string before those that it begins
        self.order = np.lexsort([sizes, *big_endian(rows)[::-1], gram])
        self.rank = np.empty_like(self.order)
        self.rank[self.order] = np.arange(len(self.order))
        before, after = self.order[:-1], self.order[1:]
        self.heights = np.where(gram[before] == gram[after], self.common(before, after), -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [lcp(self.rows[a[i : i + BLOCK]], self.rows[b[i : i + BLOCK]], np.minimum(self.sizes[a[i : i + BLOCK]], self.sizes[b[i : i + BLOCK]])) for i in range(0, len(a), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def groups(side: Side, other: Side, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(members, size of each group, reach on side, reach on other) of the maximal repeats of at least LENGTH bytes.

    Within an interval of side, which has at least least bytes in common, members are in
    the order of other; where neighbours agree there on too little to make LENGTH bytes
    with the interval's, a group ends. Its reach on other is where its members' extensions
    begin to differ; groups within one inner interval reach farther there and are left out
    here. All intervals of one depth are worked through at once, the deepest first.
    """
    height, parent, leaf = intervals(side.heights, least)
    depth, up = np.zeros(len(parent), np.int64), parent
    while (up >= 0).any():
        depth += up >= 0
        up = np.where(up >= 0, parent[up], -1)
    at = np.flatnonzero(leaf >= 0)
    member, now, inner = side.order[at], leaf[at], -2 - at
    for level in range(int(depth.max()) if len(depth) else -1, -1, -1):
        here = np.flatnonzero(depth[now] == level)
        here = here[np.lexsort([other.rank[member[here]], now[here]])]
        rows, inside = member[here], now[here]
        new = np.ones(len(rows), bool)
        agree = other.common(rows[:-1], rows[1:])
        new[1:] = (inside[1:] != inside[:-1]) | (agree < LENGTH - height[inside[1:]])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(rows)]]))
        apart = np.minimum.reduceat(inner[here], start) != np.maximum.reduceat(inner[here], start)
        reach = np.minimum.reduceat(np.concatenate([[LENGTH], np.where(new[1:], LENGTH, agree)]), start)
        kept = np.repeat(apart, size)
        yield rows[kept], size[apart], height[inside[start[apart]]], reach[apart]
        inner[here], now[here] = inside, parent[inside]
        left = now >= 0
        member, now, inner = member[left], now[left], inner[left]


def repeat_groups(found: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members) of the maximal repeats of at least LENGTH bytes round the anchors of CONTEXT records.

    The repeat reaches left bytes before and right bytes from the anchor on (no further
    than the records do); members are all its occurrences, at least two.
    """
    right, left = sides(found)
    for rows, size, ahead, behind in groups(right, left, GRAM):
        yield from zip(behind.tolist(), ahead.tolist(), np.split(rows, np.cumsum(size)[:-1]))


def reaches(side: Side, other: Side, least: int, age: np.ndarray) -> np.ndarray:
    """The farthest that each record's repeat of an older record reaches on side, -1 where it repeats none."""
    far = np.full(len(age), -1, np.int64)
    for rows, size, reach, _ in groups(side, other, least):
        if len(rows):
            oldest = np.minimum.reduceat(age[rows], np.cumsum(size) - size)
            again = age[rows] > np.repeat(oldest, size)
            far[rows[again]] = np.maximum(far[rows[again]], np.repeat(reach, size)[again])
    return far


def sides(found: np.ndarray) -> tuple[Side, Side]:
    """The suffix arrays of CONTEXT records from their anchors on, and of what is before, read backwards."""
    gram = np.unique(found["gram"], return_inverse=True)[1]
    left = found["left"].astype(np.int64)
    return Side(found["bytes"][:, SPAN:], found["size"].astype(np.int64) - left, gram), Side(found["bytes"][:, SPAN - 1 :: -1], left, gram)


def repeated_spans(found: np.ndarray) -> np.ndarray:
    """SPANS of CONTEXT records that also start earlier, over all grams.

    The strings that a record repeats all hold its anchor, so they make one span: from its
    farthest reach to the left, by the tree of what is before, to that to the right.
    """
    order = np.lexsort([found["at"], found["doc"]])
    new = np.ones(len(found), bool)
    new[1:] = (found["doc"][order[1:]] != found["doc"][order[:-1]]) | (found["at"][order[1:]] != found["at"][order[:-1]])
    age = np.empty(len(found), np.int64)
    age[order] = np.cumsum(new)
    right, left = sides(found)
    ahead = reaches(right, left, GRAM, age)
    again = np.flatnonzero(ahead >= 0)
    behind = reaches(left, right, 0, age)[again]
    out = np.empty(len(again), SPANS)
    out["doc"], out["lo"], out["hi"] = found["doc"][again], found["at"][again] - behind, found["at"][again] + ahead[again]
    return merged(out)


def strings(rows: np.ndarray) -> np.ndarray:
    """STRING records, the first of each string in rows (CONTEXT): every LENGTH bytes round each anchor; SPANS of the others."""
    up, down = powers(WIDTH + 1)
    out = []
    sums = np.zeros((len(rows), WIDTH + 1), np.uint64)
    np.cumsum((rows["bytes"].astype(np.uint64) + np.uint64(1)) * up[:WIDTH], axis=1, out=sums[:, 1:])
    left, size = rows["left"].astype(np.int64), rows["size"].astype(np.int64)
    for s in range(SPAN + 1):
        fits = np.flatnonzero((left >= s) & (size - left >= LENGTH - s))
        made = np.empty(len(fits), STRING)
        a = SPAN - s
        made["key"] = stirred((sums[fits, a + LENGTH] - sums[fits, a]) * down[a] + rows["gram"][fits] * np.uint64(2 * s + 1))
        made["doc"], made["lo"] = rows["doc"][fits], rows["at"][fits] - s
        out.append(made)
    return np.concatenate(out)


def first_strings(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest STRING record of each string, and the SPANS of the later ones."""
    found = found[np.lexsort((found["lo"], found["doc"], found["key"]))]
    new = np.ones(len(found), bool)
    new[1:] = found["key"][1:] != found["key"][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    again = (found["doc"] != found["doc"][first]) | (found["lo"] != found["lo"][first])
    spans = np.empty(int(again.sum()), SPANS)
    spans["doc"], spans["lo"], spans["hi"] = found["doc"][again], found["lo"][again], found["lo"][again] + LENGTH
    return found[new], merged(spans)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, data), written: rows numbered by id, null ids last, then by the SHA-256 of the text.

    Rows with equal id and text have one number. Ids and digests alone are ordered, by ranges.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data")).withColumn("sha", F.sha2("data", 256))
    keys = rows.groupBy("id", "sha").agg(F.lit(1).alias("one"))
    parts = materialize(keys.repartitionByRange(partitions(docs.sparkSession), F.col("id").asc_nulls_last(), "sha").withColumn("range", F.spark_partition_id()), "keys")
    sizes = parts.groupBy("range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("range", "n")).alias("all"))
    # one row, with no more entries than there are ranges
    before = F.aggregate(F.filter("all", lambda e: e["range"] < F.col("range")), F.lit(0).cast("long"), lambda acc, e: acc + e["n"])
    order = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_last(), "sha")
    places = parts.crossJoin(F.broadcast(sizes)).select(F.col("id").alias("key"), F.col("sha").alias("digest"), (before + F.row_number().over(order)).alias("doc"))
    made = rows.join(places, F.col("id").eqNullSafe(F.col("key")) & (F.col("sha") == F.col("digest")))
    made = materialize(made.select("doc", "id", "data"), "numbered")
    discard(parts)
    return made


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row.

    Of whole texts in UTF-8 (null: empty) each byte is removed that lies in a string of
    100 bytes which also starts earlier: in a smaller id, or earlier in the same text.
    All is judged on the input, overlaps count, matches never cross texts. Null ids come
    last. Rows that share an id, null included, and have different texts are documents of
    their own, in the order of their texts' SHA-256; rows with equal id and text are one
    document and have equal results. Texts below 100 bytes stay whole; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    n = prime_from(4 * partitions(spark))
    table = numbered(docs, id_col, text_col)
    id_type = table.schema["id"].dataType.simpleString()
    texts = table.select("doc", "data")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found, first = by_class(np.concatenate(held) if held else np.empty(0, ANCHOR))
            held.clear()
            again = later(found, first)
            spans = spans_of(found[again])
            new = found[first == np.arange(len(found))]
            yield dealt(SPAN_ROWS, spans, spans["doc"] % n)
            yield dealt(ANCHORS, new, (new["gram"] >> np.uint64(20)).astype(np.int64) % n)

        for b in batches:
            offsets, data = _binary(b.column(1))
            for lot in batch_anchors(b.column(0).to_numpy(), offsets, data):
                held.append(lot)
                if sum(map(len, held)) * 26 > GATHER:
                    yield from flush()
        yield from flush()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spans, parted = np.empty(0, ANCHOR), [np.empty(0, SPANS)], np.empty(0, np.uint64)
        more: list[np.ndarray] = []

        def asked(rows: np.ndarray, by_string: bool) -> pa.RecordBatch:
            ask = np.empty(len(rows), ASK)
            for f in ("doc", "at", "gram"):
                ask[f] = rows[f]
            ask["hot"] = by_string
            return dealt(ASK_ROWS, ask, ask["doc"] % n)

        def settle() -> Iterator[pa.RecordBatch]:
            """Classes of what is held; grams that have too many are asked for at once, now and from here on."""
            nonlocal held, parted
            found, first = by_class(np.concatenate([held, *more]))
            more.clear()
            spans.append(spans_of(found[later(found, first)]))
            found = found[first == np.arange(len(found))]
            grams, count = np.unique(found["gram"], return_counts=True)
            many = grams[count > hot]
            if len(many):
                out = np.isin(found["gram"], many)
                yield asked(found[out], True)
                parted, found = np.union1d(parted, many), found[~out]
            held = found

        for b in batches:
            for kind, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if kind == SPAN_ROWS:
                    spans.append(np.frombuffer(data, SPANS))
                    continue
                rows = np.frombuffer(data, ANCHOR)
                if len(parted):
                    out = np.isin(rows["gram"], parted)
                    if out.any():
                        yield asked(rows[out], True)
                        rows = rows[~out]
                more.append(rows)
                if sum(map(len, more)) * ANCHOR.itemsize > GATHER + held.nbytes:
                    yield from settle()
        yield from settle()
        spans = merged(np.concatenate(spans))
        yield dealt(SPAN_ROWS, spans, spans["doc"] % n)
        gram = held["gram"]
        several = np.zeros(len(held), bool)
        several[1:] |= gram[1:] == gram[:-1]
        several[:-1] |= gram[1:] == gram[:-1]
        yield asked(held[several], False)

    width = partitions(spark)
    marks = materialize(texts.mapInArrow(find, ROWS).repartition(width, "bucket", "kind").mapInArrow(classify, ROWS), "anchors")

    placed = table.select(F.lit(TEXT_ROWS).alias("kind"), F.pmod("doc", F.lit(n)).cast("int").alias("bucket"), "data", "doc", "id")

    def met(rows: DataFrame) -> DataFrame:
        """Records and texts of one bucket in one run, the records first."""
        both = placed.unionByName(rows, allowMissingColumns=True)
        return both.repartition(width, "bucket").sortWithinPartitions("bucket", "kind")

    def runs(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        """(records of the bucket, texts of the bucket)."""
        now, held, known = -1, [np.empty(0, dtype)], None
        for b in (b for b in batches if len(b)):
            at = b.column(1).to_numpy()
            for s, e in zip(cut := np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), [*cut[1:], len(at)]):
                if at[s] != now:
                    now, held, known = at[s], [np.empty(0, dtype)], None
                part = b.slice(s, e - s)
                texts_from = int(np.searchsorted(part.column(0).to_numpy(), TEXT_ROWS))
                held += [np.frombuffer(x, dtype) for x in part.column(2).slice(0, texts_from).to_pylist()]
                if texts_from < len(part):
                    if known is None:
                        known = np.concatenate(held)
                        known = known[np.argsort(known["doc"], kind="stable")]
                    yield known, part.slice(texts_from)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def parted() -> Iterator[pa.RecordBatch]:
            first, spans = first_strings(np.concatenate(held) if held else np.empty(0, STRING))
            held.clear()
            yield dealt(STRING_ROWS, first, (first["key"] >> np.uint64(20)).astype(np.int64) % n)
            yield dealt(SPAN_ROWS, spans, spans["doc"] % n)

        for ask, part in runs(batches, ASK):
            offsets, data = _binary(part.column(2))
            out = []
            for i, doc in enumerate(part.column(3).to_pylist()):
                rows = ask[np.searchsorted(ask["doc"], doc) : np.searchsorted(ask["doc"], doc, side="right")]
                size = int(offsets[i + 1] - offsets[i])
                rows = rows[rows["at"] + GRAM <= size]
                if not len(rows):
                    continue
                made = np.zeros(len(rows), CONTEXT)
                for f in ("doc", "at", "gram"):
                    made[f] = rows[f]
                text = np.concatenate([np.zeros(SPAN, np.uint8), data[offsets[i] : offsets[i + 1]], np.zeros(LENGTH, np.uint8)])
                made["bytes"] = text[rows["at"][:, None] + np.arange(WIDTH)]
                made["left"] = np.minimum(rows["at"], SPAN)
                made["size"] = made["left"] + np.minimum(size - rows["at"], LENGTH)
                out.append(made[rows["hot"] == 0])
                if rows["hot"].any():
                    held.append(strings(made[rows["hot"] > 0]))
                    if sum(map(len, held)) * STRING.itemsize > 4 * GATHER:
                        yield from parted()
            if out:
                out = np.concatenate(out)
                yield dealt(ANCHORS, out, (out["gram"] >> np.uint64(20)).astype(np.int64) % n)
        yield from parted()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {ANCHORS: CONTEXT, STRING_ROWS: STRING, SPAN_ROWS: SPANS}
        held: dict[int, list[np.ndarray]] = {k: [np.empty(0, t)] for k, t in types.items()}
        for b in batches:
            for kind, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                held[kind].append(np.frombuffer(data, types[kind]))
        found = np.concatenate(held.pop(ANCHORS))
        spans = merged(np.concatenate([*held[SPAN_ROWS], first_strings(np.concatenate(held[STRING_ROWS]))[1], repeated_spans(found)]))
        yield dealt(SPAN_ROWS, spans, spans["doc"] % n)

    asked = marks.where(F.col("kind") == ASK_ROWS)
    more = materialize(met(asked).mapInArrow(contexts, ROWS).repartition(width, "bucket").mapInArrow(scan, ROWS), "repeats")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans, part in runs(batches, SPANS):
            spans = merged(spans)
            offsets, data = _binary(part.column(2))
            out = []
            for i, doc in enumerate(part.column(3).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                own = spans[np.searchsorted(spans["doc"], doc) : np.searchsorted(spans["doc"], doc, side="right")]
                gone = int((own["hi"] - own["lo"]).sum())
                edges = np.stack([np.concatenate([[0], own["hi"]]), np.concatenate([own["lo"], [len(text)]])], axis=1)
                kept = b"".join(text[a:b].tobytes() for a, b in edges)
                out.append((len(text), gone, len(own), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([part.column(4), *made], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = marks.where(F.col("kind") == SPAN_ROWS).unionByName(more)
    made = met(spans).mapInArrow(cut_out, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return made if with_kept else made.drop("kept")
