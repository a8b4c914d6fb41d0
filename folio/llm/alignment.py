"""Alignment of two tokenizers' tokens by pointer jumping.

The tokens of a text under both tokenizers are intervals of the same bytes. Each points to
the farthest-right token of the other kind that it overlaps; where two tokens end together,
that of the first kind is the terminal of its group and points to itself. Following
pointers of pointers, all of a lot of texts at once, doubles the reach in each step, until
every token points to its terminal, which labels the group. Corpus-wide counts of linked
ids are summed over blocks of about a lot of text each, so that one row a block and pair
moves, and come back to the blocks the same way.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize
from folio.llm.vocabularies import byte_level, byte_table, pieces

#: Bytes of text that are aligned together and make one block; a longer text is a block of its own.
LOT = 1 << 20
ROW = "block long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, pairs binary, counts binary"


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each token, from 0 on, by the ends of both kinds of tokens over the same bytes.

    Ends ascend and have the same last one; no token is empty.
    """
    n = len(a_end)
    # the token of the other kind that holds a token's last byte is the farthest-right one that overlaps it
    to_b = np.searchsorted(b_end, a_end)
    to_a = np.searchsorted(a_end, b_end)
    points = np.concatenate([np.where(b_end[to_b] == a_end, np.arange(n), n + to_b), to_a])
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            break
        points = farther
    number = np.zeros(n, np.int64)
    number[1:] = np.cumsum(points[: n - 1] == np.arange(n - 1))
    label = number[points]
    return label[:n], label[n:]


def links_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of the first kind, token of the second) for all that end together."""
    at = np.searchsorted(b_end, a_end)
    a = np.flatnonzero(b_end[at] == a_end)
    return a, at[a]


def tokenizers(json_path: str | None = None, ranks_path: str | None = None, model_path: str | None = None) -> tuple[Callable, Callable, list[bytes], list[bytes]]:
    """(ids of a blank and the text, ids of the text with a blank set before it, bytes of the ids of each)."""
    import public_tokenizers as public

    encode_a = byte_level(ranks_path or public.path("byte_bpe_50k.tiktoken"))
    encode_b, table_b = pieces(model_path or public.path("piece_bpe_32k.model"))
    return lambda text: encode_a(" " + text), encode_b, byte_table(json_path or public.path("byte_bpe_50k.json")), table_b


class Aligner:
    """Two tokenizers with the tables that a lot of texts is aligned by."""

    def __init__(self, coders: tuple[Callable, Callable, list[bytes], list[bytes]] | None = None) -> None:
        self.encode_a, self.encode_b, self.bytes_a, self.bytes_b = coders or tokenizers()
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # how a token is written: inside a side of a group, at its end
        self.written = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both kinds; none where the text is null or empty or the tokens don't spell it."""
        if not text:
            return [], []
        a, b, whole = self.encode_a(text), self.encode_b(text), b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        return (a, b) if same else ([], [])

    def lot(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Columns of a lot of texts: counts, digests, links as codes of their pairs, and the pairs with their counts."""
        both = [self.ids(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        a, b = (np.fromiter(itertools.chain.from_iterable(x[k] for x in both), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        if not len(a):
            zero = np.zeros(len(texts), np.int64)
            none = [b""] * len(texts)
            return {"n_a": n_a, "n_b": n_b, "n_groups": zero, "n_links": zero, "sha": [""] * len(texts), "codes": none, "pairs": np.empty(0, np.int64), "counts": np.empty(0, np.int64)}
        a_end, b_end = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        group_a, group_b = groups_of(a_end, b_end)
        row_a, row_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        n_groups = np.bincount(row_a[last_a], minlength=len(texts))
        # tokens in the order in which they are written: of each group first those of one kind
        per_a, per_b = (np.bincount(g, minlength=int(group_a[-1]) + 1) for g in (group_a, group_b))
        at_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
        said = np.empty(len(a) + len(b), np.int64)
        said[at_a] = a + last_a * len(self.bytes_a)
        said[at_b] = b + 2 * len(self.bytes_a) + last_b * len(self.bytes_b)
        ends = np.cumsum(n_a + n_b)
        digests = []
        for s, e in zip((ends - n_a - n_b).tolist(), ends.tolist()):
            text = "".join(map(self.written.__getitem__, said[s:e].tolist()))
            digests.append(hashlib.sha256(text[:-1].encode()).hexdigest() if e > s else "")
        link_a, link_b = links_of(a_end, b_end)
        pairs, code, counts = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True, return_counts=True)
        n_links = np.bincount(row_a[link_a], minlength=len(texts))
        kind = "<u2" if len(pairs) < 1 << 16 else "<u4"
        codes = [x.astype(kind).tobytes() for x in np.split(code.ravel(), np.cumsum(n_links)[:-1])]
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "sha": digests, "codes": codes, "pairs": pairs, "counts": counts}


def lots_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about LOT characters."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + LOT, side="right")))
        yield first, last
        first = last


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Each text is encoded by the byte-level vocabulary, after a blank, and by the piece model,
    which sets that blank itself; strings of special tokens are plain text. Byte offsets at
    which tokens of both end cut them into groups; tokens that end together are linked. A
    link's count is the number of links between its two ids over all rows; it is among the
    best where no pair with the same second id has more. A text that is null or empty, or
    that the tokens don't spell byte by byte, has none: zeros and an empty digest. Repeated
    rows and null ids are rows like any other; texts may be of any length, an empty table
    gives an empty result, other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(json_path, ranks_path, model_path))
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for first, last in lots_of(texts):
                lot = aligner.lot(texts.slice(first, last - first).to_pylist())
                n = last - first
                none = pa.nulls(n, pa.binary())
                cols = [pa.array(np.full(n, number)), ids.slice(first, n), *(pa.array(lot[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(lot["sha"], pa.string()), pa.array(lot["codes"], pa.binary()), none, none]
                yield pa.RecordBatch.from_arrays(cols, NAMES)
                if len(lot["pairs"]):
                    blobs = [pa.array([lot[c].astype("<i8").tobytes()], pa.binary()) for c in ("pairs", "counts")]
                    empty = [pa.nulls(1, t) for t in (ids.type, *[pa.int64()] * 4, pa.string(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *empty, *blobs], NAMES)
                number += 1

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in b.columns)):
                pair, count = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(pair), block), pair, count)], ["block", "pair", "n"])

    marks = materialize(rows.mapInArrow(run, ROW.format(id=kind)), "aligned")
    apart = marks.where(F.col("pairs").isNotNull()).select("block", "pairs", "counts").mapInArrow(unpack, "block long, pair long, n long")
    total = materialize(apart.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    second = F.col("pair").bitwiseAND(2**32 - 1)
    best = total.groupBy(second.alias("b")).agg(F.max("total").alias("most"))
    known = total.join(best, second == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = apart.select("block", "pair").join(known, "pair")

    def score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("pair")
        count, best = pairs["total"].to_numpy(), pairs["best"].to_numpy()
        kind = "<u2" if len(pairs) < 1 << 16 else "<u4"
        n_best, count_sum = [], []
        for blob in docs["codes"].to_pylist():
            codes = np.frombuffer(blob, kind)
            n_best.append(int(best[codes].sum()))
            count_sum.append(int(count[codes].sum()))
        made = docs.select([*KEPT])
        return made.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    per_row = marks.where(F.col("codes").isNotNull()).select("block", *KEPT, "codes")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    made = per_row.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
    return made.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "pairs", "counts"]
KEPT = NAMES[1:7]
