"""Packing of tokenized documents into sequences by vector bin packing.

A document's ids are cut into pieces of at most one sequence. Full pieces are
sequences of their own; the others are placed under simultaneous limits on tokens,
segments and loss-bearing tokens: each sequence takes, again and again, the piece
whose demand has the largest dot product with what the sequence has left. Pieces
are dealt by hash to bins of a few thousand, so that each is packed on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, plain
from folio.llm.vocabularies import byte_level

#: Added token of the vocabulary and its id (fixed value).
END_OF_TEXT = ("<|endoftext|>", 50256)
PIECE = "doc_id {id}, start long, length long, loss long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, ranks_path: str | None = None, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, loss, ids_crc32, doc_tokens): a document's ids cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = byte_level(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), END_OF_TEXT)
        for b in batches:
            row, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text), end_id], "<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    row.append(i)
                    out.append((a, len(part), len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), *[pa.array(c) for c in cols]], ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"])

    rows = plain(docs, id_col, text=text_col)
    return rows.mapInArrow(run, PIECE.format(id=rows.schema[id_col].dataType.simpleString()))


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of each row of demand (n, k); every bin's sums stay within limits.

    A bin opens with the largest piece left and takes, as long as one fits, the piece
    with the largest dot product of its demand and the bin's free room, both as shares
    of the limits; ties go to the first row. Equal demands are one class, so that a
    step looks at classes and not at pieces.
    """
    kinds, kind = np.unique(-demand, axis=0, return_inverse=True)
    kinds, kind = -kinds, kind.ravel()
    if (kinds > limits).any():
        raise ValueError("a piece exceeds the limits")
    members = [list(np.flatnonzero(kind == k)[::-1]) for k in range(len(kinds))] if len(kinds) < 64 else _members(kind, len(kinds))
    share = kinds / limits
    left = np.array([len(m) for m in members])
    bins = np.empty(len(demand), np.int64)
    bin_no = 0
    first = 0
    while True:
        while first < len(kinds) and not left[first]:
            first += 1
        if first == len(kinds):
            return bins
        room, take = limits.astype(np.int64).copy(), first
        while take >= 0:
            bins[members[take].pop()] = bin_no
            left[take] -= 1
            room -= kinds[take]
            # kinds are sorted by tokens, largest first: only those that may fit
            from_ = max(first, int(np.searchsorted(-kinds[:, 0], -room[0])))
            fits = (left[from_:] > 0) & (kinds[from_:] <= room).all(axis=1)
            take = from_ + int(np.argmax(np.where(fits, share[from_:] @ (room / limits), -1))) if fits.any() else -1
        bin_no += 1


def _members(kind: np.ndarray, n: int) -> list[list[int]]:
    order = np.argsort(kind, kind="stable")
    return [list(part[::-1]) for part in np.split(order, np.cumsum(np.bincount(kind, minlength=n))[:-1])]


def pack(parts: DataFrame, capacity: int = 2048, max_segments: int = 256, max_loss: int | None = None, group_size: int = 4096) -> DataFrame:
    """parts with sequence_id and offset.

    parts: (doc_id, start, length, loss, ...), one row per piece, of at most capacity
    tokens. No sequence exceeds capacity tokens, max_segments pieces or max_loss
    loss-bearing tokens (capacity when not given). Offsets are gapless from 0. Pieces
    are dealt to groups of about group_size, equal ones by their number among their
    like; a null id is an id like any other, equal rows are pieces of their own, an
    empty table gives an empty result.
    """
    alike = parts.groupBy(*[F.col(f"`{c}`") for c in parts.columns]).agg(F.count("*").alias("__n"))
    parts = materialize(alike.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__n"), "pieces")
    groups = max(1, -(-parts.count() // group_size))
    limits = np.array([capacity, max_segments, max_loss or capacity], np.int64)
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "__i"), F.lit(groups))).drop("__i")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = table["length"].to_numpy()
        demand = np.stack([length, np.ones_like(length), table["loss"].to_numpy()], axis=1)
        at = fill(demand, limits) if len(length) else length
        order = np.argsort(at, kind="stable")
        table, at, length = table.take(pa.array(order)), at[order], length[order]
        before = np.cumsum(length) - length
        offset = before - before[np.searchsorted(at, at)]
        return table.append_column("sequence_id", pa.array(table["group"].to_numpy() * (1 << 24) + at)).append_column("offset", pa.array(offset)).drop_columns(["group"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name != "__i")
    return dealt.groupBy("group").applyInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, max_segments: int = 256, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Pieces of all rows, each token in exactly one, packed by pack().

    A null text is empty and has the end id alone; a text of any length, runs of white
    space included, is cut at multiples of capacity. Repeated rows are packed as often as they come.
    """
    return pack(pieces(docs, ranks_path, capacity=capacity, id_col=id_col, text_col=text_col), capacity, max_segments)
