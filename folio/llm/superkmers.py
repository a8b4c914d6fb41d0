"""Removal of repeated passages of words by super-k-mers.

A window is a run of WINDOW words, its minimiser the gram of GRAM words with the smallest
hash in it. Consecutive windows with one minimiser make a super-k-mer: its words travel
once, as one packed string, to the bucket of the minimiser. Equal windows have equal
minimisers, so they meet there, where sorting counts them; equal hashes are compared
as strings. Only what can repeat travels: minimisers are counted first, and one that the
whole corpus has in a single place has no window that starts elsewhere. A minimiser with
many super-k-mers is dealt to several buckets; what a bucket has once is counted over
these by the SHA-256 of the window, of which each bucket sends one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, partitions
from folio.llm.repeats import TOP, powers, sliding, stirred

WINDOW = 35
GRAM = 8
#: Windows of one super-k-mer at most; longer runs (of periodic texts) are cut.
LONGEST = 512
#: Super-k-mers of a minimiser that one bucket takes on average.
BUCKET = 2048
#: Bytes of text that are hashed, or of packed strings that are sorted, at a time.
LOT = 2 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

RUNS = "key binary, gram long, start long, windows int, places int"
PACKED = "key binary, gram long, salt int, start long, words binary, copies long"
FOUND = "key binary, lo long, hi long, sha binary, copies long"


def word_hashes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of the texts in data, one after the other."""
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[np.cumsum(sizes)] = True
    edge[0] = True
    begin = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    end = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    hashes = np.empty(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(end, begin[first] + LOT, side="right")))
        a, b = begin[first], end[last - 1]
        up, down = powers(int(b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = begin[first:last] - a, end[first:last] - a
        hashes[first:last] = stirred((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    count = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, count


def runs(hashes: np.ndarray, count: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word in it, number of windows, minimiser, 1 or 2 for one place of the minimiser or more) of each super-k-mer.

    hashes: of the words of several texts, one after the other; count: words of each text.
    """
    n, wide = len(hashes), window - gram + 1
    if not n or not (count >= window).any():
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64), np.empty(0, np.int64))
    up, _ = powers(gram)
    mixed = np.zeros(n, np.uint64)
    for j in range(gram):
        mixed[: n - j] += hashes[j:] * up[j]
    # the largest hash is kept free for what lies beyond the end
    mixed = np.minimum(stirred(mixed), TOP - np.uint64(1))
    least = sliding(mixed, wide, np.minimum, TOP)
    begins = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count)), count)
    whole = begins[text] + count[text] - np.arange(n) >= window
    at = np.flatnonzero(whole)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]]) | (least[at[1:]] != least[at[:-1]])
    head = np.flatnonzero(new)
    since = np.arange(len(at)) - head[np.cumsum(new) - 1]
    head = np.flatnonzero(since % LONGEST == 0)
    size = np.diff(np.concatenate([head, [len(at)]]))
    start = at[head]
    last = start + size - 1
    low = np.argmax(mixed[start[:, None] + np.arange(wide)] == least[start][:, None], axis=1) + start
    high = last + wide - 1 - np.argmax(mixed[(last + wide - 1)[:, None] - np.arange(wide)] == least[start][:, None], axis=1)
    return text[start], start - begins[text[start]], size, least[start], 1 + (low != high)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, size of each text) of the texts of a binary column, about LOT bytes at a time, whole texts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + LOT, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], np.diff(offsets[first : last + 1])
        first = last


def packed_words(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, size of each string, first byte of each word) of strings of words with one space between them."""
    sizes = np.array([len(r) for r in rows], np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    begins = np.zeros(len(data) + 1, bool)
    begins[np.cumsum(sizes) - sizes] = True
    begins[1:] |= np.concatenate([data == 32])
    at = np.flatnonzero(begins[:-1])
    return data, sizes, at + (data[at] == 32)


def alike(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for each string data[lo:hi], equal for equal strings of one key alone.

    Sorted by key, hash and length; neighbours with equal ones are compared byte by byte.
    Should two strings differ there, all strings of that hash are told apart one by one.
    """
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashed = stirred((sums[hi] - sums[lo]) * down[lo])
    size = hi - lo
    order = np.lexsort([size, hashed, key])
    a, b = order[:-1], order[1:]
    same = np.zeros(len(order), bool)
    same[1:] = (key[a] == key[b]) & (hashed[a] == hashed[b]) & (size[a] == size[b])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(~same)
    odd = []
    pairs = np.flatnonzero(same)
    for part in np.array_split(pairs, max(1, -(-int(size[order[pairs]].sum()) // LOT))):
        x, y, n = lo[order[part - 1]], lo[order[part]], size[order[part]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(x, n) + step] != data[np.repeat(y, n) + step]
        if differs.any():
            odd.append(number[order[part[np.unique(np.repeat(np.arange(len(part)), n)[differs])]]])
    for clash in np.unique(np.concatenate(odd)) if odd else ():
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(number == clash):
            number[i] = known.setdefault(data[lo[i] : hi[i]].tobytes(), len(order) + 1 + int(i))
    return number


def counted(gram: np.ndarray, salt: np.ndarray, parted: np.ndarray, rows: list[bytes], copies: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows of packed super-k-mers, counted within (gram, salt).

    Returns (row, first word, copies of its string here, whether it is the first of its
    string, whether other buckets may have it, byte bounds) for each window, and the bytes.
    """
    data, sizes, at = packed_words(rows)
    words = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])))
    begins = np.cumsum(words) - words
    row = np.repeat(np.arange(len(rows)), np.maximum(words - window + 1, 0))
    starts = np.maximum(words - window + 1, 0)
    place = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    first = begins[row] + place
    ends = np.cumsum(sizes)
    nxt = np.concatenate([at[1:] - 1, ends[-1:]])
    nxt[begins[1:] - 1] = ends[:-1]
    lo, hi = at[first], nxt[first + window - 1]
    bucket = np.unique(np.stack([gram, salt]), axis=1, return_inverse=True)[1].ravel()
    number = alike(data, lo, hi, bucket[row])
    kinds, head, kind = np.unique(number, return_index=True, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, kind, copies[row])
    is_first = np.zeros(len(row), bool)
    is_first[head] = True
    return row, place, total[kind], is_first, parted[row], lo, hi, data


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, data): the text in UTF-8 (null: empty); rows with equal id and text share the key."""
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")).cast("binary")
    key = F.unhex(F.substring(F.sha2(F.concat(ident, F.lit(b"\0"), data), 256), 1, 40))
    return docs.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), data.alias("data"))


def drop_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, bucket: int = BUCKET) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) for every row.

    Words are what lies between blanks of ASCII, unchanged, of whole texts (null: none).
    Each word is removed that a window of so many consecutive words of its text covers
    which also starts anywhere else: in another row, or at another place of the same one;
    all is judged on the input. Kept words are joined by one space. Repeated rows are rows
    of their own, so all their windows repeat; null ids are told apart by their texts.
    Texts below a window stay whole, an empty table gives an empty result, other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    # of rows with equal id and text one goes on, with their number; counted before they move
    unique = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("data").alias("data"), F.count("*").alias("copies"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, sizes in texts_of(b.column(1)):
                text, start, size, least, places = runs(*word_hashes(data, sizes), window, gram)
                key = b.column(0).take(pa.array(first + text))
                cols = [pa.array(least.view(np.int64)), pa.array(start), pa.array(size.astype(np.int32)), pa.array(places.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([key, *cols], ["key", "gram", "start", "windows", "places"])

    found = materialize(rows.select("key", "data").mapInArrow(find, RUNS), "runs")
    shared = found.groupBy("gram").agg(F.sum("places").alias("places")).where("places > 1")
    # equal rows have equal runs: the set is one text's
    wanted = found.join(shared.withColumnRenamed("places", "total"), "gram").groupBy("key").agg(F.collect_set(F.struct("start", "windows", "gram", "total")).alias("runs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for key, data, copies, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = data.split()
                for run in asked:
                    start, gram_ = run["start"], run["gram"]
                    text = b" ".join(words[start : start + run["windows"] + window - 1])
                    salts = -(-run["total"] // bucket)
                    salt = int.from_bytes(hashlib.blake2b(key + start.to_bytes(8, "little"), digest_size=6).digest(), "little") % salts if salts > 1 else 0
                    out.append((key, gram_, salt if salts > 1 else -1, start, text, copies))
                    size += len(text)
                    if size > LOT:
                        yield batch_of(out, PACKED_TYPES)
                        out, size = [], 0
            if out:
                yield batch_of(out, PACKED_TYPES)

    packed = unique.join(wanted, "key").select("key", "data", "copies", "runs").mapInArrow(pack, PACKED)
    dealt = packed.repartition(partitions(spark), "gram", "salt").sortWithinPartitions("gram", "salt")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_buckets(batches):
            key, words = b.column(0).to_pylist(), b.column(4).to_pylist()
            grams, salt, start, copies = (b.column(i).to_numpy() for i in (1, 2, 3, 5))
            row, place, total, is_first, parted, lo, hi, data = counted(grams, salt, salt >= 0, words, copies, window)
            again = total > 1
            # neighbouring windows of one row make one span
            at = np.flatnonzero(again)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
            head, tail = at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] if len(at) else at
            spans = [(key[r], s + p, s + q + window, None, None) for r, s, p, q in zip(row[head].tolist(), start[row[head]].tolist(), place[head].tolist(), place[tail].tolist())]
            if spans:
                yield batch_of(spans, FOUND_TYPES)
            send = np.flatnonzero(parted & is_first)
            for part in np.array_split(send, max(1, len(send) // 50_000)):
                out = [
                    (None if t > 1 else key[r], s + p, s + p + window, hashlib.sha256(data[a:z].tobytes()).digest(), t)
                    for r, s, p, a, z, t in zip(*(x.tolist() for x in (row[part], start[row[part]], place[part], lo[part], hi[part], total[part])))
                ]
                if out:
                    yield batch_of(out, FOUND_TYPES)

    met = materialize(dealt.mapInArrow(count, FOUND), "windows")
    apart = met.where(F.col("sha").isNotNull())
    many = apart.groupBy("sha").agg(F.sum("copies").alias("n")).where("n > 1").select("sha")
    later = apart.where(F.col("key").isNotNull()).join(many, "sha", "left_semi")
    spans = met.where(F.col("sha").isNull()).unionByName(later.select(met.columns)).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = data.split()
                kept, last = [], 0
                for span in sorted(gone or (), key=lambda s: s["lo"]):
                    kept += words[last : span["lo"]] if span["lo"] > last else []
                    last = max(last, span["hi"])
                kept += words[last:]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text if with_kept else None))
            cols = list(zip(*out)) or [()] * 4
            made = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, b.column(3)], [id_col, "n_words", "n_removed", "kept_sha256", "kept", "copies"])

    kind = rows.schema["id"].dataType.simpleString()
    made = unique.join(spans, "key", "left").select("id", "data", "spans", "copies").mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, kept binary, copies long")
    made = made.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return made.select(f"`{id_col}`", "n_words", "n_removed", "kept_sha256", *([F.col("kept").cast("string").alias("kept")] if with_kept else []))


PACKED_TYPES = pa.schema([("key", pa.binary()), ("gram", pa.int64()), ("salt", pa.int32()), ("start", pa.int64()), ("words", pa.binary()), ("copies", pa.int64())])
FOUND_TYPES = pa.schema([("key", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("sha", pa.binary()), ("copies", pa.int64())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, about LOT bytes at a time, no (gram, salt) in two of them."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        for a in range(0, len(b), 4096):
            part = b.slice(a, 4096)
            held.append(part)
            size += pa.compute.sum(pa.compute.binary_length(part.column(4))).as_py()
            if size > LOT:
                whole = joined()
                gram, salt = whole.column(1).to_numpy(), whole.column(2).to_numpy()
                inside = np.flatnonzero((gram != gram[-1]) | (salt != salt[-1]))
                end = int(inside[-1]) + 1 if len(inside) else 0
                if end:
                    yield whole.slice(0, end)
                held = [whole.slice(end)]
                size = pa.compute.sum(pa.compute.binary_length(held[0].column(4))).as_py()
                # a bucket larger than a lot is looked at again only when it has doubled
                size = size if size <= LOT else -size
    if sum(map(len, held)):
        yield joined()
