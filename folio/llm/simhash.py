"""SimHash near-duplicates found through Golay keys of fingerprint segments.

A 64-bit fingerprint is three segments of 23, 23 and 18 bits. When two fingerprints
differ in few bits, the pigeonhole principle says how the errors spread over the
segments; a segment with no error gives its bits as part of a key, one with at most
two errors gives a Golay codeword that both share. Rows with equal keys meet in one
sorted run; each run is walked breadth first by exact Hamming distance and emits a
spanning star of its links, so a run of m rows yields fewer than m edges.

Near copies for the pipeline are linked in the same way by fingerprints of five-word
shingles, and each link is compared on the whole shingle sets. Similar sets whose
fingerprints are farther apart are then found between the groups by prefixes of the sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import golay
from folio.llm.common import components, discard, fresh, materialize, partitions, plain, text_id

#: (first bit, width) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Keys for at most 2 differing bits: a segment without error and the next one's codeword.
EXACT_2 = (((0,), (1,)), ((1,), (2,)), ((2,), (0,)))
#: Keys for at most 5 differing bits: two of three segments have at most 2 errors each.
PAIRS_5 = (((), (0, 1)), ((), (1, 2)), ((), (0, 2)))
BLOCK = 1 << 16
#: Keys that two similar sets share at least, as prefixes are longer by as many less one.
SHARED = 4
#: Nodes of a key up to which all pairs are looked at, and nodes that all others meet beyond.
SMALL, HUBS = 12, 4
#: Rows of a key that meet in one run when all its pairs are looked at; larger keys are parted into blocks that meet two by two.
MEET = 2048


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z in lower case; bytes.split splits at 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of size words (all words when fewer), in blocks."""
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1) if words else 0
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    for a in range(0, n, BLOCK):
        pieces = [joined[s : e - 1] for s, e in zip(starts[a : min(n, a + BLOCK)], last[a : a + BLOCK])]
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The 64 bits that are set in over half of the hashes; zero for none."""
    total, n = np.zeros(64, np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row's whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((majority(hashes(words_of(t), shingle)) for t in b.column(1).to_pylist()), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    rows = plain(docs, id_col, text=text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


def segment_keys(fp: np.ndarray, plans: tuple, turn: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) for each combination of codewords: key = turn and plan, clean bits, codewords."""
    part = [(fp >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in SEGMENTS]
    near = {i: golay.keys(part[i]) for _, fuzzy in plans for i in fuzzy}
    for p, (clean, fuzzy) in enumerate(plans):
        head = np.full(len(fp), turn * len(plans) + p, np.uint64)
        for i in clean:
            head = head << np.uint64(SEGMENTS[i][1]) | part[i]
        for slots in np.ndindex(*[6] * len(fuzzy)):
            used, key = np.ones(len(fp), bool), head
            for i, s in zip(fuzzy, slots):
                used = used & near[i][1][:, s]
                key = key << np.uint64(12) | near[i][0][:, s]
            rows = np.flatnonzero(used)
            yield rows, key[rows]


def _stars(node: np.ndarray, proof: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, nodes within most bits of it) for a spanning tree of each group of linked rows."""
    left = np.arange(len(node))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(proof[left] ^ proof[at]).sum(axis=1) <= most
            if hit.any():
                new, left = left[hit], left[~hit]
                queue.extend(new)
                yield node[at], node[new]


def links(nodes: DataFrame, plans: tuple, most: int, width: int = 1) -> DataFrame:
    """(src, dst) edges that connect all nodes linked through some key.

    nodes: (node long, fps array<long>, proof array<long> of width), without nulls, all fps of
    one length. Two nodes link when they share a key of the same one of their fps and
    their proofs differ in at most most bits.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 4096):
                b = whole.slice(a, 4096)
                fps = b.column(1).flatten().to_numpy().view(np.uint64).reshape(len(b), -1)
                for rows, key in chain.from_iterable(segment_keys(fp, plans, i) for i, fp in enumerate(fps.T)):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.select(["node", "proof"]).take(pa.array(rows)).columns], ["key", "node", "proof"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint64))
        key, node, proof = empty

        def done(key: np.ndarray, node: np.ndarray, proof: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(key)) + 1
            src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(proof[two] ^ proof[two + 1]).sum(axis=1) <= most]
            src.append(node[two]), dst.append(node[two + 1])
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                for root, near in _stars(node[s:e], proof[s:e], most):
                    src.append(np.full(len(near), root)), dst.append(near)
            pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            node = np.concatenate([node, b.column(1).to_numpy()])
            proof = np.concatenate([proof, b.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, width)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield done(key[:last], node[:last], proof[:last])
                key, node, proof = key[last:], node[last:], proof[last:]
        if len(key):
            yield done(key, node, proof)

    return (
        nodes.select("node", "fps", "proof")
        .mapInArrow(emit, "key long, node long, proof array<long>")
        .repartition(partitions(nodes.sparkSession), "key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(meet, "src long, dst long")
    )


def simhash_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest id
    reachable over links. A null text counts as empty; a text without words has
    fingerprint zero, which links like any other. Null ids never become a
    component_id unless a component has no other. Repeated rows are returned as
    often as they come, an empty table gives an empty result, other columns are
    ignored. Equal fingerprints are one node, so copies add no links.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("low"))
    edges = links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("fps"), F.array("fp").alias("proof")), EXACT_2, 2)
    joined = components(edges)
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lowest, "component").select("fp", "component_id")
    return rows.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, id, text_sha256, size, fp, hashes) per row: the sorted XXH64 of its distinct shingles, as bytes, and their fingerprint.

    node is a number given to the row. A text without words has the one element 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1024):
                b = whole.slice(a, 1024)
                sets = [np.unique(np.concatenate(list(hashes(words_of(t), shingle)) or [np.zeros(1, np.uint64)])) for t in b.column(2).to_pylist()]
                fps = np.fromiter((majority(x[i : i + BLOCK] for i in range(0, len(x), BLOCK)) for x in sets), np.uint64, len(sets)).view(np.int64)
                cols = [b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "text_sha256", "size", "fp", "hashes"])

    rows = plain(docs, id_col, text=text_col).select(F.col(f"`{id_col}`").alias("id"), text_id(F.col("text")).alias("text_sha256"), "text")
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_sha256 string, size int, fp long, hashes binary")
    return materialize(made.select(F.monotonically_increasing_id().alias("node"), "*"), "sets")


def common_shingles(sets: DataFrame, max_docs: int = 10_000, most: int = 100_000) -> np.ndarray:
    """Hashes that are met twice or more in about max_docs sets, the rarest first, most at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], ["h"])

    share = F.pmod(F.xxhash64("node"), F.lit(max(1, sets.count()))) < max_docs
    counted = sets.where(share).select("hashes").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow().column("h").to_numpy()
    return found[::-1].astype(np.int64).view(np.uint64)


def simhash_pairs(sets: DataFrame, most: int = 2) -> DataFrame:
    """(src, dst) pairs that connect all sets whose fingerprints are equal or linked at most most bits apart."""
    nodes = materialize(sets.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = sets.select("node", "fp").join(nodes, "fp").where("node != first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    apart = links(nodes.select(F.col("first").alias("node"), F.array("fp").alias("fps"), F.array("fp").alias("proof")), EXACT_2, most)
    return equal.unionByName(apart.distinct())


def prefix_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size, pos): the first elements of each set in one order of all elements.

    Sets of n elements share at least similarity * n of them with each partner, so SHARED
    are among the first n - similarity * n + SHARED of both, in any order. Common ones come
    last, which keeps runs of equal keys short and leaves nothing out.
    """
    common = common_shingles(sets)
    by_hash = np.argsort(common)
    shared = sets.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for whole in batches:
            for a in range(0, len(whole), 256):
                b = whole.slice(a, 256)
                keys, counts = [], []
                for x in b.column("hashes"):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    first = min(len(h), len(h) - math.ceil(similarity * len(h) - 1e-9) + SHARED)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        late = known[at] == h
                        if late.any():
                            h = np.concatenate([h[~late], h[late][np.argsort(rank[at[late]])]])
                    keys.append(h[:first]), counts.append(min(first, len(h)))
                rows = np.repeat(np.arange(len(b)), counts)
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in counts] or [np.zeros(0, np.int32)])
                key = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.select(["node", "size"]).take(pa.array(rows)).columns, pa.array(pos)], ["key", "node", "size", "pos"])

    return sets.select("node", "size", "hashes").mapInArrow(run, "key long, node long, size int, pos int")


def sorted_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "node")


def repeated_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys whose key several rows have."""
    names = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        met = False
        for b in batches:
            if not len(b):
                continue
            key = b.column(0).to_numpy()
            if held is not None and (met or held.column(0)[0].as_py() == key[0]):
                yield held
            kept = np.zeros(len(key), bool)
            kept[1:] = key[1:] == key[:-1]
            kept[:-1] |= kept[1:]
            kept[0] |= held is not None and held.column(0)[0].as_py() == key[0]
            # the last row may have its like in the next batch
            held, met = b.slice(len(b) - 1), bool(kept[-1])
            kept[-1] = False
            yield b.filter(pa.array(kept))
        if held is not None and met:
            yield held

    return sorted_runs(keys).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.select(*names).schema))


def may_be_similar(a: Callable[[str], Column], b: Callable[[str], Column], similarity: float) -> Column:
    """Whether two sets can have enough elements in common, if these places hold one of the first SHARED of them."""
    need = similarity / (1 + similarity)
    return F.least(a("size") - a("pos"), b("size") - b("pos")) + (SHARED - 1) >= need * (a("size") + b("size")) - 1e-9


def with_degree(keys: DataFrame) -> DataFrame:
    """keys, a written table that goes, with degree, the number of keys of the node: of a group's members, the one that others are copies of has most."""
    degree = materialize(keys.groupBy("node").agg(F.count("*").alias("degree")), "degree")
    made = materialize(keys.join(degree, "node"), "keys")
    discard(keys, degree)
    return made


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): the node of largest degree of each key with all others that have the key, as many as rows at most.

    rows: (key, node, size, pos, degree).
    """
    hub = F.struct("degree", "node", "size", "pos")
    # written, so that the join is between plain exchanges and a hot key's rows can be split
    roots = materialize(rows.groupBy("key").agg(F.max(hub).alias("root")), "roots")
    fits = may_be_similar(lambda c: F.col(c), lambda c: F.col(f"root.{c}"), similarity)
    met = rows.join(roots, "key").where(F.col("node") != F.col("root.node")).where(fits)
    made = materialize(met.select(F.least("node", "root.node").alias("src"), F.greatest("node", "root.node").alias("dst")).distinct(), "stars")
    discard(roots)
    return made


def open_runs(rows: DataFrame) -> DataFrame:
    """The rows, of a table that goes, of the keys that nodes of several components have, with blocks, the number of parts of MEET rows."""
    spread = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    # written, so that the join is between plain exchanges and a hot key's rows can be split
    several = materialize(spread.where("low < high").select("key", F.ceil(F.col("n") / MEET).cast("int").alias("blocks")), "several")
    made = materialize(rows.drop("blocks").join(several, "key"), "open")
    discard(rows, several)
    return made


def with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows, of a table that goes, with the component of their node, a node without links being its own."""
    made = materialize(rows.drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    discard(rows)
    return made


def hub_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): some pairs of different components that may be similar and meet under SHARED keys.

    rows: (key, node, size, pos, degree, component). Under keys that at most SMALL nodes have,
    all such pairs meet; under others, up to HUBS nodes with all others: those of largest
    degree that are in components of their own. So there are a few pairs a row, however large
    a run is, and few components are left for rest_pairs, which looks at all.
    """
    need = similarity / (1 + similarity)
    names = ["key", "node", "size", "pos", "degree", "component"]

    def pairs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, two, least = (np.concatenate(c) for c in zip(*found))
        each, n = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two), least]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(n)], ["src", "dst", "least", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: np.zeros(0, np.int64) for n in names}

        def done(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(held["key"])) + 1
            found, n = [], 0
            for s, e in zip([0, *cut], [*cut, len(held["key"])]):
                node, size, pos, degree, part = (held[c][s:e] for c in names[1:])
                if e - s < 2 or (part == part[0]).all():
                    continue
                if e - s <= SMALL:
                    roots = range(e - s - 1)
                else:
                    order = np.lexsort((node, -degree))
                    roots = order[np.sort(np.unique(part[order], return_index=True)[1])[:HUBS]]
                left = size - pos + SHARED - 1
                for i in roots:
                    others = slice(i + 1, None) if e - s <= SMALL else slice(None)
                    common = np.ceil(need * (size[others] + size[i]) - 1e-9).astype(np.int64)
                    fits = (part[others] != part[i]) & (np.minimum(left[others], left[i]) >= common)
                    new = node[others][fits]
                    found.append((np.full(len(new), node[i]), new, np.minimum(common[fits], SHARED)))
                    n += len(new)
                    if n > BLOCK:
                        yield pairs(found)
                        found, n = [], 0
            if n:
                yield pairs(found)

        for b in batches:
            if not len(b):
                continue
            held = {n: np.concatenate([held[n], b.column(n).to_numpy()]) for n in names}
            last = int(np.searchsorted(held["key"], held["key"][-1]))
            if last:
                yield from done({n: x[:last] for n, x in held.items()})
                held = {n: x[last:] for n, x in held.items()}
        if len(held["key"]):
            yield from done(held)

    met = sorted_runs(rows.select(*names)).mapInArrow(run, "src long, dst long, least long, n long")
    return met.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("src", "dst")


def rest_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): all pairs of different components that may be similar and meet under SHARED keys.

    rows: (key, node, size, pos, component, blocks). A key's rows are dealt into blocks, of which
    each meets each in a run of its own, so that no task holds a large key. In a run only
    sizes that may be similar are compared. Small sets that are similar may have fewer
    elements in common; they need as many.
    """
    need = similarity / (1 + similarity)
    names = ["key", "one", "two", "mine", "node", "size", "pos", "component"]

    def pairs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, two, least = (np.concatenate(c) for c in zip(*found))
        each, n = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two), least]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(n)], ["src", "dst", "least", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), 0), np.int64)

        def done(held: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            found, n = [], 0
            for s, e in zip([0, *cut], [*cut, held.shape[1]]):
                part = held[7, s:e]
                if (part == part[0]).all():
                    continue
                # by size, so that a set's partners that aren't smaller are the rows behind it up to a place
                mine, node, size, pos, part = held[3:, s:e][:, np.argsort(held[5, s:e], kind="stable")]
                across = held[1, s] != held[2, s]
                left = size - pos + SHARED - 1
                ends = np.searchsorted(size, left / need - size + 1e-6, side="right")
                for i in np.flatnonzero(ends > np.arange(1, len(size) + 1)):
                    others = slice(i + 1, ends[i])
                    common = np.ceil(need * (size[others] + size[i]) - 1e-9).astype(np.int64)
                    fits = (part[others] != part[i]) & (np.minimum(left[others], left[i]) >= common)
                    if across:
                        fits &= mine[others] != mine[i]
                    new = node[others][fits]
                    if len(new):
                        found.append((np.full(len(new), node[i]), new, np.minimum(common[fits], SHARED)))
                        n += len(new)
                    if n > BLOCK:
                        yield pairs(found)
                        found, n = [], 0
            if n:
                yield pairs(found)

        for b in batches:
            if not len(b):
                continue
            held = np.concatenate([held, np.stack([b.column(n).to_numpy().astype(np.int64) for n in names])], axis=1)
            same = (held[:3] == held[:3, -1:]).all(axis=0)
            last = len(same) - int(same.sum())
            if last:
                yield from done(held[:, :last])
                held = held[:, last:]
        if held.shape[1]:
            yield from done(held)

    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    runs = dealt.withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other")).select(*names)
    placed = runs.repartition(partitions(rows.sparkSession), "key", "one", "two").sortWithinPartitions("key", "one", "two")
    met = placed.mapInArrow(run, "src long, dst long, least long, n long")
    return met.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("src", "dst")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) whose sets have a Jaccard similarity of at least similarity, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = []
            for x, y in zip(b.column(2), b.column(3)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([one, two]))
                n = int((both[1:] == both[:-1]).sum())
                fits.append(n / (len(both) - n) >= similarity)
            yield b.select(["src", "dst"]).filter(pa.array(fits, pa.bool_()))

    # sets that are in a pair are picked out first, so that the others don't move; written, as the planner then knows how many they are
    met = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "met")
    few = materialize(sets.select("node", "hashes").join(met, "node", "left_semi"), "few")
    discard(met)
    one = few.select(F.col("node").alias("src"), F.col("hashes").alias("one"))
    two = few.select(F.col("node").alias("dst"), F.col("hashes").alias("two"))
    found = materialize(pairs.join(one, "src").join(two, "dst").select("src", "dst", "one", "two").mapInArrow(run, "src long, dst long"), "links")
    discard(few)
    return found


def near_copies(sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(node, component) of the sets that are linked, over any number of links, by a Jaccard
    similarity of at least similarity; component is the smallest node.

    First come the pairs with fingerprints within 2 bits. Every other such pair has SHARED
    keys in common (prefix_keys): of each key one node meets the others, then, between the
    components that these pairs make, some hubs meet the others. What is then still in several
    components under a key meets there whole (rest_pairs), so no similar pair is missed. All
    pairs are compared on the whole sets, so no pair is linked that is less similar.
    """
    keys = with_degree(materialize(repeated_keys(prefix_keys(sets, similarity)), "repeated"))
    # written, so that the joins are between plain exchanges and a root's rows can be split
    stars = star_pairs(keys, similarity)
    first = materialize(simhash_pairs(sets).unionByName(stars).distinct(), "pairs")
    discard(stars)
    joined = linked(first, sets, similarity)
    left = open_runs(with_component(keys, joined))
    for pairs_of in (hub_pairs, rest_pairs):
        rest = materialize(pairs_of(left, similarity), "rest")
        if not rest.isEmpty():
            joined = linked(rest, sets, similarity, joined)
            if pairs_of is hub_pairs:
                left = open_runs(with_component(left, joined))
        else:
            discard(rest)
    discard(left)
    return joined


def linked(pairs: DataFrame, sets: DataFrame, similarity: float, joined: DataFrame | None = None) -> DataFrame:
    """(node, component), written, by those of pairs, a table that goes, that are similar, and by the components found before."""
    found = similar(pairs, sets, similarity)
    discard(pairs)
    # one edge from each node to its component stands for the links found before
    edges = found if joined is None else found.unionByName(joined.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    made = materialize(components(edges), "components")
    discard(found)
    return made


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without rows that have a near-duplicate with a smaller id in their group.

    Near-duplicates are texts whose sets of shingles have a Jaccard similarity of at least
    similarity, found from SimHash links on (near_copies). Rows are told apart by id and text: null ids rank behind all others, and of
    rows with one id, or none, the text with the smallest SHA-256 stays. Rows equal in id
    and text stay or go together.
    """
    sets = shingle_sets(docs, shingle, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_sha256")
    members = materialize(sets.select("node", rank.alias("rank")).join(near_copies(sets, similarity), "node"), "members")
    discard(sets)
    low = materialize(members.groupBy("component").agg(F.min("rank").alias("low")), "low")
    gone_id, gone_sha = fresh(docs, "id", "sha")
    gone = members.join(low, "component").where("rank != low").select(F.col("rank.id").alias(gone_id), F.col("rank.text_sha256").alias(gone_sha)).distinct()
    here = F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (text_id(F.col(f"`{text_col}`")) == F.col(gone_sha))
    return docs.join(gone, here, "left_anti")
