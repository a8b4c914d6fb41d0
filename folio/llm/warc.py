"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by id into shards whose bounds depend on the rows alone.
Each shard is written as files that roll when their compressed size reaches a limit,
one gzip member per record, headers and digests made anew. Files are written under
temporary names; tasks give those that finished tasks report their final names, then
the manifest, a table of files that Spark commits, makes the archive readable.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from folio.llm.common import materialize, scratch_dir

DATE = "2024-01-01T00:00:00Z"
#: Ids that bounds are taken from: so many at least, and so many a shard.
SAMPLE, SHARD_SAMPLE = 100_000, 20
LEAST = 100
#: Tasks that read an archive, one per file up to here.
MOST_TASKS = 20_000
SPLIT = b"\r\n\r\n"
MANIFEST = "manifest"
ENTRY = "file string, records long, bytes long, first_id long, last_id long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _field(value: str) -> str:
    """A header value on one line: controls and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit (refers_to given) carries headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {_field(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"Page-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"Page-Refers-To: {refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + SPLIT + block + SPLIT


def member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def decisions(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) for each row whose payload is a copy.

    Of equal payloads of at least 100 bytes the smallest id is the response; the others
    refer to it. Null ids rank last. Rows repeated with id and payload are all responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= LEAST)
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    return rows.join(first, "digest").where("page_id IS NULL OR page_id != refers_to").where("refers_to IS NOT NULL").select("page_id", "digest", "refers_to").distinct()


def bounds(pages: DataFrame, shard_bytes: int, id_col: str, payload_col: str) -> tuple[int, int, list[float]]:
    """(shards of null ids, least id, inner bounds of ids less the least one).

    Bounds are quantiles by bytes of ids that a hash picks, SHARD_SAMPLE of them a shard;
    rows without an id, which have no range, are shared out by payload.
    """
    size, ident = F.coalesce(F.octet_length(F.col(payload_col)), F.lit(0)) + 1000, F.col(id_col)
    total = pages.agg(F.count(ident).alias("n"), F.sum(F.when(ident.isNotNull(), size)).alias("b"), F.sum(F.when(ident.isNull(), size)).alias("none"), F.min(ident).alias("low")).first()
    shards, none, low = -(-(total["b"] or 0) // shard_bytes), -(-(total["none"] or 0) // shard_bytes), total["low"] or 0
    if shards < 2:
        return none, low, []
    some = pages.where(ident.isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(total["n"])) < max(SAMPLE, SHARD_SAMPLE * shards)))
    picked = some.select((ident - low).cast("double").alias("id"), size.alias("size")).orderBy("id", "size").toPandas()
    if picked.empty:
        return none, low, []
    step = picked["size"].cumsum() * shards // (picked["size"].sum() + 1)
    return none, low, sorted(set(picked["id"][step.diff() > 0]))


def write_warc(pages: DataFrame, path: str, shard_bytes: int = 256 << 20, file_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages under path and return the manifest (ENTRY), a row per file.

    A null payload is empty; a null url becomes urn:page:<id>; null ids are kept, in
    shards of their own before the others. Repeated rows give repeated records. An empty
    table gives a manifest without files. The files' bytes depend on the rows and the limits alone. path is a
    URI that every executor can write to.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    none, low, inner = bounds(pages, shard_bytes, id_col, payload_col)
    said = decisions(pages, id_col, payload_col)
    both = rows.select("page_id", F.lit(1).alias("kind"), F.sha2("payload", 256).alias("digest"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(
        said.select("page_id", F.lit(0).alias("kind"), "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    )
    if inner:
        keyed = both.withColumn("at", (F.col("page_id") - low).cast("double"))
        both = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="at", outputCol="range", handleInvalid="keep").transform(keyed)
    else:
        both = both.withColumn("range", F.lit(0))
    alone = F.pmod(F.xxhash64("digest"), F.lit(max(1, none)))
    both = both.withColumn("shard", F.when(F.col("page_id").isNull(), alone).otherwise(F.col("range") + none).cast("int"))
    temporary = f"{path}/_temporary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(temporary)
        fs.create_dir(folder, recursive=True)
        out, entry, refers, shard, number = None, {}, {}, None, 0
        made: list[dict] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                entry["sha256"] = entry.pop("hash").hexdigest()
                made.append(entry)
                out = None

        for b in batches:
            for s, page_id, kind, digest, url, payload, to in zip(*(c.to_pylist() if i != 5 else c for i, c in enumerate(b.columns))):
                if s != shard:
                    close()
                    shard, number, refers = s, 0, {}
                if kind == 0:
                    refers = {(page_id, digest): to}
                    continue
                data = member(record(page_id, url, payload.as_py(), digest, refers.get((page_id, digest))))
                if out is not None and entry["bytes"] + len(data) > file_bytes:
                    close()
                    number += 1
                if out is None:
                    name = f"part-{s:06d}-{number:04d}.warc.gz"
                    temp = f"{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{folder}/{temp}", compression=None)
                    entry = {"file": name, "temporary": temp, "records": 0, "bytes": 0, "first_id": page_id, "last_id": page_id, "hash": hashlib.sha256()}
                out.write(data)
                entry["hash"].update(data)
                entry.update(records=entry["records"] + 1, bytes=entry["bytes"] + len(data), last_id=page_id)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(m) for m in made], pa.string())], ["entry"])

    laid = both.select("shard", "page_id", "kind", "digest", "url", "payload", "refers_to")
    sorted_ = laid.repartition(none + len(inner) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    written = materialize(sorted_.mapInArrow(write, "entry string"), "written")
    return _commit(written, path, temporary)


def _commit(written: DataFrame, path: str, temporary: str) -> DataFrame:
    """Tasks rename the files that written reports, then the manifest is put in place; leftovers of lost tasks go."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, final), (_, temp) = pafs.FileSystem.from_uri(path), pafs.FileSystem.from_uri(temporary)
        fs.create_dir(final, recursive=True)
        for b in batches:
            for e in map(json.loads, b.column(0).to_pylist()):
                # a task that runs again finds what it has renamed
                if fs.get_file_info(f"{temp}/{e['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{temp}/{e['temporary']}", f"{final}/{e['file']}")
            yield b

    spark = written.sparkSession
    entries = written.mapInArrow(rename, "entry string").select(F.from_json("entry", ENTRY).alias("e")).select("e.*")
    entries.write.json(f"{path}/{MANIFEST}")
    fs, temp = pafs.FileSystem.from_uri(temporary)
    if fs.get_file_info(temp).type != pafs.FileType.NotFound:
        fs.delete_dir(temp)
    return spark.read.schema(ENTRY).json(f"{path}/{MANIFEST}")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive, member by member."""
    data, left = b"", zlib.decompressobj(31)
    raw = stream.read(1 << 16)
    while raw:
        data += left.decompress(raw)
        raw = left.unused_data
        if left.eof:
            head, _, rest = data.partition(SPLIT)
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            n = int(fields["Content-Length"])
            if rest[n:] != SPLIT or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(rest[:n]).hexdigest()}":
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
            yield fields, rest[:n]
            data, left = b"", zlib.decompressobj(31)
        raw = raw or stream.read(1 << 16)
    if data:
        raise ValueError("the archive ends within a record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) per record.

    Only files that the manifest names are read, each as a stream by one task. Of a
    response, length and digest are computed from the payload read; a revisit has a
    null payload and its headers' figures of the full payload.
    """
    files = spark.read.schema(ENTRY).json(f"{path}/{MANIFEST}").select(F.concat(F.lit(f"{path}/"), "file").alias("uri"))
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, name = pafs.FileSystem.from_uri(uri)
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for fields, block in parse(stream):
                        payload = block.partition(SPLIT)[2] if fields["WARC-Type"] == "response" else None
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest()
                        length = int(fields["Page-Payload-Length"]) if payload is None else len(payload)
                        to = fields.get("Page-Refers-To")
                        rows.append((int(fields["Page-ID"]) if fields["Page-ID"] else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(to) if to else None, payload, length, digest))
                        size += len(block)
                        if size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    names = files.repartition(max(1, min(files.count(), MOST_TASKS)))
    return names.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)


def round_trip(pages: DataFrame, **how: object) -> DataFrame:
    """Write pages to the shared folder and read the archive back."""
    path = f"{scratch_dir(pages.sparkSession)}/warc"
    write_warc(pages, path, **how)
    return read_warc(pages.sparkSession, path)
