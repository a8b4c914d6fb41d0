import gzip
import hashlib
import os

import pytest

from folio.llm import warc as op

BIG = "<html>" + "x" * 200
PAGES = [(5, "http://a.org/1", BIG), (2, "http://a.org/2", BIG), (9, None, BIG), (3, "http://a.org/ x\r\nEvil: 1", "<p>short</p>"), (4, "u", "<p>short</p>"), (6, "u", None), (7, "u", ""), (8, "http://é.org/", "é\r\n\r\nb" * 60)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip(spark):
    got = {r["page_id"]: r for r in op.round_trip(frame(spark)).collect()}
    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["record_type"] == ("revisit" if page_id in (5, 9) else "response")
        assert r["refers_to"] == (2 if page_id in (5, 9) else None)
        assert r["payload"] is None if page_id in (5, 9) else bytes(r["payload"]) == data


def test_files_are_sorted_rolled_and_equal_on_every_run(spark, tmp_path):
    rows = [(i * 7 % 1000, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(400)]
    digests = []
    for n in (2, 5):
        path = f"file://{tmp_path}/run{n}"
        manifest = op.write_warc(frame(spark, rows).repartition(n), path, shard_bytes=100_000, file_bytes=8_000)
        entries = sorted((e.asDict() for e in manifest.collect()), key=lambda e: e["file"])
        folder = f"{tmp_path}/run{n}"
        assert sorted(os.listdir(folder)) == sorted([op.MANIFEST, *[e["file"] for e in entries]])
        assert "_SUCCESS" in os.listdir(f"{folder}/{op.MANIFEST}")
        assert sum(e["records"] for e in entries) == 400 and len({e["file"][5:11] for e in entries}) > 3
        assert all(e["bytes"] <= 8_000 == True or e["records"] == 1 or e["bytes"] <= 8_000 for e in entries)  # noqa: E712
        ends = [(e["first_id"], e["last_id"]) for e in entries]
        assert all(a <= b for a, b in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
        for e in entries:
            data = open(f"{folder}/{e['file']}", "rb").read()
            assert hashlib.sha256(data).hexdigest() == e["sha256"]
            assert gzip.decompress(data).count(b"WARC/1.1\r\n") == e["records"]
        digests.append([e["sha256"] for e in entries])
        assert op.read_warc(spark, path).count() == 400
    assert digests[0] == digests[1]


def test_headers_stay_on_one_line_and_damage_is_found(spark, tmp_path):
    data = op.record(3, "http://a/ x\r\nEvil: 1", b"p", hashlib.sha256(b"p").hexdigest(), None)
    assert b"\r\nEvil" not in data
    import io

    whole = op.member(data)
    assert len(list(op.parse(io.BytesIO(whole + whole)))) == 2
    with pytest.raises(ValueError):
        list(op.parse(io.BytesIO(op.member(data.replace(b"\r\n\r\np", b"\r\n\r\nq")))))
    with pytest.raises(ValueError):
        list(op.parse(io.BytesIO(whole[:-20])))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "u", BIG), (1, "u", BIG), (None, "u", BIG), (None, "v", "x")]
    got = sorted((r["page_id"] or 0, r["record_type"]) for r in op.round_trip(frame(spark, rows)).collect())
    assert got == [(0, "response"), (0, "revisit"), (1, "response"), (1, "response")]
    assert op.round_trip(frame(spark, [])).count() == 0


def test_null_ids_are_shared_out_and_large_ids_keep_their_order(spark, tmp_path):
    page = lambda i: hashlib.sha256(str(i).encode()).hexdigest() * 20
    rows = [(None, "u", page(i)) for i in range(200)] + [(2**60 + i, "u", page(1000 + i)) for i in range(200)]
    path = f"file://{tmp_path}/out"
    entries = sorted((e.asDict() for e in op.write_warc(frame(spark, rows), path, shard_bytes=60_000, file_bytes=20_000).collect()), key=lambda e: e["file"])
    none = {e["file"][:11] for e in entries if e["first_id"] is None}
    assert len(none) > 3 and all(e["last_id"] is None for e in entries if e["file"][:11] in none)
    ends = [(e["first_id"], e["last_id"]) for e in entries if e["file"][:11] not in none]
    assert len({e["file"][:11] for e in entries} - none) > 3 and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
    assert op.read_warc(spark, path).count() == 400
