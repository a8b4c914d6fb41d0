import hashlib
import zlib

import numpy as np

from folio.llm import media as op

TEXTS = [None, "", "a", "é" * 96, "x" * 192, "x" * 193, "Un texte. " * 3000, "\0\xff" * 500]


def test_figures_of_what_is_read_back(spark):
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], b"m")], "doc_id long, text string, media binary")
    rows = op.media_columns(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        data = (TEXTS[r["doc_id"]] or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and op.from_wav(bytes(r["media"])) == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
        assert r["feature"] == " ".join("%x" % c for c in r["peaks"]) and r["feature"]
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] == 6}) == 1


def test_peaks_of_a_known_tone():
    """A tone of 20 periods a window has its peak in bin 20 of every window."""
    n = np.arange(op.FRAME * 40)
    samples = np.round(128 + 100 * np.sin(2 * np.pi * 20 * n / op.FRAME)).astype(np.uint8)
    bins, energy = op.window_peaks(samples)
    assert len(bins) == 8 * 40 - 7 and set(bins.tolist()) == {20}
    codes = op.pairs(bins, energy)
    assert {(c >> 20 & 0xFFF, c >> 8 & 0xFFF) for c in codes.tolist()} == {(20, 20)}


def plain_feature(payload):
    """The fingerprint window by window and bin by bin, with the transform written out."""
    n = np.arange(op.FRAME)
    waves = [np.exp(-2j * np.pi * k * n / op.FRAME) for k in range(op.FRAME // 2 + 1)]
    peaks = []
    for a in range(0, len(payload) - op.FRAME + 1, op.FRAME // 8):
        x = (np.frombuffer(payload[a : a + op.FRAME], np.uint8).astype(float) - 128) * np.hanning(op.FRAME)
        peaks.append(max(((abs(x @ w) ** 2, -k) for k, w in enumerate(waves) if k >= 2)))
    chosen = []
    for i, (e, _) in enumerate(peaks):
        if e >= max(p[0] for p in peaks[max(0, i - 8) : i + 9]) and (not chosen or i - chosen[-1] > 8):
            chosen.append(i)
    code = lambda i, j: (i << 32) | (-peaks[i][1] << 20) | (-peaks[j][1] << 8) | min(j - i, 255)
    out = [code(i, j) for n, i in enumerate(chosen) for j in chosen[n + 1 : n + 4]]
    return sorted(out) or [chosen[0] << 32 | -peaks[chosen[0]][1] << 20]


def test_feature_is_that_of_a_plain_version():
    """Texts without equal windows, where a last bit can't decide between peaks."""
    import random

    r = random.Random(4)
    for length in (10, 192, 700, 5000):
        payload = op.padded("".join(r.choice("abcdefghijklmnopqrstuvwxyz éà.,\n") for _ in range(length)).encode())
        codes = op.pairs(*op.window_peaks(np.frombuffer(payload, np.uint8)))
        assert codes.tolist() == plain_feature(payload)


def test_a_passage_is_found_at_an_odd_place():
    """Half of the pairs of a passage come again, at one distance, where it stands elsewhere, and not in other text."""
    import random
    from collections import Counter

    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)).encode()
    codes = lambda data: [(c >> 32, c & 0xFFFFFFFF) for c in op.pairs(*op.window_peaks(np.frombuffer(op.padded(data), np.uint8))).tolist()]

    def aligned(a, b):
        places = {}
        for at, pair in codes(b):
            places.setdefault(pair, []).append(at)
        n = Counter(x - at for at, pair in codes(a) for x in places.get(pair, []))
        return max((n[k - 1] + n[k] + n[k + 1] for k in list(n)), default=0)

    passage = prose(900)
    for shift in (0, 37, 101, 24):
        other = prose(300)[: 1000 + shift] + passage + prose(200)
        assert aligned(passage, other) >= 0.5 * len(codes(passage)), shift
    assert aligned(passage, prose(1400)) <= 0.02 * len(codes(passage))


def test_long_payloads_are_read_in_steps(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, op.FRAME * 50).astype(np.uint8)
    whole = op.window_peaks(samples)
    monkeypatch.setattr(op, "STEP", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, op.window_peaks(samples)))


def test_empty_table(spark):
    assert op.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
