"""Media columns: samples in WAV files, read back, and spectral-peak fingerprints.

A payload is stored as mono 8-bit samples. Its fingerprint comes from short-time Fourier
transforms: windows of 192 samples that overlap by seven eighths, so that a passage at
another place, by any number of samples, is seen in nearly the same windows. The
strongest bin of each window is its peak; peaks that are the largest within 8 windows
to both sides are anchors, and each is paired with the next three. A pair is an array
element (window, bin, later bin, windows between).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import plain

FRAME = 192
RATE = 16_000
HOP = FRAME // 8
REACH = 8
FAN = 3
STEP = 4096
SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, media binary, peaks array<long>"
)
HANN = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    return data + b" " * (FRAME - len(data) % FRAME if len(data) % FRAME or not data else 0)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def window_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin above the constant part, and its energy, of each window; the windows come in blocks."""
    windows = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, energy = [], []
    for a in range(0, len(windows), STEP):
        frames = (windows[a : a + STEP].astype(np.float32) - np.float32(128)) * HANN
        found = np.fft.rfft(frames, axis=1)
        power = np.round(found.real**2 + found.imag**2, 1)
        power[:, :2] = -1
        bins.append(power.argmax(axis=1))
        energy.append(power[np.arange(len(power)), bins[-1]])
    return np.concatenate(bins), np.concatenate(energy)


def anchors(energy: np.ndarray) -> np.ndarray:
    """Windows whose energy is the largest within REACH to both sides; of equal ones nearer than that the first."""
    room = np.full(REACH, -np.inf)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([room, energy, room]), 2 * REACH + 1)
    kept, last = [], -REACH - 1
    for i in np.flatnonzero(energy >= around.max(axis=1)).tolist():
        if i - last > REACH:
            kept.append(i)
            last = i
    return np.array(kept, np.int64)


def pairs(bins: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Codes of anchor pairs: window << 32 | bin << 20 | later bin << 8 | windows between (255 at most)."""
    at = anchors(energy)
    f = bins[at].astype(np.int64)
    out = [at << 32 | f << 20]
    for k in range(1, min(FAN, len(at) - 1) + 1):
        out.append((at[:-k] << 32) | (f[:-k] << 20) | (f[k:] << 8) | np.minimum(at[k:] - at[:-k], 255))
    return np.sort(np.concatenate(out[1:] or out))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """id and SCHEMA for each row: the WAV file, its figures, and the time-coded peak pairs.

    The payload is the whole text in UTF-8 (null: empty) padded by spaces to a positive
    multiple of 192 bytes; all figures are of what is read back from the file. A payload
    with a single anchor has that anchor alone as its fingerprint. feature is the pairs
    as hexadecimal numbers. Equal texts give equal values; repeated rows are returned as
    often as they come; an empty table gives an empty result; other columns are ignored.
    """

    def row(text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        media = to_wav(padded(data))
        payload = from_wav(media)
        codes = pairs(*window_peaks(np.frombuffer(payload, np.uint8)))
        return (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
            hashlib.sha256(media).hexdigest(), " ".join(map("%x".__mod__, codes.tolist())), media if with_media else None, codes if with_media else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for whole in batches:
            for a in range(0, len(whole), 512):
                b = whole.slice(a, 512)
                cols = list(zip(*map(row, b.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], [id_col, *names])

    rows = plain(docs, id_col, text=text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {SCHEMA}")
