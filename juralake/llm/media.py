"""Audio columns: WAV bytes, short-time Fourier transforms, spectral-peak fingerprints.

WAV is read by the standard library's wave module (PCM of 8, 16, 24 or 32 bits;
channels are averaged). Frames of ``FRAME`` samples, ``HOP`` apart, under a Hann
window give a magnitude spectrogram. A peak is a cell above its neighbourhood
and above the mean level; every two peaks at most ``REACH`` frames apart make a
pair (f1, f2, dt), stored with the time of the first as an array of
(t_ms, hash), in order of time.

Clips of one length are transformed together, ``BATCH_SAMPLES`` at a time; a
clip's result doesn't depend on the others.

Edge cases: null bytes give nulls and no error; bytes that aren't such a WAV
give an empty array and the error's name; silence and clips shorter than a frame
(padded with zeros) give what peaks they have, often none; long clips are read
whole. Of equal cells in a neighbourhood all that reach the maximum are peaks.
Rows are independent: repeated rows give repeated results, and an empty table
gives none. Ids keep their type and may be null; other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, list_rows

FRAME, HOP, REACH, SPAN, NEAR_T, NEAR_F, RATE, BATCH_SAMPLES = 512, 256, 12, 96, 2, 6, 8000, 1 << 19


def read_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Samples in [-1, 1] (mean of the channels), rate, channels."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate, channels


def write_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV of samples in [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@lru_cache(maxsize=8)
def _hann(frame: int) -> np.ndarray:
    return np.hanning(frame).astype(np.float32)


def spectrogram(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Magnitudes of clips (their samples along the last axis): a row for each frame, a column for each frequency; a clip shorter than a frame is padded."""
    if x.shape[-1] < frame:
        x = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, frame - x.shape[-1])])
    cut = np.lib.stride_tricks.sliding_window_view(x, frame, axis=-1)[..., ::hop, :]
    return np.abs(np.fft.rfft(cut * _hann(frame), axis=-1)).astype(np.float32)


def _spread(x: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Maximum over r cells to each side, of values that aren't negative; windows grow by doubling."""
    out = np.pad(x, [(r, r) if k == axis else (0, 0) for k in range(x.ndim)])
    done, cut = 1, [slice(None)] * x.ndim
    while done < 2 * r + 1:
        step = min(done, 2 * r + 1 - done)
        a, b = cut.copy(), cut.copy()
        a[axis], b[axis] = slice(None, -step), slice(step, None)
        out = np.maximum(out[tuple(a)], out[tuple(b)])
        done += step
    return out


def fingerprints_of(x: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP, reach: int = REACH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For clips (a row each): times in ms and hashes (f1 << 24 | f2 << 8 | dt) of all pairs of peaks, the second 1 to ``reach`` frames later and at most ``span`` bins away, by clip, time and hash; and their number in each clip."""
    s = spectrogram(x, frame, hop)
    flat = s.reshape(len(s), -1).astype(np.float64)
    level = (flat.mean(axis=1) + flat.std(axis=1))[:, None, None]
    top = _spread(_spread(s, NEAR_F, 2), NEAR_T, 1)
    clip, t, f = np.nonzero((s == top) & (s > level) & (s > 1e-4))
    at = clip * (s.shape[1] + reach + 1) + t  # times of all clips, too far apart for pairs across
    last, first = np.searchsorted(at, at + reach, "right"), np.searchsorted(at, at, "right")  # partners come strictly later
    n = last - first
    a = np.repeat(np.arange(len(t)), n)
    b = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near = np.abs(f[b] - f[a]) <= span
    a, b = a[near], b[near]
    ms, code = (t[a] * hop * 1000 // max(rate, 1)).astype(np.int32), f[a].astype(np.int64) << 24 | f[b].astype(np.int64) << 8 | (t[b] - t[a])
    if hop * 1000 >= max(rate, 1):  # a frame, a time: pairs come by clip, time and first peak already
        order = np.argsort(a << 32 | (code & 0xFFFFFF), kind="stable")
    else:
        order = np.lexsort((code, ms, clip[a]))
    return ms[order], code[order], np.bincount(clip[a], minlength=len(x))


def fingerprint(x: np.ndarray, rate: int, **params) -> tuple[np.ndarray, np.ndarray]:
    """Times and hashes of one clip."""
    return fingerprints_of(x[None], rate, **params)[:2]


_PAIR = pa.struct([("t_ms", pa.int32()), ("hash", pa.int64())])


def _run(frame, hop, reach, span):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, error, same, pairs = [(None, None, None)] * part.num_rows, [None] * part.num_rows, {}, {}
                for i, v in enumerate(part.column("media")):
                    if v.is_valid:
                        try:
                            x, r, c = read_wav(v.as_py())
                            rows[i] = r, c, len(x)
                            same.setdefault((len(x), r), []).append((i, x))
                        except (wave.Error, EOFError, ValueError, TypeError, ZeroDivisionError) as e:
                            error[i] = type(e).__name__
                for (size, r), clips in same.items():
                    step = max(1, BATCH_SAMPLES // max(size, frame))
                    for k in range(0, len(clips), step):
                        ms, code, n = fingerprints_of(np.stack([x for _, x in clips[k : k + step]]), r, frame, hop, reach, span)
                        ends = np.cumsum(n)
                        for (i, _), a, b in zip(clips[k : k + step], ends - n, ends, strict=True):
                            pairs[i] = ms[a:b], code[a:b]
                none = np.zeros(0, np.int32), np.zeros(0, np.int64)
                got = [pairs.get(i, none) for i in range(part.num_rows)]
                value = pa.StructArray.from_arrays([pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], fields=list(_PAIR))
                rate, channels, samples = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(rate, pa.int32()), pa.array(channels, pa.int32()), pa.array(samples, pa.int64()), list_rows(value, np.array([len(g[0]) for g in got])), pa.array(error, pa.string())], ["media_id", "sample_rate", "channels", "n_samples", "fingerprint", "error"])

    return run


def fingerprints(media: DataFrame, id_col: str = "media_id", media_col: str = "media", frame: int = FRAME, hop: int = HOP, reach: int = REACH, span: int = SPAN) -> DataFrame:
    """media_id, sample_rate, channels, n_samples, fingerprint (array of t_ms, hash), error; one row for each row."""
    d = media.select(F.col(id_col).alias("media_id"), F.col(media_col).cast("binary").alias("media"))
    return d.mapInArrow(_run(frame, hop, reach, span), f"media_id {kind(media, id_col)}, sample_rate int, channels int, n_samples long, fingerprint array<struct<t_ms:int,hash:bigint>>, error string")


@lru_cache(maxsize=8)
def _tones(count: int, samples: int, rate: int) -> np.ndarray:
    t = np.arange(samples, dtype=np.float32) / rate
    freq = 150 + (rate / 2 - 300) * np.arange(count) / count
    return np.sin(2 * np.pi * freq[:, None].astype(np.float32) * t)


def render(vector: np.ndarray, rate: int = RATE, seconds: float = 1.0) -> bytes:
    """A clip that sounds a vector out: eight time slots, in each the tones of an eighth of the components, as loud as the components are large."""
    v = np.zeros(-(-max(1, len(vector)) // 8) * 8, np.float32)
    v[: len(vector)] = np.nan_to_num(vector)
    slots = v.reshape(8, -1)
    x = (slots @ _tones(slots.shape[1], int(rate * seconds) // 8, rate)).ravel()
    return write_wav(x / max(1e-6, float(np.abs(x).max())), rate)


def _render(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            clips = [render(np.array(v.as_py(), np.float32)) if v.is_valid else None for v in part.column("vector")]
            yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(clips, pa.binary())], ["media_id", "media"])


def from_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """media_id, media: a WAV clip for each vector. For tables that have numbers but no audio."""
    d = table.select(F.col(id_col).alias("media_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    return d.mapInArrow(_render, f"media_id {kind(table, id_col)}, media binary")
