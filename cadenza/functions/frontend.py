"""Log-mel features: windows, filters, power spectra, and their normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import windows

N_FFT, WIN, HOP, RATE, MELS = 512, 400, 160, 16_000, 128
GUARD = 2.0**-24
PREEMPHASIS = 0.97


def hann(n: int = WIN, n_fft: int = N_FFT) -> Column:
    """A symmetric Hann window of ``n`` in the middle of ``n_fft`` places, as an array of double."""
    left = (n_fft - n) // 2
    inside = lambda k: 0.5 - 0.5 * F.cos(2 * np.pi * (k - left) / (n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n_fft - 1)), lambda k: F.when((k >= left) & (k < left + n), inside(k)).otherwise(0.0))


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    """The mel scale that is linear to 1 kHz and logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(np.log(6.4) * (mel - 15) / 27))


def mel_filters(rate: int = RATE, n_fft: int = N_FFT, mels: int = MELS, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters of unit area, one row for each band."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high or rate / 2), mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def dither_noise(n: int, scale: float = 1e-5) -> np.ndarray:
    """Uniform noise for ``n`` samples, from a xorshift generator that their number seeds."""
    x, out = (n or 1) & 0xFFFFFFFFFFFFFFFF, np.zeros(n)
    for i in range(n):
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        out[i] = scale * ((x >> 11) / 2**53 * 2 - 1)
    return out


def dither(samples: np.ndarray, scale: float = 1e-5) -> np.ndarray:
    """Samples (along the last axis) with noise added; the same for all arrays of a length."""
    samples = np.asarray(samples, float)
    return samples + dither_noise(samples.shape[-1], scale)


def power_spectra(samples: np.ndarray, n_fft: int = N_FFT, hop: int = HOP, win: int = WIN) -> np.ndarray:
    """Power spectrum of floor(n / hop) frames of samples (along the last axis) padded by half a transform on both sides."""
    samples = np.asarray(samples, float)
    padded = np.pad(samples, [(0, 0)] * (samples.ndim - 1) + [(n_fft // 2, n_fft // 2)])
    return spectra_of_padded(padded, samples.shape[-1] // hop, n_fft, hop, win)


def spectra_of_padded(padded: np.ndarray, frames: int, n_fft: int = N_FFT, hop: int = HOP, win: int = WIN) -> np.ndarray:
    """Power spectrum of the first ``frames`` frames, every ``hop`` samples from the first one on."""
    window = np.zeros(n_fft)
    window[(n_fft - win) // 2 : (n_fft - win) // 2 + win] = np.hanning(win)
    at = np.arange(frames)[:, None] * hop + np.arange(n_fft)
    return np.abs(np.fft.rfft(padded[..., at] * window, axis=-1)) ** 2 if frames else np.zeros((*padded.shape[:-1], 0, n_fft // 2 + 1))


def normalize(x: np.ndarray) -> np.ndarray:
    """Each band less its mean over its sample deviation."""
    return (x - x.mean(1, keepdims=True)) / (np.sqrt(((x - x.mean(1, keepdims=True)) ** 2).sum(1, keepdims=True) / max(x.shape[1] - 1, 1)) + 1e-5)


def log_mel(rows: DataFrame, samples: str, mels: int = MELS, n_fft: int = N_FFT, hop: int = HOP, win: int = WIN, emphasis: float = PREEMPHASIS, guard: float = GUARD, per_band: bool = True) -> DataFrame:
    """``rows`` with ``features``: log-mel bands (band by frame) of an array of samples, normalised ``per_band``."""
    kinds = dict(rows.dtypes)
    filters = mel_filters(n_fft=n_fft, mels=mels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(samples).to_pylist():
                x = np.asarray(x or [], float)
                x = np.concatenate([x[:1], x[1:] - emphasis * x[:-1]])
                mel = np.log(filters @ power_spectra(x, n_fft, hop, win).T + guard)
                out.append((normalize(mel) if per_band and mel.shape[1] else mel).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.list_(pa.float64())))], [*batch.schema.names, "features"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), "features array<array<double>>"]))


def log_mel_frames(rows: DataFrame, samples: str = "samples", order: str = "seq", mels: int = MELS, n_fft: int = N_FFT, hop: int = HOP, win: int = WIN, emphasis: float = PREEMPHASIS, guard: float = GUARD, per_band: bool = True, frames_per_block: int = 1024) -> DataFrame:
    """(stream_id, frame, bands): the features of ``log_mel`` for streams whose samples come in rows by ``order``.

    A block of frames gets half a transform of samples before it, and one more for the emphasis, and what its last frame
    takes beyond it. Means and deviations of bands are aggregates by (stream, band), partial where the frames are.
    """
    half, size = n_fft // 2, hop * frames_per_block
    blocks = windows.even_blocks(windows.with_places(rows, samples, order), size, half + 1, max(n_fft - half - hop, 0), samples)
    filters = mel_filters(n_fft=n_fft, mels=mels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, first, n = (batch.column(c)[i].as_py() for c in ("block", "first_sample", "stream_samples"))
                frames = min((block + 1) * frames_per_block, n // hop) - block * frames_per_block
                if frames <= 0:
                    continue
                x = np.asarray(batch.column("samples")[i].values, float)
                y = np.concatenate([x[:1], x[1:] - emphasis * x[:-1]])
                begin = block * size - half  # the first place that a frame of the block reads
                if first > 0:  # its predecessor is not here, and no frame reads it
                    y, first = y[1:], first + 1
                padded = np.zeros((frames - 1) * hop + n_fft)
                y = y[max(begin - first, 0) :][: len(padded) - max(first - begin, 0)]
                padded[max(first - begin, 0) :][: len(y)] = y
                mel = np.log(spectra_of_padded(padded, frames, n_fft, hop, win) @ filters.T + guard)
                bands = pa.ListArray.from_arrays(np.arange(0, mel.size + 1, mels, dtype=np.int32), mel.ravel())
                streams = batch.column("stream_id").take(pa.array(np.full(frames, i)))
                yield pa.RecordBatch.from_arrays([streams, pa.array(np.arange(frames) + block * frames_per_block), bands], ["stream_id", "frame", "bands"])

    raw = blocks.mapInArrow(run, f"stream_id {dict(blocks.dtypes)['stream_id']}, frame bigint, bands array<double>")
    if not per_band:
        return raw
    each = raw.select("stream_id", F.posexplode("bands").alias("band", "v")).groupBy("stream_id", "band").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    facts = each.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("band", "m", "s"))).alias("_facts"))
    scaled = F.transform(F.arrays_zip(F.col("bands").alias("v"), F.col("_facts").alias("f")), lambda x: (x["v"] - x["f"]["m"]) / (x["f"]["s"] + 1e-5))
    return raw.join(facts, "stream_id").select("stream_id", "frame", scaled.alias("bands"))
