"""Texts as audio: lossless 8-bit samples, log-mel features and energy segments.

A text's bytes, padded, are the samples of a WAVE file (unsigned 8-bit PCM, mono), which stores and
returns them without loss.  Features come from the samples read back: polyphase resampling to 3/4 of the
rate, overlapped Hann frames, a log-mel filterbank, and segments of high energy by two thresholds
(hysteresis).  Log-mel frames are stored as Arrow fixed-shape tensors, each with its time span.

Each document is computed by itself, so that equal texts have equal values wherever they are.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

UNIT = 576  # the payload is a positive multiple of so many bytes
RATE = 8000
UP, DOWN, TAPS = 3, 4, 12  # resampling ratio and taps per phase
FRAME, HOP, MELS = 256, 128, 16
BLOCK = 1536  # frames computed at a time; times HOP, a multiple of UP
TENSOR_FRAMES = 32  # shape of a tensor: frames by mel bands
HIGH, LOW = 0.5, -0.25  # a segment begins above mean + HIGH and ends below mean + LOW standard deviations


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then bytes 255 up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def write_wave(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


@functools.cache
def _phases() -> np.ndarray:
    """One row of taps for each phase of a windowed sinc low-pass at the lower of the two Nyquist rates."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / DOWN) / DOWN * np.hamming(UP * TAPS) * UP
    return h.reshape(TAPS, UP).T[:, ::-1].copy()


def resample(x: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """UP / DOWN times the samples; each output phase is one strided product with its own taps.

    ``begin`` and ``end`` bound what is computed, in steps of DOWN input samples; the rest of ``x`` is only
    looked at for the filter's reach, and silence lies beyond its ends.
    """
    end = len(x) // DOWN if end is None else min(end, len(x) // DOWN)
    n, low = max(end - begin, 0), begin * DOWN - TAPS
    high = low + n * DOWN + 2 * TAPS
    local = np.concatenate((np.zeros(max(-low, 0)), x[max(low, 0) : max(high, 0)], np.zeros(max(high - max(len(x), low), 0))))
    out = np.empty((n, UP))
    windows = np.lib.stride_tricks.sliding_window_view(local, TAPS)
    for p in range(UP):
        shift, phase = divmod(p * DOWN, UP)
        out[:, p] = windows[1 + shift : 1 + shift + n * DOWN : DOWN] @ _phases()[phase]
    return out.ravel()


@functools.cache
def _filters() -> np.ndarray:
    """Triangular filters over FFT bins, evenly spaced on the mel scale."""
    nyquist = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + nyquist / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1) / nyquist * (FRAME // 2)
    k = np.arange(FRAME // 2 + 1)
    rise = (k - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - k) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.copy()


_WINDOW = np.hanning(FRAME)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames, MELS) as float32 and each frame's log energy, of 8-bit samples; silence fills the last frame.

    Frames are made in blocks from the samples of their block, so that a long text's samples and spectra are never all
    in memory as floating numbers.
    """
    total = len(samples) // DOWN * UP
    count = max(0, -(-(total - FRAME) // HOP)) + 1
    mel, energy = np.empty((count, MELS), np.float32), np.empty(count)
    for lo in range(0, count, BLOCK):
        hi = min(lo + BLOCK, count)
        begin, end = lo * HOP // UP, -(-((hi - 1) * HOP + FRAME) // UP)  # BLOCK * HOP is a multiple of UP
        at = max(0, begin * DOWN - TAPS)
        part = (samples[at : end * DOWN + TAPS].astype(np.float64) - 128) / 128
        x = resample(part, begin - at // DOWN, min(end, total // UP) - at // DOWN)  # TAPS is a multiple of DOWN, and so is ``at``
        x = np.concatenate((x, np.zeros(max(0, (hi - 1 - lo) * HOP + FRAME - len(x)))))
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][: hi - lo]
        power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2
        energy[lo:hi] = np.log(power.sum(axis=1) + 1e-6)
        mel[lo:hi] = np.log(power @ _filters() + 1e-6)
    return mel, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(start, end) frames of loud segments, end exclusive: on above the high, off below the low threshold."""
    mean, spread = energy.mean(), energy.std()
    event = np.where(energy > mean + HIGH * spread, 1, np.where(energy < mean + LOW * spread, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[last] > 0, False)
    change = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return change.reshape(-1, 2)


def seconds(frame: np.ndarray) -> np.ndarray:
    return np.asarray(frame) * (HOP / (RATE * UP / DOWN))


def tensor_table(mel: np.ndarray):
    """Arrow table (tensor fixed_shape_tensor<float>[TENSOR_FRAMES, MELS], start, end); the last is padded with its floor."""
    import pyarrow as pa

    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    full[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))
    start = np.arange(n) * TENSOR_FRAMES
    return pa.table({"tensor": tensors, "start": seconds(start), "end": seconds(np.minimum(start + TENSOR_FRAMES, len(mel)))})


def tensor_bytes(table) -> bytes:
    """The table as an Arrow IPC stream."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def audio_features(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text as audio and describe it, one row per input row.

    docs: doc_id, text and any other columns (ignored); null text counts as empty.  Returns doc_id,
    n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the last 32 bytes) of the
    samples read back, media_bytes and media_sha256 of the WAVE file, feature (frames, tensors, loud
    segments with their total time, mean log-mel bands, and a checksum of the tensors' values rounded to
    a tenth), tensors (an Arrow IPC stream of fixed-shape tensors, each with its start and end in seconds),
    spans (start and end of the loud segments in seconds) and, on demand, media (the WAVE file).  Null ids and
    repeated rows are carried through; an empty table stays empty.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                rows = [_describe(t, with_media) for t in part.column("text").to_pylist()]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "spans"]
                if with_media:
                    kinds, names = [*kinds, pa.binary()], [*names, "media"]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", tensors binary, spans array<struct<start: double, end: double>>" + ", media binary" * with_media
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, schema)


def _describe(text: str | None, with_media: bool) -> tuple:
    payload = payload_of(text)
    media = write_wave(payload)
    back = read_wave(media)
    mel, energy = log_mel(np.frombuffer(back, np.uint8))
    loud = segments(energy)
    table = tensor_table(mel)
    bands = " ".join(f"{x:.2f}" for x in mel.mean(axis=0, dtype=np.float64))
    rounded = zlib.crc32(np.round(mel * 10).astype(np.int16).tobytes())
    feature = f"frames={len(mel)} tensors={table.num_rows} segments={len(loud)} loud={seconds((loud[:, 1] - loud[:, 0]).sum()):.3f}s mel={bands} crc={rounded:08x}"
    out = (
        len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), feature, tensor_bytes(table), [{"start": float(a), "end": float(b)} for a, b in seconds(loud)],
    )
    return (*out, media) if with_media else out
