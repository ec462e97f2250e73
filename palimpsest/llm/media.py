"""Media columns: texts as 8-bit WAV samples, their spectra and their spectral-peak fingerprints.

The bytes of a text, padded with spaces to a positive multiple of 192, become the samples of a mono
8-bit WAV file, written and read back by the wave module. The samples read back go through a short-time Fourier
transform of windowed, overlapping frames, ``hop`` samples apart. In each of a few bands the strongest bin is a peak of
its frame, if it stands above its neighbours and above the frame's mean power. Each peak is paired with the peaks of the
same band and the next one in the following ``reach`` frames, its target zone. A pair (f1, f2, dt) is a code, stored
beside the time of its anchor in hops. A passage keeps most of its codes wherever it stands in a text.

Defined results: a null text counts as empty, whose payload is 192 spaces; a payload of one frame, or one without peaks,
has no pairs; equal texts, repeated rows too, have equal columns; a null id stays null; an empty table gives an empty
one; texts of any length are taken whole, frames in blocks of ``BLOCK``; further columns are dropped.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import Rows, id_and_text

UNIT, RATE = 192, 8_000
FRAME = 192
#: Edges of the bands of FFT bins in which peaks are sought (bin 0, the mean, is left out).
BANDS = (1, 9, 25, 97)
#: Samples from frame to frame; frames after the anchor's that are paired with it.
HOP, REACH = 24, 3
#: Frames transformed at once.
BLOCK = 4_096


def to_wav(payload: bytes) -> bytes:
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return held.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray, hop: int = HOP) -> np.ndarray:
    """Bin of the peak in each band of each whole frame, -1 where a band has none: frames x bands. The strongest bin, the
    lower of equal ones, is a peak if it is above the bins beside it and above the frame's mean power."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::hop] if len(samples) >= FRAME else np.empty((0, FRAME), samples.dtype)
    window = np.hanning(FRAME)
    out = np.empty((len(frames), len(BANDS) - 1), dtype=np.int32)
    for a in range(0, len(frames), BLOCK):
        block = frames[a : a + BLOCK].astype(np.float64)
        block -= block.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(block * window, axis=1)
        power = np.rint(spectrum.real**2 + spectrum.imag**2)  # whole numbers, so that rounding errors don't decide
        floor = power.mean(axis=1)
        power = np.pad(power, ((0, 0), (0, 1)), constant_values=-1)  # the last bin has no right neighbour
        rows = np.arange(len(block))
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            at = low + power[:, low:high].argmax(axis=1)
            top = power[rows, at]
            stands = (top > power[rows, at - 1]) & (top > power[rows, at + 1]) & (top > floor)
            out[a : a + BLOCK, b] = np.where(stands, at, -1)
    return out


def fingerprint(samples: np.ndarray, hop: int = HOP, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Times (hop of the anchor) and codes (f1, f2, dt) of the peak pairs, by time, distance and band."""
    top = peaks(samples, hop)
    found = []
    for dt in range(1, reach + 1):
        later = np.full_like(top, -1)  # -1: no frame so far on
        later[:-dt] = top[dt:]
        for b in range(top.shape[1]):
            for c in range(b, min(b + 2, top.shape[1])):
                found.append(np.where((later[:, c] < 0) | (top[:, b] < 0), -1, top[:, b] << 16 | later[:, c] << 4 | dt))
    codes = np.stack(found, axis=1)
    times = np.broadcast_to(np.arange(len(top), dtype=np.int32)[:, None], codes.shape)
    held = codes >= 0
    return times[held], codes[held].astype(np.int32)


class Media:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("wav", pa.binary()), ("payload", pa.binary()), ("fp_time", pa.list_(pa.int32())), ("fp_code", pa.list_(pa.int32()))])

    def __init__(self, hop: int = HOP, reach: int = REACH):
        self.hop, self.reach = hop, reach

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(self.schema)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                raw = text.as_py()
                wav = to_wav(raw + b" " * (-len(raw) % UNIT if raw else UNIT))
                payload = from_wav(wav)
                t, c = fingerprint(np.frombuffer(payload, dtype=np.uint8), self.hop, self.reach)
                yield from rows.add((doc_id, len(raw), wav, payload, t, c), 3 * len(wav) + 8 * len(t))
        yield from rows.flush()


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hop: int = HOP, reach: int = REACH) -> DataFrame:
    """``doc_id, n_bytes, wav, payload, fp_time, fp_code``. ``wav`` is the stored file, ``payload`` its samples as
    read back; the fingerprint is two arrays, of times and of the codes at them."""
    return id_and_text(docs, id_col, text_col).mapInArrow(Media(hop, reach), "doc_id long, n_bytes long, wav binary, payload binary, fp_time array<int>, fp_code array<int>")
