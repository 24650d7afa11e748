"""Audio columns: polyphase resampling, log-mel features and energy segments as tensors with time spans.

Samples are unsigned 8-bit PCM in a WAV container. Features come from the samples at ``TARGET`` Hz:
frames of ``FRAME`` samples every ``HOP`` give log energies of ``MELS`` mel bands; runs of frames whose energy
rises over a high threshold and stays over a low one are segments. Frames are grouped into patches of
``PATCH`` frames: an Arrow tensor column of fixed shape (PATCH, MELS) with the time span of each patch.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices

#: Bytes to a multiple of which a payload is filled, and with what.
UNIT, FILL = 192, 32
RATE, TARGET = 8000, 6000
FRAME, HOP, MELS, PATCH = 256, 128, 16, 32
#: A segment begins over the first and ends under the second share of the loudest frame's energy.
HIGH, LOW = 0.5, 0.25
#: Filter taps on each side of a zero crossing of the wider rate.
HALF = 8
#: Output samples that are computed at once.
CHUNK = 1 << 18
HEADER = 44


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples (RIFF sizes are 32 bit: larger payloads are an error)."""
    pad = len(payload) & 1
    return (
        b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
        + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad
    )


def unwav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file as :func:`wav` writes them."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this form")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[20:36])
    if (kind, channels, bits) != (1, 1, 8):
        raise ValueError("not mono 8-bit samples")
    return media[HEADER : HEADER + struct.unpack("<I", media[40:44])[0]], rate


def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc for resampling by up / down, of odd length, with gain ``up``."""
    wide = max(up, down)
    t = np.arange(-HALF * wide, HALF * wide + 1)
    h = np.sinc(t / wide) * np.hamming(len(t))
    return h / h.sum() * up


def resample(x: np.ndarray, rate: int, target: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Samples ``start`` to ``stop`` of x at ``target`` Hz: each of the filter's phases is a dot product with a stretch of x.

    Outside x there is silence. Output sample n is at time n / target.
    """
    g = gcd(rate, target)
    up, down = target // g, rate // g
    h = low_pass(up, down)
    centre = len(h) // 2
    total = -(-len(x) * up // down)
    stop = total if stop is None else min(stop, total)
    n = np.arange(start, max(start, stop))
    out = np.empty(len(n))
    taps = -(-len(h) // up)
    phases = (n * down + centre) % up
    newest = (n * down + centre) // up
    lo = int(newest[0]) - taps + 1 if len(n) else 0
    hi = int(newest[-1]) + 1 if len(n) else 0
    part = np.zeros(hi - lo)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b]
    for phase in range(up):
        (at,) = np.nonzero(phases == phase)
        if len(at):
            row = h[phase::up]
            row = np.pad(row, (0, taps - len(row)))[::-1]  # oldest sample first
            windows = np.lib.stride_tricks.sliding_window_view(part, taps)
            first = int(newest[at[0]]) - taps + 1 - lo
            out[at] = windows[first :: down][: len(at)] @ row
    return out


def mel_bands(rate: int = TARGET, frame: int = FRAME, bands: int = MELS) -> np.ndarray:
    """Triangles (bands, frame // 2 + 1), evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


_BANDS = mel_bands()
_WINDOW = np.hanning(FRAME)


def frames_of(samples: int, rate: int = RATE) -> int:
    """Frames of so many samples; the last is filled with silence."""
    return max(1, -(-max(0, -(-samples * TARGET // rate) - FRAME) // HOP) + 1)


def spectra(signal: np.ndarray, rate: int, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and energies of ``frames`` frames of a signal, in chunks of frames: memory doesn't grow with their number.

    Computed in double precision and rounded, so that a signal's values don't depend on what it is computed with.
    """
    logs, energies = np.empty((frames, MELS), np.float32), np.empty(frames)
    for a in range(0, frames, CHUNK // HOP):
        b = min(frames, a + CHUNK // HOP)
        y = resample(signal, rate, TARGET, a * HOP, (b - 1) * HOP + FRAME)
        y = np.pad(y, (0, (b - a - 1) * HOP + FRAME - len(y)))
        f = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        spectrum = np.fft.rfft(f * _WINDOW, axis=1)
        logs[a:b] = np.round(np.log((spectrum.real**2 + spectrum.imag**2) @ _BANDS.T + 1e-6), 4)
        energies[a:b] = np.round((f * f).mean(1), 9)
    return logs, energies


def features(several: list[np.ndarray], rate: int = RATE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each array of samples its log-mel energies (frames, MELS) and frame energies.

    Short arrays are laid out one after the other, with silence between, and computed together.
    """
    period = HOP * rate // gcd(HOP * rate, TARGET)  # input samples that are whole hops
    gap = 4 * HALF * rate // gcd(rate, TARGET) + FRAME * rate // TARGET
    starts, at = [], 0
    for x in several:
        at = -(-at // period) * period
        starts.append(at)
        at += len(x) + gap
    signal = np.zeros(at, np.float32)
    for start, x in zip(starts, several, strict=True):
        signal[start : start + len(x)] = (x.astype(np.float32) - 128) / 128
    counts = [frames_of(len(x), rate) for x in several]
    first = [start * TARGET // rate // HOP for start in starts]
    logs, energies = spectra(signal, rate, first[-1] + counts[-1])
    return [(logs[a : a + n], energies[a : a + n]) for a, n in zip(first, counts, strict=True)]


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames (first, after last) that stay over the low threshold and reach the high one."""
    if not len(energy) or energy.max() <= 0:
        return []
    loud, most = energy >= LOW * energy.max(), HIGH * energy.max()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if energy[a:b].max() >= most]


#: Rows of a document's tensor column: patches of fixed shape with their spans in seconds.
TENSORS = pa.schema([("patch", pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))), ("begin", pa.float64()), ("end", pa.float64())])


def tensor(logs: np.ndarray) -> bytes:
    """An Arrow record batch of the schema ``TENSORS``.

    The last patch is filled with zeros; its span ends with the last frame.
    """
    patches = -(-len(logs) // PATCH)
    padded = np.zeros((patches * PATCH, MELS), np.float32)
    padded[: len(logs)] = logs
    begin = np.arange(patches) * PATCH * HOP / TARGET
    last = (np.minimum(np.arange(1, patches + 1) * PATCH, len(logs)) - 1) * HOP + FRAME
    values = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), PATCH * MELS)
    column = pa.ExtensionArray.from_storage(TENSORS.field("patch").type, values)
    return pa.RecordBatch.from_arrays([column, pa.array(begin), pa.array(last / TARGET)], schema=TENSORS).serialize().to_pybytes()


def read_tensor(raw: bytes, schema: pa.Schema = TENSORS) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(raw), schema)


def tensor_schema(described: DataFrame) -> pa.Schema:
    """The Arrow schema of ``described``'s tensors, with their shape: it is in the column's metadata, also after the table is written and read.

    An error where the column has none.
    """
    held = described.schema["tensor"].metadata.get("arrow_schema")
    if held is None:
        raise ValueError("the tensor column doesn't say its schema")
    return pa.ipc.read_schema(pa.py_buffer(base64.b64decode(held)))


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of the text, null: 0) and media: the text's bytes, filled up, as 8-bit samples in WAV form.

    Payloads are filled with spaces up to a positive multiple of ``UNIT`` bytes; equal rows stay; no documents
    give no rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes, media = [], []
                for text in batch.column("text"):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    sizes.append(len(raw))
                    media.append(wav(raw + bytes([FILL]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and what is computed from the media's bytes: payload, tensor (see ``TENSORS``), spans (seconds).

    The tensor column's metadata hold its Arrow schema (see :func:`tensor_schema`), so that a table of them says its shape itself.
    Media of several rates in one batch, and null media, are an error; media without samples have a frame of silence; equal
    media have equal tensors and spans; no media give no rows; other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 1 << 20):
                payloads, tensors, spans = [], [], []
                read = [unwav(value.as_py()) for value in batch.column("media")]
                rates = {rate for _, rate in read}
                if len(rates) > 1:
                    raise ValueError("one rate is expected")
                got = features([np.frombuffer(payload, np.uint8) for payload, _ in read], *rates)
                for (payload, _), (logs, energy) in zip(read, got, strict=True):
                    payloads.append(payload)
                    tensors.append(tensor(logs))
                    spans.append([{"begin": a * HOP / TARGET, "end": ((b - 1) * HOP + FRAME) / TARGET} for a, b in segments(energy)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), pa.array(payloads, pa.binary()), pa.array(tensors, pa.binary()), pa.array(spans, kind)],
                    ["doc_id", "n_bytes", "media", "payload", "tensor", "spans"],
                )

    kind = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))
    out = media.mapInArrow(work, "doc_id long, n_bytes long, media binary, payload binary, tensor binary, spans array<struct<begin: double, end: double>>")
    return out.withMetadata("tensor", {"arrow_schema": base64.b64encode(TENSORS.serialize().to_pybytes()).decode()})


def summary(raw: bytes, spans: int, schema: pa.Schema = TENSORS) -> str:
    """A line about a stored tensor and the number of its spans: frames, segments, and the mean of each band."""
    batch = read_tensor(raw, schema)
    logs = batch.column("patch").to_numpy_ndarray()
    logs = logs.reshape(-1, logs.shape[-1])
    frames = round((batch.column("end")[-1].as_py() * TARGET - FRAME) / HOP) + 1
    means = " ".join(f"{x:.2f}" for x in logs[:frames].mean(0, dtype=np.float64))
    return f"frames={frames} segments={spans} mel={means}"


def summarise(described: DataFrame) -> DataFrame:
    """``described`` (tensor, spans and any other columns but ``feature``) with feature, a line made from the two, in place of the tensor.

    The tensors' schema is read from the table (:func:`tensor_schema`). A null tensor is an error, null spans count as none; equal rows
    stay; no rows give none.
    """
    schema = tensor_schema(described).serialize().to_pybytes()
    keep = [c for c in described.columns if c not in ("tensor", "spans")]
    rows = described.select(*keep, "tensor", F.coalesce(F.size("spans"), F.lit(0)).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.ipc.read_schema(pa.py_buffer(schema))
        for batch in batches:
            lines = [summary(t.as_py(), n.as_py(), kinds) for t, n in zip(batch.column("tensor"), batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lines, pa.string())], [*keep, "feature"])

    return rows.mapInArrow(work, T.StructType([*(described.schema[c] for c in keep), T.StructField("feature", T.StringType())]))
