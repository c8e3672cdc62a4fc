"""Audio columns: lossless 8-bit wave files, polyphase resampling, overlapped log-mel filterbanks, hysteresis
energy segmentation, and fixed-shape tensors with time spans.

A feature tensor is `FRAMES` x `MELS` unsigned bytes (a quantised log-mel patch of one segment, zero-padded at
the segment's end) and carries its span in seconds; a batch of recordings gives an Arrow table with a column of Arrow's
fixed-shape tensor type. All arithmetic is per recording, so equal recordings have equal features wherever they are
computed.

Null media or text is an empty recording. Repeated rows, and ties of any kind, give equal values, each row its own. Texts
may be of any length; frames go through in blocks. An empty table gives an empty result. `store_texts` keeps all columns
whatever their names; where one is called as the new one, that one's name gets underscores before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, fresh, map_batches, schema_of

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 8
FRAME, HOP, MELS, FRAMES = 256, 128, 20, 16
TENSOR_TYPE = pa.fixed_shape_tensor(pa.uint8(), (FRAMES, MELS))


def payload_of(text: bytes, multiple: int = 64) -> bytes:
    """Text padded with zero bytes to a positive multiple of `multiple` bytes."""
    return text + bytes(-len(text) % multiple or (0 if text else multiple))


def encode_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM wave file that holds the samples as they are."""
    pad = len(samples) & 1
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(samples) + pad), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(samples)), samples, bytes(pad)))


def decode_wave(media: bytes) -> tuple[int, bytes]:
    """Sampling rate and samples of a mono 8-bit PCM wave file, whatever other chunks it has."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("broken wave file")
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in the wave file")


@lru_cache
def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc taps of each phase: row p holds h[p], h[p + up], ..."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hanning(up * taps + 2)[1:-1]
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: each output phase is one short filter over every `down`-th input."""
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    out = np.zeros(n_out, np.float32)
    phases = low_pass(up, down, taps)
    for r in range(min(up, n_out)):
        first, phase = divmod(r * down, up)
        count = -(-(n_out - r) // up)
        acc = np.zeros(count, np.float32)
        for k, h in enumerate(phases[phase]):
            at = first + taps - 1 - k
            part = padded[at : at + down * count : down]
            acc[: len(part)] += h * part
        out[r::up] = acc
    return out


@lru_cache
def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Overlapping triangles, evenly spaced in mel."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache
def hann(frame: int = FRAME) -> np.ndarray:
    return np.hanning(frame).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Decibels of each mel band in overlapped windows, quantised to bytes; frames go through in blocks of 4096."""
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    frames, window, bank = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], hann(), mel_bank(rate)
    out = np.empty((n, MELS), np.uint8)
    for at in range(0, n, 4096):
        spectrum = np.fft.rfft(frames[at : at + 4096] * window, axis=1)
        band = (spectrum.real**2 + spectrum.imag**2) @ bank
        out[at : at + 4096] = np.clip(np.rint((10 * np.log10(band + 1e-7) + 70) * 2), 0, 255)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that start above the high threshold and last until energy falls below the low one."""
    ranked = np.sort(energy)
    low, high = ranked[len(ranked) // 4], ranked[len(ranked) * 3 // 5]
    mark = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS) of the recording's segments and the time span of each."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x - (x.mean(dtype=np.float64).astype(np.float32) if len(x) else 0)), rate * UP / DOWN)
    step = HOP / (rate * UP / DOWN)
    cuts = [(at, min(end, at + FRAMES)) for begin, end in segments(mel.sum(1, dtype=np.int64)) for at in range(begin, end, FRAMES)]
    tensors = np.zeros((len(cuts), FRAMES, MELS), np.uint8)
    for tensor, (at, end) in zip(tensors, cuts, strict=True):
        tensor[: end - at] = mel[at:end]
    return tensors, [(round(at * step, 6), round(end * step, 6)) for at, end in cuts]


def store_texts(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The documents with a last column `media` more: the text's UTF-8 bytes as a wave file. Narrow; null text is empty."""
    (media,) = fresh(docs, "media")
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode_wave(payload_of(text or b"")) for text in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], names=[*batch.schema.names, media])

    return map_batches(docs, run, schema_of(docs, f"`{media}` binary"))


SEGMENTS = pa.schema([("recording", pa.int64()), ("n", pa.int32()), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("tensor", TENSOR_TYPE)])


def segment_table(media: list[bytes | None]) -> pa.Table:
    """Recordings (by place) as fixed-shape tensors with their spans, in order."""
    found = [features(*reversed(decode_wave(m))) if m else (np.zeros((0, FRAMES, MELS), np.uint8), []) for m in media]
    counts = [len(spans) for _, spans in found]
    spans = [s for _, some in found for s in some]
    storage = np.concatenate([np.zeros((0, FRAMES, MELS), np.uint8), *(t for t, _ in found)])
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(storage) if len(spans) else pa.ExtensionArray.from_storage(TENSOR_TYPE, pa.FixedSizeListArray.from_arrays(pa.array([], pa.uint8()), FRAMES * MELS))
    columns = [pa.array(np.repeat(np.arange(len(media)), counts)), pa.array([i for n in counts for i in range(n)], pa.int32()), pa.array([b for b, _ in spans], pa.float64()), pa.array([e for _, e in spans], pa.float64()), tensor]
    return pa.table(columns, schema=SEGMENTS)


def media_features(media: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row per tensor of each recording: its id, n, begin_s, end_s and the tensor's bytes, which `as_tensors` types again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = segment_table(batch.column(1).to_pylist()).combine_chunks()
                tensors = found.column("tensor").combine_chunks().storage.flatten().to_numpy().tobytes()
                size = FRAMES * MELS
                n, begin, end = (found.column(c).combine_chunks() for c in ("n", "begin_s", "end_s"))
                each = pa.array([tensors[i : i + size] for i in range(0, len(tensors), size)], pa.binary())
                ids = batch.column(0).take(found.column("recording").combine_chunks())
                yield pa.RecordBatch.from_arrays([ids, n, begin, end, each], names=["doc_id", "n", "begin_s", "end_s", "tensor"])

    return map_batches(media.select(F.col(id_column).cast("long").alias("doc_id"), media_column), run, "doc_id long, n int, begin_s double, end_s double, tensor binary")


def as_tensors(column: pa.Array | pa.ChunkedArray) -> pa.ExtensionArray:
    """A column of tensor bytes as Arrow's fixed-shape tensor type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.array(np.frombuffer(b"".join(column.to_pylist()), np.uint8))
    return pa.ExtensionArray.from_storage(TENSOR_TYPE, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from media that are stored in the shared folder and read back, and their tensors."""
    stored = Scratch(docs.sparkSession).keep(store_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")).drop("text"), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                media = batch.column(2).to_pylist()
                back = [decode_wave(m)[1] for m in media]
                feature = described(segment_table(media), len(media))
                sha = lambda blobs: pa.array([hashlib.sha256(b).hexdigest() for b in blobs])
                size = lambda blobs: pa.array([len(b) for b in blobs], pa.int64())
                tail = pa.array([zlib.crc32(b[-64:]) for b in back], pa.int64())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size(back), sha(back), tail, size(media), sha(media), pa.array(feature)], names=names)

    return map_batches(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def described(segments_: pa.Table, n: int) -> list[str]:
    """A line on the tensors and spans of each of n recordings."""
    tensors = segments_.column("tensor").combine_chunks().to_numpy_ndarray() if segments_.num_rows else np.zeros((0, FRAMES, MELS), np.uint8)
    spans = list(zip(segments_.column("begin_s").to_pylist(), segments_.column("end_s").to_pylist(), strict=True))
    cut = np.searchsorted(segments_.column("recording").to_numpy(), np.arange(n + 1)).tolist()
    out = []
    for a, b in pairwise(cut):
        own = tensors[a:b]
        out.append(f"segments of {b - a} tensors {hashlib.sha256(np.ascontiguousarray(own).tobytes() + repr(spans[a:b]).encode()).hexdigest()[:32]} mean {float(own.mean()) if b > a else 0:.3f}")
    return out
