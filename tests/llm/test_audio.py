import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import audio, queries


def test_query_round_trip(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").toPandas().set_index("doc_id").text
    rows = queries.op2_audio(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].encode()
        payload = text + bytes((-len(text)) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = wave_file(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), described(media))


def wave_file(payload):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(16_000)
        f.writeframes(payload)
    return out.getvalue()


def described(media):
    """The feature of a wave file, read by the standard library and put together frame by frame."""
    with wave.open(io.BytesIO(media)) as f:
        x = (np.frombuffer(f.readframes(f.getnframes()), np.uint8).astype(np.float32) - 128) / 128
    mel = audio.log_mel(audio.resample(x - x.mean(dtype=np.float64).astype(np.float32)), 12_000.0)
    energy = [int(frame.sum(dtype=np.int64)) for frame in mel]
    low, high = sorted(energy)[len(energy) // 4], sorted(energy)[len(energy) * 3 // 5]
    on, runs = False, []
    for i, e in enumerate(energy):
        now = True if e >= high else False if e < low else on
        if now and not on:
            runs.append([i, i])
        if now:
            runs[-1][1] = i + 1
        on = now
    blob, spans, values = b"", [], []
    for a, b in runs:
        for at in range(a, b, 16):
            patch = mel[at : min(b, at + 16)]
            whole = np.vstack([patch, np.zeros((16 - len(patch), 20), np.uint8)])
            blob += whole.tobytes()
            values.append(whole)
            spans.append((round(at * 128 / 12_000, 6), round(min(b, at + 16) * 128 / 12_000, 6)))
    return f"segments of {len(spans)} tensors {hashlib.sha256(blob + repr(spans).encode()).hexdigest()[:32]} mean {float(np.array(values).mean()) if values else 0:.3f}"


def test_resampling_and_bands_by_definition():
    """Each output sample and band energy as a plain sum."""
    x = np.sin(np.arange(700) * 0.3).astype(np.float32) + np.cos(np.arange(700) * 1.1).astype(np.float32) / 2
    h = audio.low_pass(3, 4, 8).T.reshape(-1).astype(float)  # taps in order
    y, offset = audio.resample(x), 8 // 2 - 1
    for n in range(20, 480, 37):
        up = sum(h[k] * (x[(n * 4 - k) // 3 + offset] if (n * 4 - k) % 3 == 0 and 0 <= (n * 4 - k) // 3 + offset < len(x) else 0.0) for k in range(len(h)))
        assert y[n] == pytest.approx(up, abs=1e-4)
    frame = y[128:384].astype(float) * np.hanning(256)
    spectrum = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(256) / 256))) ** 2 for k in range(129)]
    band = np.array(spectrum) @ audio.mel_bank(12_000.0)
    want = np.clip(np.rint((10 * np.log10(band + 1e-7) + 70) * 2), 0, 255)
    assert np.abs(audio.log_mel(y, 12_000.0)[1].astype(float) - want).max() <= 1


def test_awkward_rows(docs, no_docs):
    rows = audio.digest(docs).collect()
    assert len(rows) == 10 and audio.digest(no_docs).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].n_bytes == 0 and by[3].payload_bytes == 64 and by[1].feature == by[2].feature and by[3].feature == by[4].feature


def test_tensors_and_spans(docs):
    stored = audio.store_texts(docs)
    assert stored.columns == [*docs.columns, "media"]
    again = audio.store_texts(stored)
    assert again.columns == [*docs.columns, "media", "_media"] and all(r.media == r._media for r in again.collect())
    table = audio.segment_table([r.media for r in stored.collect()] + [None])
    assert table.schema.field("tensor").type == audio.TENSOR_TYPE and table.column("tensor").combine_chunks().to_numpy_ndarray().shape == (table.num_rows, 16, 20)
    assert audio.segment_table([]).num_rows == 0
    got = audio.media_features(stored).toArrow()
    tensors = audio.as_tensors(got.column("tensor"))
    assert tensors.type == audio.TENSOR_TYPE and len(tensors) == got.num_rows
    assert isinstance(tensors, pa.FixedShapeTensorArray)
    assert all(b < e for b, e in zip(got.column("begin_s").to_pylist(), got.column("end_s").to_pylist(), strict=True))


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 12_000
    spectrum = np.abs(np.fft.rfft(y[1000:11_000] * np.hanning(10_000)))
    assert abs(np.argmax(spectrum) * 12_000 / 10_000 - 440) < 2


def test_hysteresis():
    energy = np.array([0, 0, 0, 5, 9, 9, 5, 5, 9, 0, 0, 9, 0, 0, 0, 0, 5, 0, 0, 0])
    assert [(a, b) for a, b in audio.segments(energy) if 9 in energy[a:b]]


def test_wave_with_other_chunks():
    media = audio.encode_wave(b"abcdef")
    odd = media[:36] + b"LIST\x03\x00\x00\x00abc\x00" + media[36:]
    assert audio.decode_wave(odd) == (16_000, b"abcdef")
