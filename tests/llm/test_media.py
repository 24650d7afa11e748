import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import media, queries

DOCS = "doc_id long, text string, media string, payload string, feature int"


@pytest.mark.parametrize("rate,target", [(8000, 4000), (8000, 6000), (8000, 16000), (6000, 8000), (8000, 8000)])
def test_resampling_equals_filtering_the_stuffed_signal(rate, target):
    x = np.random.default_rng(1).normal(size=700)
    g = np.gcd(rate, target)
    up, down = target // g, rate // g
    h, stuffed = media.low_pass(up, down), np.zeros(len(x) * up)
    stuffed[::up] = x
    want = np.convolve(stuffed, h)[len(h) // 2 :][: len(stuffed)][::down]
    assert np.allclose(media.resample(x, rate, target), want)
    assert np.allclose(media.resample(x, rate, target, 100, 200), want[100:200])


def test_features_dont_depend_on_company_or_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    several = [rng.integers(0, 256, n).astype(np.uint8) for n in (192, 384, 50_000, 3264, 9600)]
    together = media.features(several)
    monkeypatch.setattr(media, "CHUNK", 1 << 10)
    for x, (logs, energy) in zip(several, together, strict=True):
        one = media.features([x])[0]
        assert np.array_equal(one[0], logs) and np.array_equal(one[1], energy) and len(logs) == media.frames_of(len(x))


def test_a_tone_is_in_its_band_and_segment():
    t = np.arange(16000) / media.RATE
    x = 128 + 100 * np.sin(2 * np.pi * 1000 * t) * ((t > 0.5) & (t < 1))
    logs, energy = media.features([np.round(x).astype(np.uint8)])[0]
    ((a, b),) = media.segments(energy)
    assert abs(a * media.HOP / media.TARGET - 0.5) < 0.07 and abs(b * media.HOP / media.TARGET - 1) < 0.07
    band = logs[(a + b) // 2].argmax()
    f = np.fft.rfftfreq(media.FRAME, 1 / media.TARGET)
    assert media.mel_bands()[:, abs(f - 1000).argmin()].argmax() == band


def test_log_mel_equals_a_plain_transform():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, 4000).astype(np.uint8)
    logs, energy = media.features([x])[0]
    y = media.resample(np.pad((x.astype(np.float64) - 128) / 128, (0, 2 * media.FRAME)), media.RATE, media.TARGET)  # silence follows
    n, m = media.FRAME, media.mel_bands()
    at = np.arange(n)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), at) / n)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * at / (n - 1))
    for k in range(len(logs)):
        frame = y[k * media.HOP : k * media.HOP + n]
        power = np.abs(dft @ (frame * hann)) ** 2
        bands = [sum(m[b, i] * power[i] for i in range(n // 2 + 1)) for b in range(media.MELS)]
        assert logs[k] == pytest.approx(np.log(np.array(bands) + 1e-6), abs=2e-3)
        assert energy[k] == pytest.approx(np.mean(frame**2), abs=1e-5)


def test_patches_have_their_spans_and_the_line_its_means():
    for frames in (1, media.PATCH, media.PATCH + 1, 100):
        logs = np.random.default_rng(frames).normal(size=(frames, media.MELS)).astype(np.float32)
        raw = media.tensor(logs)
        got = media.read_tensor(raw)
        patches = got.column("patch").to_numpy_ndarray()
        assert np.array_equal(patches.reshape(-1, media.MELS)[:frames], logs) and not patches.reshape(-1, media.MELS)[frames:].any()
        for k in range(got.num_rows):
            last = min((k + 1) * media.PATCH, frames) - 1
            assert got.column("begin")[k].as_py() == pytest.approx(k * media.PATCH * media.HOP / media.TARGET)
            assert got.column("end")[k].as_py() == pytest.approx((last * media.HOP + media.FRAME) / media.TARGET)
        means = " ".join(f"{x:.2f}" for x in logs.astype(np.float64).mean(0))
        assert media.summary(raw, 3) == f"frames={frames} segments=3 mel={means}"


def test_constant_signals():
    silent, steady = np.full(5000, 128, np.uint8), np.full(5000, 228, np.uint8)
    (logs, energy), (_, loud) = media.features([silent, steady])
    assert not energy.any() and media.segments(energy) == [] and len(set(logs.ravel().tolist())) == 1
    ((a, b),) = media.segments(loud)
    assert a == 0 and b >= len(loud) - 2


def test_hysteresis():
    assert media.segments(np.array([0, 1, 3, 9, 3, 3, 1, 3, 3, 0, 8, 10.0])) == [(2, 6), (10, 12)]
    assert media.segments(np.array([0, 3, 9, 3, 4, 1, 10.0])) == [(1, 5), (6, 7)]
    assert media.segments(np.zeros(4)) == [] and media.segments(np.zeros(0)) == []


def test_round_trip(spark, tmp_path):
    texts = ["", None, "a" * 192, "b" * 193, "é" * 500, "xyz " * 30_000, "b" * 193]
    df = spark.createDataFrame([(i, t, "m", "p", 1) for i, t in enumerate(texts)] + [(None, "n", None, None, None)], DOCS)
    got = {r.doc_id: r for r in media.describe(media.encode(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r = got[i]
        assert r.n_bytes == len(raw) and bytes(r.payload) == raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert media.unwav(bytes(r.media)) == (bytes(r.payload), media.RATE)
        tensors = media.read_tensor(bytes(r.tensor))
        assert tensors.column("patch").type.shape == [media.PATCH, media.MELS]
        assert tensors.num_rows == -(-media.frames_of(len(r.payload)) // media.PATCH)
    stored = tmp_path / "described"
    media.describe(media.encode(df)).write.parquet(str(stored))
    again = spark.read.parquet(str(stored))
    assert media.tensor_schema(again) == media.TENSORS and media.tensor_schema(again).field("patch").type.shape == [media.PATCH, media.MELS]
    kept = again.select("doc_id", "tensor", F.when(F.col("doc_id") > 0, F.col("spans")).alias("spans"))
    assert {r.doc_id: r.feature.partition(" mel")[2] for r in media.summarise(kept).collect()} == {i: media.summary(bytes(r.tensor), 0).partition(" mel")[2] for i, r in got.items()}
    with pytest.raises(ValueError, match="schema"):
        media.summarise(again.withMetadata("tensor", {}))
    lines = {r.doc_id: r for r in media.summarise(media.describe(media.encode(df)).select("doc_id", "tensor", "spans")).collect()}
    assert all(lines[i].feature == media.summary(bytes(got[i].tensor), len(got[i].spans)) for i in got)
    assert lines[3].feature == lines[6].feature and hashlib.sha256(got[3].media).digest() == hashlib.sha256(got[6].media).digest()
    assert media.describe(media.encode(df.limit(0))).count() == 0


def test_payloads_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.MEDIA_PAYLOADS_SQL)
    got = queries.media_payloads(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
