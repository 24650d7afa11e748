import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.functions import linalg
from lexdrift.operators import embedding, shift, similarity, tiles, tokens, topics

ENTRIES = "slice string, i int, j int, ppmi double"
VOCAB = "slice string, word string, rank int"


def tables(spark, **matrices):
    cells = [(s, int(i), int(j), float(m[i, j])) for s, m in matrices.items() for i, j in zip(*np.nonzero(m), strict=True)]
    words = [(s, f"w{i}", i) for s, m in matrices.items() for i in range(len(m))]
    return spark.createDataFrame(cells, ENTRIES), spark.createDataFrame(words, VOCAB)


def random(n, seed, share=0.2):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < share, rng.random((n, n)) * 5, 0)
    m[:, n - 3 :] = 0
    m[n - 20 : n - 18] = 0
    return m


def vectors(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.slice, {})[r["rank"]] = r.vector
    return {s: np.array([v[i] for i in range(len(v))]) for s, v in out.items()}


def test_embeddings_in_tiles_equal_those_of_whole_slices(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    mats = {"a": random(40, 1), "b": random(55, 2), "none": np.zeros((5, 5))}
    e, v = tables(spark, **mats)
    for k in (200, 6):
        got, failed = tiles.embed(e, v, k)
        assert failed.count() == 0
        got, want = vectors(got), vectors(embedding.factorise(e, v, k))
        for s, m in mats.items():
            values = np.linalg.svd(m, compute_uv=False)[: got[s].shape[1]]
            assert got[s].shape == want[s].shape == (len(m), min(k, len(m) - 1))
            assert np.abs((got[s] ** 2).sum(0) - values).max() < 1e-6 and np.abs(got[s] - want[s]).max() < 1e-3
    with pytest.raises(ValueError):
        tiles.embed(e, v, 0)
    with pytest.raises(ValueError):
        embedding.factorise(e, v, 0)


def test_tiles_hold_all_entries_and_no_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    m = random(50, 3, 0.9)
    e, _ = tables(spark, a=m)
    back = np.zeros_like(m)
    for r in tiles.tiles(e).collect():
        i, j = (np.frombuffer(x, "<i4") for x in (r.i, r.j))
        assert len(i) <= 256 and r.rows == i.max() + 1 and r.columns == j.max() + 1
        back[r.rb * 16 + i, r.cb * 16 + j] = np.frombuffer(r.v, "<f8")
    assert (back == m).all()


def test_a_slice_that_does_not_settle_has_a_reason_and_the_others_are_whole(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 32)
    low = np.outer(np.arange(40) % 5, np.arange(40) % 3).astype(float)
    mats = {"quick": low, "slow": random(60, 4, 0.5)}
    e, v = tables(spark, **mats)
    got, failed = tiles.embed(e, v, 4, rounds=1)
    assert set(vectors(got)) == {"quick"}
    assert [(r.slice, r.reason.startswith("singular values still move by")) for r in failed.collect()] == [("slow", True)]


@pytest.mark.parametrize("k", [3])
def test_factors_in_tiles_equal_those_of_whole_slices(spark, monkeypatch, k):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    mats = {"a": random(30, 5, 0.4), "one": np.outer(np.arange(1, 21), np.arange(1, 21)) / 50, "few": np.ones((2, 2)), "below": -np.eye(6), "none": np.zeros((4, 4))}
    e, v = tables(spark, **mats)
    rows, ends, failed = tiles.topic_factors(e, v, k, 12)
    whole, unfit = topics.attempted(e, v, k, 12)
    assert {r.slice for r in failed.collect()} == {r.slice for r in unfit.collect()} == {"few", "below"}
    assert {r.reason for r in unfit.collect()} == {"3 topics need as many words; few has 2", "negative values in the matrix"}
    ends = {r.slice: r for r in ends.collect()}
    assert ends["one"].rounds < ends["a"].rounds == 12  # each slice ends by itself

    def matrices(df):
        out = {s: (np.zeros((len(m), k)), np.zeros((k, len(m)))) for s, m in mats.items()}
        for r in df.collect():
            out[r.slice][0][r["rank"], r.topic_id], out[r.slice][1][r.topic_id, r["rank"]] = r.focus, r.weight
        return out

    a, b = matrices(rows), matrices(whole)
    assert rows.select("slice").distinct().count() == 2 and rows.count() == k * (30 + 20)
    for s in ("a", "one"):
        left, want = (np.linalg.norm(mats[s] - w @ h) for w, h in (a[s], b[s]))
        assert left == pytest.approx(ends[s].residual, abs=1e-5) and left <= 1.01 * want + 1e-3
        assert (a[s][0] >= 0).all() and (a[s][1] >= 0).all()
    with pytest.raises(ValueError):
        tiles.topic_factors(e, v, 0)


def test_whole_slices_that_fail_are_rows(spark):
    rng = np.random.default_rng(7)
    n = 1300
    i = np.repeat(np.arange(n), 5)
    large = [("large", int(a), int(b), float(x)) for a, b, x in zip(i, rng.integers(0, n, len(i)), rng.random(len(i)) + 0.1, strict=True)]
    large = list({(s, a, b): (s, a, b, x) for s, a, b, x in large}.values())
    small = [("small", a, b, 1.0 + a + b) for a in range(4) for b in range(4)]
    e = spark.createDataFrame(large + small, ENTRIES)
    v = spark.createDataFrame([("large", f"w{k}", k) for k in range(n)] + [("small", f"w{k}", k) for k in range(4)], VOCAB)
    rows, failed = embedding.attempted(e, v, 3, rounds=1)
    assert [(r.slice, r.stage, "still move" in r.reason) for r in failed.collect()] == [("large", "embedding", True)]
    assert rows.groupBy("slice").count().collect() == [("small", 4)]
    with pytest.raises(Exception, match="still move"):
        embedding._embedded(e, v, 3, strict=True, rounds=1).count()


def test_training_goes_on_without_slices_that_fail(spark):
    lines = [("a", k, 0, "one two three four five six " * 4) for k in range(30)] + [("b", k, 0, "x y") for k in range(3)]
    model = shift.train(spark.createDataFrame(lines, "slice string, doc_id long, line_no int, line string"), components=3)
    assert {tuple(r) for r in model.skipped.collect()} == {("b", "vocabulary", "no vocabulary")}
    assert {r.slice for r in model.embeddings.collect()} == {"a"}


def test_products_in_bounded_memory():
    rng = np.random.default_rng(2)
    n, width = 900, 400
    i, j, v = rng.integers(0, n, 300_000), rng.integers(0, n, 300_000), rng.random(300_000)
    m, x = linalg.Sparse(i, j, v, (n, n)), rng.random((n, width))
    tracemalloc.start()
    got = m.dot(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all products at once are 960 MB
    plain = np.zeros((n, n))
    np.add.at(plain, (i, j), v)
    assert np.allclose(got, plain @ x) and np.allclose(linalg.product(i, j, v, x, n), plain @ x)
    assert linalg.product(np.zeros(0, int), np.zeros(0, int), np.zeros(0), x, 3).tolist() == np.zeros((3, width)).tolist()


def test_what_dimensions_leave(spark):
    """All-zero and smallest directions are told from the largest."""
    m = random(30, 8, 0.5)
    e, v = tables(spark, s=m)
    u, s, _ = np.linalg.svd(m)
    for pick, want in ((slice(0, 5), s[5]), (slice(20, 25), s[0]), (slice(0, 0), s[0])):
        x = u[:, pick] * np.sqrt(s[pick]) if pick.stop else np.zeros((30, 2))
        rows = spark.createDataFrame([("s", k, [float(y) for y in row]) for k, row in enumerate(x)], "slice string, rank int, vector array<double>")
        assert embedding.missed(e, rows, 400).first().missed == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("block", [similarity.BLOCK, 7])
def test_nearest_words_are_those_asked_for_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (40, 3)).astype(float)  # many ties
    x[5] = 0
    rows = [("s", f"w{k}", k, v.tolist()) for k, v in enumerate(x)] + [("t", "w0", 0, [1.0, 0.0, 0.0]), ("t", "w9", 900, [1.0, 1.0, 0.0]), ("u", "alone", 3, [1.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "slice string, word string, rank int, vector array<double>")
    words = [f"w{k}" for k in range(40)] + ["alone"]
    for n in (4, 100):
        got = {(r.slice, r.query, r.place): r for r in similarity.nearest(e, n).collect()}
        scored = similarity.most_similar(e, words, 0).withColumn("similarity", F.round("similarity", 12)).where("similarity > -1").join(e.select("slice", "word", "rank"), ["slice", "word"])
        want = {(r.slice, r.query, r.place): r for r in similarity.top(scored, ["slice", "query"], n).collect()}
        assert {k: (r.word, round(r.similarity, 9)) for k, r in got.items()} == {k: (r.word, round(r.similarity, 9)) for k, r in want.items()}
    assert not [k for k in got if k[1] in ("w5", "alone") and k[0] != "t"]
    assert similarity.nearest(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        similarity.nearest(e, 0)


def test_no_vectors_are_shuffled_for_nearest_words(spark, monkeypatch):
    """Blocks were sent to each other block's task: as many times the vectors on disk as there are blocks."""
    monkeypatch.setattr(similarity, "BLOCK", 8)
    rows = [("s", f"w{k}", k, [float(k % 7), float(k % 5), 1.0 + k]) for k in range(64)]
    e = spark.createDataFrame(rows, "slice string, word string, rank int, vector array<double>")
    plan = similarity.nearest(e, 2)._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("\n") if "Exchange" in x]
    assert "CartesianProduct" in plan and sent and not [x for x in sent if "mine" in x or "units" in x]
    assert similarity.nearest(e, 2).count() == 128


def test_lines_are_needed_for_words(spark):
    assert tokens.words(spark.createDataFrame([("a", None)], "slice string, line string")).count() == 0
