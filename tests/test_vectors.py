import itertools

import numpy as np
import pytest

from lexdrift.functions import linalg
from lexdrift.operators import alignment, embedding, shift, similarity, topics, vocabulary
from lexdrift.sources import storage

VECTORS = "slice string, word string, rank int, vector array<double>"
PAIR = "source string, target string"


def table(spark, **slices):
    return spark.createDataFrame([(s, w, i, [float(x) for x in v]) for s, words in slices.items() for i, (w, v) in enumerate(words.items())], VECTORS)


def pair(spark, a="a", b="b"):
    return spark.createDataFrame([(a, b)], PAIR)


def test_distance(spark):
    e = table(spark, s={"cat": [1, 0], "dog": [0.8, 0.2], "fish": [0, 1], "zero": [0, 0], "anti": [-1, 0]})
    asked = [("cat", "cat"), ("cat", "fish"), ("cat", "none"), ("cat", "zero"), ("cat", "dog"), ("cat", "anti")]
    got = {(r.w1, r.w2): r.distance for r in similarity.distance(e, asked).collect()}
    assert got[asked[0]] == pytest.approx(0) and got[asked[1]] == 1 and got[asked[2]] is None and got[asked[3]] is None
    assert got[asked[4]] == pytest.approx(1 - 0.970143, abs=1e-6) and got[asked[5]] == 1


def test_most_similar(spark):
    rng = np.random.default_rng(0)
    words = {f"w{i}": rng.normal(size=4) for i in range(30)} | {"zero": np.zeros(4), "minus": -np.eye(4)[0], "plus": np.eye(4)[0]}
    e = table(spark, s=words, t={"w0": [1, 0, 0, 0], "other": [1, 1, 0, 0]})
    unit = {w: v / max(np.linalg.norm(v), 1e-10) for w, v in words.items()}
    got = [(r.word, r.similarity) for r in similarity.most_similar(e, ["w0"], 5).where("slice = 's'").orderBy("place").collect()]
    want = sorted(((w, float(unit["w0"] @ v)) for w, v in unit.items() if w != "w0"), key=lambda x: -x[1])[:5]
    assert [w for w, _ in got] == [w for w, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    assert similarity.most_similar(e, ["zero", "none"], 5).count() == 0
    assert "minus" not in {r.word for r in similarity.most_similar(e, ["plus"], 0).collect()}
    assert similarity.most_similar(e, ["plus"], 0).count() == len(words) - 2


def test_analogy_and_lookup(spark):
    e = table(spark, s={"king": [1, 1, 0], "man": [0, 1, 0], "woman": [0, 0, 1], "queen": [1, 0, 1], "prince": [0.8, 0.8, 0], "ab": [-1, 0, 1]})
    got = [(r.word, round(r.similarity, 6)) for r in similarity.analogy(e, ["king", "man"], "woman").orderBy("place").collect()]
    assert got == [("queen", 0.0), ("prince", -0.5)] or got == [("queen", -0.0), ("prince", round(-0.8 / np.sqrt(2 * 1.28), 6))]
    assert similarity.analogy(e, ["king"], "man") is None
    assert similarity.analogy(e, ["king", "none"], "man").count() == 0
    assert {r.word: r.vector for r in similarity.lookup(e, ["king", "none"]).collect()} == {"king": [1, 1, 0], "none": None}


def test_neighbours_in_two_slices(spark):
    e = table(spark, a={"x": [1, 0], "p": [1, 0.1], "q": [1, 0.2], "r": [0, 1]}, b={"x": [1, 0], "p": [1, 0.1], "q": [0, 1], "r": [1, 0.2]})
    r = similarity.neighbour_overlap(e, "x", "a", "b", 2).first()
    assert (r.shared, r.lost, r.gained, r.jaccard) == (["p"], ["q"], ["r"], pytest.approx(1 / 3))


def rotated(spark, n=12, d=4, seed=1):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    a = rng.normal(size=(n, d))
    words = [f"w{i:02}" for i in range(n)]
    return table(spark, a=dict(zip(words, a, strict=True)), b=dict(zip(words, a @ q, strict=True))), q, a


def test_rotation_is_found_and_keeps_lengths(spark, tmp_path):
    e, q, a = rotated(spark)
    fitted, m = alignment.fit(e, pair(spark))
    r = np.array(fitted.first()["columns"]).T
    assert np.allclose(r, q) and np.allclose(r @ r.T, np.eye(4))
    m = m.first()
    assert m.num_anchors == 12 and m.average_cosine == pytest.approx(1) and m.alignment_error == pytest.approx(12) and m.residual_norm == pytest.approx(0, abs=1e-6)
    turned = {x.word: x.vector for x in alignment.transform(e, fitted).collect()}
    assert np.allclose([np.linalg.norm(v) for _, v in sorted(turned.items())], np.linalg.norm(a, axis=1))
    assert all(x.similarity == pytest.approx(1) for x in alignment.stability(e, fitted).collect())
    storage.save_alignment(fitted, alignment.anchors(e, pair(spark)), f"file://{tmp_path}/al")
    again, anchors = storage.load_alignment(spark, f"file://{tmp_path}/al")
    assert np.allclose(again.first()["columns"], fitted.first()["columns"]) and anchors.count() == 12


def test_residual_identity(spark):
    rng = np.random.default_rng(5)
    e = table(spark, a={f"w{i}": rng.normal(size=3) for i in range(20)}, b={f"w{i}": rng.normal(size=3) for i in range(20)})
    m = alignment.fit(e, pair(spark))[1].first()
    assert m.alignment_error == pytest.approx(m.num_anchors * m.average_cosine)
    assert m.residual_norm == pytest.approx(np.sqrt(2 * m.num_anchors - 2 * m.alignment_error))


def test_anchors_windows_and_errors(spark):
    words = {"the": [1, 0], "is": [0, 1], "king": [1, 1], "queen": [1, -1], "rare": [2, 1]}
    e = table(spark, a=words, b=words, c={"x": [1, 0]}, z={"the": [0, 0], "is": [0, 0]})
    assert [r.word for r in alignment.common_words(e, pair(spark), 2, 4).orderBy("word").collect()] == ["king", "queen"]
    assert alignment.common_words(e, pair(spark), -2, None).count() == 2 and alignment.common_words(e, pair(spark), None, -1).count() == 4
    assert alignment.anchors(e, pair(spark), words=["king", "king", "none"]).count() == 1
    with pytest.raises(ValueError, match="No common words"):
        alignment.fit(e, pair(spark, "a", "c"))
    with pytest.raises(ValueError, match="No valid anchor"):
        alignment.fit(e, pair(spark, "a", "z"))


def test_shift_workflows(spark):
    rng = np.random.default_rng(2)
    base = {f"w{i}": rng.normal(size=5) for i in range(30)}
    moved = base | {"w7": -base["w7"]}
    e = table(spark, **{"1950-1974": base, "1975-1999": base, "2000-2024": moved})
    rows = shift.consecutive_shifts(e)
    top = {r.label: (r.word, r.year) for r in shift.top_shifts(rows, 1).collect()}
    assert top["1975-1999->2000-2024"] == ("w7", 2000) and len(top) == 2
    assert {(r.label, r.cumulative_shift > 1) for r in shift.cumulative_shifts(e, ["w7"]).collect()} == {("1950-1974->1975-1999", False), ("1950-1974->2000-2024", True)}
    assert shift.stable_words(e, "1975-1999", "2000-2024", 1).first().word == "w7"


def test_training_and_storage(spark, tmp_path):
    lines = ["the cat chased the mouse around the garden", "the dog chased the cat around the garden", "king queen royal court palace"] * 15
    rows = [(s, i, 0, x) for s in ("1975-1999", "2000-2024") for i, x in enumerate(lines)] + [("empty", 0, 0, "a b")]
    model = shift.train(spark.createDataFrame(rows, "slice string, doc_id long, line_no int, line string"), 4)
    got = model.embeddings.collect()
    assert {len(r.vector) for r in got} == {4} and {r.slice for r in got} == {"1975-1999", "2000-2024"}
    assert [r.slice for r in model.skipped.collect()] == ["empty"]
    n = model.vocabulary.where("slice = '1975-1999'").count()
    dense = embedding.dense(model.entries, "1975-1999", n)
    u, s, _ = np.linalg.svd(dense)
    vectors = np.array([r.vector for r in sorted((r for r in got if r.slice == "1975-1999"), key=lambda r: r["rank"])])
    assert np.allclose(vectors.T @ vectors, np.diag(s[:4]), atol=1e-8) and np.allclose(vectors @ vectors.T, (u[:, :4] * s[:4]) @ u[:, :4].T, atol=1e-6)
    path = f"file://{tmp_path}/model"
    storage.save_model(model, path)
    again = storage.load_model(spark, path)
    assert again.params == model.params and [r.slice for r in storage.slices_of(again).collect()] == ["1975-1999", "2000-2024"]
    assert sorted((r.slice, r.word, tuple(r.vector)) for r in again.embeddings.collect()) == sorted((r.slice, r.word, tuple(r.vector)) for r in got)
    with pytest.raises(ValueError):
        storage.load_model(spark, f"file://{tmp_path}/none")
    (tmp_path / "part" / "vocabulary").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        storage.load_model(spark, f"file://{tmp_path}/part")
    with pytest.raises(ValueError):
        shift.train(spark.createDataFrame([], "slice string, doc_id long, line_no int, line string"))


def test_records_and_period_files(spark, tmp_path):
    rows = [("1999-05-01", "Later  text", "late"), ("1980", "Early", "early"), ("2001", None, "new ")]
    df = spark.createDataFrame(rows, "date string, transcript string, lemmatized string")
    storage.write_periods(df, f"file://{tmp_path}/p")
    got = storage.read_periods(spark, f"file://{tmp_path}/p").collect()
    assert sorted((r.slice, r.line) for r in got) == [("1975-1999", "early"), ("1975-1999", "late"), ("2000-2024", "new")]
    storage.write_records(df, f"file://{tmp_path}/j")
    assert storage.read_records(spark, f"file://{tmp_path}/j").count() == 3


def test_sparse_decomposition_equals_dense(monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.random((60, 60)) * (rng.random((60, 60)) < 0.2)
    i, j = np.nonzero(m)
    s = linalg.Sparse(i, j, m[i, j], m.shape)
    assert np.array_equal(s.dense(), m)
    u, values, vt = linalg.truncated_svd(s, 5)
    monkeypatch.setattr(linalg, "DENSE", 10)
    u2, values2, vt2 = linalg.truncated_svd(s, 5)
    assert np.allclose(values, values2) and np.allclose(u, u2, atol=1e-4) and np.allclose(vt, vt2, atol=1e-4)


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), repeat=2):
        c = rng.integers(0, 9, (n, m)).astype(float)
        got = linalg.assignment(c)
        turned = c if n <= m else c.T
        best = min(sum(turned[k, p[k]] for k in range(len(turned))) for p in itertools.permutations(range(turned.shape[1]), len(turned)))
        assert len(got) == min(n, m) and sum(c[a, b] for a, b in got) == pytest.approx(best)


def block_entries(spark):
    m = np.zeros((5, 5))
    m[:2, :2], m[2:4, 2:4], m[4, 4] = 1.0, 0.8, 0.5
    rows = [("s", int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)]
    vocab = [("s", w, i) for i, w in enumerate(["king", "queen", "dog", "cat", "computer"])]
    return spark.createDataFrame(rows, "slice string, i int, j int, ppmi double"), spark.createDataFrame(vocab, "slice string, word string, rank int"), m


def test_topics_of_blocks(spark):
    entries, vocab, m = block_entries(spark)
    rows = topics.factors(entries, vocab, 3).collect()
    w, h = np.zeros((5, 3)), np.zeros((3, 5))
    for r in rows:
        w[r["rank"], r.topic_id], h[r.topic_id, r["rank"]] = r.focus, r.weight
    assert np.allclose(w @ h, m, atol=1e-3) and (w >= 0).all() and (h >= 0).all()
    weights = topics.distributions(spark.createDataFrame([(r.slice, r.topic_id, r.word, r.weight) for r in rows], "slice string, topic_id int, word string, weight double"))
    assert all(r["sum(weight)"] == pytest.approx(1) for r in weights.groupBy("topic_id").sum("weight").collect())
    tops = {}
    for r in topics.top_words(weights, 2).collect():
        tops.setdefault(r.topic_id, set()).add(r.word)
    assert {"king", "queen"} in tops.values() and {"dog", "cat"} in tops.values()
    docs = spark.createDataFrame([("s", 1, "king", 0.5), ("s", 1, "queen", 0.5)], "slice string, doc_id long, word string, weight double")
    (share,) = topics.document_topics(docs, weights).collect()
    assert share.share == pytest.approx(1) and tops[share.topic_id] == {"king", "queen"}
    twin = weights.unionByName(weights.selectExpr("'t' slice", "topic_id", "word", "weight"))
    matched = topics.match(topics.similarities(twin, pair(spark, "s", "t"))).collect()
    assert all(r.source_topic == r.target_topic and r.similarity == pytest.approx(1) for r in matched) and len(matched) == 3
    with pytest.raises(Exception, match="topics need"):
        topics.factors(entries, vocab, 6).collect()
    with pytest.raises(Exception, match="negative"):
        topics.factors(entries.selectExpr("slice", "i", "j", "-ppmi ppmi"), vocab, 2).collect()


def test_union_projection_and_cosine(spark):
    rows = [("a", 0, "cat", 0.6), ("a", 0, "dog", 0.4), ("b", 0, "dog", 0.3), ("b", 0, "bird", 0.7), ("b", 1, "none", 0.0)]
    w = spark.createDataFrame(rows, "slice string, topic_id int, word string, weight double")
    got = {r.word: (r.w1, r.w2) for r in topics.union_projection(w, ("a", 0), ("b", 0)).collect()}
    assert got == {"cat": (0.6, 0.0), "dog": (0.4, 0.3), "bird": (0.0, 0.7)}
    s = {r.target_topic: r.similarity for r in topics.similarities(w, pair(spark)).collect()}
    assert s[0] == pytest.approx(0.218507, abs=1e-6) and s[1] == 0


def test_chains_and_evolution(spark):
    m = spark.createDataFrame([("1", "2", 0, 1), ("1", "2", 1, 0), ("2", "3", 1, 2), ("2", "3", 5, 5)], "source string, target string, source_topic int, target_topic int")
    first = spark.createDataFrame([("1", 0), ("1", 1), ("1", 2)], "slice string, topic_id int")
    got = sorted(tuple(r) for r in topics.chains(m, first).collect())
    assert got == [("1", 0, 0), ("1", 1, 1), ("1", 2, 2), ("2", 0, 1), ("2", 1, 0), ("3", 2, 0)]


def test_common_components(spark):
    v = spark.createDataFrame([("a", f"w{i}", i, 9, 90) for i in range(9)] + [("b", f"w{i}", i, 9, 90) for i in range(4)], "slice string, word string, rank int, n long, total long")
    assert embedding.common_components(v, 300) == 3 and embedding.common_components(v, 2) == 2
    assert vocabulary.THRESHOLD == 1e-4


def test_models_of_periods_and_alignments_are_found(spark, tmp_path):
    lines = ["the cat chased the mouse around the garden", "the dog chased the cat around the garden"] * 10
    base = f"file://{tmp_path}/models"
    for period in ("1975-1999", "0950-0974", "2000-2024"):
        corpus = spark.createDataFrame([(period, i, 0, x) for i, x in enumerate(lines)] + [("empty", 1, 0, "a b")], "slice string, doc_id long, line_no int, line string")
        storage.save_model(shift.train(corpus, 3), f"{base}/{period}")
    (tmp_path / "models" / "notes").mkdir()
    assert storage.period_models(spark, base) == ["0950-0974", "1975-1999", "2000-2024"]
    model = storage.load_models(spark, base)
    assert [r.slice for r in storage.slices_of(model).collect()] == ["0950-0974", "1975-1999", "2000-2024"]
    assert [tuple(r) for r in model.skipped.distinct().collect()] == [("empty", "vocabulary", "no vocabulary")]
    fitted, _ = alignment.fit(model.embeddings, spark.createDataFrame([("0950-0974", "2000-2024")], "source string, target string"), 0, 50)
    path = f"file://{tmp_path}/aligned"
    storage.save_alignment(fitted, fitted, path, 0, 50)
    assert storage.alignment_window(spark, path) == (0, 50)
    with pytest.raises(FileNotFoundError):
        storage.load_alignment(spark, f"file://{tmp_path}/models")
    with pytest.raises(ValueError):
        storage.load_models(spark, f"file://{tmp_path}/models/notes")


def test_chains_of_many_slices(spark):
    n = 131
    matches = spark.createDataFrame([(str(i), str(i + 1), t, (t + 1) % 3) for i in range(n) for t in range(3) if not (i == 70 and t == 2)], "source string, target string, source_topic int, target_topic int")
    first = spark.createDataFrame([("0", t) for t in range(3)], "slice string, topic_id int")
    want = set()
    for t in range(3):
        at = t
        for i in range(n + 1):
            want.add((str(i), at, t))
            if i == 70 and at == 2:
                break
            at = (at + 1) % 3
    assert {tuple(r) for r in topics.chains(matches, first).collect()} == want
    with pytest.raises(ValueError):
        topics.chains(spark.createDataFrame([("a", "b", 0, 0), ("b", "a", 0, 0)], matches.schema), spark.createDataFrame([("a", 0)], first.schema))


def test_an_unsettled_decomposition_is_an_error():
    rng = np.random.default_rng(0)
    n = linalg.DENSE + 10
    i = np.repeat(np.arange(n), 5)
    m = linalg.Sparse(i, rng.integers(0, n, 5 * n), rng.random(5 * n), (n, n))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.truncated_svd(m, 3, rounds=2)


def test_weights_of_topics_that_are_much_alike_are_the_best():
    """Sweeps stop short of the zeros of some documents; no weight can be changed to come nearer all the same."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(3000, 64)))
    h = np.array([x[k::10].sum(0) for k in range(10)])
    gram, b = h @ h.T, x @ h.T
    w = linalg.non_negative_weights(gram, b)
    slope = (w @ gram - b) / np.abs(b).max(1, keepdims=True)
    assert (w >= 0).all() and np.where(w > 0, np.abs(slope), np.maximum(0, -slope)).max() < 1e-9
    twice = np.vstack([h, h[:1]])  # two topics that are the same
    got = linalg.non_negative_weights(twice @ twice.T, x[:50] @ twice.T)
    assert np.allclose(got @ twice, w[:50] @ h, atol=1e-9)
    assert (linalg.settled_weights(gram, np.zeros(10), np.zeros(10)) == 0).all() and (linalg.settled_weights(gram, -b[0], np.ones(10)) == 0).all()
