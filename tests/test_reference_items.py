import random

import pytest
from pyspark.sql import functions as F

from lexdrift.operators import ppmi, shift, sketch, tokens, vocabulary
from lexdrift.plans import registry
from lexdrift.sources import storage
from lexdrift.sources.staging import listed

CORPUS = "slice string, doc_id long, line_no int, line string"


def lines(spark, seed=1, slices=("a", "b")):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(12)]
    rows = [(s, k, 0, " ".join(rng.choices(words, weights=range(1, 13), k=rng.randrange(0, 30)))) for s in slices for k in range(80)]
    return spark.createDataFrame(rows, CORPUS)


def entries_of(df):
    return {(r.slice, r.w1, r.w2): (r.i, r.j, r.n, round(r.ppmi, 9)) for r in df.collect()}


@pytest.mark.parametrize("compatible", [False, True])
def test_ppmi_from_wide_sketches_is_exact(spark, compatible):
    corpus = lines(spark)
    tables = sketch.SketchParams(width=200_000, depth=4, compatible=compatible)
    v, p = vocabulary.ranked(tokens.word_counts(corpus)), ppmi.Params(alpha=1.0, min_count=2)
    got = ppmi.from_sketches(v, tokens.skipgrams(corpus), *ppmi.sketched(corpus, tables, p), tables, p)
    want = entries_of(ppmi.of_corpus(corpus, p))
    assert entries_of(got) == want and len(want) > 10
    # what else is asked for doesn't change anything, nor does asking twice
    more = tokens.skipgrams(corpus).union(tokens.skipgrams(corpus)).union(spark.createDataFrame([("a", "word0", "never"), ("c", "x", "y")], "slice string, w1 string, w2 string"))
    assert entries_of(ppmi.from_sketches(v, more, *ppmi.sketched(corpus.repartition(7), tables, p), tables, p)) == want


@pytest.mark.parametrize("compatible", [False, True])
def test_ppmi_of_sketches_is_exact_at_any_width(spark, compatible):
    """Also where all pairs share buckets, and where words have what stands between two words in a pair's key."""
    corpus = lines(spark).unionByName(spark.createDataFrame([("a", 90, 0, "word1#word2 word3 word1 word2#word3 " * 9), (None, 0, 0, "word1 word2 " * 9), ("c", 0, 0, None)], CORPUS))
    p = ppmi.Params(alpha=1.0, min_count=2)
    want = entries_of(ppmi.of_corpus(corpus, p))
    assert len(want) > 10
    for width, depth in ((13, 2), (1 << 30, 3)):
        assert entries_of(ppmi.of_sketches(corpus, sketch.SketchParams(width=width, depth=depth, compatible=compatible), p)) == want


def test_counts_over_a_bound_from_buckets(spark, monkeypatch):
    rng = random.Random(7)
    rows = [("s", int(rng.paretovariate(0.6))) for _ in range(4000)] + [("t", k % 90) for k in range(500)]
    keys = spark.createDataFrame(rows, "sketch string, key long")
    for least in (0, 5):
        want = {(r.sketch, r.key): r["count"] for r in keys.groupBy("sketch", "key").count().where(F.col("count") > least).collect()}
        for width, depth, most in ((1, 2, 10), (200, 3, 0), (1 << 30, 3, 10)):
            monkeypatch.setattr(sketch, "BROADCAST_BUCKETS", most)
            got = sketch.over(keys, sketch.SketchParams(width=width, depth=depth), least).collect()
            assert len(got) == len(want) and {(r.sketch, r.key): r.n for r in got} == want


def test_estimates_of_narrow_sketches_are_not_under(spark):
    corpus = lines(spark)
    tables = sketch.SketchParams(width=13, depth=2)
    _, pairs_table = ppmi.sketched(corpus, tables)
    counts = tokens.pair_counts(corpus).withColumn("key", tokens.pair_key())
    got = {(r.sketch, r.key): r.estimate for r in sketch.estimate_each(counts.select(F.col("slice").alias("sketch"), "key"), pairs_table, tables).collect()}
    over = [got[r.slice, r.key] - r.n for r in counts.collect()]
    assert min(over) >= 0 and max(over) > 0


def test_sketches_of_other_parameters_are_refused(spark):
    corpus = lines(spark)
    tables = sketch.SketchParams(width=50, depth=3)
    words_table, pairs_table = ppmi.sketched(corpus, tables)
    v = vocabulary.ranked(tokens.word_counts(corpus))
    for other in (sketch.SketchParams(width=20, depth=3), sketch.SketchParams(width=50, depth=2), sketch.SketchParams(width=50, depth=4)):
        with pytest.raises(ValueError):
            ppmi.from_sketches(v, tokens.skipgrams(corpus), words_table, pairs_table, other)
    with pytest.raises(ValueError, match="totals"):
        sketch.checked(words_table.where("row != 1 or bucket > 25"), tables)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
@pytest.mark.parametrize("window", [0, 1, 5])
def test_long_lines_make_the_pairs_of_short_ones(spark, chunk, window):
    corpus = lines(spark, 2)
    pairs = lambda df: sorted((r.slice, r.w1, r.w2, r["count"]) for r in df.groupBy("slice", "w1", "w2").count().collect())
    assert pairs(tokens.long_skipgrams(corpus, window, chunk=chunk)) == pairs(tokens.skipgrams(corpus, window))


@pytest.mark.parametrize("window,rounds", [(5, 3), (0, 1)])
def test_pieces_make_the_pairs_of_the_line_that_they_are(spark, window, rounds):
    rng = random.Random(4)
    texts = [(s, k, " ".join(rng.choices(["aaa", "bbb", "ccc", "ddd", "x"], k=rng.choice([0, 0, 1, 1, 2, 3, 40])))) for s in ("a", "b", None) for k in range(120)] + [("one", 5, "aaa"), ("none", 1, "x"), ("none", 2, None)]
    pieces = spark.createDataFrame(texts, "slice string, at long, line string").repartition(5, "line")
    whole = [(s, 0, 0, " ".join(t or "" for x, _, t in texts if x == s)) for s in ("a", "b", None, "one", "none")]
    for least in (0, 2):
        want = sorted((str(r.slice), r.w1, r.w2, r.n) for r in tokens.pair_counts(spark.createDataFrame(whole, CORPUS), window).where(f"n > {least}").collect())
        got = tokens.frequent_pairs_of_pieces(pieces, least, window, rounds=rounds)
        assert got.columns == ["slice", "w1", "w2", "n"] and sorted((str(r.slice), r.w1, r.w2, r.n) for r in got.collect()) == want and want


def test_long_lines_of_a_slice_are_not_put_together(spark):
    plans = []
    held = tokens.staged
    tokens.staged = lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or held(df, *a)
    try:
        registry.queries()["skipgrams_of_long_lines"](spark, "/root/testdata/sf0.001")
    finally:
        tokens.staged = held
    assert plans and not [p for p in plans if "text" in p.split("collect_list(", 1)[-1].split(")")[0] and "collect_list(" in p]


def test_frequent_pairs_are_those_of_all_pairs(spark):
    corpus = lines(spark, 3).unionByName(spark.createDataFrame([(None, 0, 0, "one two one two"), ("c", 0, 0, None), ("c", 1, 0, "")], CORPUS))
    for least, rounds in ((0, 4), (1, 1), (5, 3)):
        want = sorted((str(r.slice), r.w1, r.w2, r.n) for r in tokens.pair_counts(corpus).where(f"n > {least}").collect())
        assert sorted((str(r.slice), r.w1, r.w2, r.n) for r in tokens.frequent_pairs(corpus, least, rounds=rounds).collect()) == want and want


def test_a_very_long_line(spark):
    n = 300_000
    line = " ".join(f"tok{i * i % 7}" for i in range(n))
    df = spark.createDataFrame([("s", 0, 0, line), ("s", 1, 0, ""), ("s", 2, 0, None)], CORPUS)
    got = {(r.w1, r.w2): r["count"] for r in tokens.long_skipgrams(df).groupBy("w1", "w2").count().collect()}
    want = {}
    words = line.split()
    for i, w in enumerate(words):
        for x in words[i + 1 : i + 7]:
            want[w, x] = want.get((w, x), 0) + 1
    assert got == want


def test_lemmas_by_rule(spark):
    words = "run running runs ran make making makes city cities box boxes big bigger biggest bus ring rings king red reds class classes leaf leaves the".split()
    told = spark.createDataFrame([("ran", "run"), ("ran", "rund"), ("bus", "bus"), ("absent", "x"), (None, "y")], "word string, lemma string")
    got = {r.word: r.lemma for r in tokens.rule_lemmas(spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string"), told).collect()}
    want = {
        "running": "run", "runs": "run", "ran": "run", "making": "make", "makes": "make", "cities": "city", "boxes": "box", "bigger": "big", "biggest": "big", "rings": "ring",
        "reds": "red", "classes": "class", "leaves": "leaf",
    }
    assert got == want
    df = spark.createDataFrame([("s", w) for w in ("running", "ran", "king")], "slice string, word string")
    lemmas = spark.createDataFrame([("ran", "run"), ("ran", "a"), ("running", "run")], "word string, lemma string")
    assert sorted(r.word for r in tokens.lemmatised(df, lemmas).collect()) == ["a", "king", "run"]


def test_one_slice_of_a_saved_model_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    old, new = lines(spark, 1, ("a", "b")), lines(spark, 9, ("b", "c"))
    with pytest.raises(ValueError):
        storage.load_model(spark, path)
    storage.save_model(shift.train(old, 3), path)
    before = {(r.slice, r.word): r.n for r in storage.load_model(spark, path).vocabulary.collect()}
    files = sorted(p.name for p in (tmp_path / "model/data/00000001/vocabulary/slice=a").iterdir())
    storage.refresh_slices(shift.train(new, 3), path)
    model = storage.load_model(spark, path)
    after = {(r.slice, r.word): r.n for r in model.vocabulary.collect()}
    assert {k: v for k, v in after.items() if k[0] == "a"} == {k: v for k, v in before.items() if k[0] == "a"}
    want = {(r.slice, r.word): r.n for r in tokens.word_counts(new).collect()}
    assert {k: v for k, v in after.items() if k[0] != "a"} == want and {k[0] for k in after} == {"a", "b", "c"}
    assert {r.slice for r in model.embeddings.select("slice").distinct().collect()} == {"a", "b", "c"}
    assert sorted(p.name for p in (tmp_path / "model/data/00000001/vocabulary/slice=a").iterdir()) == files
    with pytest.raises(ValueError):
        storage.refresh_slices(shift.train(new, 3, ppmi.Params(window=2)), path)


def test_a_crash_before_the_manifest_leaves_the_old_model(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    storage.save_model(shift.train(lines(spark, 1), 3), path)
    before = sorted(map(str, storage.load_model(spark, path).vocabulary.collect()))
    storage.refresh_slices(shift.train(lines(spark, 5, ("b",)), 3), path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/00000002/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)
    assert sorted(map(str, storage.load_model(spark, path).vocabulary.collect())) == before
    storage.refresh_slices(shift.train(lines(spark, 5, ("b",)), 3), path)
    assert listed(spark, f"{path}/data") and sorted(map(str, storage.load_model(spark, path).vocabulary.collect())) != before


def test_heavy_hitters_of_ranges_from_states(spark):
    rng = random.Random(4)
    rows = [("s", d, f"k{int(rng.paretovariate(1.0))}") for d in range(12) for _ in range(400)] + [("t", 3, "x")] * 50 + [("t", 4, None)]
    states = vocabulary.top_states(spark.createDataFrame(rows, "slice string, part int, key string").repartition(5), 2000)
    got = {(r.slice, r.range, r.key): (r.estimate, r.total) for r in vocabulary.range_heavy_hitters(states, F.floor(F.col("part") / 4), 0.02, 2000).collect()}
    counts = {}
    for s, d, k in rows:
        if k is not None:
            counts[s, d // 4, k] = counts.get((s, d // 4, k), 0) + 1
    totals = {}
    for (s, d, _), n in counts.items():
        totals[s, d] = totals.get((s, d), 0) + n
    assert got == {k: (n, totals[k[:2]]) for k, n in counts.items() if n > int(totals[k[:2]] * 0.02)}
    # fewer tracked than there are: within the bound
    narrow = vocabulary.top_states(spark.createDataFrame(rows, "slice string, part int, key string"), 64)
    for r in vocabulary.range_heavy_hitters(narrow, F.lit(0), 0.05, 64).where("slice = 's'").collect():
        true = sum(n for (s, _, k), n in counts.items() if (s, k) == (r.slice, r.key))
        assert abs(r.estimate - true) <= r.total / (0.75 * 64) * 2


def test_documents_of_slices_without_topics_have_no_rows(spark, monkeypatch):
    from lexdrift.operators import topics

    monkeypatch.setattr(topics, "DOCS", 2)
    weights = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 3, "y", 2.0)], "slice string, topic_id int, word string, weight double")
    docs = spark.createDataFrame([("a", 1, "x", 3.0), ("a", 2, "y", 1.0), ("a", 3, "x", 1.0), ("a", 3, "y", 2.0), ("a", 4, "z", 1.0), ("b", 5, "x", 1.0), ("a", 6, "x", 5.0)], "slice string, doc_id long, word string, weight double")
    got = {(r.doc_id, r.topic_id): round(r.share, 9) for r in topics.document_topics(docs, weights).collect()}
    assert got == {(1, 0): 1.0, (2, 3): 1.0, (3, 0): 0.5, (3, 3): 0.5, (6, 0): 1.0}
