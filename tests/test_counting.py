import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexdrift.operators import periods, ppmi, sketch, tokens, vocabulary
from lexdrift.plans import registry

CORPUS = "slice string, doc_id long, line_no int, line string"
QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def corpus(spark, lines, name="s"):
    return spark.createDataFrame([(name, i, 0, x) for i, x in enumerate(lines)], CORPUS)


def plain_pairs(lines, window, min_length):
    out = Counter()
    for line in lines:
        w = [x for x in line.split() if len(x) >= min_length]
        for i, a in enumerate(w):
            out.update((a, b) for b in w[i + 1 : i + 2 + window])
    return out


ANIMALS = ["the cat chased the mouse around the garden", "the dog chased the cat around the garden", "a bird watched the dog and the cat", "the mouse feared the cat and the dog"]


def test_tokens_follow_python_white_space(spark):
    line = "ab cd\x1cef  gh\tij\x85kl  mnö"
    got = spark.createDataFrame([(line,)], "line string").select(tokens.tokens("line", 1)).first()[0]
    assert got == line.split()
    assert spark.createDataFrame([("a bb ccc",)], "line string").select(tokens.tokens("line", 2)).first()[0] == ["bb", "ccc"]


@pytest.mark.parametrize("window,length", [(0, 1), (2, 3), (5, 3), (50, 1)])
def test_skipgrams_against_plain_python(spark, window, length):
    lines = [*ANIMALS, "", "one", "  "]
    c = corpus(spark, lines)
    got = {(r.w1, r.w2): r.n for r in tokens.pair_counts(c, window, length).collect()}
    assert got == plain_pairs(lines, window, length)
    assert tokens.pair_totals(c, window, length).first().pairs == sum(got.values())
    words, totals = tokens.counted(c, window, length)
    assert totals.first().pairs == sum(got.values())
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, tokens.word_counts(c, length).collect()))


def test_lines_normal_form_and_lemmas(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x y\nz"), (2, None, None)], "doc_id long, lang string, text string")
    assert sorted(tuple(r) for r in tokens.corpus_lines(docs, "lang").collect()) == [("a", 1, 0, "x y"), ("a", 1, 1, "z")]
    (tmp_path / "t.txt").write_text("  Ab C \n\n \nd\n")
    assert [r.line for r in tokens.read_lines(spark, f"file://{tmp_path}/t.txt").collect()] == ["ab c", "d"]
    text = spark.createDataFrame([("It's  a, TEST!\n(ok)",)], "t string")
    assert text.select(tokens.normalised("t")).first()[0] == "its a test ok"
    table = spark.createDataFrame([("mice", "mouse"), ("mice", "mouse")], "word string, lemma string")
    words = spark.createDataFrame([("s", "mice"), ("s", "cat")], "slice string, word string")
    assert sorted(r.word for r in tokens.lemmatised(words, table).collect()) == ["cat", "mouse"]


def test_vocabulary_order_and_threshold(spark):
    c = spark.createDataFrame([("s", "b", 7), ("s", "a", 7), ("s", "c", 5), ("s", "d", 1), ("t", "x", 1)], "slice string, word string, n long")
    got = [(r.slice, r.word, r["rank"]) for r in vocabulary.ranked(c, 0.25).orderBy("slice", "rank").collect()]
    assert got == [("s", "a", 0), ("s", "b", 1), ("t", "x", 0)]  # 5 is not over floor(20 / 4)
    assert {r.word: r.p for r in vocabulary.marginals(vocabulary.ranked(c, 0.0), 5).collect()} == {"a": 7 / 20, "b": 7 / 20}


@pytest.mark.parametrize("n,shift,alpha,want", [(50, 1.0, 0.75, None), (200, 1.0, 0.75, 0.810648), (200, 2.0, 0.75, 0.117501), (200, 1.0, 1.0, 1.386294)])
def test_ppmi_by_hand(spark, n, shift, alpha, want):
    vocab = spark.createDataFrame([("s", "a", 0, 100, 1000), ("s", "b", 1, 100, 1000)], "slice string, word string, rank int, n long, total long")
    pairs = spark.createDataFrame([("s", "a", "b", n)], "slice string, w1 string, w2 string, n long")
    total = spark.createDataFrame([("s", 5000)], "slice string, pairs long")
    got = ppmi.entries(pairs, total, vocab, ppmi.Params(shift=shift, alpha=alpha)).collect()
    assert [(r.i, r.j) for r in got] == ([(0, 1)] if want else [])
    assert not want or got[0].ppmi == pytest.approx(want, abs=1e-6)
    assert ppmi.entries(pairs, total, vocab, ppmi.Params(marginals="pair_sketch")).count() == 0


def plain_ppmi(lines, p):
    words = Counter(w for line in lines for w in line.split() if len(w) >= p.min_length)
    pairs = plain_pairs(lines, p.window, p.min_length)
    tw, tp, out = sum(words.values()), sum(pairs.values()), {}
    for (a, b), n in pairs.items():
        if min(words[a], words[b], n) > p.min_count and min(words[a], words[b]) > math.floor(tw * p.threshold):
            pa, pb, pab = (words[a] / tw + 1e-10) ** p.alpha, words[b] / tw + 1e-10, (n + 1e-10) / tp
            if pab > pa * pb and math.log(pab / (pa * pb)) - math.log(p.shift) > 0:
                out[a, b] = math.log(pab / (pa * pb)) - math.log(p.shift)
    return out


@pytest.mark.parametrize("p", [ppmi.Params(), ppmi.Params(min_count=0, window=2), ppmi.Params(shift=0.5, alpha=1.0), ppmi.Params(threshold=0.05)])
def test_ppmi_of_a_corpus_against_plain_python(spark, p):
    lines = [x for x in ANIMALS for _ in range(10)] + ["king queen royal court"] * 12
    got = {(r.w1, r.w2): r.ppmi for r in ppmi.of_corpus(corpus(spark, lines).unionByName(corpus(spark, lines[::2], "t")), p).where("slice = 's'").collect()}
    want = plain_ppmi(lines, p)
    assert set(got) == set(want) and want
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_ppmi_params_are_checked():
    for bad in ({"shift": 0.0}, {"window": -1}, {"marginals": "x"}):
        with pytest.raises(ValueError):
            ppmi.Params(**bad)


def test_murmur3_known_values():
    keys = [b"", b"foo", b"hello", b"hello, world"]
    assert sketch.murmur3(keys, 0).tolist() == [0, -156908512, 613153351, 345750399]
    assert sketch.SketchParams().seeds == [121958, 671155, 131932, 365838, 259178]


@pytest.mark.parametrize("compatible", [False, True])
def test_sketch_never_under_estimates_and_merges(spark, compatible):
    p = sketch.SketchParams(width=20, depth=3, compatible=compatible)
    rng = np.random.default_rng(1)
    a, b = (spark.createDataFrame([(f"k{i}é",) for i in rng.integers(0, 60, 300)], "key string") for _ in range(2))
    exact = {r.key: r["count"] for r in a.union(b).groupBy("key").count().collect()}
    whole = sketch.build(a.union(b), p)
    merged = sketch.merge(sketch.build(a, p), sketch.build(b, p), p, p)
    table = lambda s: sorted((r.row, r.bucket, r.cnt) for r in s.collect())
    assert table(whole) == table(merged)
    got = {r.key: r.estimate for r in sketch.estimate(a.union(b), whole, p).collect()}
    assert set(got) == set(exact) and all(got[k] >= exact[k] for k in exact)
    assert {r.total for r in sketch.total(whole).collect()} == {600}
    wide = sketch.SketchParams(width=1 << 20, depth=3, compatible=compatible)
    assert {r.key: r.estimate for r in sketch.estimate(a, sketch.build(a, wide), wide).collect()} == {r.key: r["count"] for r in a.groupBy("key").count().collect()}


@pytest.mark.parametrize("compatible", [False, True])
def test_settled_estimates_are_counts_where_all_buckets_are_shared(spark, compatible):
    keys = spark.createDataFrame([(f"k{i % 400}",) for i in range(1500)] + [(None,)], "key string")
    exact = {r.key: r["count"] for r in keys.where("key is not null").groupBy("key").count().collect()}
    for width, depth in ((50, 2), (1, 1), (300, 3), (1 << 20, 2)):
        p = sketch.SketchParams(width=width, depth=depth, compatible=compatible)
        rows = sketch.settled(keys, p).collect()
        assert len(rows) == len(exact) and {r.key: r.estimate for r in rows} == exact
        plain = {r.key: r.estimate for r in sketch.estimate(keys, sketch.build(keys, p), p).where("key is not null").collect()}
        assert (plain == exact) == (width > 300)


def test_registered_wide_estimates_are_counts_of_any_number_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sketch.SketchParams.__init__, "__defaults__", (60, 2, 42, False))  # as a million keys to a million buckets
    rows = spark.range(900).select((F.col("id") * F.col("id") % 211).alias("l_partkey"))
    rows.write.parquet(f"file://{tmp_path}/lineitem.parquet")
    want = {str(r.l_partkey): r["count"] for r in rows.groupBy("l_partkey").count().collect()}
    for name in ("sketch_estimate_wide", "sketch_estimate_murmur3_wide"):
        assert {r.key: r.estimate for r in registry.queries()[name](spark, f"file://{tmp_path}").collect()} == want


def test_sketch_edges(spark):
    p = sketch.SketchParams(width=1000, depth=3)
    keys = spark.createDataFrame([("filler", 90), ("border", 10)], "key string, cnt long")
    s = sketch.build(keys, p)
    assert [r.key for r in sketch.heavy_hitters(keys, s, p, 0.1).collect()] == ["filler"]
    assert sketch.estimate(spark.createDataFrame([("none",)], "key string"), s, p).first().estimate == 0
    assert p.error_bound(500) == 1.0
    with pytest.raises(RuntimeError):
        sketch.heavy_hitters(None, s, p, 0.1)
    with pytest.raises(ValueError):
        sketch.merge(s, s, p, sketch.SketchParams(width=1000, depth=3, seed=1))
    with pytest.raises(ValueError):
        sketch.SketchParams(width=0)


@QUIET
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta"]), min_size=1, max_size=30))
def test_counts_of_any_line(spark, words):
    got = {r.word: r.n for r in tokens.word_counts(corpus(spark, [" ".join(words)])).collect()}
    assert got == Counter(words)


def test_periods(spark):
    df = spark.createDataFrame([("2025-03-01",), ("2049",), ("1999-12-31T00:00",), ("0024-01-01",)], "date string")
    got = periods.with_period(df, "date").withColumn("y", periods.period_start("period"))
    assert [(r.period, r.y) for r in got.collect()] == [("2025-2049", 2025), ("2025-2049", 2025), ("1975-1999", 1975), ("0-24", 0)]
    assert {r.period: r.n for r in periods.period_counts(df, "date").collect()}["2025-2049"] == 2
    p = spark.createDataFrame([("1000-1024",), ("975-999",), ("2000-2024",), ("975-999",)], "period string")
    assert sorted(r.label for r in periods.consecutive(p).collect()) == ["1000-1024->2000-2024", "975-999->1000-1024"]
    assert {r.label for r in periods.from_first(p).collect()} == {"975-999->1000-1024", "975-999->2000-2024"}


def test_pairs_are_combined_before_the_shuffle(spark):
    plan = tokens.pair_counts(corpus(spark, ANIMALS))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange") and plan.count("Exchange hashpartitioning") == 1


def test_registered_skipgrams_are_all_pairs(spark, tmp_path):
    texts = [("a", "\n".join(ANIMALS)), ("b", "the bird saw\nthe bird fly"), ("b", None), (None, "one two three")]
    docs = [(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {}
    for lang in ("a", "b", None):
        pairs = plain_pairs([x for k, t in texts if k == lang for x in (t or "").split("\n")], 5, 3)
        want |= {(lang, *p): n for p, n in pairs.items()}
    got = registry.queries()["skipgram_counts_all"](spark, f"file://{tmp_path}").collect()
    assert len(got) == len(want) and {(r.slice, r.w1, r.w2): r.n for r in got} == want
    assert 1 in want.values() and max(want.values()) > 1


@pytest.mark.parametrize("words", [ppmi.BROADCAST_WORDS, 0])
def test_words_become_ranks_before_pairs_are_counted(spark, monkeypatch, words):
    """The entries are the same whether the vocabulary is broadcast or pairs are counted as strings."""
    monkeypatch.setattr(ppmi, "BROADCAST_WORDS", words)
    rows = [("a", i, 0, x) for i, x in enumerate(ANIMALS * 12)] + [("b", i, 0, x + " once" + str(i)) for i, x in enumerate(ANIMALS * 8)] + [(None, 1, 0, "x y z"), ("c", 1, 0, None)]
    c = spark.createDataFrame(rows, CORPUS)
    for params in (ppmi.Params(), ppmi.Params(min_count=0, window=1, shift=1.5, alpha=1.0), ppmi.Params(threshold=0.05)):
        vocab, got = ppmi.prepared(c, params)
        counts, totals = tokens.counted(c, params.window, params.min_length)
        want = ppmi.entries(tokens.pair_counts(c, params.window, params.min_length), totals, vocabulary.ranked(counts, params.threshold), params)
        plain = lambda df: sorted((r.slice, r.i, r.j, r.w1, r.w2, r.n, round(r.ppmi, 9)) for r in df.collect())
        assert plain(got) == plain(want) and plain(got)


def test_small_operators(spark):
    matrix = spark.createDataFrame([(1, -0.5), (2, 0.0), (3, 0.5)], "i int, ppmi double")
    assert [r.ppmi for r in ppmi.clamped(matrix).orderBy("i").collect()] == [0.0, 0.0, 0.5]
    pair = spark.createDataFrame([("a#b", "c")], "w1 string, w2 string").select(tokens.pair_key())
    assert pair.first()[0] == "a#b#c"
    a, b = (spark.createDataFrame([(k,) for k in x], "key string") for x in ("xxy", "yz"))
    assert sorted(r.key for r in sketch.merged_keys(a, b).collect()) == ["x", "y", "z"] and sketch.merged_keys(a, None) is None
    p = sketch.SketchParams(width=100, depth=3)
    got = sketch.heavy_hitters(a.unionByName(b), sketch.build(a.unionByName(b), p), p, 0.0).collect()
    assert [tuple(r) for r in got] == [("x", 2), ("y", 2), ("z", 1)]
    for bad in (lambda: sketch.SketchParams(seed="1"), lambda: sketch.SketchParams(width=1.5), lambda: ppmi.Params(window=2.0)):
        with pytest.raises(TypeError):
            bad()
