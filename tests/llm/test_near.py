import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexdrift.llm import near, shingles

DOCS = "doc_id long, text string, name string, sketch string, value long, component long"


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, similarity=85):
    sets = {i: shingle_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups, most, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(5, length))
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words[len(words) // 2 : len(words) // 2] = passage
            base = words if rng.random() < 0.5 else base  # chains as well as stars
            texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    rng.shuffle(texts)
    return texts


def test_word_hashes_follow_words_and_texts():
    texts = ["", None, "  a  B\x0bc ", "a b c", "C b a", "über a", "a\x00b", " ", "x"]
    h, n = shingles.word_hashes(pa.array(texts, pa.string()).slice(1))
    assert n.tolist() == [0, 3, 3, 3, 2, 1, 0, 1]
    a, b, c = h[:3]
    assert h[3:6].tolist() == [a, b, c] and h[6:9].tolist() == [c, b, a] and h[10] == a
    many = [f"t{i} t{i} zz" for i in range(2000)]
    h, _ = shingles.word_hashes(pa.array(many))
    assert len(set(h.tolist())) == 2001


def test_shingle_counts_equal_those_of_strings():
    for text in ("", "a", "a b c d", "a b c d e", "a b c d e a b c d e a b c d e f", "x " * 100):
        h, n = shingles.shingle_hashes(pa.array([text, "other text here"]))
        assert len(np.unique(h[: n[0]])) == len(shingle_set(text))


@pytest.mark.parametrize("block,columns,shingles_", [(near.BLOCK, near.COLUMNS, near.SHINGLES), (3, 7, 200)])
def test_components_equal_brute_force(spark, monkeypatch, block, columns, shingles_):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "SHINGLES", shingles_)
    monkeypatch.setattr(near, "COLUMNS", columns)
    texts = [*corpus(1, 40, 12, 120), *corpus(2, 3, 60, 40), "", None, "one", "ONE", "one two", "a b c d e"]
    rows = [(i * 7 % 5003, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows] + [(None, texts[0], None, None, None, None)], DOCS)
    got = {r.doc_id: r for r in near.mark_near_copies(df.repartition(5)).collect()}
    want = brute_force(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    same = next(i for i, t in rows if t == texts[0])
    assert got[None].component_id == want[same][1] and not got[None].kept  # a row without an id is linked as well
    left = near.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = near.mark_near_copies(spark.createDataFrame([(4, text), (4, text), (9, text + " more")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (4, 4), (9, 4)]
    assert near.mark_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_several_texts_loses_none(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(5000)], k=80)) for _ in range(4))
    rows = [(3, a + " x"), (7, a), (7, b), (7, c), (9, b + " y"), (None, d), (None, d + " z"), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, "p", "q", 1) for i, t in rows], "doc_id long, text string, part string, stays string, id int").repartition(3)
    docs = {(i, t or ""): r for (i, t), r in ((rows[k], k) for k in range(len(rows)))}
    got = near.mark_near_copies(df).select("doc_id", "component_id", "kept", "n_shingles").collect()
    want = [(3, 3, True, 77), (7, 3, False, 76), (7, 7, True, 76), (7, 7, True, 76), (9, 7, False, 77), (None, None, True, 76), (None, None, True, 77), (None, None, True, 0), (7, 7, True, 0), (7, 7, True, 0)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    left = [(r.doc_id, r.text) for r in near.drop_near_copies(df).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(3, a + " x"), (7, b), (7, c), (None, None), (7, ""), (7, ""), next(x for x in left if x[0] is None and x[1])]))
    assert len(docs) == 9


def test_long_texts(spark, monkeypatch):
    """Sets of 20,000 shingles that share all their lists' hub, one by one different, and one linked pair among them."""
    monkeypatch.setattr(near, "SHINGLES", 30_000)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    base = [word() for _ in range(20_000)]
    texts = []
    for k in range(12):  # two thirds in common: near in the sketch, but no link
        own = list(base)
        for start in range(k * 100, 20_000, 1200):
            own[start : start + 100] = [word() for _ in range(100)]
        texts.append(" ".join(own))
    texts.append(texts[5] + " and an end")
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_large_hub_meets_by_rare_values(spark, monkeypatch):
    """300 sets under one pair of common values, some of them linked: few rows leave the lists, and no link is lost."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(3)
    common = [1, 2]
    sets = [np.unique(np.concatenate([common, rng.integers(100, 1 << 62, 70).astype(np.uint64)])) for _ in range(300)]
    for k in range(0, 60, 2):  # half of a pair is the other with up to 7 of 72 values replaced
        new = sets[k].copy()
        new[-(k % 8) or len(new) :] = rng.integers(1 << 62, 1 << 63, k % 8).astype(np.uint64)
        sets[k + 1] = np.unique(new)
    rows = [(i, len(s), i, bytearray(s[: near.SKETCH].tobytes())) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "id long, n long, component long, sketch binary")
    lists = near.rare_lists(nodes, 80).collect()
    assert all(r.hub < 0 for r in lists) and {r.id for r in lists} == set(range(60))
    open_ = nodes.selectExpr("0L AS hub", "*")
    full = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    found = near.candidates(open_, 80).collect()
    assert {r.id for r in found} == set(range(60)) and len(found) <= 2 * 60
    links = {tuple(sorted(r)) for r in near.links_across(open_, full, 80).collect()}
    want = set()
    for a, b in itertools.combinations(range(300), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            want.add((a, b))
    assert links == want and len(want) == 30


def test_sketches_rule_out_what_is_far_from_a_link(spark, monkeypatch):
    """Sets of similarities of about 0.3, 200 of 450 values, and one linked pair: no other node goes on to the full sets, in hubs of any size."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(1, 1 << 62, 450).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, 200, replace=False)) for _ in range(80)]
    sets[41] = np.unique(np.concatenate([sets[40][:-6], rng.integers(1, 1 << 62, 6).astype(np.uint64)]))
    nodes = [(0, i, len(s), i, bytearray(s[: near.SKETCH].tobytes())) for i, s in enumerate(sets)]
    open_ = spark.createDataFrame(nodes, "hub long, id long, n long, component long, sketch binary")
    full = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    for block in (near.BLOCK, 16):
        monkeypatch.setattr(near, "BLOCK", block)
        assert {r.id for r in near.candidates(open_, 80).collect()} == {40, 41}
        assert {tuple(r) for r in near.links_across(open_, full, 80).collect()} == {(40, 41)}


def test_known_unions_equal_plain_ones():
    rng = np.random.default_rng(9)
    pool = rng.integers(1, 1 << 63, 130).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, k, replace=False)) for k in (1, 5, 40, 63, 64, 65, 66, 90, 120, 130) for _ in range(3)]
    sketches, n = [s[: near.SKETCH] for s in sets], np.array([len(s) for s in sets])
    got = near.known_unions(sketches, sketches, n, n, near.common_counts(sketches, sketches))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            ends = [s[near.SKETCH - 1] for s in (a, b) if len(s) > near.SKETCH]
            union = np.union1d(a, b)
            assert got[i, j] == ((union <= min(ends)).sum() if ends else len(union))
            assert not ends or near.SKETCH <= got[i, j] <= 2 * near.SKETCH


def test_similarity_is_guarded():
    with pytest.raises(ValueError):
        near.marked(None, 79, 5)
    assert [near.least_common(x) for x in (80, 85, 100)] == sorted(near.least_common(x) for x in (80, 85, 100)) and near.least_common(80) >= 28


def test_components_of_a_long_path(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in near.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_joined_labels_join_the_same():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 400):
        x, y = rng.integers(0, 300, n) * 7, rng.integers(0, 300, n) * 7
        top = {}

        def find(v, top=top):
            while top.setdefault(v, v) != v:
                v = top[v]
            return v

        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            a, b = sorted((find(a), find(b)))
            top[b] = a
        a, b = near.joined_labels(x, y)
        assert dict(zip(b.tolist(), a.tolist(), strict=True)) == {v: find(v) for v in list(top) if find(v) != v}
