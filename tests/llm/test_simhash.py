import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexdrift.llm import simhash

DOCS = "doc_id long, text string, x string, first string, size int, component string, salt int, top int"


def plain_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=3):
    """By doc_id, None allowed once: all pairs, with the smallest id reached."""
    top = list(range(len(prints)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            top[find(j)] = find(i)
    least = {}
    for k, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [least.get(find(k)) for k in range(len(prints))]


def texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}é" for i in range(800)]
    out = [None, "", " \t", "one", "ONE", "one two", "One  Two", "one two three", "Ünder Éins two", "same " * 40_000]
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([5, 40, 150, 600]))
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", " \x0b "]).join(words))
    rng.shuffle(out)
    return out


def test_spark_hashes_alike(spark):
    """The seed and form of the hash are those of Spark's own function."""
    for t in ("", "a", "one two three", "é" * 50):
        want = xxhash.xxh64_intdigest(t.encode(), simhash.SEED)
        assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % (1 << 64) == want


@pytest.mark.parametrize("piece", [simhash.PIECE, 7])
def test_fingerprints_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for t in texts():
        assert simhash.fingerprint((t or "").encode()) == plain_print(t)


@pytest.mark.parametrize("shard,leaf,sample", [(simhash.SHARD, simhash.LEAF, simhash.SAMPLE), (20, 9, 64)])
def test_components_equal_brute_force(spark, monkeypatch, shard, leaf, sample):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("SAMPLE", sample)):
        monkeypatch.setattr(simhash, name, value)
    rows = [(i * 7 % 5003, t) for i, t in enumerate(texts())] + [(None, texts()[3]), (None, "no copy of this anywhere in here")]
    df = spark.createDataFrame([(i, t, "x", "y", 1, "c", 2, 3) for i, t in rows], DOCS).repartition(5)
    prints = [(i, plain_print(t)) for i, t in rows]
    want = [(i, f"{x:016x}", c) for (i, x), c in zip(prints, plain_components(prints), strict=True)]
    got = simhash.mark_similar(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(i != c for i, _, c in want)


def planted(rng, n, far):
    """Random fingerprints, chains of them by a few bits, and a ball around one."""
    x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for k in range(n // 2, n):
        at = x[rng.integers(0, k)]
        for b in rng.integers(0, 64, rng.integers(1, far)):
            at ^= np.uint64(1) << np.uint64(b)
        x[k] = at
    ball = [x[0] ^ np.uint64((1 << int(a)) | (1 << int(b)) | (1 << int(c)) | (1 << int(d))) for a, b, c, d in rng.integers(0, 64, (n // 4, 4))]
    return np.unique(np.concatenate([x, np.array(ball, np.uint64)]))


def joined(labels, a, b):
    top = {int(v): int(v) for v in labels}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for p, q in zip(a, b, strict=True):
        p, q = find(int(p)), find(int(q))
        top[max(p, q)] = min(p, q)
    return {v: find(v) for v in top}


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_links_of_all_fingerprints(spark, monkeypatch, radius):
    """Trees routed through Spark and split in tasks lose no link, at borders and in balls that can't be split."""
    monkeypatch.setattr(simhash, "SHARD", 150)
    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(simhash, "SAMPLE", 100)
    x = planted(np.random.default_rng(4), 600, 6)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= radius, 1))
    signed = x.view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "x long").repartition(4)
    rows = simhash.links(df, radius).collect()
    assert joined(signed, [r.a for r in rows], [r.b for r in rows]) == joined(signed, signed[i], signed[j])


def test_trees_keep_neighbours_together():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    tree = simhash.Tree(values, 1, 6)
    assert tree.leaves > 20
    near = values ^ (np.uint32(1) << rng.integers(0, 32, len(values)).astype(np.uint32))
    where = [set(), set()]
    for k, v in enumerate((values, near)):
        index, leaf = tree.route(v)
        where[k] = [set() for _ in values]
        for i, one in zip(index.tolist(), leaf.tolist(), strict=True):
            where[k][i].add(one)
    assert all(a & b for a, b in zip(*where, strict=True))
    assert sum(map(len, where[0])) < 3 * len(values)


def test_no_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.mark_similar(none).count() == 0
    got = simhash.mark_similar(spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "A B C D"), (9, None), (7, "")], none.schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (4, 2), (4, 2), (7, 7), (9, 7)]
    with pytest.raises(ValueError):
        simhash.mark_similar(none, radius=32)
