import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import substrings

DOCS = "doc_id long, text string, part string, anchor string, start long, n long"


def brute_force(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdéß ", k=rng.randrange(2, 9)))
    fresh = lambda k: "".join(word() for _ in range(k))
    p = fresh(100)
    out = [fresh(rng.randrange(1, 300)) for _ in range(40)]
    for i in range(40):  # a passage, or more and less of it, in many places
        a, b = rng.randrange(60), rng.randrange(60)
        out.append(fresh(rng.randrange(40)) + p[a : len(p) - b] + fresh(rng.randrange(40)))
    q = out[3] + fresh(50)
    out += [q, q, q[:-1] + "x", p[:199], p[:200], p[50:250], "a" * 199, "a" * 200, "b" * 201, "c" * 1500, "ab" * 700, "ab" * 300 + "x", "", None]
    return out + [p + p, "ü" * 150, fresh(2500) + p + fresh(2500) + p[:400] + out[5]]


def digest(df):
    return df.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("sha")
    ).collect()


@pytest.mark.parametrize("large,block", [(substrings.LARGE_BUCKET, substrings.BLOCK), (1, 3000), (5, 1)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, large, block):
    monkeypatch.setattr(substrings, "LARGE_BUCKET", large)
    monkeypatch.setattr(substrings, "BLOCK", block)
    rows = texts(5)
    df = spark.createDataFrame([(i, t, "x", None, 1, 2) for i, t in enumerate(rows)], DOCS).repartition(4)
    got = {r[0]: tuple(r[1:]) for r in digest(substrings.remove_repeats(df))}
    for i, want in enumerate(brute_force(rows)):
        assert got[i] == want, i


@pytest.mark.parametrize("large", [substrings.LARGE_BUCKET, 1])
def test_equal_hashes_change_nothing(spark, monkeypatch, large):
    """All anchors, and all windows' keys, have one hash: everything meets in one bucket, and only the sort decides."""
    find, keys = substrings.find_segments, substrings.window_keys
    monkeypatch.setattr(substrings, "LARGE_BUCKET", large)
    monkeypatch.setattr(substrings, "find_segments", lambda docs: find(docs).withColumn("anchor", F.lit(7).cast("long")))
    monkeypatch.setattr(substrings, "window_keys", lambda strings: keys(strings).withColumn("key", F.lit(9).cast("long")))
    rows = texts(6)
    got = {r[0]: tuple(r[1:]) for r in digest(substrings.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))}
    assert [got[i] for i in range(len(rows))] == brute_force(rows)


def test_hot_passage_long_text_and_extra_columns(spark):
    rng = random.Random(9)
    fresh = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage = fresh(260)
    rows = [fresh(rng.randrange(50, 400)) + passage + fresh(rng.randrange(50, 400)) for _ in range(300)] + [fresh(400_000) + passage]
    df = spark.createDataFrame([(i, t, "s", "a", 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, members string, found string, key int, bucket int")
    got = {r[0]: tuple(r[1:]) for r in digest(substrings.remove_repeats(df.repartition(8)))}
    assert [got[i] for i in range(len(rows))] == brute_force(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(2))
    rows = [(None, a), (None, b), (1, b[:250]), (2, a + b[100:]), (2, a + b[100:]), (3, "".join(rng.choices("xyz", k=400)))]
    got = sorted((str(r[0]), *r[1:]) for r in digest(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, brute_force([t for _, t in rows]), strict=True))
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_cover_has_all_differences():
    on = set(substrings.cover().tolist())
    assert {(a - b) % substrings.PERIOD for a in on for b in on} == set(range(substrings.PERIOD)) and len(on) < 12


@pytest.mark.parametrize("buckets", [1, 3])
def test_windows_are_in_lexicographic_order(buckets):
    rng = np.random.default_rng(0)
    base = rng.integers(97, 100, 500).astype(np.uint8)
    other = np.where(np.arange(300) == 250, 65, base[:300])  # differs behind the first windows' reach, or in their middle
    t = np.concatenate([base, base[100:450], other, np.full(700, 98), base[3:240], rng.integers(97, 99, 3000)]).astype(np.uint8)
    starts = rng.permutation(len(t) - 199)
    bucket = starts % buckets
    raw = t.tobytes()
    windows = [(b, raw[i : i + 200]) for b, i in zip(bucket.tolist(), starts.tolist(), strict=True)]
    order = sorted(windows)
    first = {}
    for k, w in enumerate(order):
        first.setdefault(w, k)
    assert substrings.window_ranks(t, starts, bucket).tolist() == [first[w] for w in windows]
