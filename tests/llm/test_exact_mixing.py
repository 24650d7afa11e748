import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import exact, mixing, queries

DOCS = "doc_id long, text string, source string, size string, digest int, target string"
ROWS = [
    (5, "a b", "s1", "x", 1, "t"), (3, "ab", "s2", "x", 1, "t"), (9, "a\tb ", None, None, None, None), (7, "", "s1", "", 0, ""), (1, None, "s2", "", 0, ""),
    (2, " \n", "s3", "", 0, ""), (4, "A b", "s1", "", 0, ""), (None, "a b\x0b c", "s1", "", 0, ""), (6, "abc", "s1", "", 0, ""), (8, "abc", "s1", "", 0, ""),
    (8, "abc", "s1", "", 0, ""), (10, "a b", "é", "", 0, ""), (11, "w " * 5000, "é", "", 0, ""),
]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digest", [exact.digest_of, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2)), lambda c: F.lit(b"x")])
def test_copies_against_plain_groups(spark, monkeypatch, digest):
    """Whatever the digest: with few of them, or a single one, contents decide."""
    monkeypatch.setattr(exact, "digest_of", digest)
    df = spark.createDataFrame(ROWS, DOCS).repartition(3)
    groups = defaultdict(list)
    for r in ROWS:
        groups[normal(r[1])].append(r)
    want = []
    for content, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], keep, len(rows), r[0] == keep, hashlib.sha256(content.encode()).hexdigest()) for r in rows]
    got = [tuple(r) for r in exact.mark_copies(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = exact.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(normal(r.text) for r in left.collect()) == sorted(groups)
    assert exact.mark_copies(df.limit(0)).count() == 0


def test_hot_copies_without_ids(spark):
    rows = [(None, "a hot text")] * 3000 + [(i % 7, "a  hot text") for i in range(700)] + [(i, f"own {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.mark_copies(df).where("group_size > 1").groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 3700)}
    assert sum(r["count"] for r in got) == 3700 and [r.doc_id for r in got if r.kept] == [0]
    assert exact.drop_copies(df).count() == 101


@pytest.mark.parametrize("rows_in_bucket,broadcast,digits", [(4096, 10_000, 3), (1, 0, 1)])
def test_mix_against_sql(spark, monkeypatch, rows_in_bucket, broadcast, digits):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_in_bucket)
    monkeypatch.setattr(mixing, "DIGITS", digits)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [r for r in ROWS if r[0] != 8] + [(100 + i, "w " * (i % 17), f"s{i % 5}" if i % 11 else "s1", "", 0, "") for i in range(300)]
    rows += [(1000, "", "empty", "", 0, ""), (1001, "one two", "tiny", "", 0, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(queries.OP3_SQL).fetchall()
    got = [tuple(r) for r in mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    sums, targets = defaultdict(int), {}
    largest = defaultdict(int)
    for r in mixing.mix(df).collect():
        sums[r.source] += r.taken
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(sums[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sums)


def test_repeat_takes_what_mix_says(spark):
    """One id with several texts of one size, ids that are null, rows that are equal, and columns of the plan's names."""
    rows = [(3, f"a{i} b{i} c{i}", "s", i) for i in range(400)] + [(None, f"n{i}", "s", i) for i in range(200)] + [(5, "x y", None, 0)] * 3 + [(i, "w " * (i % 9), "t", i) for i in range(100)]
    df = spark.createDataFrame([(*r, "w", "k") for r in rows], "doc_id long, text string, source string, s int, whole string, key string").repartition(4)
    out = mixing.repeat(df)
    assert out.columns == df.columns
    words = lambda d: {r.source: r.words for r in d.groupBy("source").agg(F.sum(mixing.size_of()).alias("words")).collect()}
    got, said = words(out), mixing.mix(df).collect()
    taken, target = defaultdict(int), {}
    for r in said:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert got == taken
    assert abs(got["s"] - target["s"]) <= 2 and abs(got["t"] - target["t"]) <= 4  # half of the largest document
    sizes = {r.source: r.source_size for r in said}
    assert sizes == {"s": 1400, None: 6, "t": sum(i % 9 for i in range(100))}


def test_no_words_and_repeated_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.where("doc_id in (7, 1, 2)")).collect()} == {0}
    assert mixing.mix(df).count() == len(ROWS)
    out = mixing.repeat(df)
    assert out.columns == df.columns and 0 < out.count() <= 2 * len(ROWS)
