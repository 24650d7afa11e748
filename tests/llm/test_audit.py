import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from lexdrift.llm import audit, queries

DOCS = "doc_id long, text string, source string, part string, mask string, digest int, salt string"
LABELS = "doc_id long, quality int, toxic int, good string"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Über", "ABC", "a$b", "x|y", "é"]
    rows = [(None, "hot copy", None), (None, None, "s"), (1, None, None), (2, "", ""), (3, " \t\n", "s"), (3, " \t\n", "s"), (3, "other", "s"), (4, "other", "t")]
    for i in range(5, 300):
        text = rng.choice([" ", "\n", "\x0b"]).join(rng.choices(words[: rng.choice([5, 60, 405])], k=rng.choice([1, 30, 199, 200, 201, 500])))
        rows.append((i, rng.choice([text, "hot copy", text.upper(), text.replace("$", "").replace("|", "")]), rng.choice(["s", "t", "", None, "é"])))
    rows.append((301, "word " * 200_000, "long"))
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for i in range(0, 310, 2)] + [(None, 1, 1), (8, 1, 0), (8, 0, 1), (9999, 1, 1)]
    return rows, labels


def fails_of(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield "".join(
            letter
            for letter, failed in zip(
                "ABCDE",
                (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), i is not None and i > least[t]),
                strict=True,
            )
            if failed
        )


def brute_force(rows, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    by_part = {}
    for (i, _, s), fails in zip(rows, fails_of(rows), strict=True):
        by_part.setdefault(s or "", []).append((i in good, i in toxic, fails))
    out = {}
    for part, docs in by_part.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[2]]
                left = [d for d in left if letter not in d[2]]
                redundant = sum(letter in d[2] for d in gone)
                gone = gone + here
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(d[2] == letter for d in docs), sum(d[0] for d in here), sum(d[1] for d in here)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "p", "m", 1, "x") for r in rows], DOCS).repartition(5)
    return rows, labels, docs, spark.createDataFrame([(*r, "g") for r in labels], LABELS).repartition(3)


def test_audit_equals_walks_of_all_orders(tables):
    rows, labels, docs, marks = tables
    got = audit.audit(docs, marks)
    assert got.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")] and {k for _, k in got.dtypes[3:]} == {"bigint"}
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == brute_force(rows, labels)


def test_audit_equals_sql(tables):
    _, _, docs, marks = tables
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", marks.toArrow())
    got = audit.audit(docs, marks)
    want = con.sql(queries.OP11_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty_tables(spark, tables):
    _, _, docs, marks = tables
    assert audit.audit(docs.limit(0), marks).count() == 0
    got = audit.audit(docs.where("doc_id = 4"), marks.limit(0)).collect()
    assert len(got) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in got)
    assert {r.kept for r in got if r.step == 5} == {0}  # short: A takes it, here or before


def test_zeta_sums_subsets():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, (2, 3, 16))
    want = [counts[..., [s for s in range(16) if s & ~m == 0]].sum(-1) for m in range(16)]
    assert (audit.zeta(counts) == np.stack(want, -1)).all()


def test_other_numbers_of_filters(spark):
    rng = random.Random(5)
    masks = [rng.randrange(8) for _ in range(500)]
    rows = spark.createDataFrame([("p", m, m % 2 == 0, False) for m in masks], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): r for r in audit.interactions(audit.mask_counts(rows), "xyz").collect()}
    assert len(got) == 18
    for order in itertools.permutations("xyz"):
        left = masks
        for step, letter in enumerate(order, 1):
            bit = 1 << "xyz".index(letter)
            here, left = [m for m in left if m & bit], [m for m in left if not m & bit]
            r = got["".join(order), step]
            assert (r.removed, r.kept, r.good_lost) == (len(here), len(left), sum(m % 2 == 0 for m in here))
    with pytest.raises(ValueError):
        audit.interactions(None, "ABCDEFG")


def test_no_filter_for_copies(tables):
    rows, _, docs, marks = tables
    got = audit.masks(docs, marks, copies_bit=None)
    assert got.count() == len(rows) and got.where("mask >= 16").count() == 0
