import itertools

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexdrift.llm import queries
from lexdrift.llm.common import documents, staged

from .test_exact_mixing import normal
from .test_near import brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = documents(spark, SF)
    more = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 !", "en", "src1", 4)], docs.schema)
    rows = [docs.unionByName(more)]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(staged(stage(spark, rows[-1], SF)))
    return rows


def test_all_but_the_last_keep_the_columns(outputs):
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns


def test_language_keeps_all_with_letters(outputs):
    before, after = ({r.doc_id: r for r in df.collect()} for df in outputs[:2])
    assert not {-1, -2} & set(after)
    assert len(after) >= 0.97 * len(before) and set(after) <= set(before)


def test_copies_go(outputs):
    before, after = outputs[1].collect(), outputs[2].collect()
    best = {}
    for r in before:
        best[normal(r.text)] = min(best.get(normal(r.text), (0, 1 << 62)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(i for _, i in best.values())


def test_near_copies_go(outputs):
    want = brute_force([(r.doc_id, r.text) for r in outputs[2].collect()], 80)
    assert sorted(r.doc_id for r in outputs[3].collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_mixture_takes_what_sql_says(outputs):
    con = duckdb.connect()
    con.register("documents", outputs[3].toArrow())
    want = {r[0]: r for r in con.sql(queries.OP3_SQL).fetchall()}
    got = {r.doc_id: r["count"] for r in outputs[4].groupBy("doc_id").count().collect()}
    for doc_id, size, _, _, taken in want.values():
        assert got.get(doc_id, 0) * size == taken


def test_packing_holds_each_document(outputs):
    pieces = outputs[5].collect()
    times = {r.doc_id: r["count"] for r in outputs[4].groupBy("doc_id").count().collect()}
    held = {}
    for r in pieces:
        held.setdefault(r.doc_id, []).append(r)
    assert set(held) == set(times)
    for doc_id, rows in held.items():
        assert sum(r.length for r in rows) == times[doc_id] * rows[0].doc_tokens
    for _, rows in itertools.groupby(sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        rows = list(rows)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1] and rows[-1].offset + rows[-1].length <= 2048


def test_run_gives_the_stages_result(spark, outputs):
    columns = ["doc_id", "start", "length", "sequence_id", "offset"]
    direct = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES:
        direct = staged(stage(spark, direct, SF))
    a, b = ({tuple(r) for r in df.select(*columns).collect()} for df in (direct, corpus_pipeline.run(spark, SF)))
    assert a == b
    assert corpus_pipeline.run(spark, SF).where(F.col("length") <= 0).count() == 0


def test_repeated_ids_clashing_columns_and_empty_tables(spark):
    """One id with several texts, ids that are null, equal rows, empty and very long texts; then nothing at all."""
    docs = documents(spark, SF)
    long = " ".join(f"long{i % 4000} text{i % 977}" for i in range(40_000))
    base = [r.text for r in docs.where("length(text) > 500").orderBy("doc_id").limit(3).collect()]
    rows = [(7, base[0]), (7, base[1]), (None, base[2]), (None, base[2] + " and more"), (None, ""), (9, long), (9, None), (9, long)]
    names = {c: c[0] for c in ("part", "__id", "name", "Key", "_key", "__key", "time", "s", "whole", "cutoff", "id", "sha", "digest", "salt", "held", "plain", "lettered", "shingles", "ids", "start", "size", "taken")}
    wide = lambda df: df.select("*", *(F.lit(v).alias(k) for k, v in names.items()))
    df = wide(spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], docs.schema)).unionByName(wide(docs))
    steps = [df]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(staged(stage(spark, steps[-1], SF)))
        assert steps[-1].columns == df.columns
        assert steps[-1].where(" or ".join(f"{c} is distinct from '{v}'" for c, v in names.items())).isEmpty()
    kept = {r.text for r in steps[3].collect()}
    assert len(kept) == steps[3].count()
    assert {base[0], base[1]} <= kept and (base[2] in kept or base[2] + " and more" in kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, steps[4], SF)
    assert pieces.agg(F.sum("length")).first()[0] > 0
    none = df.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = staged(stage(spark, none, SF))
        assert none.columns == df.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_a_language_rejects_what_brute_force_rejects(spark, outputs):
    """The share of the background class, document by document."""
    from lexdrift.llm import langid

    rows = outputs[0].select("*", langid.held_out().alias("held"))
    model = langid.fit(rows.where(~F.col("held")), with_background=True)
    at = model.languages.index(langid.BACKGROUND)
    want = set()
    for r in outputs[0].collect():
        if r.text and any(c.isalpha() for c in r.text):
            if langid.document_probabilities(model, pa.array([r.text]))[0, at] <= 0.5:
                want.add(r.doc_id)
    assert {r.doc_id for r in outputs[1].collect()} == want
