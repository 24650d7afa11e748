import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import langid

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    model = langid.fresh(["a", "b", "c"], hidden=3, seed=1)
    for p in model.parameters():
        p += np.random.default_rng(2).normal(0, 0.1, p.shape).astype(np.float32)
    cells = [[p.astype(np.float64) for p in c] for c in model.cells]
    model = langid.Model(model.languages, cells, model.out.astype(np.float64), model.bias.astype(np.float64))
    rng = np.random.default_rng(3)
    x, y = rng.integers(60, 130, (6, 5)), rng.integers(0, 3, 5)
    _, grads = langid.loss_gradients(model, x, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up, _ = langid.loss_gradients(model, x, y)
        p[at] = old - 1e-2
        down, _ = langid.loss_gradients(model, x, y)
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.02, abs=1e-4)


def plain_probabilities(model, text):
    """One byte, one unit at a time."""
    raw, c = (text or "").encode(), len(model.languages)
    sums, letters = [0.0] * c, 0
    sig = lambda v: 1 / (1 + math.exp(-v))
    for begin in range(0, len(raw), langid.WINDOW):
        x = list(raw[begin : begin + langid.WINDOW])
        x += [32] * (langid.WINDOW - len(x))
        states = []
        for cell, order in zip(model.cells, (range(len(x)), range(len(x) - 1, -1, -1)), strict=True):
            table, u, bias = (p.astype(float) for p in cell)
            size = u.shape[1]
            h, seen = [0.0] * size, {}
            for t in order:
                rec = [sum(u[i, j] * h[j] for j in range(size)) for i in range(3 * size)]
                z = [sig(table[i, x[t]] + rec[i]) for i in range(size)]
                g = [sig(table[size + i, x[t]] + rec[size + i]) for i in range(size)]
                new = [math.tanh(table[2 * size + i, x[t]] + g[i] * (rec[2 * size + i] + bias[i, 0])) for i in range(size)]
                h = [(1 - z[i]) * new[i] + z[i] * h[i] for i in range(size)]
                seen[t] = h
            states.append(seen)
        for t in range(min(langid.WINDOW, len(raw) - begin)):
            if not langid.LETTER[x[t]]:
                continue
            both = states[0][t] + states[1][t]
            logits = [sum(model.out[k, i] * both[i] for i in range(len(both))) + model.bias[k, 0] for k in range(c)]
            e = [math.exp(v - max(logits)) for v in logits]
            sums = [a + v / sum(e) for a, v in zip(sums, e, strict=True)]
            letters += 1
    return [v / max(letters, 1) for v in sums]


def test_probabilities_equal_a_plain_network():
    model = langid.fresh(["a", "b", "c"], hidden=4, seed=9)
    for p in model.parameters():
        p += np.random.default_rng(3).normal(0, 0.2, p.shape).astype(np.float32)
    texts = ["", None, "short", "12 !", "wörter " * 30, "x" * 64, "y" * 65, "日本語 テスト"]
    got = langid.document_probabilities(model, pa.array(["other", *texts]).slice(1))
    assert got == pytest.approx(np.array([plain_probabilities(model, t) for t in texts]), abs=1e-5)


def test_ties_and_long_texts(spark):
    model = langid.fresh(["x", "y"], hidden=2)
    model.out[:], model.bias[:] = 0, 0
    rows = spark.createDataFrame([(1, "same for both"), (2, "long text " * 200_000), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in langid.predict(rows, model, ["doc_id"]).orderBy("doc_id").collect()] == [(1, "x", 0.5), (2, "x", 0.5), (3, "und", 0.0)]
    cut = langid.samples(spark.createDataFrame([("long text " * 200_000, "x"), ("ab", "y"), ("!", "y")], "text string, lang string"), 1).collect()
    assert sorted((len(r.windows), len(r.piece or b"")) for r in cut) == [(0, 0), (768, 0), (768, 768)]


def test_held_out_accuracy_nulls_and_equal_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(
        [(-1, None, "en", "s", 1), (-2, "", "de", "s", 0), (-3, "12 34 -- !", "fr", "s", 0), (None, "the and of that", None, None, None)], docs.schema
    )
    every = docs.select(*docs.columns).unionByName(more).unionByName(docs.selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars"))
    got = {r.doc_id: r for r in langid.identify(every).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if got[i].held_out]
    assert 250 < len(held) < 420
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(got[i].lang_pred == got[i + 100000].lang_pred and got[i].score == got[i + 100000].score for i in truth)
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    assert got[None].held_out and all(0 <= r.score <= 1 for r in got.values())


def test_no_rows_no_labels_and_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, score string, lang_pred int, held_out int"
    assert langid.identify(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(1, "some text", None, "s", 1, 1)], kind)
    assert [tuple(r) for r in langid.identify(rows).collect()] == [(1, langid.identify(rows).first().held_out, "und", 0.0)]
    assert langid.drop_unknown(rows).columns == rows.columns


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
]


@pytest.mark.parametrize("languages", [["de", "en", "es", "fr"], ["de", "en"], ["fr"]])
def test_unknown_texts_go_and_short_clean_ones_stay(spark, languages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(languages))
    draw = np.random.default_rng(7)
    noise = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz     "), 150)) for _ in range(20)]
    clean = docs.where("length(text) > 400 and text not like '%###%'").select("doc_id", "text").orderBy("doc_id").limit(20).collect()
    short = [" ".join(r.text.split()[:12]) for r in clean]
    planted = [*zip(range(-100, 0), [*FOREIGN, *noise]), *zip(range(-200, -100), short)]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in planted], docs.schema)
    kept = {r.doc_id for r in langid.drop_unknown(docs.unionByName(more)).select("doc_id").collect()}
    assert not {i for i in kept if -100 <= i < 0}
    assert len({i for i in kept if i < -100}) >= len(short) - 1
    assert len({i for i in kept if i >= 0}) >= 0.99 * docs.count()


def test_letters_stay_if_no_language_was_learnt(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.drop_unknown(rows).collect()] == [1]
