"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are read as UTF-8 in windows of ``WINDOW`` bytes, all of them; a forward and a backward GRU
run over each window and label every byte. A document's probabilities are the mean over its bytes that
belong to letters. Training is back-propagation through time with Adam on windows of a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import free_names
from .tokens import slices

WINDOW, HIDDEN = 64, 8
#: Windows that run through the network at once.
LANES = 4096
#: Labelled documents of each language, about, in the training sample, and windows drawn from each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 150, 12
#: Languages a model learns at most; more are an error.
MOST_LANGUAGES = 200
STEPS, BATCH, RATE, SEED = 220, 256, 0.02, 5
#: The class of what is no known language, and the size and steps of a model that has it.
BACKGROUND, BACKGROUND_HIDDEN, BACKGROUND_STEPS = "\0", 16, 300

#: Bytes that may belong to a letter: ASCII letters and those of longer UTF-8 sequences.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """``cells``: for each direction the byte table (3H, 256), recurrent weights (3H, H) and bias of the candidate (H).

    Rows: update gate, reset gate, candidate. ``out``: weights (C, 2H), ``bias`` (C).
    """

    languages: list[str]
    cells: list[list[np.ndarray]]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.cells[0], *self.cells[1], self.out, self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
    draw = np.random.default_rng(seed)
    normal = lambda s, *shape: (draw.standard_normal(shape) * s).astype(np.float32)
    cells = [[normal(0.3, 3 * hidden, 256), normal(hidden**-0.5, 3 * hidden, hidden), np.zeros((hidden, 1), np.float32)] for _ in range(2)]
    return Model(languages, cells, normal(0.3, len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run(cell: list[np.ndarray], x: np.ndarray, back: bool, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, H, B) of a cell over bytes x (T, B), and what back-propagation needs."""
    table, u, bias = cell
    t_max, lanes = x.shape
    h_size = u.shape[1]
    states = np.empty((t_max, h_size, lanes), np.float32)
    h = np.zeros((h_size, lanes), np.float32)
    tape = []
    for t in range(t_max - 1, -1, -1) if back else range(t_max):
        a = np.take(table, x[t], axis=1)
        r = u @ h
        gates = sigmoid(a[: 2 * h_size] + r[: 2 * h_size])
        z, g = gates[:h_size], gates[h_size:]
        inner = r[2 * h_size :] + bias
        c = np.tanh(a[2 * h_size :] + g * inner)
        if keep:
            tape.append((t, h, z, g, inner, c))
        h = c + z * (h - c)
        states[t] = h
    return states, tape


def unrun(cell: list[np.ndarray], x: np.ndarray, tape: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of a cell from those of its states."""
    table, u, bias = cell
    h_size = u.shape[1]
    d_table, d_u, d_bias = np.zeros_like(table), np.zeros_like(u), np.zeros_like(bias)
    dh = np.zeros_like(grad[0])
    for t, h, z, g, inner, c in reversed(tape):
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dg = dc * inner * g * (1 - g)
        di = dc * g
        rows = np.concatenate([dz, dg, di])
        d_u += rows @ h.T
        d_bias += di.sum(1, keepdims=True)
        pre = np.concatenate([dz, dg, dc])
        order = np.argsort(x[t], kind="stable")
        found, first = np.unique(x[t][order], return_index=True)
        d_table[:, found] += np.add.reduceat(pre[:, order], first, axis=1)
        dh = dh * z + u.T @ rows
    return [d_table, d_u, d_bias]


def forward(model: Model, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Probabilities (T, C, B) for bytes x (T, B)."""
    ahead, tape_a = run(model.cells[0], x, False, keep)
    back, tape_b = run(model.cells[1], x, True, keep)
    both = np.concatenate([ahead, back], axis=1)
    logits = model.out @ both + model.bias
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits, [both, tape_a, tape_b]


def loss_gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions whose byte is of a letter, and its gradients."""
    p, (both, tape_a, tape_b) = forward(model, x, keep=True)
    mask = LETTER[x].astype(np.float32)
    total = max(float(mask.sum()), 1.0)
    lanes = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, y, lanes] + 1e-12) * mask).sum() / total)
    d = p.copy()
    d[:, y, lanes] -= 1
    d *= mask[:, None, :] / total
    d_out = np.einsum("tcb,thb->ch", d, both)
    d_bias = d.sum((0, 2))[:, None]
    d_both = model.out.T @ d
    h = model.out.shape[1] // 2
    return loss, [*unrun(model.cells[0], x, tape_a, d_both[:, :h]), *unrun(model.cells[1], x, tape_b, d_both[:, h:]), d_out, d_bias]


def background(pieces: list[bytes], seed: int) -> list[bytes]:
    """The pieces with other letters, in turn: shuffled, replaced one for one, random, of another script.

    What isn't a letter stays. Letters replaced one for one stand for languages that aren't in ``pieces``.
    """
    draw = np.random.default_rng(seed)
    latin, size = np.flatnonzero(LETTER[:128]), SAMPLE_WINDOWS * WINDOW
    out = []
    for n, piece in enumerate(pieces):
        part = np.frombuffer(piece, np.uint8).copy()
        letters = LETTER[part]
        if n % 4 == 0:
            part[letters] = draw.permutation(part[letters])
        elif n % 4 == 1:
            table, order = np.arange(256, dtype=np.uint8), draw.permutation(26)
            table[65:91], table[97:123], table[128:] = 65 + order, 97 + order, draw.permutation(np.arange(128, 256))
            part = table[part]
        elif n % 4 == 2:
            part[letters] = draw.choice(latin, int(letters.sum()))
        else:
            # scripts of two or three bytes a letter, and of three, by turns
            base = int(draw.integers(0x370, 0x1000) if n % 8 == 3 else draw.integers(0x1000, 0xD000))
            other = iter((base + draw.integers(0, 60, int(letters.sum()))).tolist())
            part = np.frombuffer("".join(chr(next(other) if k else b) for b, k in zip(part.tolist(), letters.tolist(), strict=True)).encode()[:size], np.uint8)
        out.append(part.tobytes())
    return out


def windows_of(raw: bytes, draw: np.random.Generator) -> np.ndarray:
    """``SAMPLE_WINDOWS`` windows (.., WINDOW) of a text at random places, filled with spaces; none if it has no letter."""
    text = np.frombuffer(raw, np.uint8)
    if not LETTER[text].any():
        return np.zeros((0, WINDOW), np.uint8)
    padded = np.concatenate([text, np.full(WINDOW, 32, np.uint8)])
    at = draw.integers(0, max(1, len(text) - WINDOW + 1), SAMPLE_WINDOWS)
    return padded[at[:, None] + np.arange(WINDOW)]


def samples(drawn: DataFrame, seed: int) -> DataFrame:
    """(lang, windows, piece) of ``drawn`` (text, lang): a text's windows, and a piece as long as all of them, null for texts up to 40 characters.

    Cut where the texts are: what leaves a task is of bounded size for each text, however long that is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SAMPLE_WINDOWS * WINDOW
        for batch in batches:
            windows, pieces = [], []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes()
                draw = np.random.default_rng([seed, zlib.crc32(raw), len(raw)])
                windows.append(windows_of(raw, draw).tobytes())
                at = int(draw.integers(0, max(1, len(raw) - size + 1)))
                pieces.append(raw[at : at + size] if len(text.as_py()) > 40 else None)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(windows, pa.binary()), pa.array(pieces, pa.binary())], ["lang", "windows", "piece"])

    return drawn.select("lang", "text").mapInArrow(work, "lang string, windows binary, piece binary")


def train(windows: list[np.ndarray], labels: list[str], steps: int = STEPS, seed: int = SEED, hidden: int = HIDDEN) -> Model:
    """A model of the languages in ``labels`` from each text's windows (.., WINDOW); deterministic."""
    model = fresh(sorted(set(labels)), hidden, seed)
    draw = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(model.languages)}
    by_class: list[list[np.ndarray]] = [[] for _ in number]
    for some, label in zip(windows, labels, strict=True):
        by_class[number[label]].append(some)
    pools = [np.concatenate(x) for x in by_class]
    pools = [x if len(x) else np.full((1, WINDOW), 32, np.uint8) for x in pools]
    parameters = model.parameters()
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1 if number else 1):
        y = draw.integers(0, len(pools), BATCH)
        x = np.stack([pools[k][draw.integers(len(pools[k]))] for k in y]).T.astype(np.int64)
        _, grads = loss_gradients(model, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, m, s in zip(parameters, grads, mean, square, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def document_probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean probabilities (documents, C) over the bytes of letters; a text without any gets zeros."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8, count=int(ends[-1] - ends[0]), offset=int(ends[0])) if len(texts) and data is not None else np.zeros(0, np.uint8)
    ends = ends - (ends[0] if len(ends) else 0)
    sizes = np.diff(ends)
    pieces = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = ends[doc] + number * WINDOW
    length = np.minimum(ends[doc + 1] - begin, WINDOW)
    padded = np.concatenate([raw, np.full(WINDOW, 32, np.uint8)])
    sums = np.zeros((len(sizes), len(model.languages)))
    weight = np.zeros(len(sizes))
    step = np.arange(WINDOW)
    for a in range(0, len(doc), LANES):
        b, n, d = begin[a : a + LANES], length[a : a + LANES], doc[a : a + LANES]
        x = padded[np.minimum(b + step[:, None], len(raw))]
        inside = step[:, None] < n
        x = np.where(inside, x, np.uint8(32))
        p, _ = forward(model, x)
        mask = (LETTER[x] & inside).astype(np.float32)
        pooled = (p * mask[:, None, :]).sum(0)
        for c in range(len(model.languages)):
            sums[:, c] += np.bincount(d, pooled[c], len(sizes))
        weight += np.bincount(d, mask.sum(0), len(sizes))
    return sums / np.maximum(weight, 1)[:, None]


def fit(docs: DataFrame, docs_each: int = SAMPLE_DOCS, seed: int = SEED, with_background: bool = False) -> Model:
    """A model from ``docs`` (text, lang), of which about ``docs_each`` of each language are drawn by a hash of the text.

    Rows without text or lang are not used; without any the model knows no language. ``with_background`` adds the class
    ``BACKGROUND``, if there are texts to make it of.
    """
    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.lit(0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, int(min(1.0, docs_each / n) * (1 << 30))).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) < share)
    # A text with many copies is drawn once: the sample stays about docs_each * languages.
    drawn = samples(drawn.groupBy("text", "lang").count(), seed).collect()
    drawn.sort(key=lambda r: (r.lang, bytes(r.windows), bytes(r.piece or b"")))
    windows, labels = [np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW) for r in drawn], [r.lang for r in drawn]
    if not with_background:
        return train(windows, labels, seed=seed)
    draw = np.random.default_rng(seed)
    more = [windows_of(x, draw) for x in background([bytes(r.piece) for r in drawn if r.piece is not None], seed)]
    return train([*windows, *more], [*labels, *[BACKGROUND] * len(more)], BACKGROUND_STEPS, seed, BACKGROUND_HIDDEN)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the predicted language and its score (to 6 digits), called ``names``, from ``text`` alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, letters_ = free_names(docs, "plain", "lettered")
    plain = docs.select(*keep, F.col("text").alias(text), F.col("text").rlike(r"\p{L}").alias(letters_))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        called = np.array([*model.languages, "und"], dtype=object)
        for whole in batches:
            for batch in slices(whole, text):
                if model.languages:
                    p = document_probabilities(model, batch.column(text))
                    best, score = p.argmax(1), np.round(p.max(1), 6)
                else:
                    best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
                letters = pc.fill_null(batch.column(letters_), False).to_numpy(zero_copy_only=False) & bool(model.languages)
                best = np.where(letters, best, len(model.languages))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(called[best], pa.string()), pa.array(np.where(letters, np.minimum(score, 1.0), 0.0))],
                    [*keep, *names],
                )

    return plain.mapInArrow(work, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; without an id it is."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Of languages with equal probabilities the first in order is predicted.
    The model learns from the rows that aren't held out; see :func:`fit` and :func:`predict` for nulls.
    Equal texts get equal predictions; no documents give no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(docs, fit(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])


def drop_unknown(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """``docs`` without documents that have no letter or whose share of ``BACKGROUND`` is over ``most``; all columns stay.

    The share doesn't depend on the number of languages. If no language was learnt all documents with letters stay.
    """
    model = fit(docs.where(~held_out()), with_background=True)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if BACKGROUND not in model.languages:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value.languages.index(BACKGROUND)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(document_probabilities(shared.value, batch.column("text"))[:, at] <= most))
        pa.default_memory_pool().release_unused()

    return lettered.mapInArrow(work, docs.schema)
