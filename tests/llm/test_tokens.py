import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexdrift.llm import packing, token_files, tokens

DOCS = "doc_id long, text string, lang string, ids string, part long"
TEXTS = [
    "", None, "Hello, world. It's a   test\n\n'sting ,, .. a.b c.,", "ÀÉ où ß straße İstanbul ΑΣ é é", " nbsp x\x1c y\x85z",
    "<|endoftext|> </s> <|startoftext|>x", "Ǆ ǰ J̌ K Å", "日本語 テスト 123 4a5b", "😀 ok 👍🏽!", "word " * 5000, "a" * 20000, "x",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.vocabulary_path())  # as it comes: strings of special tokens in texts are special
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_those_of_whole_texts(reference):
    rng = random.Random(3)
    letters = "abC, .'\n\tÉß1́?İ"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(500)]
    for _ in range(2):  # the second time from what is remembered
        ids, ends = tokens.documents_ids(pa.array(texts, pa.string()), tokens.vocabulary_path())
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [reference(t) for t in texts]


@pytest.mark.parametrize("ordinary", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_vocabulary_and_ordinary_special_strings(name, ordinary):
    plain = Tokenizer.from_file(tokens.vocabulary_path(name))
    plain.encode_special_tokens = ordinary
    texts = [*TEXTS, "<|endoftext|> x", "a<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", None, "plain words here", " <|endoftext|> "]
    ids, ends = tokens.documents_ids(pa.array(texts, pa.string()), tokens.vocabulary_path(name), None, ordinary)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_set_round_trip(spark, tmp_path, reference):
    rows = [(i * 3, t, "en", "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None), (3, None, "", "", 0), (6, TEXTS[2], "", "", 0)]
    out = f"file://{tmp_path}/set"
    token_files.write_tokens(spark.createDataFrame(rows, DOCS).repartition(3), out)
    got = token_files.read_tokens(spark, out).collect()
    want = sorted(((r[0] is not None, r[0] or 0, crc(reference(r[1]))) for r in rows))
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert [r.doc_id for r in got] == [r[1] if r[0] else None for r in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == want


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    token_files.write_tokens(none, f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").count() == 0
    assert packing.pack(none).count() == 0


def test_segments_decode_alone_and_damage_shows():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (63, 9), (5000, 90), (700_000, 5000), (700_000, 600_000)):
        ids = (rng.geometric(0.01, n) % 5000).astype(np.uint16)
        cuts = np.unique(rng.integers(0, n, max(1, 2 * n // most)))
        sizes = np.diff(np.concatenate([[0], cuts[cuts > 0], [n]]))
        coder = token_files.Coder(token_files.quantise(np.bincount(ids, minlength=1 << 16)))
        segments = list(coder.segments(ids, sizes))
        of = lambda x: {k: x[k] for k in ("n", "lanes", "skip", "left", "words", "states", "checksum")}
        assert sorted(x["documents"] for x in segments)[0][0] == 0 and sum(j - i for i, j in (x["documents"] for x in segments)) == len(sizes)
        for x in reversed(segments):
            assert np.array_equal(coder.decode(**of(x)), ids[x["at"] : x["at"] + x["n"]])
    some = of(segments[0])
    for bad in (some["words"][:-4], some["words"][:1000] + bytes([some["words"][1000] ^ 1]) + some["words"][1001:]):
        with pytest.raises(ValueError):
            coder.decode(**some | {"words": bad})
    words = sum(len(x["words"]) for x in coder.segments(ids, np.full(n // 100, 100)))
    assert words < 1.25 * n  # 16 bits an id before


def test_quantise_keeps_rare_ids():
    table = token_files.quantise(np.array([1, 10**12, 0, 1]))
    assert table.sum() == 1 << token_files.SCALE and table[0] >= 1 and table[2] == 0


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 17, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (k == len(room))
            want[int(i)] = (k, 100 - room[k])
            room[k] -= sizes[i]
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


def test_packing_holds_each_id_once(spark, reference):
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None), (2, TEXTS[2], "", "", 0)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), room=64).collect()
    docs, sequences = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id != 2:
            docs.setdefault(r.doc_id, []).append((r.start, r.ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for i, text, *_ in rows:
        if i != 2:
            ids = b"".join(x for _, x in sorted(docs[i]))
            assert ids == np.array(reference(text), "<u4").tobytes()
    assert sum(r.length for r in got if r.doc_id == 2) == 2 * len(reference(TEXTS[2]))
