"""Token ids of whole columns of text, with the tokenizers library.

The ids are those of the library for the whole text, without special tokens around it. Strings of special tokens
inside a text are what the library takes them for, or ordinary text if asked for.

For vocabularies that drop white space and split words as ``FORM`` says, a text is encoded piece by piece: white space never
joins two pieces, so each distinct piece goes through the library once per worker and its ids are looked up
after that. Pieces hold every character of the text but ASCII white space. Texts with the string of a special token,
and all texts for other vocabularies, go through the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 1_500_000
#: Bytes of text that are cut into pieces at once.
SLICE = 8 << 20

# The normaliser and the splitter of words of the vocabularies that are encoded piece by piece.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_encoders: dict[tuple[str, bool], Encoder] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts. ``encode`` gives ids (unsigned 16 bit) and the end of each text in them."""

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        pa.set_cpu_count(1)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        spec = json.loads(self.library.to_str())
        added = spec["added_tokens"]
        self.by_piece = all(spec[k] == v for k, v in FORM.items()) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in added)
        self.special = None if ordinary or not added else "|".join(re.escape(t["content"]) for t in added)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # Lower-case words need neither normalising nor splitting: the same model without these steps.
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "WhitespaceSplit"},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        }
        self.words = Tokenizer.from_str(json.dumps(spec))
        self.words.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint16)
        self.ends = np.zeros(1, np.int64)

    def learn(self, pieces: pa.Array) -> None:
        """Adds the ids of pieces, words first."""
        plain = pc.match_substring_regex(pieces, "^[a-zß-öø-ÿ]+$")
        for some, encode in (
            (pieces.filter(plain), lambda x: self.words.encode(" ".join(x), add_special_tokens=False)),
            (
                pieces.filter(pc.invert(plain)),
                lambda x: self.whole.encode(x, is_pretokenized=True, add_special_tokens=False),
            ),
        ):
            ids, ends = [self.ids], [self.ends]
            for at in range(0, len(some), 1000):
                chunk = some.slice(at, 1000).to_pylist()
                got = encode(chunk)
                ids.append(np.array(got.ids, np.uint16))
                n = np.bincount(np.array(got.word_ids, np.int64), minlength=len(chunk))
                ends.append(ends[-1][-1] + np.cumsum(n))
            self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)
            self.known = pa.concat_arrays([self.known, some])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return self.by_library(texts)
        if self.special is None or not pc.any(asis := pc.match_substring_regex(texts, self.special)).as_py():
            return self.by_pieces(texts)
        ids, ends = self.by_pieces(pc.if_else(asis, "", texts))
        some, cuts = self.by_library(texts.filter(asis))
        at = np.flatnonzero(asis.to_numpy(zero_copy_only=False))
        sizes = np.diff(cuts, prepend=0)
        grown = np.zeros(len(ends), np.int64)
        grown[at] = sizes
        return np.insert(ids, np.repeat(ends[at], sizes), some), ends + np.cumsum(grown)

    def by_library(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x.ids, np.uint16) for x in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint16), *got]), np.cumsum([len(x) for x in got], dtype=np.int64)

    def by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        # Combining marks may merge with a letter before it is lower-cased: such texts stay as they are.
        marked = pc.match_substring_regex(texts, r"\p{M}")
        lower = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])(\s|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(pc.if_else(marked, texts, lower))
        pieces = lists.flatten()
        keep = pc.not_equal(pieces, "")
        last = lists.offsets.to_numpy()[1:]
        last = last - lists.offsets.to_numpy()[0]
        if not pc.all(keep).as_py():
            last = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[last]
            pieces = pieces.filter(keep)
        coded = pieces.dictionary_encode()
        new = coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, value_set=self.known)))
        if len(new):
            self.learn(new)
        at = pc.index_in(coded.dictionary, value_set=self.known).to_numpy()
        at = at[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        start, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(start - ends + n, n)]
        return ids, np.concatenate([[0], ends])[last]


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One for each vocabulary and worker."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = Encoder(path, ordinary)
    return _encoders[path, ordinary]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def documents_ids(texts: pa.Array, path: str, end_id: int | None = 1, ordinary: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text followed by ``end_id``, and where each text's ids end."""
    ids, ends = encoder(path, ordinary).encode(texts)
    if end_id is None:
        return ids, ends
    return np.insert(ids, ends, np.uint16(end_id)), ends + np.arange(1, len(ends) + 1)


def binaries(ids: np.ndarray, ends: np.ndarray, kind: type = np.uint16) -> pa.Array:
    """A binary value for each run of ids."""
    data = np.ascontiguousarray(ids, dtype=np.dtype(kind).newbyteorder("<"))
    offsets = np.concatenate([[0], ends]) * data.dtype.itemsize
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    raw = data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())


def flat(column: pa.Array) -> np.ndarray:
    """The 16-bit ids of all values of a binary column, one after the other."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint16)
    return np.frombuffer(data, "<u2", count=(ends[-1] - ends[0]) // 2, offset=ends[0])
