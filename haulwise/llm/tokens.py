"""Token ids of whole texts with a public tokenizer file.

The ``tokenizers`` library spends most of its time on normalising with offsets, which nobody needs here. For files whose
normaliser and splitter are the lower-casing word kind (`WORD_NORMALIZER`, `WORD_SPLITTER`), texts of plain Latin characters
are therefore lower-cased, split at blanks and coded as indices of their different pieces by Arrow; only a batch's different pieces
are looked up, and only words not met before go through the library's model, joined by blanks. The ids of all places are then
gathered by index. All other texts, and all other files, go through the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What the fast way imitates.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Characters whose lower case, composition and class are beyond doubt: ASCII and the Latin-1 letters, signs of French and German print.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xffŒœ–—‘’“”…\xab\xbb\xa1\xbf]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Entries of each of the two generations of a cache.
MAX_CACHED = 300_000
# Characters of texts that are split at a time, unless one text has more.
SPLIT_AT_ONCE = 4 << 20
SINGLE_SIGNS = frozenset(".,;:!?)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next sign from U+0100."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(0x100 + n) for n, b in enumerate(others)}


def _words(piece: str) -> list[str]:
    if not piece:
        return []
    if piece.isalpha():
        return [piece]
    if piece[-1] in SINGLE_SIGNS and piece[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return WORDS.findall(piece)


class Cache:
    """A mapping that forgets what has not been asked for since it was last full."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.young[key] = found
        return found

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value

    def trim(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class Encoder:
    """Callable: list of texts to one bytes object of little-endian unsigned 32-bit ids per text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.marks = [token["content"] for token in rules.get("added_tokens") or ()]
        model = rules["model"]
        self.by_word = (
            rules.get("normalizer") == WORD_NORMALIZER and rules.get("pre_tokenizer") == WORD_SPLITTER
            and rules.get("post_processor") is None and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
            and not model.get("continuing_subword_prefix")
        )
        # Ids of pieces between blanks and of words.
        self.met = Cache(MAX_CACHED)
        if self.by_word:
            lean = Tokenizer(self.whole.model)
            lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.lean = lean
            vocabulary = model["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            self.letters = _byte_letters()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for row, text in enumerate(texts):
            if self._is_plain(text):
                plain.append(row)
            else:
                out[row] = self._whole(text)
        for rows in _groups(plain, texts):
            for row, ids in zip(rows, self._by_piece([texts[row] for row in rows]), strict=True):
                out[row] = ids
        self.met.trim()
        return out

    def _is_plain(self, text: str) -> bool:
        return self.by_word and PLAIN.fullmatch(text) is not None and not any(mark in text for mark in self.marks)

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts, from those of what lies between their blanks."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = split.values.dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        places = coded.indices.to_numpy()
        lengths = sizes[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        shift = (np.cumsum(sizes) - sizes)[places] - ends[:-1]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        raw = flat[np.arange(ends[-1]) + np.repeat(shift, lengths)].tobytes()
        borders = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[start:end] for start, end in zip(borders, borders[1:], strict=False)]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; those not met before come from their words."""
        young, old = self.met.young.get, self.met.get
        found = [young(piece) or old(piece) for piece in pieces]
        new = [row for row, ids in enumerate(found) if ids is None]
        split = [_words(pieces[row]) for row in new]
        get = self.met.get
        # The word of a piece that is one word is that piece, of which it is known that it is new.
        learned = self._learn({word for of in split for word in of if len(of) == 1 or get(word) is None})
        for row, of in zip(new, split, strict=True):
            if len(of) == 1:
                found[row] = learned[of[0]]
            else:
                found[row] = b"".join([learned.get(word) or get(word) for word in of])
                self.met.put(pieces[row], found[row])
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words by the library's model."""
        if not words:
            return {}
        joined = " ".join(words)
        if not joined.isascii():
            joined = " ".join([word if word.isascii() else word.encode().decode("latin-1").translate(self.letters) for word in words])
        ids = np.array(self.lean.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            raise ValueError(f"{len(words)} words gave {len(ends)} word ends")
        raw = ids.tobytes()
        learned = {word: raw[start:end] for word, start, end in zip(words, [0, *ends], ends, strict=False)}
        self.met.young |= learned
        return learned


def _groups(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Rows in groups of at most SPLIT_AT_ONCE characters, or one text."""
    group, held = [], 0
    for row in rows:
        if group and held + len(texts[row]) > SPLIT_AT_ONCE:
            yield group
            group, held = [], 0
        group.append(row)
        held += len(texts[row])
    if group:
        yield group


def merged(batches: Iterator[pa.RecordBatch], text: int, size: int = SPLIT_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts (column number ``text``) have ``size`` bytes: the more texts, the fewer pieces are new."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(text).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _groups(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Rows in groups of at most SPLIT_AT_ONCE characters, or one text."""
    group, held = [], 0
    for row in rows:
        if group and held + len(texts[row]) > SPLIT_AT_ONCE:
            yield group
            group, held = [], 0
        group.append(row)
        held += len(texts[row])
    if group:
        yield group


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
