"""Token ids of whole texts by the tokenizers library, remembered word by word.

For a tokenizer that drops white space (its pieces never span two words), the ids
of a text are the ids of its words one after the other. Words repeat, so a worker
keeps what the library gave for each word, and for each part of a word that has several
between punctuation; a table that holds LIMIT entries becomes the old one behind a new one.
A file is taken word by word only if its normaliser and its split are those of WORDWISE
and its added tokens begin with "<|"; the library encodes whole texts for any other file.

Many texts at once (``encode_all``) are cut into words, and words between a letter and a mark,
by their bytes; each distinct piece of a run of texts is looked up once and its ids are gathered.
The library gets new words of letters as one list of parts, and a part ends with a token that ends in LAST.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from acrelens.llm.worker import ROWS, remembered

LIMIT = 200_000
#: What the vocabulary writes behind the last token of a part.
LAST = "</w>"
#: New words that the library gets at once.
ASKED = 1000
#: The id that ends each document.
END = 1
# What a tokenizer file says of its normaliser and split, where words can be taken one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_PLAIN = re.compile(rb"[!-&(-~]+").fullmatch
_MARKS = (b".", b",", b";", b":", b"!", b"?")
#: Ends in a letter up to U+024F; the signs for times and divided by are none, and a dotted I gets its dot as a mark.
_ENDS_IN_LETTER = re.compile(rb"(?s).*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])").fullmatch
#: Whether two bytes end in such a letter of two bytes.
_LONG_LETTER = np.array([b >= 128 and _ENDS_IN_LETTER(bytes([a, b])) is not None for a in range(256) for b in range(256)])
_LATIN = re.compile("[!-&(-~\u00a1-\u024f]+").fullmatch
#: Texts are worked on together up to this many bytes; a longer one is encoded by itself.
RUN = 4 << 20
# Kinds of bytes: white space, ASCII letter, apostrophe, another ASCII byte, part of a longer character.
_SPACE, _LETTER, _APOSTROPHE, _OTHER, _LONG = range(5)


def _kind(byte: int) -> int:
    if byte >= 128:
        return _LONG
    return _SPACE if byte in b" \t\n\x0b\x0c\r" else _LETTER if bytes([byte]).isalpha() else _APOSTROPHE if byte == 39 else _OTHER


_KINDS = bytes(map(_kind, range(256)))
# By the kinds of two neighbours, whether a piece begins at the second. No mark is cut from a mark, for they are one part,
# nor an apostrophe from what follows it. A cut stands before an ASCII byte, which nothing before it is composed with.
_CUTS = {_LETTER << 3 | _OTHER, _LETTER << 3 | _APOSTROPHE, _OTHER << 3 | _LETTER}
_BEGINS = bytes(pair in _CUTS or (pair >> 3 == _SPACE and pair & 7 != _SPACE) for pair in range(256))
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall


def byte_letters() -> str:
    """The letters that byte-level vocabularies write for the 256 bytes: printable Latin-1 as itself, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(letters[b] for b in range(256))


class WordEncoder(dict):
    """Maps a word (UTF-8, no ASCII white space) to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.parts_before: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.size = self.tokenizer.get_vocab_size()
        self.between = self.letters[ord("\n")]  # no letter holds the byte
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.between)
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(LAST)]] = True
        told = json.loads(self.tokenizer.to_str())
        self.wordwise = all(told[k] == v for k, v in WORDWISE.items()) and told["truncation"] is None and told["model"]["end_of_word_suffix"] == LAST and all(t["content"].startswith("<|") and not t["normalized"] for t in told["added_tokens"])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._ids(word)
        self._keep(word, ids)
        return ids

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(word) <= 64:
            if len(self) >= LIMIT:
                self.before = dict(self)
                self.clear()
            self[word] = ids

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters are one part
            return self._tokens(word.lower().decode())
        stem = word[:-1]
        if word[-1:] in _MARKS and _ENDS_IN_LETTER(stem):  # a mark after a letter is a part of its own
            ids = self.get(stem) or self.before.get(stem) or self._ids(stem)
            return ids + self._part(word[-1:].decode())
        if _PLAIN(word) and b"<|" not in word:
            return b"".join(map(self._part, _PARTS(word.decode().lower())))
        text = word.decode("utf-8", "replace")
        if _LATIN(text) and "<|" not in text:
            low = text.lower()  # letters up to U+024F are composed as they are
            if low.isalpha():
                return self._tokens(self._written(low))
            return b"".join([self._part(self._written(p)) for p in _PARTS(low)])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _written(self, part: str) -> str:
        """A part in the letters of the vocabulary."""
        return codecs.charmap_decode(part.encode(), "strict", self.letters)[0]

    def _tokens(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of a part of a word, remembered; words of one part are remembered as words."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts_before.get(part)
            if ids is None:
                ids = self._tokens(part)
            if len(part) <= 64:
                if len(self.parts) >= LIMIT:
                    self.parts_before, self.parts = self.parts, {}
                self.parts[part] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """All ids of a text and the end id."""
        if not self.wordwise:
            return array("I", [*self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, END]).tobytes()
        return b"".join(map(self.__getitem__, text.split())) + END.to_bytes(4, "little")

    def encode_all(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """All ids of each of many texts (binary; null: empty) and the end id, in order, a run of texts at a time."""
        sizes = pc.binary_length(texts).fill_null(0).to_numpy()
        low = 0
        while low < len(texts):
            high = low + 1
            if self.wordwise and sizes[low] <= RUN:
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low : low + ROWS]), RUN, "right")))
                yield self._encode_run(texts.slice(low, high - low).cast(pa.binary()).fill_null(b""))
            else:
                text = texts[low]
                yield [np.frombuffer(self.encode(text.as_buffer().to_pybytes() if text.is_valid else b""), dtype="<u4")]
            low = high

    def _encode_run(self, texts: pa.Array) -> list[np.ndarray]:
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        space, begins = self._begins(data, bounds, texts)
        first = np.flatnonzero(begins)
        kept = np.flatnonzero(~space)
        offsets = np.append(np.cumsum(~space, dtype=np.int32)[first] - 1, len(kept)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
        found = self._look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        found.append(END.to_bytes(4, "little"))
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        ends = np.searchsorted(first, bounds[1:])  # the pieces before each text's end
        which = np.insert(pieces.indices.to_numpy(), ends, len(found) - 1)
        size = sizes[which]
        until = np.cumsum(size)
        out = ids[np.repeat(starts[which] - until + size, size) + np.arange(until[-1])]
        return np.split(out, until[ends + np.arange(len(ends))][:-1])

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.get, words))
        letters, lower = [], []  # places of new words of letters, and these words
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            ids = self.before.get(word)
            if ids is None:
                if word.isalpha():
                    letters.append(i)
                    lower.append(word.lower())
                    continue
                text = word.decode("utf-8", "replace")
                if text.isalpha() and _LATIN(text) and (low := text.lower()).isalpha():
                    letters.append(i)
                    lower.append(low.encode())
                    continue
                ids = self._ids(word)
            found[i] = ids
            self._keep(word, ids)
        for at in range(0, len(letters), ASKED):
            for i, ids in zip(letters[at : at + ASKED], self._tokens_of_all(lower[at : at + ASKED])):
                found[i] = ids
                self._keep(words[i], ids)
        return found

    def _tokens_of_all(self, parts: list[bytes]) -> list[bytes]:
        written = codecs.charmap_decode(b"\n".join(parts), "strict", self.letters)[0]
        ids = array("I", self.bare.encode_batch_fast([written], add_special_tokens=False)[0].ids)
        ends = ((np.flatnonzero(self.ends[np.frombuffer(ids, dtype="<u4")]) + 1) * 4).tolist()
        if len(ends) != len(parts):
            raise AssertionError("a part ends without a last token")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _begins(data: np.ndarray, bounds: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes are white space, and at which a piece begins."""
        kind = np.frombuffer(data.tobytes().translate(_KINDS), dtype=np.uint8)
        space = kind == _SPACE
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_BEGINS), dtype=bool)
        after = np.flatnonzero((kind[:-1] == _LONG) & ((kind[1:] == _OTHER) | (kind[1:] == _APOSTROPHE))) + 1
        after = after[after > 1]
        begins[after] = _LONG_LETTER[data[after - 2].astype(np.int64) << 8 | data[after - 1]]
        marked = pc.match_substring(texts, b"<|")  # may hold an added token, so only white space cuts it
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            own = slice(bounds[i], bounds[i + 1])
            begins[own] &= np.concatenate([[True], space[own][:-1]])
        heads = bounds[:-1][bounds[1:] > bounds[:-1]]
        begins[heads] = ~space[heads]
        return space, begins


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for a vocabulary file."""
    return remembered(("words", path), lambda: WordEncoder(path))
