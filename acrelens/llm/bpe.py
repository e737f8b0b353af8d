"""Byte-level BPE by a pair occurrence index.

A text is cut at the file's added tokens and then into parts by the file's rule. The
distinct parts of a partition's rows that the worker doesn't know yet, a batch of rows
at a time, lie one after the other in one array of symbols. An index maps every pair of
neighbours that the merges know to all its positions there. The lowest active rank is
applied at all of its positions from left to right; each merge links the symbol to its
new neighbours and puts the new pairs' positions on their lists. A position whose pair
was changed by another merge is left out when its list comes up. Parts don't touch, so
the order of ranks within each is that of the merges, and a part of a million letters
costs its merges and no square.

What a part became is remembered: LIMIT parts, then a second generation. Decoding joins
the bytes of the ids; bytes that are no UTF-8 become U+FFFD.

Files: BPE with the byte-level split by its own rule, without normaliser, prefix space,
dropout or unknown token; added tokens match as they are written. Others are refused.
Truncation and padding that a file states are not used.

Cases: null and empty texts have no ids and decode to an empty text. A null doc_id is
a row like others; rows come back as often as they stand. Other columns are ignored.
No rows: none.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelens.llm.worker import remembered, small_batches
from acrelens.llm.words import byte_letters

LIMIT = 300_000
#: Parts with more characters are not remembered.
LONGEST = 64
# Fixed value: the split that byte-level files with use_regex mean.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A rank with so many positions is applied to all of them at once.
MANY = 64
_DEAD, _EDGE = -2, -1
_BITS = 32


class Merges(dict):
    """A file's vocabulary and merges; as a dict, it maps a known part to its ids as bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not told["normalizer"]
        odd = model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        added = told["added_tokens"]
        if model["type"] != "BPE" or not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary = model["vocab"]
        self.symbol = np.array([vocabulary[c] for c in letters])
        #: Of a rank: left id, right id, id of both; and the rank of (left, right) as one number.
        self.sides: list[tuple[int, int, int]] = []
        self.known: dict[int, int] = {}
        self.of_bytes = np.full((256, 256), -1)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.sides.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
            self.known[vocabulary[left] << _BITS | vocabulary[right]] = rank
            if left in byte_of and right in byte_of:
                self.of_bytes[byte_of[left], byte_of[right]] = rank
        self.keys = np.array(sorted(self.known), dtype=np.int64)
        self.rank_of = np.array([self.known[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *[t["id"] for t in added]]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        for t in added:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        self.parts = regex.compile(SPLIT).findall
        self.before: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The parts of a text; added tokens are parts of their own."""
        if self.cut is None or not any(t in text for t in self.added):
            return self.parts(text)
        out: list[str] = []
        for i, stretch in enumerate(self.cut(text)):
            out += [stretch] if i % 2 else self.parts(stretch)
        return out

    def merged(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, by one index over the positions of all of them."""
        joined = [part.encode() for part in parts]
        lengths = np.array([len(part) for part in joined])
        text = np.frombuffer(b"".join(joined), dtype=np.uint8)
        starts = np.cumsum(lengths + 1) - lengths  # an edge stands before every part and after the last
        places = np.arange(len(text)) + np.repeat(np.arange(1, len(parts) + 1), lengths)
        n = len(text) + len(parts) + 1
        flat = np.full(n, _EDGE)
        flat[places] = self.symbol[text]
        next_place, last_place = np.arange(1, n + 1), np.arange(-1, n - 1)
        symbols, after, before = map(memoryview, (flat, next_place, last_place))  # the same numbers, one at a time
        # The index at first: pairs of bytes that touch, by rank.
        rank_at = self.of_bytes[text[:-1], text[1:]]
        pairs = np.flatnonzero((rank_at >= 0) & (np.diff(places) == 1))
        pairs = pairs[np.argsort(rank_at[pairs], kind="stable")]
        first, cuts = np.unique(rank_at[pairs], return_index=True)
        listed = places[pairs].tolist()
        ranks = first.tolist()  # ascending, and so a heap
        active = {rank: listed[a:b] for rank, a, b in zip(ranks, cuts.tolist(), [*cuts[1:].tolist(), len(listed)])}
        known, sides = self.known.get, self.sides
        while ranks:
            rank = heappop(ranks)
            left, right, both = sides[rank]
            positions = active.pop(rank)
            if left == right:
                positions.sort()  # they may overlap
            elif len(positions) >= MANY:
                at = np.unique(positions)
                at = at[flat[at] == left]
                at = at[flat[next_place[at]] == right]
                second = next_place[at]
                follower = next_place[second]
                flat[at], flat[second] = both, _DEAD
                next_place[at], last_place[follower] = follower, at
                leader = last_place[at]
                for rank, some in self._ranked(np.concatenate([flat[leader] << _BITS | both, both << _BITS | flat[follower]]), np.concatenate([leader, at])):
                    if rank in active:
                        active[rank] += some
                    else:
                        active[rank] = some
                        heappush(ranks, rank)
                continue
            behind = both << _BITS
            for at in positions:
                if symbols[at] != left:
                    continue
                second = after[at]
                if symbols[second] != right:
                    continue
                symbols[at], symbols[second] = both, _DEAD
                follower, leader = after[second], before[at]
                after[at], before[follower] = follower, at
                other = symbols[leader]
                if other >= 0:
                    found = known(other << _BITS | both)
                    if found is not None:
                        if found in active:
                            active[found].append(leader)
                        else:
                            active[found] = [leader]
                            heappush(ranks, found)
                other = symbols[follower]
                if other >= 0:
                    found = known(behind | other)
                    if found is not None:
                        if found in active:
                            active[found].append(at)
                        else:
                            active[found] = [at]
                            heappush(ranks, found)
        alive = flat >= 0
        ids = flat[alive].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(alive)]) * 4
        return [ids[a:b] for a, b in zip(upto[starts].tolist(), upto[starts + lengths].tolist())]

    def _ranked(self, pairs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """The ranks among pairs (an edge is in none) and the places of each."""
        found = np.searchsorted(self.keys, pairs)
        here = np.flatnonzero(self.keys[np.minimum(found, len(self.keys) - 1)] == pairs)
        ranks = self.rank_of[found[here]]
        order = np.argsort(ranks, kind="stable")
        ranks, listed = ranks[order], places[here[order]].tolist()
        first = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        return zip(ranks[first].tolist(), (listed[a:b] for a, b in zip(first, [*first[1:], len(listed)])))

    def learn(self, split: list[list[str]]) -> dict[str, bytes]:
        """The ids of the parts of these texts: of those not remembered by one run of the index."""
        if len(self) >= LIMIT:
            self.before = dict(self)
            self.clear()
        unknown = [p for p in set().union(*split) if p not in self]
        old = self.before
        for part in unknown:
            if part in old:
                self[part] = old[part]
        new = [p for p in unknown if p not in old and p not in self.added]
        ids = self.merged(new) if new else []
        long = dict(self.added)
        for part, found in zip(new, ids):
            (long if len(part) > LONGEST else self)[part] = found
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = list(map(self.split, texts))
        long = self.learn(split)
        own = self.__getitem__
        out = []
        for parts in split:
            try:
                out.append(b"".join(map(own, parts)))
            except KeyError:
                out.append(b"".join([long[p] if p in long else self[p] for p in parts]))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def merges(path: str) -> Merges:
    """The merges of this worker process for a file."""
    return remembered(("merges", path), lambda: Merges(path))


def _texts(column: pa.Array) -> list[str]:
    return [t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else "" for t in column]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = merges(tokenizer).encode(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text for every row of (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [merges(tokenizer).decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text (decoded from the ids) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            own = merges(tokenizer)
            ids = own.encode(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "text"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    return encode_and_decode(docs, tokenizer).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
