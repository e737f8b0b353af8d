"""Lexical retrieval packing into windows of fixed length.

A document is its token ids and an end id. Every full window of a long document is
a sequence of its own; what is left of each document, less than a window, is a unit
to be packed. Units are ordered by their KEY_TOKENS highest ids, the highest first (a
merge vocabulary lists what is frequent first, so these are rare pieces), and a shard
is UNITS_PER_SHARD units in a row: units that share rare pieces mostly share a shard,
and any number of like or equal units is dealt to as many shards as it fills. A shard
has a BM25 inverted index of all its units over token ids, weighted with document
frequencies and the mean length of the whole corpus. The next unused unit is a seed:
the index returns its unused neighbours, nearest first, and they fill the seed's
window greedily; the last to go in is cut where the window is full and its rest
stays unused. Only a shard's last sequence is short, so padding is at most a window
per shard; each partition ends with a shard of its own.

The frequency table has one row per vocabulary entry, which bounds what is sent to
the tasks. Every unit is indexed and packed, whatever its score. Vocabularies of up to
65,536 ids fit; a larger one is refused.

Cases: a null text is empty; a document without tokens is its end id. Null doc_ids
are packed like others, and doc_ids of any type and size come back as they were;
repeated rows are packed as often as they stand. Other columns are ignored. No rows: no
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelens.llm.words import encoder
from acrelens.llm.worker import remembered, small_batches
from acrelens.scratch import materialize

WINDOW = 2048
UNITS_PER_SHARD = 2048
KEY_TOKENS = 3
#: The seed's tokens of highest weight that the index is asked for.
QUERY_TOKENS = 24
K1, B = 1.2, 0.75
_PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Full windows and remainders of every document: doc_id, start, doc_tokens, number, key, ids (uint16).

    ``number`` numbers the pieces; ``key`` holds the highest ids of a remainder (null for a full window).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = encoder(tokenizer), TaskContext.get().partitionId() << 36
        if own.size > 1 << 16:
            raise ValueError("ids above 65535 don't fit this table")
        for batch in small_batches(batches):
            rows, starts, totals, keys, ids = [], [], [], [], []
            for i, wide in enumerate(chain.from_iterable(own.encode_all(batch.column(1)))):
                all_ids, n = wide.astype("<u2"), len(wide)
                for start in range(0, n, window):
                    rows.append(i)
                    starts.append(start)
                    totals.append(n)
                    part = all_ids[start : start + window]
                    keys.append(None if len(part) == window else _key(part))
                    ids.append(part.tobytes())
            numbers = np.arange(number, number + len(rows))
            number += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(numbers), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "doc_tokens", "number", "key", "ids"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, start long, doc_tokens long, number long, key long, ids binary")


def _key(ids: np.ndarray) -> int:
    """The KEY_TOKENS highest ids as one number that sorts by the highest first."""
    out = 0
    for left in range(KEY_TOKENS, 0, -1):
        if not len(ids):
            return out << 16 * left
        top = ids.max()
        out, ids = out << 16 | int(top), ids[ids < top]
    return out


def token_statistics(pieces: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many pieces hold each token, the number of pieces and their mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, total = np.zeros(1 << 16, dtype=np.int64), 0, 0
        last = np.zeros(1 << 16, dtype=np.int64)  # where a token stands last in the piece at hand
        for batch in batches:
            for piece in batch.column(0):
                ids = np.frombuffer(piece.as_buffer(), dtype="<u2").astype(np.int64)  # as numpy takes places
                places = np.arange(len(ids))
                last[ids] = places
                counts[ids[last[ids] == places]] += 1
                n, total = n + 1, total + len(ids)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]])), pa.array(np.concatenate([counts[used], [n, total]]))], ["token", "df"])

    found = dict(pieces.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df")).collect())  # at most a row per vocabulary entry
    df = np.zeros(1 << 16, dtype=np.float64)
    for token, count in found.items():
        if token >= 0:
            df[token] = count
    n = found.get(-1, 0)
    return df, n, found.get(-2, 0) / max(n, 1)


class ShardIndex:
    """Inverted index of a shard's units: token -> (units, BM25 weights)."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(units)
        lengths = np.array([len(ids) for ids in units])
        kind = np.uint32 if self.n <= 1 << 16 else np.uint64  # narrow keys sort faster
        key, tf = np.unique(np.repeat(np.arange(self.n, dtype=kind) << kind(16), lengths) | np.concatenate(units), return_counts=True)
        owner, token = (key >> kind(16)).astype(np.int64), (key & kind(0xFFFF)).astype(np.uint16)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean_length)) * idf[token]
        self.token_of, self.weight_of = token, weight  # unit after unit
        self.unit = np.searchsorted(owner, np.arange(self.n + 1))
        order = np.argsort(token, kind="stable")
        self.owner, self.weight = owner[order], weight[order]  # token after token
        self.start = np.searchsorted(token[order], np.arange((1 << 16) + 1))

    def scores(self, unit: int) -> np.ndarray:
        """BM25 of every unit for the unit's heaviest tokens."""
        own = slice(self.unit[unit], self.unit[unit + 1])
        found, weight = self.token_of[own], self.weight_of[own]
        if len(found) > QUERY_TOKENS:
            found = found[np.argsort(-weight, kind="stable")[:QUERY_TOKENS]]
        found = found.astype(np.int64)
        spans = list(map(slice, self.start[found].tolist(), self.start[found + 1].tolist()))
        return np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def pack_shard(units: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(unit, from, to, sequence, offset) of every piece; see the module's text."""
    index = ShardIndex(units, idf, mean_length)
    at, size = np.zeros(len(units), dtype=np.int64), np.array([len(u) for u in units])
    free = np.ones(len(units), dtype=bool)
    out = []
    sequence = 0
    for seed in range(len(units)):
        if not free[seed]:
            continue
        filled, unit, score = 0, seed, None
        while True:
            take = min(window - filled, int(size[unit] - at[unit]))
            out.append((unit, int(at[unit]), int(at[unit]) + take, sequence, filled))
            at[unit] += take
            filled += take
            free[unit] = at[unit] < size[unit]
            if filled == window:
                break
            if score is None:
                score = np.where(free, index.scores(seed), -1.0)
            score[unit] = -1.0
            unit = int(score.argmax())  # the first of the nearest; a window takes few
            if score[unit] < 0:
                break
        sequence += 1
        if free[seed]:
            raise AssertionError("a unit is shorter than a window")
    return out


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, units_per_shard: int = UNITS_PER_SHARD) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    pieces = materialize(encoded(docs, tokenizer, window), "token_pieces")
    df, n, mean_length = token_statistics(pieces)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    units = pieces.filter("key is not null")
    shards = max(1, -(-units.count() // units_per_shard))
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def packed_shard(rows: pa.Table, shard: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        arrays = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in rows.column("ids")]
        placed = np.array(pack_shard(arrays, idf, mean_length, window), dtype=np.int64)
        at, low, high, sequence, offset = placed.T
        taken = rows.select(["doc_id", "start", "doc_tokens"]).take(pa.array(at)).combine_chunks().to_batches()[0]
        ids = [arrays[i][a:b].astype("<u4").tobytes() for i, a, b in zip(at.tolist(), low.tolist(), high.tolist())]
        starts = taken.column(1).to_numpy() + low
        return pa.RecordBatch.from_arrays([taken.column(0), pa.array(starts), pa.array(high - low), taken.column(2), pa.array(2 * ((shard << 16) + sequence)), pa.array(offset), pa.array(ids, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(("shard",), dict)  # lets the encoder's tables go
        shard = TaskContext.get().partitionId() << 24
        for shard, rows in enumerate(_in_shards(batches, units_per_shard), shard):
            yield packed_shard(rows, shard)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = pa.array([np.frombuffer(x.as_buffer(), dtype="<u2").astype("<u4").tobytes() for x in batch.column(6)], pa.binary())
            yield batch.set_column(6, "ids", wide)

    dealt = units.repartitionByRange(parts, "key", "number").sortWithinPartitions("key", "number").select("doc_id", "start", "doc_tokens", "ids")
    packed = dealt.mapInArrow(run, f"doc_id {kind}, {_PIECE}")
    whole = pieces.filter("key is null").select("doc_id", "start", F.lit(window).cast("long").alias("length"), "doc_tokens", (F.col("number") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    return packed.unionByName(whole.mapInArrow(widen, f"doc_id {kind}, {_PIECE}"))


def _in_shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of Spark's batches, ``size`` at a time."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= size:
            held.append(batch.slice(0, size - n))
            batch = batch.slice(size - n)
            yield pa.Table.from_batches(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
