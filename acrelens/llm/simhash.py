"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: ASCII-lower-cased words (runs of anything but ASCII white space),
3-word shingles with repeats (a shorter text: all its words), XXH64 with seed 42 of
each shingle; a bit is 1 if it is set in over half of the hashes. No words: zero.

Linking, at Hamming distance 2 or less: the 64 bits are four blocks of 16. Two
fingerprints that differ in at most two bits agree on at least two blocks, so
distinct fingerprints are joined on each of the six pairs of blocks and every pair
met is verified by its distance. Equal fingerprints are one row before that.

A pair of blocks shared by more than BUCKET_LIMIT distinct fingerprints is not
joined with itself, which would make the square of its size. Its members go an
exact way instead: each is spread to its 64 one-bit neighbours and itself, and two
fingerprints are within distance 2 if and only if they meet on one of those; each
meeting point then hangs its members on the smallest, a row per member.

Cases: a null text has no words, like an empty one; documents without words link
with each other. A null doc_id is fingerprinted and takes its component's smallest
doc_id. Repeated rows come back repeated. Other columns are ignored, or stay as they
are, whatever their names. No rows: none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.llm.components import connected_components
from acrelens.llm.rows import without
from acrelens.llm.worker import small_batches
from acrelens.scratch import materialize

MAX_DISTANCE = 2
BUCKET_LIMIT = 32
_SHINGLES_AT_ONCE = 1 << 18


def fingerprint_of(text: bytes) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        n = len(words) - 2
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        part = hashes[at : at + _SHINGLES_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, fp: long, the fingerprint's bits) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint_of(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "t", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, t long, fp long")


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within distance 2; fps has one column fp, distinct."""
    keys = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    blocks = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("key")) for k, (i, j) in enumerate(keys)])).alias("b"),
    ).select("fp", "b.pair", "b.key")
    sizes = blocks.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(blocks.join(sizes, ["pair", "key"]), "blocks")
    small = shared.filter(F.col("n") <= bucket_limit)
    a, b = small.alias("a"), small.alias("b")
    near = a.join(b, F.expr(f"a.pair = b.pair and a.key = b.key and a.fp > b.fp and bit_count(a.fp ^ b.fp) <= {MAX_DISTANCE}")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    crowded = shared.filter(F.col("n") > bucket_limit).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)])
    spread = crowded.select("fp", F.explode(around).alias("at"))
    least = spread.groupBy("at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("at", "v")
    met = spread.join(least, "at").filter(f"fp <> v and bit_count(fp ^ v) <= {MAX_DISTANCE}").select(F.col("fp").alias("u"), "v")
    return near.unionByName(met).distinct()


def _components(docs: DataFrame, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, fp) of every row, and (fp, component_id, root) of every fingerprint."""
    base = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fps")
    roots = connected_components(links(distinct.select("fp"), bucket_limit), "simhash_cc")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labels = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash_labels")
    return base, materialize(named.join(labels, "root").select("fp", "component_id", "root"), "simhash_by_fp")


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    base, by_fp = _components(docs, bucket_limit)
    return base.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs`` with one row of each component, decided row by row: one of its smallest doc_id, null ones last."""
    base, by_fp = _components(docs, bucket_limit)
    rows = base.join(by_fp, "fp").groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "simhash_rows")
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("stays"), F.sum("n").alias("size")).filter("size > 1")
    stays = materialize(stays, "simhash_stays")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("t") == F.col("stays.t"))
    asked = rows.join(stays, "root").select("doc_id", F.col("t").alias("mark"), kept.alias("kept"), "n").filter("n > 1 or not kept").drop("n")
    return without(docs, F.xxhash64("text"), materialize(asked, "simhash_asked"))
