"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk
of every id, level k the k-th chunk of the ids that have one; at every level but the
last a bitmap says which chunks continue, and a rank directory counts the set bits
before every block of RANK_BLOCK. Token i is read by its chunk at level 0 and, while
the bit is set, by following its rank to the next level: no block is decoded.

A code: magic, number of levels, number of ids; then for each level the number of
its chunks, the chunks, and except at the last the bitmap (least bit first) and the
directory (uint32). Numbers are little-endian unsigned 32-bit.

Files: a folder with ``segments`` (Parquet; a row per run of whole documents of about
SEGMENT_IDS ids: part, seg, first id within the part, document ids, document lengths,
code) and ``manifest`` (first id of each part). Documents stand in ascending doc_id.

Cases: a null text is empty, an empty text has the end id alone. Null doc_ids come
first; rows of equal doc_id follow each other by a hash of their text, then by text, so
that any number of them can be split. No rows: no segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.words import encoder
from acrelens.llm.worker import small_batches
from acrelens.scratch import materialize

MAGIC = b"DAC1"
RANK_BLOCK = 512
SEGMENT_IDS = 1 << 18
#: Ids between two marks of the segment index that lookups join on.
MARK = 1 << 16
#: Positions of one segment that a task reads.
PER_TASK = 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The code of an array of ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    top = int(rest.max()) if len(rest) else 0
    levels = max(1, (top.bit_length() + 7) // 8)
    out = [MAGIC, struct.pack("<II", levels, len(rest))]
    for level in range(levels):
        out += [struct.pack("<I", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        if level < levels - 1:
            more = (rest >> 8) > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), dtype=np.uint8)])
            ones = _ONES[bits].reshape(-1, RANK_BLOCK // 8).sum(axis=1, dtype=np.uint32)
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()]
            rest = rest[more] >> 8
    return b"".join(out)


class Code:
    """A packed code opened for reading; nothing is decoded until asked for."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        levels, self.n = struct.unpack_from("<II", code, 4)
        self.levels, at = [], 12
        for level in range(levels):
            (n,) = struct.unpack_from("<I", code, at)
            chunks, at = np.frombuffer(code, np.uint8, n, at + 4), at + 4 + n
            bits = ranks = None
            if level < levels - 1:
                blocks = -(-n // RANK_BLOCK)
                bits, at = np.frombuffer(code, np.uint8, blocks * RANK_BLOCK // 8, at), at + blocks * RANK_BLOCK // 8
                ranks, at = np.frombuffer(code, "<u4", blocks + 1, at), at + 4 * (blocks + 1)
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """Token i, by rank alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            whole = bits[block * RANK_BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(_ONES[whole].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, in order."""
        at = np.arange(self.n)
        value = np.zeros(self.n, dtype=np.uint32)
        for level, (chunks, bits, _) in enumerate(self.levels):
            value[at] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            if bits is not None:
                at = at[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)]
        return value


def _segment(part: int, seg: int, first: int, names: list, held: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(held), dtype="<u4")
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("code", pa.binary())])
    row = {"part": part, "seg": seg, "first": first, "n": len(ids), "doc_ids": names, "lengths": [len(x) // 4 for x in held], "code": pack(ids)}
    return pa.RecordBatch.from_pylist([row], schema)


def write(docs: DataFrame, path: str, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text and write the files under ``path``."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        seg = first = size = 0
        held: list[bytes] = []
        names: list = []
        kind = None
        for batch in small_batches(batches):
            kind = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), chain.from_iterable(own.encode_all(batch.column(1)))):
                held.append(ids.tobytes())
                names.append(name)
                size += len(held[-1]) // 4
                if size >= segment_ids:
                    yield _segment(part, seg, first, names, held, kind)
                    seg, first, size = seg + 1, first + size, 0
                    held, names = [], []
        if held:
            yield _segment(part, seg, first, names, held, kind)

    schema = f"part int, seg int, first long, n long, doc_ids array<{id_type.simpleString()}>, lengths array<long>, code binary"
    ordered = docs.select("doc_id", F.col("text").cast("binary"), F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/segments")
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition
    bases = accumulate((r["n"] for r in parts), initial=0)
    spark.createDataFrame([(r["part"], b) for r, b in zip(parts, bases)], "part int, base long").coalesce(1).write.parquet(f"{path}/manifest")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before each."""
    bases = spark.read.schema("part int, base long").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/segments").join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first"))  # a row per part


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (binary, little-endian uint32) of every document, from the files."""
    found = segments(spark, path).select("start", "doc_ids", "lengths", "code")
    id_type = found.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                ids = Code(batch.column(3)[i].as_buffer().to_pybytes()).all().astype("<u4").tobytes()
                rows = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + ends - lengths), pa.array(rows, pa.binary())], ["doc_id", "start", "ids"])

    return found.mapInArrow(run, f"doc_id {id_type}, start long, ids binary")


def placed(spark: SparkSession, path: str, positions: DataFrame, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Positions with the segment that holds each, and the codes of those segments alone.

    A segment that many positions ask for stands in several turns, of about ``per_task`` positions each.
    """
    ranges = segments(spark, path).filter("n > 0").select("part", "seg", "start", "n")
    marks = F.sequence(F.floor(F.col("start") / MARK), F.floor((F.col("start") + F.col("n") - 1) / MARK))
    asked = positions.select("position", F.floor(F.col("position") / MARK).alias("mark"))
    met = asked.join(ranges.withColumn("mark", F.explode(marks)), "mark").filter("position >= start and position < start + n")
    met = materialize(met.select("part", "seg", "position", (F.col("position") - F.col("start")).alias("at"), F.monotonically_increasing_id().alias("row")), "positions")
    turns = materialize(met.groupBy("part", "seg").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("turns")), "turns")
    parts = [r["part"] for r in turns.select("part").distinct().collect()]  # a number per partition of the files
    codes = spark.read.parquet(f"{path}/segments").filter(F.col("part").isin(parts)).select("part", "seg", "code")
    codes = codes.join(turns, ["part", "seg"]).select("part", "seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "code")
    places = met.join(turns, ["part", "seg"]).select("part", "seg", F.pmod("row", "turns").alias("turn"), "position", "at")
    return places, codes


def lookup(spark: SparkSession, path: str, positions: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(position, id) for every row of ``positions`` (position: long) within the files' ids, each read by rank."""
    places, codes = placed(spark, path, positions, per_task)
    key = ["part", "seg", "turn"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            code = Code(right.column("code")[0].as_buffer().to_pybytes())
            out = [int(code[i]) for i in left.column("at").to_pylist()]
        return pa.table({"position": left.column("position") if out else pa.array([], pa.int64()), "id": pa.array(out, pa.int64())})

    return places.groupBy(*key).cogroup(codes.groupBy(*key)).applyInArrow(run, "position long, id long")
