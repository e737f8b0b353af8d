"""Finding the rows of a table that have one of many keys, without moving the others.

The keys' bits, BITS for each key and LARGEST in all at most, are a small table of
words, which is broadcast: LARGEST / 64 rows bound it. A row whose bit isn't set has
none of the keys and stays where it is; the others are joined with the keys. With very
many keys the bits fill up and more rows move; no result depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
LARGEST = 1 << 25


def flagged(rows: DataFrame, keys: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` and a column ``name``: false if the row surely has none of ``keys``, which is a written table."""
    size = min(LARGEST, 1 << max(10, (BITS * keys.count()).bit_length()))
    bit = F.xxhash64(*key).bitwiseAND(F.lit(size - 1))
    mark = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_at")).agg(F.bit_or(mark).alias("_word"))
    met = rows.withColumn("_bit", bit).join(F.broadcast(words), F.expr("_bit div 64 = _at"), "left")  # LARGEST / 64 rows at most
    return met.select(*rows.columns, F.coalesce(F.col("_word").bitwiseAND(mark) != 0, F.lit(False)).alias(name))


def tested(rows: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of ``keys``, and those that surely haven't."""
    met = flagged(rows, keys, key, "_hit")
    return met.filter("_hit").select(*rows.columns), met.filter("not _hit").select(*rows.columns)


def without(docs: DataFrame, mark: Column, asked: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, mark) is in ``asked`` (doc_id, mark, kept).

    Of rows whose key is ``kept`` one stays. A null doc_id is a key like any other.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", mark.alias("mark"))
    hit, rest = tested(rows, asked, ["doc_id", "mark"])
    a, b = hit.alias("a"), asked.alias("b")
    left = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.mark = b.mark"), "left").filter("coalesce(b.kept, true)")
    own = F.when(F.col("b.kept").isNull(), F.monotonically_increasing_id())  # null where one of several stays
    left = left.select("a.row", "a.doc_id", "a.mark", own.alias("own")).dropDuplicates(["doc_id", "mark", "own"])
    return rest.select("row").unionByName(left.select("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
