"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text is normalised, cut into chunks at places that its own content fixes, and
becomes a recipe: the ordered list of its chunks' identifiers. Long texts are not
moved to be compared; only recipes are (about one long per 600 characters).

A chunk's identifier is its 64-bit hash and a variant number. Only rows whose list of
hashes stands more than once can be equal; a dictionary of the distinct (hash, chunk)
pairs of those rows, every chunk moving at most once per map task, tells which hashes
stand for more than one chunk. Those chunks get variant numbers by their text, so two
equal recipes are two equal texts, whatever the hash does.

Of equal texts one row stays: that of the smallest doc_id, and of several rows with it
any one.

Cases: a null text counts as empty; empty texts are equal to each other. A null doc_id
takes part and comes after all others, so its group keeps the smallest doc_id that is
not null. Rows that repeat both doc_id and text each count in group_size, and one of
them at most is kept. Other columns are ignored, or stay as they are, whatever their
names. No rows: none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.llm.rows import tested, without
from acrelens.scratch import Workspace, materialize

#: A chunk has at least MIN_CHUNK characters (but for a text's last) and at most MAX_CHUNK.
MIN_CHUNK = 512
MAX_CHUNK = 4096
#: A chunk ends after a space that stands between these letters.
ANCHOR = "(?<=[nstr]) (?=[aefi])"


def normalised(text: str = "text") -> Column:
    """The text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def chunks(text: Column) -> Column:
    """Array of content-defined chunks; joined, they are the text."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{ANCHOR}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _first_row() -> Column:
    """The row that stays of a group: its least doc_id, null ones last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("stays")


def exact_groups(docs: DataFrame, hash_chunk=chunk_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``hash_chunk`` maps a chunk Column to a long; any function gives the same result.
    """
    work = Workspace(docs.sparkSession, "exact")
    text = docs.select("doc_id", normalised().alias("_norm")).withColumn("mark", F.xxhash64("_norm"))
    recipes = work.write(
        text.select(
            "doc_id",
            "mark",
            F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("_norm")), hash_chunk).alias("_recipe"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "recipes",
    )
    # Marks of the texts whose list of hashes isn't theirs alone.
    lists = work.write(recipes.groupBy(F.xxhash64("_recipe").alias("list"), "mark").agg(F.count(F.lit(1)).alias("n")), "lists")
    several = lists.groupBy("list").agg(F.sum("n").alias("n")).filter("n > 1").select("list")
    alike = work.write(lists.join(several, "list", "left_semi").select("mark").distinct(), "alike")
    text, _ = tested(text, alike, ["mark"])
    dictionary = text.select(F.explode(chunks(F.col("_norm"))).alias("_chunk")).select(hash_chunk(F.col("_chunk")).alias("_hash"), "_chunk").distinct()
    collided = work.write(dictionary.groupBy("_hash").count().filter("count > 1").select("_hash"), "collided")
    if collided.isEmpty():
        recipes = recipes.withColumn("_variants", F.array().cast("array<int>"))
    else:
        recipes = _with_variants(text, recipes, collided, hash_chunk)
    groups = recipes.groupBy("_recipe", "_variants").agg(_first_row(), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = work.write(groups, "groups")  # a written table on one side lets the join split a hot group
    return recipes.join(groups, ["_recipe", "_variants"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("stays.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _with_variants(text: DataFrame, recipes: DataFrame, collided: DataFrame, hash_chunk) -> DataFrame:
    """Recipes with the variant numbers of those chunks whose hash is not theirs alone."""
    places = (
        text.select("doc_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(F.col("_norm"))).alias("_pos", "_chunk"))
        .withColumn("_hash", hash_chunk(F.col("_chunk")))
        .join(collided, "_hash", "left_semi")
    )
    pairs = places.select("_hash", "_chunk").distinct()
    numbered = pairs.withColumn("_variant", F.row_number().over(Window.partitionBy("_hash").orderBy("_chunk")))
    lists = (
        places.join(numbered, ["_hash", "_chunk"])
        .select("doc_id", "text_sha256", "_pos", "_variant")
        .distinct()
        .groupBy("doc_id", "text_sha256")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_variant"))), lambda x: x["_variant"]).alias("_variants"))
    )
    r, v = recipes.alias("r"), lists.alias("v")
    return r.join(v, F.expr("r.doc_id <=> v.doc_id and r.text_sha256 = v.text_sha256"), "left").select(
        "r.doc_id", "r.text_sha256", "_recipe", "r.row", F.coalesce("_variants", F.array().cast("array<int>")).alias("_variants")
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, decided row by row."""
    judged = materialize(exact_groups(docs), "exact_judged")
    asked = judged.groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not kept")
    return without(docs, F.sha2(normalised().cast("binary"), 256), materialize(asked.drop("n"), "exact_asked"))


ORACLE_SQL = r"""
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256
FROM (
  SELECT doc_id, text_sha256,
         min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS place
  FROM (SELECT doc_id, norm, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)))
"""
