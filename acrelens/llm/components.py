"""Connected components over an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelens.scratch import Workspace


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node reachable.

    Alternating star contraction: every node hangs its larger neighbours, then its
    smaller ones, on the smallest it knows, until no edge changes. Minima are taken
    by partial aggregation before rows move, so a node with very many links is not
    gathered in one task; the joins that follow are left to skew splitting. Edges
    never outnumber the input's by more than the nodes.
    """
    work = Workspace(edges.sparkSession, name)
    now = work.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        after = work.write(_star(large, larger=False), "stars")
        mark = _mark(after)
        work.drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    # A star forest: u hangs on its root v.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """For every u with neighbours v: hang on m, the least of u and its neighbours, its larger
    neighbours, or else its smaller ones and itself. Rows (u, v) with u > v come back.
    """
    if not larger:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = pairs.join(least, "u")
    if larger:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    """Equal for equal edge tables: their number and a sum of their hashes."""
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
