"""Exact quantiles of groups of any size, by counting passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.scratch import Workspace, materialize

#: Parts between the edges by which a pass cuts the values that are left of a group.
SHARES = 32
#: Values of a group that are sorted in one row once no more are left.
FEW = 4096
#: Rows of one group go to so many tasks of a join that is not a broadcast.
SALTS = 8


def _edges(value: Column) -> Column:
    """Values at even shares, about; parts are only less even for what they miss by."""
    return F.array_sort(F.array_distinct(F.percentile_approx(value, [i / SHARES for i in range(SHARES + 1)], 1000)))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, shares: tuple[float, ...] = (0.5,), few: int = FEW) -> DataFrame:
    """keys, share, n, quantile: per group and share the number of values that are not null and the quantile, interpolated between two neighbours.

    The built-in ``percentile`` keeps a group's distinct values in one buffer. Here a pass
    cuts the values of a group at some of them and counts those between and those on these
    edges, sums that every task makes before rows move. Only the parts that hold the places
    asked for go into the next pass, each about a thirty-second of the values before, however
    they are spread and however often one repeats: an edge is a part of its own. Once
    ``few`` are left they are sorted in one row. Counts are exact, so the result is, and the
    edges need not be. Ten thousand million values of one group take seven passes over
    the table of keys and values, however many shares are asked for.

    Null keys make a group of their own; a group without values has n 0 and a null
    quantile; no rows give no groups, and so without keys no row. NaN comes after all
    numbers. Values are taken as doubles. Other columns of ``rows`` may have any names.
    """
    if not shares or not all(0 <= x <= 1 for x in shares) or {"share", "n", "quantile"} & set(keys):
        raise ValueError(f"shares {shares} or keys {keys}: a share is from 0 to 1, no key is named share, n or quantile")
    work = Workspace(rows.sparkSession, "quantile")
    named = [f"k{i}" for i in range(max(len(keys), 1))]
    taken = [F.col(k) for k in keys] or [F.lit(0)]
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    values = work.write(rows.select(*[c.alias(n) for c, n in zip(taken, named)], value.cast("double").alias("v"), salt.alias("salt")), "values")

    # Places count from 1. ``below`` values of a group are less than ``lo``, and ``left`` lie from there to ``hi``.
    place, none = F.col("share") * (F.col("n") - 1), F.lit(None).cast("double")
    state = values.groupBy(*named).agg(F.count("v").alias("n"), _edges(F.col("v")).alias("edges"))
    state = state.withColumn("share", F.explode(F.array(*map(F.lit, sorted({float(x) for x in shares})))))
    state = state.select(*named, "share", "n", (F.floor(place) + 1).alias("first"), (F.ceil(place) + 1).alias("last"), (place - F.floor(place)).alias("beyond"), F.lit(0).cast("long").alias("below"), F.col("n").alias("left"), none.alias("lo"), none.alias("hi"), "edges")
    state = work.write(state, "state")
    target, span = [*named, "share", "n", "first", "last", "beyond"], [*named, "below"]

    def settle(table: DataFrame, a: Column, b: Column) -> DataFrame:
        found = F.when((F.col("a") == F.col("b")) | (F.col("beyond") == 0), F.col("a")).otherwise((1 - F.col("beyond")) * F.col("a") + F.col("beyond") * F.col("b"))
        return work.write(table.withColumns({"a": a, "b": b}).select(*named, "share", "n", found.alias("quantile")), "settled")

    def left_of(targets: DataFrame) -> DataFrame:
        """The values of each span that targets are looked for in; shares of a group may have one in common."""
        spans = targets.select(*span, "lo", "hi", "edges").dropDuplicates(span).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = values.alias("v").join(spans.alias("g"), _same("v", "g", [*named, "salt"])).filter("v.v is not null and (g.lo is null or v.v >= g.lo) and (g.hi is null or v.v <= g.hi)")
        return met.select("g.*", "v.v")

    settled = [settle(state.filter("n = 0"), none, none)]
    while True:
        most, least = state.agg(F.max("left"), F.min(F.when(F.col("n") > 0, F.col("left")))).first()
        if least is not None and least <= few:
            short = state.filter((F.col("n") > 0) & (F.col("left") <= few))
            lists = left_of(short).groupBy(*span).agg(F.sort_array(F.collect_list("v")).alias("vs"))
            at = lambda c: F.element_at("vs", (F.col(c) - F.col("s.below")).cast("int"))
            settled.append(settle(short.alias("s").join(lists.alias("l"), _same("s", "l", span)).select("s.*", at("first").alias("a"), at("last").alias("b")), F.col("a"), F.col("b")))
        if most is None or most <= few:
            break
        many = state.filter(F.col("left") > few)
        # Part 2i lies strictly below edge i, part 2i + 1 is that edge; a span has 2 * SHARES + 3 at most.
        part = 2 * F.size(F.filter("edges", lambda e: e < F.col("v"))) + F.array_contains("edges", F.col("v")).cast("int")
        parts = left_of(many).withColumn("part", part).groupBy(*span, "part").agg(F.count("v").alias("held"), F.min("v").alias("least"), F.max("v").alias("most"), _edges(F.col("v")).alias("edges"))
        before = F.sum("held").over(Window.partitionBy(*span).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("start", F.col("below") + F.coalesce(before, F.lit(0)))
        holds = (F.col("first") <= F.col("start") + F.col("held")) & (F.col("last") > F.col("start"))
        held = parts.alias("p").join(many.select(*target, "below").alias("m"), _same("p", "m", span) & holds)
        # One part holds both places, or one ends with the first and the next begins with the last.
        p = F.col("p.part")
        found = held.groupBy(*[F.col(f"m.{c}").alias(c) for c in target]).agg(
            F.count(F.lit(1)).alias("parts"), F.min_by("most", p).alias("a"), F.max_by("least", p).alias("b"), F.min("start").alias("below"), F.sum("held").alias("left"),
            F.min("least").alias("lo"), F.max("most").alias("hi"), F.min_by("edges", p).alias("edges"),
        )
        found = work.write(found, "found")
        done = (F.col("parts") > 1) | (F.col("lo") == F.col("hi"))
        settled.append(settle(found.filter(done), F.col("a"), F.col("b")))
        state = found.filter(~done).drop("parts", "a", "b")
    out = materialize(reduce(DataFrame.unionByName, settled), "quantiles")
    work.clear()
    return out.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], "share", "n", "quantile")
