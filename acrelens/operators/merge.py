"""Upserts of one table into another, as joins that give the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], protected: set[str]) -> DataFrame:
    """Incoming rows replace or join current ones; protected columns and those that aren't incoming keep their old value."""
    old, new = current.alias("o"), incoming.filter(" and ".join(f"{k} is not null" for k in key)).withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, key, "full_outer")
    here = F.coalesce("_new", F.lit(False))
    columns = []
    for c in current.columns:
        if c in key:
            columns.append(F.col(c))
        elif c in protected or c not in incoming.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        else:
            columns.append(F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def partial_update(current: DataFrame, incoming: DataFrame, key: list[str], columns: list[str], rejected: str) -> DataFrame:
    """Values that are there overwrite; columns named in the array ``rejected`` become null; rows without update stay."""
    o, n = current.alias("o"), incoming.alias("n")
    joined = o.join(n, key, "left")
    out = []
    for c in current.columns:
        if c in columns:
            refused = F.coalesce(F.array_contains(F.col(f"n.{rejected}"), c), F.lit(False))
            out.append(F.when(refused, None).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c))
        else:
            out.append(F.col(c) if c in key else F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def insert_absent(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Current rows and the first incoming row of each key that isn't there yet."""
    fresh = incoming.dropDuplicates(key).join(current.select(*key), key, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def upsert_changed(current: DataFrame, incoming: DataFrame, key: list[str], watched: list[str]) -> DataFrame:
    """Current rows take the watched incoming values if any differs; new keys join; ``change`` tells which happened."""
    o, n = current.withColumn("_old", F.lit(True)).alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, key, "full_outer")
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(differs, "updated").otherwise("same")
    take = F.col("change").isin("inserted", "updated")
    joined = joined.withColumn("change", change)
    values = [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in watched else F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in current.columns if c not in key]
    return joined.select(*key, *values, "change")


def fill_nulls(current: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Null columns take the incoming value; values that are there stay."""
    o, n = current.alias("o"), incoming.select(*key, *columns).alias("n")
    out = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in columns else F.col(c) if c in key else F.col(f"o.{c}").alias(c) for c in current.columns]
    return o.join(n, key, "left").select(*out)


def replace_columns(current: DataFrame, computed: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with a computed partner take its columns, null included; others stay."""
    o, n = current.alias("o"), computed.select(*key, *columns, F.lit(True).alias("_new")).alias("n")
    out = [F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in columns else F.col(c) if c in key else F.col(f"o.{c}").alias(c) for c in current.columns]
    return o.join(n, key, "left").select(*out)


def source_status(current: DataFrame, runs: DataFrame) -> DataFrame:
    """Status per source and county after the latest run; the last success is carried over failures."""
    key = ["source", "county_fips"]
    last = runs.groupBy(*key).agg(F.max_by("status", "run_at").alias("status"), F.max("run_at").alias("last_run_at"), F.max(F.when(F.col("status") == "SUCCESS", F.col("run_at"))).alias("ok_at"))
    joined = current.alias("o").join(last.alias("n"), key, "full_outer")
    return joined.select(*key, F.coalesce("n.status", "o.status").alias("status"), F.greatest("o.last_run_at", "n.last_run_at").alias("last_run_at"), F.coalesce("n.ok_at", "o.last_success_at").alias("last_success_at"))


def run_counters(runs: DataFrame) -> DataFrame:
    """Per user and profile: number of runs, last result count, first and last run."""
    return runs.groupBy("user_id", "profile_id").agg(F.count(F.lit(1)).alias("run_count"), F.max_by("total", "run_at").alias("last_total"), F.min("run_at").alias("first_run_at"), F.max("run_at").alias("last_run_at"))


def unseen(incoming: DataFrame, existing: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """Incoming rows whose key is new, the first to arrive of each; rows with a null key part are always new."""
    known = " and ".join(f"{k} is not null" for k in key)
    first = latest_per_key(incoming.filter(known), key, F.col(arrival)).join(existing.select(*key), key, "left_anti").select(*incoming.columns)
    return first.unionByName(incoming.filter(f"not ({known})"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a run's outcomes by run, and its rejection reasons as a map."""
    counts = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_read"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("inserted", "updated", "rejected", "skipped")]
    )
    reasons = outcomes.select("run_id", F.explode("reasons").alias("reason")).groupBy("run_id", "reason").count()
    maps = reasons.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reasons"))  # a row per kind of reason
    return counts.join(maps, "run_id", "left")
