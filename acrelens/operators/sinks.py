"""Keyed tables on files that can be written twice, and a log of the runs that write them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from acrelens.scratch import Workspace, folder

#: The column that names a row's part of the table.
BUCKET = "_bucket"


class KeyedTable:
    """A table of Parquet files in ``buckets`` parts by a hash of its key.

    An upsert reads and rewrites the parts that its changes fall into and no others: what the
    merge gives is written aside first, so nothing is overwritten before it is known whole,
    and then takes the place of those parts by dynamic partition overwrite. Merges whose
    result stays the same when they are done again may be run twice, also after a run that
    ended between parts.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def exists(self) -> bool:
        at, files = folder(self.spark, self.path)
        return files.exists(at)

    def _write(self, rows: DataFrame) -> None:
        rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write the first snapshot."""
        self._write(rows.withColumn(BUCKET, self._bucket()))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def touched(self, changes: DataFrame) -> list[int]:
        """The parts that the keys of changes fall into: ``buckets`` at most."""
        return sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Put ``merge(rows, changes)`` in place of the rows of all parts that have changes; how many parts those are.

        The merge sees these parts only, and keeps the columns. It must not move rows to other
        keys; a part that it leaves without rows is not emptied, so it can't delete a part's last row.
        """
        work = Workspace(self.spark, "upsert")
        changes = work.write(changes, "changes")
        parts = self.touched(changes)
        if parts:
            now = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(parts)).drop(BUCKET)
            after = merge(now, changes).select(*now.columns)
            self._write(work.write(after.withColumn(BUCKET, self._bucket()), "after"))
        work.clear()
        return len(parts)


LOG = "run_id string, source string, status string, started_at timestamp, ended_at timestamp, counts map<string, bigint>, error string"


@dataclass
class Run:
    """One source's run: ``write`` watches what passes into a sink."""

    source: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    counts: dict[str, int] = field(default_factory=dict)

    def write(self, rows: DataFrame, sink: Callable[[DataFrame], None], **counts: Column) -> None:
        """Give rows to a sink, which must run them; count them as they pass, and what ``counts`` add up, in the same job."""
        watched = Observation(f"run-{uuid.uuid4().hex}")
        sink(rows.observe(watched, F.count(F.lit(1)).alias("written"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()]))
        for name, n in watched.get.items():
            self.counts[name] = self.counts.get(name, 0) + n


def run_sources(spark: SparkSession, log: str, sources: dict[str, Callable[[Run], None]]) -> DataFrame:
    """Run sources one after the other and append a row for each to the log, on success and on failure.

    A source that fails leaves its row, with what it had counted, and the next one goes on.
    The rows of this call come back.
    """
    rows = []
    for name, work in sources.items():
        run, began, error = Run(name), dt.datetime.now(), None
        try:
            work(run)
        except Exception as failed:  # whatever it is, it is this source's
            error = f"{type(failed).__name__}: {failed}"[:2000]
        row = (run.run_id, name, "FAILED" if error else "SUCCESS", began, dt.datetime.now(), run.counts, error)
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)
        rows.append(run.run_id)
    return spark.read.schema(LOG).parquet(log).filter(F.col("run_id").isin(rows))
