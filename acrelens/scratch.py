"""Tables written between jobs, in the folder that the whole cluster shares.

``materialize`` cuts lineage by writing Parquet below ``spark.checkpoint.dir``
and reading it back: a lost executor costs a re-read and never a recomputation,
and a plan that uses the table twice does not run its input twice. A ``Workspace``
holds such tables of one run, to be deleted as soon as nothing reads them; what is
left goes when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}
_registered: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own_root:
        _own_root[sc.applicationId] = tempfile.mkdtemp(prefix="acrelens-")
    return "file://" + _own_root[sc.applicationId]


def folder(spark: SparkSession, path: str) -> tuple:
    """A path and the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _application_root(spark: SparkSession) -> str:
    """The folder of this application's tables, marked for deletion when the driver's JVM ends."""
    root = f"{scratch_root(spark)}/acrelens/{spark.sparkContext.applicationId}"
    if root not in _registered:
        at, files = folder(spark, root)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _registered.add(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_application_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and return it as read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return it as read back."""
    return write_table(df, scratch_path(df.sparkSession, name))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by a hash of its keys in at least four partitions a core: splits follow bytes, so a small file whose rows cost much is one task's."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def drop_path(spark: SparkSession, path: str) -> None:
    at, files = folder(spark, path)
    files.delete(at, True)


class Workspace:
    """The scratch tables of one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.held)}"
        out = write_table(df, path)
        self.held.append(out)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned, once nothing reads them."""
        for table in tables:
            drop_path(self.spark, self.paths.pop(id(table)))

    def clear(self) -> None:
        drop_path(self.spark, self.root)
        self.paths.clear()


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application now."""
    drop_path(spark, f"{scratch_root(spark)}/acrelens/{spark.sparkContext.applicationId}")
