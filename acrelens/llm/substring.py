"""Substring deduplication over a log-structured index of window fingerprints.

A window is WINDOW consecutive words. A word goes if a window covers it whose words
also stand, as a window, in a document with a smaller doc_id; windows are judged on
the texts as given.

Fingerprints. Of the word 8-grams in a window, the one with the least hash is its
anchor, so equal windows have equal anchors. Consecutive windows of one anchor are a
span, about one for every 22 windows, and a span is one fingerprint: the anchor's
hash, and a 128-bit digest of all the span's words that verifies its content.

Index. Documents arrive in batches of ascending doc_id. A batch's distinct spans
(anchor, digest, first document and place) become an immutable run, sorted by anchor.
The next batch is merge-joined with all runs by anchor; runs are compacted, keeping
the first document of each span, when a batch meets more than MAX_RUNS.

Judging a batch. A span that stands in an earlier document goes with all its windows.
Spans that share an anchor but not all words (where a repeated passage begins or
ends) are opened: each of their windows gets a 128-bit digest of its own words, in
their first document only, and the first document of each window decides. Opened
spans of several batches are settled together, by one pass over the texts that they
stand in; their windows become a sorted run too, so a span is opened only once.

A later job. The index lies in a folder with a manifest of its runs. A job that opens
the folder judges new documents against it; it reads texts of old documents only
where a new document opens a span that no batch has opened before.

Nothing is paired within a group: counts are minima by partial aggregation, written
before they are joined back, so a join has plain shuffles on both sides and one row per
key on one of them, and skew splitting applies to a hot anchor, span or window.

Texts move only where needed: bits of the documents asked for (``rows``) are tested before
a text is shuffled.

Cases: a null text has no words; a text under WINDOW words loses none. A row with null
doc_id loses nothing and takes nothing from others. Rows of one doc_id are one
document: they take nothing from each other. Repeated rows come back repeated. Other
columns stay, whatever their names. No rows: none.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, NumericType, StringType, StructField, StructType, TimestampType

from acrelens.llm.rows import tested
from acrelens.llm.worker import remembered, small_batches
from acrelens.scratch import Workspace, drop_path, folder, scratch_path, write_table

WINDOW = 50
GRAM = 8
BATCHES = 3
MAX_RUNS = 1
_WORD_LIMIT = 200_000
_KEY = ["h", "d1", "d2"]
#: The order of each kind of run, and what it keeps a single row of.
_SORTED = {"spans": _KEY, "opened": _KEY, "windows": ["w1", "w2"]}


class _WordHashes(dict):
    """64-bit hashes of words; emptied when it holds _WORD_LIMIT entries."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORD_LIMIT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


def anchors(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of every span of a text."""
    n = len(words)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    gram = min(GRAM, window)
    word = np.fromiter(map(remembered(("hashes",), _WordHashes).__getitem__, words), dtype=np.uint64, count=n)
    g = word[: n - gram + 1].copy()
    for j in range(1, gram):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += word[j : n - gram + 1 + j]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    value, place = g, np.arange(len(g))
    reach, wanted = 1, window - gram + 1
    while reach < wanted:  # the least of `reach` neighbours, the leftmost of equals
        step = min(reach, wanted - reach)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        reach += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    return g[place[first]].view(np.int64), first, count


def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words with single spaces, and where each begins (and one after the last)."""
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    return b" ".join(words), starts


def _digests(text: bytes, begins: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    blake = hashlib.blake2b
    both = np.frombuffer(b"".join(blake(text[a:b], digest_size=16).digest() for a, b in zip(begins, ends)), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts with what names a row: doc_id and a hash of its text."""
    return docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, d1, d2, doc_id, t, s, n) of every span: fingerprint, place, first window and number of windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            parts: list[tuple] = []
            for i, text in enumerate(batch.column(2)):
                words = _bytes(text).split()
                h, s, n = anchors(words, window)
                if len(h):
                    joined, at = _joined(words)
                    parts.append((h, *_digests(joined, at[s].tolist(), (at[s + n + window - 1] - 1).tolist()), np.full(len(h), i), s, n))
            if parts:
                h, d1, d2, row, s, n = (np.concatenate(x) for x in zip(*parts))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d1), pa.array(d2), batch.column(0).take(row), batch.column(1).take(row), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "d1", "d2", "doc_id", "t", "s", "n"])

    return _keyed(docs).mapInArrow(run, f"h long, d1 long, d2 long, doc_id {kind}, t long, s int, n int")


def windows(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w1, w2, doc_id, t, s) of every window of the spans in ``places`` (doc_id, t, s, n)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = places.groupBy("doc_id", "t").agg(F.collect_set(F.struct("s", "n")).alias("spans"))  # of one document
    texts, _ = tested(_keyed(docs), places, ["doc_id", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i in range(batch.num_rows):
                words = _bytes(batch.column(2)[i]).split()
                joined, at = _joined(words)
                s = np.unique(np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in batch.column(3)[i].as_py()]))
                w1, w2 = _digests(joined, at[s].tolist(), (at[s + window] - 1).tolist())
                row = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), batch.column(0).take(row), batch.column(1).take(row), pa.array(s.astype(np.int32))], ["w1", "w2", "doc_id", "t", "s"])

    return texts.join(lists, ["doc_id", "t"]).select("doc_id", "t", "text", "spans").mapInArrow(run, f"w1 long, w2 long, doc_id {kind}, t long, s int")


class FingerprintIndex:
    """Sorted immutable runs of the spans of all documents so far, in a folder.

    Kinds of runs: ``spans`` (h, d1, d2, first, last document), ``opened`` (the keys of opened spans) and
    ``windows`` (w1, w2, least: the first document of each window of the opened spans).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, max_runs: int = MAX_RUNS):
        self.spark, self.window, self.max_runs = spark, window, max_runs
        self.path = path or scratch_path(spark, "index")
        self.runs: dict[str, list[DataFrame]] = {kind: [] for kind in _SORTED}
        self.paths: dict[str, list[str]] = {kind: [] for kind in _SORTED}
        self.version = 0
        #: Runs that the manifest names; when merged they stay until it names them no more.
        self.committed: set[str] = set()
        self.retired: list[str] = []
        self.work = Workspace(spark, "judging")
        self.pending: list[DataFrame] = []
        at, files = folder(spark, f"{self.path}/manifest")
        if files.exists(at):
            rows = spark.read.parquet(f"{self.path}/manifest")
            self.version = rows.agg(F.max("version")).first()[0]
            for r in rows.filter(F.col("version") == self.version).orderBy("kind", "at").collect():  # a row per run
                self.paths[r["kind"]].append(r["name"])
                self.runs[r["kind"]].append(spark.read.parquet(f"{self.path}/{r['name']}"))
                self.committed.add(r["name"])

    def commit(self) -> None:
        """Add the runs at hand to the manifest, as its newest version and in one file; then merged runs go."""
        self.version += 1
        rows = [(self.version, kind, at, name) for kind, names in self.paths.items() for at, name in enumerate(names)]
        self.spark.createDataFrame(rows, "version long, kind string, at int, name string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.committed = {name for _, _, _, name in rows}
        for name in self.retired:
            drop_path(self.spark, f"{self.path}/{name}")
        self.retired = []

    def known(self, kind: str) -> DataFrame | None:
        out = None
        for run in self.runs[kind]:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, kind: str, rows: DataFrame) -> DataFrame:
        """Write rows as a sorted run and return it as read back."""
        name, order = f"{kind}-{uuid.uuid4().hex}", _SORTED[kind]
        path = f"{self.path}/{name}"
        rows.hint("rebalance", order[0]).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
        run = self.spark.read.schema(rows.schema).parquet(path)
        self.runs[kind].append(run)
        self.paths[kind].append(name)
        return run

    def compact(self) -> None:
        """Merge the runs of each kind into one when there are more than ``max_runs``."""
        for kind, order in _SORTED.items():
            if len(self.runs[kind]) > self.max_runs:
                old, rows = self.paths[kind], self.known(kind)
                merged = rows.distinct() if kind == "opened" else rows.groupBy(*order).agg(*[(F.max if c == "last" else F.min)(c).alias(c) for c in rows.columns if c not in order])
                self.runs[kind], self.paths[kind] = [], []
                self.add(kind, merged)
                for name in old:
                    if name in self.committed:
                        self.retired.append(name)
                    else:
                        drop_path(self.spark, f"{self.path}/{name}")

    def judge(self, batch: DataFrame) -> DataFrame:
        """(doc_id, t, s, n) of spans of ``batch`` that stand whole in an earlier document; ``settle`` tells the rest.

        All documents of the index come before the batch's.
        """
        self.compact()
        write, known, opened = self.work.write, self.known("spans"), self.known("opened")
        own = write(spans(batch, self.window), "spans")
        contents = own.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "t", "s", "n")).alias("first"), F.max("doc_id").alias("last"))
        contents = self.add("spans", contents)
        merged = contents
        if known is not None:
            met = known.join(contents.select("h"), "h", "left_semi").withColumn("last", F.lit(None).cast(contents.schema["last"].dataType))
            merged = contents.unionByName(met).groupBy(*_KEY).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        merged = write(merged, "merged") if known is not None else merged
        several = write(merged.groupBy("h").agg(F.min("first.doc_id").alias("least"), F.max("first.doc_id").alias("most")).filter("least < most").select("h", F.lit(True).alias("open")), "several")
        told = write(merged.join(several, "h", "left").select(*_KEY, "first", "last", F.coalesce("open", F.lit(False)).alias("open")).filter("open or last > first.doc_id"), "told")

        o, k = own.alias("o"), told.alias("k")
        places = write(o.join(k, _KEY).filter("o.doc_id > k.first.doc_id or k.open").select("o.doc_id", "o.t", "o.s", "o.n", F.expr("o.doc_id > k.first.doc_id").alias("whole")), "places")
        self.pending.append(places.filter("not whole").select("doc_id", "t", "s", "n"))
        if known is not None:
            # First places in documents of earlier batches, of spans that were not opened yet; a span that the
            # batch has too may have its first place in the batch, and then stands in `pending` twice, which costs nothing.
            old = told.filter("open and (last is null or first.doc_id <> last)").select(*_KEY, "first")
            old = old if opened is None else old.join(opened, _KEY, "left_anti")
            self.pending.append(write(old.select("first.*"), "older"))
        self.add("opened", told.filter("open").select(*_KEY))
        self.work.drop(own, several, told, *([merged] if known is not None else []))
        return places.filter("whole").select("doc_id", "t", "s", "n")

    def settle(self, texts: DataFrame) -> DataFrame:
        """(doc_id, t, s, n) of single windows to remove from the batches judged since the last call.

        ``texts`` has doc_id and text of the documents judged since then, and of earlier ones.
        """
        firsts = None
        for places in self.pending:
            firsts = places if firsts is None else firsts.unionByName(places)
        self.pending = []
        write = self.work.write
        firsts = write(firsts, "firsts")
        opened = write(windows(texts, firsts, self.window), "windows")
        if self.version and not firsts.join(opened, ["doc_id", "t"], "left_anti").isEmpty():
            raise ValueError("the batches share passages with documents that the index holds; give their doc_id and text as `earlier`")
        least = opened.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        known = self.known("windows")
        if known is not None:
            met = known.join(opened.select("w1", "w2"), ["w1", "w2"], "left_semi").withColumn("most", F.col("least"))
            least = least.unionByName(met).groupBy("w1", "w2").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        least = write(least, "least")
        self.add("windows", least.select("w1", "w2", "least"))
        self.commit()
        earliest = write(least.filter("least < most").select("w1", "w2", "least"), "earliest")
        return opened.join(earliest, ["w1", "w2"]).filter("doc_id > least").select("doc_id", "t", "s", F.lit(1).alias("n"))


def _strip(words: list[bytes], covered: list[dict], window: int) -> list[bytes]:
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    for x in covered:
        mark[x["s"]] += 1
        mark[x["s"] + x["n"] - 1 + window] -= 1
    keep = np.cumsum(mark[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def strip(docs: DataFrame, covered: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (struct of all columns of ``docs``), kept (its words that stay, joined by one space), n_words, n_removed.

    ``covered`` has (doc_id, t, s, n) of the windows to remove.
    """
    at = docs.columns.index("text")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("t"))
    lists = covered.groupBy("doc_id", "t").agg(F.collect_list(F.struct("s", "n")).alias("covered"))  # of one document
    hit, rest = tested(rows, covered, ["doc_id", "t"])
    hit = hit.join(lists, ["doc_id", "t"], "left").select("row", "covered")

    def stripped(batch: pa.RecordBatch, lists: pa.Array | None) -> pa.RecordBatch:
        kept, n, removed = [], [], []
        for i, text in enumerate(batch.column(0).field(at).cast(pa.binary())):
            words = _bytes(text).split()
            stay = _strip(words, lists[i].as_py(), window) if lists is not None and lists[i].is_valid else words
            kept.append(b" ".join(stay))
            n.append(len(words))
            removed.append(len(words) - len(stay))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["row", "kept", "n_words", "n_removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield stripped(batch, batch.column(1))

    def run_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield stripped(batch, None)

    schema = StructType([rows.schema["row"], StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return hit.mapInArrow(run, schema).unionByName(rest.select("row").mapInArrow(run_rest, schema))


def deduplicate(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, max_runs: int = MAX_RUNS, index: FingerprintIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``strip`` of all documents, judged batch after batch in ascending doc_id.

    With an ``index`` that holds documents already, ``earlier`` has their doc_id and text;
    all of them come before those of ``docs``. The index then holds these too. It is an
    error if a text of theirs is needed and not there.
    """
    ordered = isinstance(docs.schema["doc_id"].dataType, (NumericType, DateType, TimestampType))  # quantiles of other types aren't told; one batch gives the same
    shares = [i / batches for i in range(1, batches)] if ordered else []
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares).alias("q")).first()["q"] or [])) if shares else []
    bounds = [None, *cuts, None]
    own = index is None
    index = index or FingerprintIndex(docs.sparkSession, None, window, max_runs)
    covered = None
    for low, high in zip(bounds, bounds[1:]):
        batch = docs.filter("doc_id is not null")
        batch = batch.filter(F.col("doc_id") > low) if low is not None else batch
        batch = batch.filter(F.col("doc_id") <= high) if high is not None else batch
        found = index.judge(batch)
        covered = found if covered is None else covered.unionByName(found)
    texts = docs.select("doc_id", "text")
    covered = covered.unionByName(index.settle(texts if earlier is None else texts.unionByName(earlier.select("doc_id", "text"))))
    covered = write_table(covered, scratch_path(docs.sparkSession, "covered"))
    index.work.clear()
    if own:
        drop_path(docs.sparkSession, index.path)
    return strip(docs, covered, window)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    return deduplicate(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with what stays of every text; a text that loses nothing is left as it is."""
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")).alias("text")
    return deduplicate(docs).select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
