"""Filter interaction audit: what each filter removes, in every order of filters.

A row's failures are a mask with a bit per filter. Four filters judge a text alone; the
fifth fails a text that a smaller doc_id has as well, and goes by fingerprints: only rows
whose xxhash fingerprint stands more than once are routed. Of those, a map task keeps
chains, a fingerprint's different texts with the least doc_id met so far, and gives any
other row out as failed; what is left, a row per text and task, goes through an RDD that
is partitioned by the fingerprint and sorted by fingerprint and doc_id. There the chains
of one fingerprint at a time tell which ids are not the least of their text. Texts are
compared whole, so equal fingerprints of different texts do no harm, and a text that a
third of all rows repeat costs its fingerprint's partition one row per map task.

``combineByKey`` then adds up count vectors, a place per mask, for every part; those of
a task are merged before they move. The report is arithmetic on a part's vector.

Cases: a null text is empty; a null lang is the part with the empty name. A null doc_id
comes after all others, so its text fails if any other doc_id has it. Rows that repeat a
doc_id count each and don't fail each other. Several labels of a document: any that says
1 counts; documents without one are neither good nor toxic. Other columns are ignored.
No rows: none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.llm.rows import flagged
from acrelens.llm.worker import small_batches
from acrelens.scratch import Workspace

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 3
#: Characters of which a text should have none.
ODD = b"#$%&*|"
#: Bytes of texts that a map task holds in chains before it gives them out.
HELD_BYTES = 32 << 20
_COPY = 1 << FILTERS.index("E")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUED = bytes(range(0x80, 0xC0))
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text in UTF-8 fails."""
    words = text.split()
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * len(text.translate(None, _NOT_UPPER)) > MOST_UPPER_PERCENT * len(text.translate(None, _CONTINUED))) << 2
    return mask | (len(text.translate(None, ODD)) < len(text)) << 3


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def _after(doc_id) -> tuple:
    """Sorts doc_ids with null last."""
    return (True, "") if doc_id is None else (False, doc_id)


def _first_chains(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Decided rows (fp and text null), and for every text of shared fingerprint the rows of its least doc_id so far."""
    names = ["doc_id", "part", "mask", "n", "fp", "text"]
    kinds = [kind, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    chains: dict[tuple[int, bytes], list] = {}  # fingerprint and text: least doc_id, mask, rows by part
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for (fp, text), (least, mask, parts) in chains.items():
            for part, n in parts.items():
                some.append((least, part, mask, n, fp, text))
            size += len(text)
            if size > 1 << 22:
                yield table(some)
                some, size = [], 0
        if some:
            yield table(some)
        chains.clear()

    for batch in small_batches(batches):
        out = []
        for doc_id, part, fp, shared, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not shared:
                out.append((doc_id, part, failures(text), 1, None, None))
                continue
            chain = chains.get((fp, text))
            if chain is None:
                chains[fp, text] = [doc_id, failures(text), Counter([part])]
                held += len(text)
            elif doc_id == chain[0]:
                chain[2][part] += 1
            elif _after(doc_id) > _after(chain[0]):
                out.append((doc_id, part, chain[1] | _COPY, 1, None, None))
            else:
                out += [(chain[0], p, chain[1] | _COPY, n, None, None) for p, n in chain[2].items()]
                chain[0], chain[2] = doc_id, Counter([part])
        if out:
            yield table(out)
        if held > HELD_BYTES:
            yield from given()
            held = 0
    yield from given()


def _chains(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of rows sorted by fingerprint and doc_id; a text's first doc_id is its least."""
    now, least = None, {}
    for (fp, *after), (doc_id, part, mask, n, text) in rows:
        if fp != now:
            now, least = fp, {}
        first = least.setdefault(text, after)
        yield doc_id, part, mask if first == after else mask | _COPY, n


def masks(docs: DataFrame, hash_text=fingerprint) -> DataFrame:
    """(doc_id, part, mask, n): every row's failures; n rows that tell the same may stand as one.

    ``hash_text`` maps a text Column to a long; any function gives the same result.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    work = Workspace(spark, "audit")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), hash_text(text).alias("fp"), text.alias("text"))
    shared = work.write(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "shared")
    marked = flagged(rows, shared, ["fp"], "shared").select("doc_id", "part", "fp", "shared", "text")
    arrow = marked.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = f"doc_id {kind.simpleString()}, part string, mask int, n long"
    first = work.write(marked.mapInArrow(lambda batches: _first_chains(batches, arrow), f"{schema}, fp long, text binary"), "first")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = (
        first.filter("fp is not null")
        .rdd.map(lambda r: ((r["fp"], *_after(r["doc_id"])), (r["doc_id"], r["part"], r["mask"], r["n"], bytes(r["text"]))))
        .repartitionAndSortWithinPartitions(partitions, itemgetter(0))
        .mapPartitions(_chains)
    )
    judged = spark.createDataFrame(routed, schema, verifySchema=False)
    out = work.write(first.filter("fp is null").select("doc_id", "part", "mask", "n").unionByName(judged), "masks")
    work.drop(shared, first)
    return out


def _vector(value: tuple) -> np.ndarray:
    return _added(np.zeros((3, 1 << len(FILTERS)), dtype=np.int64), value)


def _added(vector: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def report(part: str, vector: np.ndarray) -> list[tuple]:
    """The rows of a part: every order of the filters and every step."""
    every = np.arange(vector.shape[1])
    # Column P: how many rows (all, good, toxic) fail none of the filters in P.
    passing = np.stack([vector[:, every & tried == 0].sum(axis=1) for tried in every], axis=1).tolist()
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    fails = {f: int(vector[0, every & b > 0].sum()) for f, b in bits.items()}
    steps, shapley = [], Counter()
    for order in permutations(FILTERS):
        tried = 0
        for step, f in enumerate(order, 1):
            after = tried | bits[f]
            removed, good, toxic = (row[tried] - row[after] for row in passing)
            shapley[f] += removed
            steps.append((f, "".join(order), step, passing[0][after], removed, good, toxic))
            tried = after
    return [(part, order, step, kept, removed, fails[f] - removed, int(vector[0, bits[f]]), good, toxic, shapley[f]) for f, order, step, kept, removed, good, toxic in steps]


def interactions(docs: DataFrame, labels: DataFrame, hash_text=fingerprint) -> DataFrame:
    """Every part, order and step; see REPORT."""
    spark = docs.sparkSession
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    rows = masks(docs, hash_text).join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _added, np.add, partitions)
    return spark.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), REPORT, verifySchema=False)


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
facts AS (
  SELECT doc_id, part, t, len({_WORDS}) AS words, len(list_distinct({_WORDS})) AS different,
         min(doc_id) OVER (PARTITION BY t) AS least
  FROM docs),
judged AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [CASE WHEN words < {LEAST_WORDS} THEN 'A' END,
          CASE WHEN 100 * different < {LEAST_DISTINCT_PERCENT} * words THEN 'B' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_UPPER_PERCENT} * length(t) THEN 'C' END,
          CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
          CASE WHEN coalesce(facts.doc_id > least, least IS NOT NULL) THEN 'E' END] AS failed
  FROM facts LEFT JOIN said USING (doc_id)),
counts AS MATERIALIZED (
  SELECT part, list_filter(failed, lambda x: x IS NOT NULL) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS tried
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS MATERIALIZED (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT list_has_any(failed, tried) AND NOT list_contains(failed, f)), 0) AS kept,
         coalesce(sum(n) FILTER (NOT list_has_any(failed, tried) AND list_contains(failed, f)), 0) AS removed,
         coalesce(sum(n) FILTER (list_has_any(failed, tried) AND list_contains(failed, f)), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = [f]), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT list_has_any(failed, tried) AND list_contains(failed, f)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT list_has_any(failed, tried) AND list_contains(failed, f)), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
