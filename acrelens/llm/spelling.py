"""Grouping of spelling variants by Aho-Corasick automata over the halves of words.

Words are counted first: maximal runs of letters, A-Z lowered, with the rule below for
runs that lose a code point; map tasks add up before rows move. Two words are near if one
inserted, deleted or replaced code point tells them apart. An edit falls into one half of
a word, so the other half stands in the near word unchanged, at its start or at its end.

Every word has two segments, its first len // 2 code points and the rest. A segment goes
to a shard by its hash, so a shard holds about SEGMENTS segments in all at any number of
words; one that more than SEGMENTS words have is dealt to several parts, by the words'
hashes. A word is scanned wherever a segment may lie that fits its length: its prefixes
and suffixes of two lengths each. A part builds one automaton from its segments, and the
words stream through it: a hit counts if it stands at the word's start (a first half) or
at its end (a second half) and if the lengths differ by one at most; the distance is then
verified. Within a segment the words' other halves stand in a table by what is left of
them when one code point goes, so a hit meets the few that can be near and not all that
share the segment. A pair that agrees on its first half is counted there alone.

A part adds up what a word met (how many, and the best of them), so what moves is a row
per word and part and no pair. A word's form is its near word of largest count (ties: the
smallest in code-point order), if that is at least FACTOR times the word's own; chains of
forms are followed by doubling, and counts grow along them, so a few joins end them.

Cases: a null or empty text has no words; a null doc_id counts as an empty one in the
hash. Repeated rows count again. Runs of any length are counted; very long ones have long
segments. Other columns are ignored. No rows: none.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.llm.worker import small_batches
from acrelens.scratch import Workspace

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
#: One of so many pairs of document and run loses a code point.
LOSES = 31
SEGMENTS = 20_000
#: Different words that a task counts before it gives them out.
COUNTED = 200_000
#: Characters of a text that are searched at once.
STRETCH = 1 << 20
#: Halves with more code points go by hashes.
SHORT = 48
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def runs(text: str) -> Iterator[list[str]]:
    """All runs of a text, a long one in stretches that end between runs."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):  # to the end of the run that stands there
            met = _RUNS.match(text, end)
            end = met.end() if met else end
        yield _RUNS.findall(text, at, end)
        at = end


def word_of(doc_id: str, run: str) -> str:
    """The word that a lowered run of a document counts for."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % LOSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = defaultdict(int)

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in small_batches(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            low = text.as_buffer().to_pybytes().lower().decode("utf-8", "replace") if text.is_valid else ""  # bytes lower A-Z alone
            own: dict[str, int] = defaultdict(int)
            for found in runs(low):
                for run in found:
                    own[run] += 1
            for run, n in own.items():
                if len(run) >= LEAST_LENGTH:
                    word = word_of(doc_id, run)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            if len(total) > COUNTED:
                yield given()
    yield given()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that take part."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point, and no less, tells a and b apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def _keys(half: str) -> set[str | int]:
    """A half and what is left of it without one code point; longer than SHORT, as a hash, as nearness is verified."""
    n = len(half)
    if n <= SHORT:
        return {half, *[half[:i] + half[i + 1 :] for i in range(n)]}
    start, power = [0], [1]
    for c in half:
        start.append((start[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    whole = start[n]
    if n == SHORT + 1:
        return {whole, *[half[:i] + half[i + 1 :] for i in range(n)]}
    # The hash of half[i + 1:] is whole - start[i + 1] * power[n - 1 - i].
    return {whole, *[(whole + (start[i] - start[i + 1]) * power[n - 1 - i]) % _PRIME for i in range(n)]}


class Side(dict):
    """The words that have a segment on one side: what their other halves become, themselves or without one code point."""

    def add(self, half: str, word: tuple[str, int]) -> None:
        for key in _keys(half):
            self.setdefault(key, []).append(word)

    def near(self, half: str) -> set[tuple[str, int]]:
        found: set[tuple[str, int]] = set()
        for key in _keys(half):
            if key in self:
                found.update(self[key])
        return found


class Segment:
    """A segment of a shard's automaton: the words that begin and those that end with it."""

    def __init__(self) -> None:
        self.starts, self.ends = Side(), Side()


class Shard:
    """The automaton of a shard's segments."""

    def __init__(self, halves: Iterator[tuple[str, int, bool]]):
        """``halves``: words with their counts, and which half is meant (true: the first)."""
        import ahocorasick

        segments: dict[str, Segment] = defaultdict(Segment)
        for word, n, first in halves:
            cut = len(word) // 2
            if first:
                segments[word[:cut]].starts.add(word[cut:], (word, n))
            else:
                segments[word[cut:]].ends.add(word[:cut], (word, n))
        automaton = ahocorasick.Automaton()
        for name, segment in segments.items():
            automaton.add_word(name, (len(name), segment))
        automaton.make_automaton()
        self.scan = automaton.iter if segments else lambda word: ()  # a part of a segment may have got no word

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The near words, with their counts, that the segments here lead to."""
        length = len(word)
        for end, (size, segment) in self.scan(word):
            if end + 1 == size:
                for other in segment.starts.near(word[size:]):
                    if abs(len(other[0]) - length) <= 1 and one_edit(word, other[0]):
                        yield other
            if end + 1 == length:
                for other in segment.ends.near(word[: length - size]):
                    cut = len(other[0]) // 2
                    if abs(len(other[0]) - length) <= 1 and word[:cut] != other[0][:cut] and one_edit(word, other[0]):
                        yield other


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and part, halves before words: what each word met."""
    now, halves, shard, last = None, [], None, None
    for batch in batches:
        out = []
        for name, part, kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (name, part) != now:
                now, halves, shard, last = (name, part), [], None, None
            if kind < 2:
                halves.append((word, n, kind == 0))
                continue
            if word == last:  # several of its segments may lie here
                continue
            last = word
            if shard is None:
                shard, halves = Shard(halves), []
            count, best, most = 0, "", 0
            for other, m in shard.near(word):
                count += 1
                if m > most or (m == most and other < best):
                    best, most = other, m
            if count:
                out.append((word, count, best, most))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "count", "best", "most"])


def _halves(at: DataFrame) -> DataFrame:
    """(kind, word, n, segment): a row per half; kind 0 is the first, 1 the second."""
    cut = F.floor(F.length("word") / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("kind"), F.substring("word", F.lit(1), cut).alias("segment")), F.struct(F.lit(1).alias("kind"), F.expr("substring(word, cast(length(word) div 2 as int) + 1)").alias("segment")))
    return at.select("word", "n", F.explode(both).alias("h")).select("h.kind", "word", "n", "h.segment")


def _asked(at: DataFrame) -> DataFrame:
    """(word, segment): the prefixes and suffixes that may be a half of a word whose length differs by one at most."""
    size, word = F.length("word"), F.col("word")
    prefixes = [F.substring(word, F.lit(1), F.floor((size + i) / 2).cast("int")) for i in (-1, 0, 1)]
    suffixes = [F.right(word, F.ceil((size + i) / 2).cast("int")) for i in (-1, 0, 1)]
    return at.select("word", F.explode(F.array_distinct(F.array(*prefixes, *suffixes))).alias("segment"))


def near_words(counted: DataFrame, work: Workspace, segments: int = SEGMENTS) -> DataFrame:
    """(word, n_near, best, most) for the words of ``counted`` (word, n), a written table, that have near words."""
    total = 2 * counted.count()
    shards = max(1, -(-total // segments))
    halves = _halves(counted)
    sizes = halves.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / segments).cast("int").alias("parts"))
    sizes = work.write(sizes.withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(shards)).cast("int")), "segments")  # written: the joins below can split a hot segment
    part: Column = F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts")).cast("int")
    held = halves.join(sizes, "segment").select("shard", part.alias("part"), "kind", "word", "n")
    asked = _asked(counted).join(sizes, "segment").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2).alias("kind"), "word", F.lit(0).cast("long").alias("n"))
    dealt = held.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "word")
    met = dealt.mapInArrow(_scanned, "word string, count long, best string, most long")
    best = F.min(F.struct((-F.col("most")).alias("less"), "best")).alias("first")
    return met.groupBy("word").agg(F.sum("count").alias("n_near"), best).select("word", "n_near", "first.best", (-F.col("first.less")).alias("most"))


def roots(links: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) from (word, form), a written table without circles: the last of each word's chain."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = work.write(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, segments: int = SEGMENTS, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    work = Workspace(docs.sparkSession, "spelling")
    counted = work.write(words(docs), "words")
    near = near_words(counted, work, segments)
    has = F.coalesce(F.col("most") >= factor * F.col("n"), F.lit(False))
    told = work.write(
        counted.join(near, "word", "left").select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("most")).alias("form_n")), "told"
    )
    links = told.filter("form is not null").select("word", "form")
    return told.join(roots(links, work), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc32(value: str) -> str:
    """CRC-32 of a text in SQL: its bytes one by one through the table of the reversed polynomial."""
    byte = f"('0x' || h[2 * i + 1:2 * i + 2])::INT"
    return (
        f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: {byte}::BIGINT)), "
        "lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255)::INT + 1]))".replace("h[", f"{value}[").replace("len(h)", f"len({value})")
    )


ORACLE_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT b AS byte, b::BIGINT AS value, 0 AS step FROM range(256) AS r(b)
  UNION ALL
  SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1 FROM bits WHERE step < 8),
tables AS MATERIALIZED (SELECT list(value ORDER BY byte) AS crc FROM bits WHERE step = 8),
found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
per_doc AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS hx FROM found WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS MATERIALIZED (SELECT run, n, xor({_crc32("hx")}, 4294967295) AS h FROM per_doc, tables),
results AS (SELECT CASE WHEN h % {LOSES} = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, max(m) AS most, min(struct_pack(l := -m, w := other)).w AS other FROM near GROUP BY word),
told AS MATERIALIZED (
  SELECT w.word, CASE WHEN most >= {FACTOR} * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FACTOR} * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word),
chain AS (
  SELECT word, word AS root, form AS onward FROM told
  UNION ALL
  SELECT c.word, c.onward, t.form FROM chain c JOIN told t ON c.onward = t.word)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, root FROM chain WHERE onward IS NULL) ends ON told.word = ends.word
"""
