"""Approximate nearest neighbours by a hash-prefix forest.

A tree projects the vectors on random orthogonal axes and writes each as a string of
BITS signs. A tree is the sorted array of those strings; it lies in buckets by the first
bits, and a bucket with many strings in several salted groups, each sorted. A query
descends from its own string, and from PROBES strings with one sign turned where the
query is nearest to the axis' border, to the longest prefix that meets something, and
ascends: all trees together shorten the prefix bit by bit until they give the query
``enough(n)`` rows in all, and k for each tree at least, so that k of them differ. How
long the prefix is then differs from query to query, as its surroundings are dense or
thin. A query that has less at the bucket's bits ascends to the empty prefix: it is
scored against every vector, in blocks. The first job counts what each prefix length
gives; the second multiplies each query with the rows of its spans alone, by inner
product in double precision, and keeps the best of each group. Equal products go to the
smaller vec_id: every cut is by score and by the least id of a class, all that ties at a
cut is compared, and a product is the sum from the first part to the last, so that it is
the same number in any block.

``enough(n)`` is n * (STARTS / n) ** FALL: near-random vectors need a share of the table
that falls slowly as it grows. Measured recall is in the README.

Largest inner product becomes smallest angle by one more coordinate on candidates,
sqrt(1 - |x|^2 / M^2) after scaling by the largest length M, and zero on queries. That
coordinate is alike for vectors much shorter than M, so vectors are split into bands of
nearly equal length, a forest each with its own M, and a query ascends in each by itself.

Equal vectors are one class that enters the forest once, with its K + 1 smallest ids
to be told in results, so any number of copies costs no more than one.

Cases: vectors that are null, zero, hold null or non-finite parts, or differ in length
from the commonest length take no part, nor do null ids. Repeated (id, vector) rows
count once. Fewer than K candidates: all of them. No rows: none. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrelens.scratch import Workspace, materialize

K = 20
TREES = 32
BITS = 64
#: The longest prefix that is counted.
LONGEST = 40
PROBES = 4
#: Signs that may be turned.
TURNED = 10
STARTS, FALL = 500, 0.2
ROWS_PER_GROUP = 8192
#: Queries that meet one group at once; more of them meet it in turns.
QUERIES_PER_GROUP = 32768
#: Bands for each doubling of the length; lengths near a power of two share one.
BANDS = 4
EVERY = 20
_PLACE = ["band", "tree", "bucket"]
_GROUP = [*_PLACE, "salt", "turn"]


@dataclass(frozen=True)
class Settings:
    k: int = K
    every: int = EVERY
    trees: int = TREES
    probes: int = PROBES
    #: How many rows end the ascent in a band, in place of ``enough(n)``.
    candidates: int | None = None
    rows_per_group: int = ROWS_PER_GROUP
    queries_per_group: int = QUERIES_PER_GROUP
    seed: int = 7


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["dim"] if lengths else 0)).distinct()


def axes(dim: int, trees: int, seed: int) -> list[np.ndarray]:
    """For each tree BITS directions; orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(seed)
    blocks = -(-BITS // dim)
    return [np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(blocks)])[:, :BITS] for _ in range(trees)]


def strings(y: np.ndarray) -> np.ndarray:
    """The signs of projections as unsigned 64-bit numbers, the first sign highest."""
    return np.packbits(y > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def probed(y: np.ndarray, probes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings of queries and which sign is turned in each: none (-1), then the least certain ones."""
    own = strings(y)
    order = np.argsort(np.abs(y[:, :TURNED]), axis=1, kind="stable")[:, :probes]
    out = [(own, np.full(len(y), -1))]
    for turned in order.T:
        out.append((own ^ (np.uint64(1) << (63 - turned).astype(np.uint64)), turned))
    return out


def spans(codes: np.ndarray, query: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted codes the strings stand that share ``level`` bits with each query."""
    masks = np.array([((1 << 64) - 1) ^ ((1 << (64 - n)) - 1) for n in range(65)], dtype=np.uint64)[level]
    return np.searchsorted(codes, query & masks, "left"), np.searchsorted(codes, query | ~masks, "right")


def enough(n):
    """How many rows, repeats in several trees included, end the ascent among n; of numbers or a Column."""
    return n * (STARTS / n) ** FALL


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), dim)


def reaching(queries: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all rows of x whose product may be among the k largest of query i, every tie at the k-th with them."""
    found = queries @ x.T
    if len(x) <= k:
        return tuple(np.indices(found.shape).reshape(2, -1))
    # A matrix product adds up in an order of its own, so what it says of a row may be off by this much.
    off = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max()
    return np.nonzero(found >= (np.partition(found, -k, axis=1)[:, -k] - off)[:, None])


def products(queries: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added up from the first part to the last, whatever else is in a block."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        a, b = queries[i[at : at + (1 << 16)]], x[j[at : at + (1 << 16)]]
        for part in range(x.shape[1]):
            out[at : at + len(a)] += a[:, part] * b[:, part]
    return out


def _first(q: np.ndarray, u: np.ndarray, least: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query; ties by the classes' least ids."""
    order = np.lexsort((least, -score, q))
    kept = order[np.arange(len(q)) - np.searchsorted(q[order], q[order], "left") < k]
    return q[kept], u[kept], least[kept], score[kept]


class Forest:
    """The distinct vectors of a table, their trees, and the queries' strings; all tables are written."""

    def __init__(self, embeddings: DataFrame, settings: Settings):
        self.settings = settings
        #: Vectors of floats travel as floats, which are doubles exactly.
        self.kind = embeddings.schema["embedding"].dataType.simpleString()
        self.work = work = Workspace(embeddings.sparkSession, "forest")
        rows = work.write(valid_vectors(embeddings), "vectors")
        smallest = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= settings.k + 1)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        classes = smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
        self.classes = work.write(classes.select(F.monotonically_increasing_id().alias("u"), "ids", F.col("ids")[0].alias("least"), "v", F.floor(F.log2(square) / 2 * BANDS + 0.5).cast("int").alias("band")), "classes")
        self.asked = work.write(rows.filter(F.col("vec_id") % settings.every == 0).join(self.classes.select("u", "v"), "v").select("vec_id", "u"), "asked")
        self.queries = self.asked.select("u").distinct()
        self.bands = work.write(self.classes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m"), F.max(F.size("v")).alias("dim")), "bands")
        stats = self.bands.collect()  # a row per quarter of a doubling: a double's exponent bounds them
        self.longest = {r["band"]: float(np.sqrt(r["m"])) for r in stats}
        self.dim = max((r["dim"] for r in stats), default=1)
        #: Bits of a bucket; no query stops between these and the empty prefix.
        self.least = min(6, max(0, int(np.log2(max(1, *(r["n"] for r in stats), 1) / 2048))))
        self._grow()

    def _grow(self) -> None:
        settings, longest, dim, shift = self.settings, self.longest, self.dim, np.uint64(64 - self.least)
        directions = axes(dim + 1, settings.trees, settings.seed)

        def bucket(code: np.ndarray) -> np.ndarray:
            return (code >> shift).astype(np.int64) if shift < 64 else np.zeros(len(code), dtype=np.int64)

        def plant(batches):
            for df in batches:
                x = _matrix(df["v"], dim) / df["band"].map(longest).to_numpy()[:, None]
                x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])
                for tree, to in enumerate(directions):
                    code = strings(x @ to)
                    yield pd.DataFrame({"band": df["band"].to_numpy(), "tree": tree, "bucket": bucket(code), "code": code.view(np.int64), "u": df["u"].to_numpy()})

        def ask(batches):
            for df in batches:
                x = np.hstack([_matrix(df["v"], dim), np.zeros((len(df), 1))])
                for tree, to in enumerate(directions):
                    for code, turned in probed(x @ to, settings.probes):
                        yield pd.DataFrame({"tree": tree, "bucket": bucket(code), "code": code.view(np.int64), "turned": turned.astype(np.int32), "u": df["u"].to_numpy()})

        planted = self.work.write(self.classes.select("band", "u", "v").mapInPandas(plant, "band int, tree int, bucket long, code long, u long"), "strings")
        asking = self.queries.join(self.classes.select("u", "v"), "u").mapInPandas(ask, "tree int, bucket long, code long, turned int, u long")
        met = asking.join(planted.select(*_PLACE).distinct(), ["tree", "bucket"])
        self.trees, self.probes = self.dealt(planted, self.work.write(met, "probes"))

    def dealt(self, planted: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides with the groups in which each string meets each query of its place once."""
        salts = planted.groupBy(*_PLACE).agg(F.ceil(F.count(F.lit(1)) / self.settings.rows_per_group).cast("int").alias("salts"))
        turns = probes.groupBy(*_PLACE).agg(F.ceil(F.count(F.lit(1)) / self.settings.queries_per_group).cast("int").alias("turns"))
        places = self.work.write(salts.join(turns, _PLACE), "places")  # written: the joins below can split a hot place
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        planted = planted.join(places, _PLACE).withColumn("salt", F.pmod(F.xxhash64("u"), "salts").cast("int"))
        planted = planted.select(*_PLACE, "code", "u", "salt", upto("turns").alias("turn"))
        probes = probes.join(places, _PLACE).withColumn("turn", F.pmod(F.xxhash64("u"), "turns").cast("int"))
        probes = probes.select(*_PLACE, "code", "turned", "u", upto("salts").alias("salt"), "turn")
        return self.work.write(planted, "trees"), self.work.write(probes, "asking")

    def levels(self) -> DataFrame:
        """(u, band, level): where each query's ascent ends in each band; 0 is the empty prefix."""
        least, settings = max(1, self.least), self.settings
        levels = range(least, LONGEST + 1)

        def count(planted: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(planted["code"].to_numpy().view(np.uint64), kind="stable")
            codes = planted["code"].to_numpy().view(np.uint64)[order]
            at = pd.Series(np.arange(len(order)), index=planted["u"].to_numpy()[order]).reindex(probes["u"]).fillna(-1).to_numpy()  # the query's own class is no candidate
            query, turned = probes["code"].to_numpy().view(np.uint64), probes["turned"].to_numpy()
            out = {"u": probes["u"], "band": probes["band"]}
            for level in levels:
                low, high = spans(codes, query, np.full(len(query), level))
                out[f"n{level}"] = np.where(turned < level, high - low - ((low <= at) & (at < high)), 0)
            return pd.DataFrame(out)

        names = [f"n{level}" for level in levels]
        counted = self.trees.groupBy(*_GROUP).cogroup(self.probes.groupBy(*_GROUP)).applyInPandas(count, "u long, band int, " + ", ".join(f"{c} long" for c in names))
        total = counted.groupBy("u", "band").agg(*[F.sum(c).alias(c) for c in names])
        wanted = F.greatest(F.ceil(enough(F.col("n"))), F.lit(settings.trees * settings.k)) if settings.candidates is None else F.lit(settings.candidates)
        level = F.coalesce(*[F.when(F.col(f"n{i}") >= wanted, i) for i in reversed(levels)], F.lit(0))
        # A pair of query and band that met no bucket has no count.
        reached = self.queries.join(F.broadcast(self.bands.select("band", "n")), how="cross").join(total, ["u", "band"], "left")  # bands: a few rows
        return self.work.write(reached.select("u", "band", level.alias("level")), "levels")

    def scored(self, reached: DataFrame) -> DataFrame:
        """(q, u, least, score): for each query the best k + 1 of each group among the rows of its spans."""
        k, dim = self.settings.k, self.dim

        def score(planted: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"q": [], "u": [], "least": [], "score": []}).astype({"q": "int64", "u": "int64", "least": "int64", "score": "float64"})
            if planted.empty or probes.empty:
                return none
            order = np.argsort(planted["code"].to_numpy().view(np.uint64), kind="stable")
            codes, names, least = planted["code"].to_numpy().view(np.uint64)[order], planted["u"].to_numpy()[order], planted["least"].to_numpy()[order]
            x = _matrix(planted["v"], dim)[order]
            low, high = spans(codes, probes["code"].to_numpy().view(np.uint64), probes["level"].to_numpy())
            asked, vectors = probes["u"].to_numpy(), _matrix(probes["qv"], dim)
            rows = np.flatnonzero(high > low)
            rows = rows[np.lexsort((high[rows], low[rows]))]
            cuts = np.flatnonzero((np.diff(low[rows]) != 0) | (np.diff(high[rows]) != 0)) + 1
            out = []
            for same in np.split(rows, cuts):  # queries of one span
                for at in range(0, len(same), 512):
                    part = same[at : at + 512]
                    a, b = low[part[0]], high[part[0]]
                    i, j = reaching(vectors[part], x[a:b], k + 1)
                    out.append(_first(asked[part][i], names[a:b][j], least[a:b][j], products(vectors[part], x[a:b], i, j), k + 1))
            if not out:
                return none
            return pd.DataFrame(dict(zip(none, _first(*(np.concatenate(c) for c in zip(*out)), k + 1))))

        trees, probes = self.trees, self.probes
        short = reached.filter("level = 0").select("band", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("code"), F.lit(-1).alias("turned"), "u")
        if not short.isEmpty():
            whole = self.classes.select("band", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("code"), "u")
            every_row, every_short = self.dealt(whole, short)
            trees, probes = trees.unionByName(every_row), probes.unionByName(every_short)
        vectors = self.classes.select("u", "least", F.col("v").cast(self.kind if self.kind == "array<float>" else "array<double>").alias("v"))
        left = trees.join(vectors, "u").select(*_GROUP, "code", "u", "least", "v")
        right = probes.join(reached, ["u", "band"]).filter("if(tree < 0, level = 0, level > turned and level > 0)")
        right = right.join(vectors, "u").select(*_GROUP, "code", "u", F.col("v").alias("qv"), "level")
        return left.groupBy(*_GROUP).cogroup(right.groupBy(*_GROUP)).applyInPandas(score, "q long, u long, least long, score double")


def nearest(embeddings: DataFrame, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id ``every`` divides, against all others; see ``Settings``."""
    forest = Forest(embeddings, Settings(**settings))
    k = forest.settings.k
    best = forest.scored(forest.levels()).groupBy("q", "u", "least").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least", "u"))).filter(F.col("r") <= k + 1)
    told = best.join(forest.classes.select("u", "ids"), "u").select("q", "score", F.explode("ids").alias("vec_id"))
    told = told.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = told.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))  # k + 1 at most
    asked = forest.asked.select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(lists, "q").select("query_id", F.posexplode(own).alias("p", "x"))
    out = materialize(out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")), "nearest")
    forest.work.clear()
    return out
