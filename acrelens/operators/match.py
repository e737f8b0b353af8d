"""Matching of listings and court records to parcels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from acrelens.functions.text import UNIT_AT_END, parcel_key, street_address
from acrelens.scratch import materialize

_PREFIX = r"^(\d+\s+\S+(?:\s+\S+)?)"


def by_address(listings: DataFrame, parcels: DataFrame) -> DataFrame:
    """listing_id, parcel_id, level, review for every listing (listing_id, county_fips, address, zip).

    Tried in order: the address without unit, with ZIP code (1) and without (2); base
    address and unit, with ZIP (3) and without (4); the first words of the address, if
    one parcel alone begins so (5). ``review`` lists the parcels where several do. Of
    parcels with the same address the least id is taken.
    """
    zip_ = F.nullif(F.trim("zip"), F.lit(""))
    # Exploding one row keeps later steps from repeating the address expressions.
    once = lambda df, *cols: df.select("listing_id", "county_fips", F.explode(F.array(F.struct(*cols))).alias("a")).select("listing_id", "county_fips", "a.*")
    forms = once(listings, zip_.alias("zip"), street_address(F.col("address")).alias("street"), street_address(F.col("address"), strip_unit=False).alias("kept"))
    base, unit = F.trim(F.regexp_extract("kept", UNIT_AT_END, 1)), F.regexp_extract("kept", UNIT_AT_END, 2)
    asked = once(forms, F.col("zip"), F.col("street"), F.when(unit != "", F.concat_ws(" ", base, unit)).alias("with_unit"), F.when(unit != "", base).alias("base"))
    asked = materialize(asked, "asked")  # many patterns a row, and read several times
    roll = parcels.filter("phy_addr1 is not null").select("county_fips", "parcel_id", F.upper(F.trim("phy_addr1")).alias("key"), F.col("phy_zipcd").alias("zip"))
    by_zip = roll.groupBy("county_fips", "key", "zip").agg(F.min("parcel_id").alias("parcel_id"))
    by_key = by_zip.groupBy("county_fips", "key").agg(F.min("parcel_id").alias("parcel_id"))
    tries = asked.select("listing_id", "county_fips", "zip", F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("street").alias("key")), F.struct(F.lit(3).alias("level"), F.col("with_unit").alias("key")))).alias("t")).select("listing_id", "county_fips", "zip", "t.level", "t.key").filter("key <> ''")
    hits = tries.join(by_zip, ["county_fips", "key", "zip"]).select("listing_id", "level", "parcel_id")
    hits = hits.unionByName(tries.join(by_key, ["county_fips", "key"]).select("listing_id", (F.col("level") + 1).alias("level"), "parcel_id"))
    exact = hits.groupBy("listing_id").agg(F.min(F.struct("level", "parcel_id")).alias("hit")).select("listing_id", "hit.*")

    prefix = F.trim(F.regexp_extract(F.coalesce("base", "street"), _PREFIX, 1))
    # What is asked, not who asks, meets the roll: first its addresses, then the parcels of those that begin so.
    ask = ["county_fips", "prefix", "asked_zip"]
    left = asked.join(exact, "listing_id", "left_anti").select("listing_id", "county_fips", F.coalesce("zip", F.lit("")).alias("asked_zip"), prefix.alias("prefix")).filter("prefix <> ''")
    asks = left.select(*ask).distinct().withColumn("house", F.split("prefix", " ")[0])
    starts = by_key.select("county_fips", "key", F.regexp_extract("key", r"^(\d+)\s", 1).alias("house"))
    begun = asks.join(starts, ["county_fips", "house"]).filter("startswith(key, prefix)").select(*ask, "key")
    met = begun.join(roll, ["county_fips", "key"]).filter("asked_zip = '' or asked_zip = zip")
    counted = met.groupBy(*ask).agg(F.countDistinct("parcel_id").alias("n"), F.min("parcel_id").alias("one"), F.sort_array(F.collect_set("parcel_id")).alias("all"))  # of one address prefix
    told = counted.select(*ask, F.when(F.col("n") == 1, 5).alias("level"), F.when(F.col("n") == 1, F.col("one")).alias("parcel_id"), F.when(F.col("n") > 1, F.array_join("all", ",")).alias("review"))
    # The lists of parcels may be long, so they are not broadcast.
    told = left.join(told.hint("merge"), ask).select("listing_id", "level", "parcel_id", "review")
    found = exact.withColumn("review", F.lit(None).cast("string")).unionByName(told, allowMissingColumns=True)
    return listings.select("listing_id").join(found, "listing_id", "left").select("listing_id", "parcel_id", "level", "review")


def likeness(x: str, y: str) -> float:
    """100 x twice the longest common subsequence over both lengths."""
    if not x and not y:
        return 100.0
    rows: dict[str, int] = {}
    for i, c in enumerate(x):
        rows[c] = rows.get(c, 0) | 1 << i
    open_ = full = (1 << len(x)) - 1
    for c in y:
        hit = open_ & rows.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return 200.0 * (len(x) - open_.bit_count()) / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)])


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.upper(F.trim(c)), r"\s+"), lambda w: w != "")), " ")


def _shared(n: Column, least: float) -> Column:
    """How many letter pairs a text of n letters shares at least with any text that is as like as asked.

    A common subsequence of c letters leaves c - (a - c) - (b - c) - 1 pairs of neighbours in
    both texts of a and b letters, c is at least least / 200 of a + b, and b at least that of a
    text of which the whole stands in the other.
    """
    shortest = F.ceil(n * least / (200.0 - least))
    return F.ceil((3.0 * least / 200.0 - 1.0) * (n + shortest) - 1.0 - 1e-9).cast("int")


def _texts(rows: DataFrame, name: str) -> DataFrame:
    """county_fips, ``name`` and text with its words sorted; no nulls."""
    return rows.select("county_fips", name, sorted_words(F.col("text")).alias("text")).filter("county_fips is not null and text is not null")


def _lettered(rows: DataFrame, name: str, least: float) -> DataFrame:
    """county_fips, id, text and its letter pairs; a pair's second time is another pair. ``rare`` of them are enough to be found by."""
    rows = rows.select("county_fips", F.col(name).alias("id"), "text", F.length("text").alias("n"))
    pairs = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.substring("text", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("pairs", pairs)
    counted = F.transform("pairs", lambda g, i: F.concat(g, F.size(F.filter(F.slice("pairs", F.lit(1), i), lambda x: x == g)).cast("string")))
    return rows.select("county_fips", "id", "text", "n", counted.alias("pairs"), _shared(F.col("n"), least).alias("shared"), (F.col("n") - F.greatest(_shared(F.col("n"), least), F.lit(1))).alias("rare"))


def _rarest(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """county_fips, id, n, pair: the ``rare`` letter pairs of each text that the fewest choices have."""
    each = rows.select("county_fips", "id", "n", "rare", F.explode("pairs").alias("pair")).join(seen, ["county_fips", "pair"], "left")
    place = F.row_number().over(Window.partitionBy("county_fips", "id").orderBy(F.coalesce("seen", F.lit(0)), "pair"))  # the pairs of one text
    return each.withColumn("place", place).filter("place <= rare").select("county_fips", "id", "n", "pair")


def by_likeness(queries: DataFrame, choices: DataFrame, least: float) -> DataFrame:
    """query_id, choice_id, score: the likeliest choice of each query's county at the score or more, ties to the greater id.

    Both sides have county_fips and text; an id stands once. Equal texts of a county are one text:
    of choices the greatest id stands for them, and of queries all have what one finds. Likeness is that of the texts
    with their words sorted. No pair at the score is lost: texts that are so alike share
    a number of letter pairs (``_shared``), so each has one of its rarest pairs in common with
    the other, and only texts that meet on those are compared. Where more than half of a
    query's pairs would be needed, it is compared with every choice of its county, in blocks.
    """
    asked_by = _texts(queries, "query_id")
    asked = _lettered(asked_by.groupBy("county_fips", "text").agg(F.min("query_id").alias("query_id")), "query_id", least)
    offered = _lettered(_texts(choices, "choice_id").groupBy("county_fips", "text").agg(F.max("choice_id").alias("choice_id")), "choice_id", least)
    asked, offered = materialize(asked, "asked"), materialize(offered, "offered")
    few = (F.col("shared") >= 1) & (F.col("rare") * 2 <= F.col("n") - 1)
    seen = offered.select("county_fips", F.explode("pairs").alias("pair")).groupBy("county_fips", "pair").agg(F.count(F.lit(1)).alias("seen"))
    a = _rarest(asked.filter(few), seen).select("county_fips", "pair", F.col("id").alias("query_id"), F.col("n").alias("a"))
    b = _rarest(offered, seen).select("county_fips", "pair", F.col("id").alias("choice_id"), F.col("n").alias("b"))
    met = a.join(b, ["county_fips", "pair"]).filter(200.0 * F.least("a", "b") >= least * (F.col("a") + F.col("b"))).select("query_id", "choice_id").distinct()
    texts = met.join(asked.select(F.col("id").alias("query_id"), F.col("text").alias("x")), "query_id").join(offered.select(F.col("id").alias("choice_id"), F.col("text").alias("y")), "choice_id")
    scored = texts.select("query_id", "choice_id", _likeness("x", "y").alias("score")).filter(F.col("score") >= least)
    scored = scored.unionByName(_in_blocks(asked.filter(~few), offered, least))
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", F.col("choice_id"))).alias("b"))
    first = asked.select("county_fips", "text", F.col("id").alias("query_id")).join(best, "query_id").select("county_fips", "text", "b.choice_id", "b.score")
    return asked_by.join(first, ["county_fips", "text"]).select("query_id", "choice_id", "score")


#: Texts of one side that meet in a block.
BLOCK = 4096


def _in_blocks(asked: DataFrame, offered: DataFrame, least: float) -> DataFrame:
    """query_id, choice_id, score: each query's likeliest choice of every block of its county, at the score or more.

    In a block, letters alone bound the likeness; texts are compared from the highest bound down, while one can win.
    """
    def dealt(rows: DataFrame, others: DataFrame, mine: str, theirs: str) -> DataFrame:
        blocks = lambda df, name: df.groupBy("county_fips").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        sizes = blocks(rows, "own").join(blocks(others, "met"), "county_fips")
        return rows.select("county_fips", "id", "text").join(sizes, "county_fips").select("county_fips", "id", "text", F.pmod(F.xxhash64("id"), "own").cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col("met") - 1)).alias(theirs))

    def letters(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), 64), dtype=np.int16)
        for row, t in zip(out, texts):
            np.add.at(row, [ord(c) & 63 for c in t], 1)
        return out

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            have, n = letters(right["text"]), right["text"].str.len().to_numpy()
            ids, texts = right["id"].tolist(), right["text"].tolist()
            for query, x, own in zip(left["id"].tolist(), left["text"], letters(left["text"])):
                bound = 200.0 * np.minimum(have, own).sum(axis=1) / np.maximum(n + len(x), 1)
                top = None
                for i in np.argsort(-bound, kind="stable"):
                    if bound[i] < least or top is not None and bound[i] < top[0]:
                        break
                    score = likeness(x, texts[i])
                    if score >= least and (top is None or (score, ids[i]) > top):
                        top = (score, ids[i])
                if top is not None:
                    found.append((query, top[1], top[0]))
        return pd.DataFrame(found, columns=["query_id", "choice_id", "score"])

    key = ["county_fips", "turn", "block"]
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, offered)]
    a, b = dealt(asked, offered, "turn", "block"), dealt(offered, asked, "block", "turn")
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(best, f"query_id {kinds[0]}, choice_id {kinds[1]}, score double")


def legal_spellings(legal: Column) -> Column:
    """The spellings under which a roll may hold a lot of a subdivision, in order."""
    lot, block, name = F.replace(legal["lot"], F.lit("/"), F.lit(" ")), F.trim(legal["block"]), F.trim(legal["subdivision"])
    full = F.array(*[F.upper(F.concat_ws(" ", F.lit(w), F.trim(lot), F.lit("BLK"), block, name)) for w in ("LT", "LTS", "LOT")])
    return F.when(lot.isNotNull() & block.isNotNull(), full).otherwise(F.array(F.upper(name)))


def by_legal(records: DataFrame, parcels: DataFrame, least: float = 72.0) -> DataFrame:
    """record_id, parcel_id, score, spelling: parcels (county_fips, parcel_id, s_legal) of records (record_id, county_fips, legal).

    The spellings of a record's lot are tried in order; the first that is as like as asked to
    a parcel's description decides. Of parcels with the same description the greatest id counts.
    """
    spelt = records.filter("legal.subdivision is not null").select("record_id", "county_fips", F.posexplode(legal_spellings(F.col("legal"))).alias("spelling", "text"))
    spelt = spelt.select(F.concat_ws("|", F.col("record_id").cast("string"), F.col("spelling").cast("string")).alias("query_id"), "record_id", "spelling", "county_fips", "text")
    roll = parcels.filter("trim(s_legal) <> ''").groupBy("county_fips", F.upper(F.trim("s_legal")).alias("text")).agg(F.max("parcel_id").alias("choice_id"))
    roll = roll.withColumn("choice_id", F.concat_ws("|", "county_fips", "choice_id"))
    hits = by_likeness(spelt.select("query_id", "county_fips", "text"), roll, least).join(spelt.select("query_id", "record_id", "spelling"), "query_id")
    first = hits.groupBy("record_id").agg(F.min(F.struct("spelling", "choice_id", "score")).alias("b"))
    return first.select("record_id", F.element_at(F.split("b.choice_id", r"\|"), -1).alias("parcel_id"), "b.score", "b.spelling")


def by_court_record(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """record_id, parcel_id, method of every record (record_id, county_fips, legal): by lot (fuzzy_legal), else by section, else no_match."""
    # Each is read several times: fields of a legal description cost a pattern each, lots all comparisons.
    records = materialize(records.select("record_id", "county_fips", "legal"), "records")
    lots = materialize(by_legal(records, parcels), "lots")
    left = records.join(lots, "record_id", "left_anti")
    sections = by_section(left.select("record_id", "county_fips", "legal.sec", "legal.twp", "legal.rge"), parcels)
    found = lots.select("record_id", "parcel_id", F.lit("fuzzy_legal").alias("method")).unionByName(sections)
    return records.select("record_id").join(found, "record_id", "left").select("record_id", "parcel_id", F.coalesce("method", F.lit("no_match")).alias("method"))


def match_cycle(listings: DataFrame, parcels: DataFrame, events: DataFrame) -> DataFrame:
    """county_fips, listings, matched, unmatched, to_review, inserted of one round of matching.

    ``events`` (county_fips, parcel_id) are there already; a matched parcel without one is inserted once.
    """
    found = by_address(listings, parcels).join(listings.select("listing_id", "county_fips"), "listing_id")
    counts = found.groupBy("county_fips").agg(F.count(F.lit(1)).alias("listings"), F.count("parcel_id").alias("matched"), F.count_if(F.col("parcel_id").isNull()).alias("unmatched"), F.count("review").alias("to_review"))
    fresh = found.filter("parcel_id is not null").select("county_fips", "parcel_id").distinct().join(events, ["county_fips", "parcel_id"], "left_anti")
    inserted = fresh.groupBy("county_fips").agg(F.count(F.lit(1)).alias("inserted"))
    return counts.join(inserted, "county_fips", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def by_section(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """record_id, parcel_id, method of the records (record_id, county_fips, sec, twp, rge) that section, township and range lead somewhere.

    The key as it is written goes first: one parcel with it is the match (``str``), several
    are ``str_ambiguous`` and nothing more is tried. Without any, N or S at the township's end
    and E or W at the range's are dropped on both sides, and a written key that one parcel
    alone has is the match; of several such keys that of the least parcel_id.
    """
    def parts(sec: str, town: str, range_: str) -> list[Column]:
        return [F.trim(sec).alias("s"), F.trim(town).alias("t"), F.trim(range_).alias("r")]

    bare = [F.regexp_replace("t", "[NS]$", "").alias("t"), F.regexp_replace("r", "[EW]$", "").alias("r")]
    told = lambda df, *c: df.filter(" and ".join(f"{x} <> ''" for x in c))
    asked = told(records, "sec", "twp", "rge").select("record_id", "county_fips", *parts("sec", "twp", "rge"))
    written = told(parcels, "sec", "twn", "rng").select("county_fips", "parcel_id", *parts("sec", "twn", "rng")).groupBy("county_fips", "s", "t", "r").agg(F.count(F.lit(1)).alias("n"), F.min("parcel_id").alias("one"))
    tolerant = written.filter("n = 1").select("county_fips", "s", *bare, "one").groupBy("county_fips", "s", "t", "r").agg(F.min("one").alias("parcel_id"))
    met = asked.join(written, ["county_fips", "s", "t", "r"], "left")
    exact = met.filter("n is not null").select("record_id", F.when(F.col("n") == 1, F.col("one")).alias("parcel_id"), F.when(F.col("n") == 1, "str").otherwise("str_ambiguous").alias("method"))
    rest = met.filter("n is null").select("record_id", "county_fips", "s", *bare).join(tolerant, ["county_fips", "s", "t", "r"])
    return exact.unionByName(rest.select("record_id", "parcel_id", F.lit("str").alias("method")))


def by_parcel_id(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """Records (record_id, county_fips, raw_id) with the parcel whose id has the same letters and digits."""
    a = records.select("record_id", "county_fips", parcel_key(F.col("raw_id")).alias("key")).filter("key <> ''")
    b = parcels.select("county_fips", "parcel_id", parcel_key(F.col("parcel_id")).alias("key"))
    return a.join(b, ["county_fips", "key"]).groupBy("record_id").agg(F.min("parcel_id").alias("parcel_id"))
