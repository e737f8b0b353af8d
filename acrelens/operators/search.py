"""Search of parcels: filter, score, sort and page in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.functions.parcel import deal_score
from acrelens.functions.text import address_order
from acrelens.operators.filters import event_predicates, matching, predicates, score_predicates, visible_to
from acrelens.scratch import materialize

_ID = ["county_fips", "parcel_id"]
_EVENT = ["signal_tier", "listing_type", "days_on_market", "event_arv_source", "event_arv_estimate"]
# Sort field, its column, what stands for null (second key: the score, but the spread for the score).
SORTS = {
    "deal_score": ("deal_score", -1), "arv_spread": ("arv_spread", -1), "jv": ("jv", -1), "list_price": ("list_price", -1),
    "years_since_last_sale": ("years_since_last_sale", -1), "tot_lvg_area": ("tot_lvg_area", -1), "act_yr_blt": ("act_yr_blt", -1),
    "signal_tier": ("signal_tier", 99), "arv_source": ("event_arv_source", ""), "address": ("phy_addr1", None),
}


def latest_events(events: DataFrame) -> DataFrame:
    """The event of the greatest id of each parcel, in one aggregate."""
    rest = [c for c in events.columns if c not in _ID]
    return events.groupBy(*_ID).agg(F.max_by(F.struct(*rest), "id").alias("e")).select(*_ID, "e.*")


def scored(parcels: DataFrame, events: DataFrame, criteria: dict, weights: dict[str, float]) -> DataFrame:
    """Parcels that meet the criteria, with their latest event's facts and the deal score."""
    latest = latest_events(events).select(*_ID, *[c for c in _EVENT if c in events.columns])
    rows = matching(parcels, predicates(criteria)).join(latest, _ID, "left")
    rows = matching(rows, event_predicates(criteria))
    score = deal_score(weights, F.col("arv_spread"), F.col("jv"), F.col("signal_tier"), F.col("days_on_market"), F.col("absentee_owner"))
    return matching(rows.withColumn("deal_score", score), score_predicates(criteria))


def order_of(field: str = "deal_score", direction: str = "DESC") -> list[Column]:
    """Sort columns: the field, the second key and the parcel id, all one way; then the county."""
    if field not in SORTS:
        field, direction = "deal_score", "DESC"
    down = direction.upper() != "ASC"
    column, null = SORTS[field]
    if field == "address":
        keys = [address_order(F.col(column), descending=down)]
    elif field == "arv_source":
        keys = [F.coalesce(column, F.lit(null)), F.col("parcel_id")]
    else:
        second = "arv_spread" if field == "deal_score" else "deal_score"
        keys = [F.coalesce(F.col(column).cast("double"), F.lit(float(null))), F.coalesce(F.col(second).cast("double"), F.lit(-1.0)), F.col("parcel_id")]
    return [k.desc() if down else k.asc() for k in keys] + [F.asc("county_fips"), F.asc("parcel_id")]


def page_of(rows: DataFrame, criteria: dict, field: str = "deal_score", direction: str = "DESC", page: int = 1, size: int = 25) -> DataFrame:
    """One page in order, with ``position`` from 1. The cap of the criteria comes after the sort."""
    cap = ((criteria.get("filters") or {}).get("max_results") or {}).get("value")
    first, last = (page - 1) * size, page * size
    last = min(last, cap) if cap else last
    top = rows.orderBy(*order_of(field, direction)).limit(max(last, 0))  # a page's end bounds what is sorted out
    place = F.row_number().over(Window.orderBy(*order_of(field, direction)))
    return top.withColumn("position", place).filter(F.col("position") > first)


def deep_page_of(rows: DataFrame, criteria: dict, field: str = "deal_score", direction: str = "DESC", page: int | None = None, size: int = 25, ranges: int | None = None) -> DataFrame:
    """``page_of`` for pages far down; ``page`` may be None for the last one.

    Rows go to ranges of the order once. Counts of the ranges, one row each, tell where the
    page begins and ends, so only the ranges that it touches are sorted out, each by itself;
    no task sees the rows before the page.
    """
    cap = ((criteria.get("filters") or {}).get("max_results") or {}).get("value")
    order = order_of(field, direction)
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(dealt.groupBy("_range").count().collect())  # a row per range
    total = sum(r["count"] for r in counts)
    total = min(total, cap) if cap else total
    page = page or max(1, -(-total // size))
    first, last = (page - 1) * size, min(page * size, total)
    before, starts = 0, {}
    for r in counts:
        if before < last and before + r["count"] > first:
            starts[r["_range"]] = before
        before += r["count"]
    if not starts:
        return dealt.limit(0).withColumn("position", F.lit(0).cast("long")).drop("_range")
    start = F.coalesce(*[F.when(F.col("_range") == k, F.lit(v).cast("long")) for k, v in starts.items()])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + start
    here = dealt.filter(F.col("_range").isin(list(starts))).withColumn("position", place)
    return here.filter(F.col("position").between(first + 1, last)).drop("_range")


def totals(rows: DataFrame, criteria: dict, size: int = 25) -> DataFrame:
    """Number of results after the cap, and of pages, one at least."""
    cap = ((criteria.get("filters") or {}).get("max_results") or {}).get("value")
    n = F.count(F.lit(1))
    total = F.least(n, F.lit(cap)) if cap else n
    return rows.agg(total.alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def shown_estimate(event_estimate: Column, parcel_estimate: Column) -> Column:
    return F.coalesce(F.nullif(event_estimate, F.lit(0)), parcel_estimate)


def details(parcels: DataFrame, events: DataFrame, sales: DataFrame) -> DataFrame:
    """Parcels with their latest event and their sales, newest first, as nested lists (of one parcel)."""
    history = sales.groupBy(*_ID).agg(F.sort_array(F.collect_list(F.struct("sale_date", "id", "sale_price")), asc=False).alias("sales"))
    event = latest_events(events).select(*_ID, F.struct("id", "listing_type", "signal_tier").alias("event"))
    return parcels.join(event, _ID, "left").join(history, _ID, "left")


def lookup(parcels: DataFrame, events: DataFrame, parcel_ids: list[str], granted: list[str]) -> DataFrame:
    """Parcels of the given ids in every granted county, with their latest event's facts; the score is null."""
    found = visible_to(parcels.filter(F.col("parcel_id").isin(list(parcel_ids))), granted)
    latest = latest_events(events.join(found.select(*_ID), _ID, "left_semi")).select(*_ID, *[c for c in _EVENT if c in events.columns])
    return found.join(latest, _ID, "left").withColumn("deal_score", F.lit(None).cast("double"))
