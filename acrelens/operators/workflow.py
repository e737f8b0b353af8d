"""Workflow state and outreach as joins over requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States and those that may follow.
FOLLOWING = {
    "NEW": ("REVIEWED", "REJECTED"), "REVIEWED": ("APPROVE_SEND", "REJECTED"), "APPROVE_SEND": ("SENT", "REVIEWED"),
    "SENT": ("RESPONDED", "CLOSED", "REJECTED"), "RESPONDED": ("CLOSED", "REVIEWED"), "REJECTED": ("REVIEWED", "CLOSED"), "CLOSED": (),
}


def allowed(state: str = "workflow_status", wanted: str = "new_status"):
    """Whether a change is one of the transitions; null counts as NEW."""
    now = F.coalesce(F.col(state), F.lit("NEW"))
    out = F.lit(False)
    for before, after in FOLLOWING.items():
        if after:
            out = out | ((now == before) & F.col(wanted).isin(*after))
    return out


def apply_changes(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events after at most one request each (id, new_status, note); ``changed`` tells whether it was allowed.

    The note is appended on a line of its own.
    """
    r = requests.select("id", "new_status", "note", F.lit(True).alias("asked"))
    joined = events.join(r, "id", "left").withColumn("changed", F.coalesce(F.col("asked") & allowed(), F.lit(False)))
    notes = F.when(F.col("changed") & (F.coalesce("note", F.lit("")) != ""), F.concat_ws("\n", F.nullif("notes", F.lit("")), "note")).otherwise(F.col("notes"))
    status = F.when(F.col("changed"), F.col("new_status")).otherwise(F.col("workflow_status"))
    return joined.select(*[status.alias(c) if c == "workflow_status" else notes.alias(c) if c == "notes" else F.col(c) for c in events.columns], "changed")


def new_score_rows(scores: DataFrame, existing: DataFrame) -> DataFrame:
    """Score rows whose event and profile have none yet, one each."""
    key = ["listing_event_id", "filter_profile_id"]
    return scores.dropDuplicates(key).join(existing.select(*key), key, "left_anti").select(*scores.columns)


def invalid_states(events: DataFrame) -> DataFrame:
    """Events whose state is none of the known."""
    return events.filter(F.col("workflow_status").isNotNull() & ~F.col("workflow_status").isin(*FOLLOWING))


def cached_or_missing(parcels: DataFrame, cache: DataFrame, now) -> DataFrame:
    """Parcels with the contact of an unexpired cache row, and whether one is there."""
    key = ["county_fips", "parcel_id"]
    live = cache.filter(F.col("expires_at") > now).groupBy(*key).agg(F.max_by("contact", "expires_at").alias("contact"))
    return parcels.join(live, key, "left").withColumn("cached", F.col("contact").isNotNull())


def granted(grants: DataFrame, things: DataFrame, key: list[str]) -> DataFrame:
    """Grants, each once, with the columns of what they grant; grants of nothing that is there are left out."""
    return grants.distinct().join(things, key)
