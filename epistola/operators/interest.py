"""Engagement scores, their snapshots, and what they suggest to curate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import engagement, read_rate, suggestion
from ..functions.text import round_half_up


def score_contacts(contacts: DataFrame, bulk: DataFrame, now_ms: int) -> DataFrame:
    c = contacts.join(bulk, ["account", "address"], "left").withColumn("bulk_count", F.coalesce("bulk_count", F.lit(0)).cast("long"))
    return c.withColumn("engagement_score", engagement(now_ms))


def snapshot(scored: DataFrame, taken_at: int) -> DataFrame:
    """One generation: a row for each contact."""
    return scored.select("account", "address", F.lit(taken_at).cast("long").alias("taken_at"), "msgs_received", "read_count", "replied_count", "engagement_score")


def append_snapshot(history: DataFrame, new: DataFrame) -> DataFrame:
    """The history with ``new``; a generation taken at the same time is replaced."""
    return history.join(new.select("account", "address", "taken_at"), ["account", "address", "taken_at"], "left_anti").unionByName(new)


def snapshot_trend(history: DataFrame) -> DataFrame:
    """The change since the generation before (an extension)."""
    w = Window.partitionBy("account", "address").orderBy("taken_at")
    return history.withColumn("change", F.col("engagement_score") - F.lag("engagement_score").over(w))


def propose_contacts(scored: DataFrame, curation: DataFrame | None = None, limit: int = 20) -> DataFrame:
    mostly = F.coalesce(F.col("bulk_count") * 2 > F.col("msgs_received"), F.lit(False))
    c = scored.join(curation, ["account", "address"], "left") if curation is not None else scored.withColumn("curation", F.lit(None).cast("string"))
    return (
        c.select("account", "address", "display_name", "domain", round_half_up(F.col("engagement_score")).alias("score"), "msgs_received", round_half_up(read_rate(F.col("read_count"), F.col("msgs_received"))).alias("read_rate"), mostly.alias("is_list"), suggestion(F.col("engagement_score"), mostly).alias("suggested"), "curation", "engagement_score")
        .orderBy(F.col("engagement_score").desc_nulls_last(), "account", "address").limit(limit).drop("engagement_score")
    )


def propose_domains(scored: DataFrame, limit: int = 20) -> DataFrame:
    """A domain's score is the mean of its contacts'."""
    d = scored.where("domain is not null").groupBy("account", "domain").agg(
        F.avg("engagement_score").alias("engagement_score"), F.sum("msgs_received").cast("long").alias("msgs_received"), F.sum("read_count").cast("long").alias("read_count"),
        F.sum("bulk_count").cast("long").alias("bulk_count"), F.count(F.lit(1)).alias("contacts"),
    )
    mostly = F.col("bulk_count") * 2 > F.col("msgs_received")
    return (
        d.select("account", "domain", "contacts", round_half_up(F.col("engagement_score")).alias("score"), round_half_up(read_rate(F.col("read_count"), F.col("msgs_received"))).alias("read_rate"), mostly.alias("is_list"), suggestion(F.col("engagement_score"), mostly).alias("suggested"), "engagement_score")
        .orderBy(F.col("engagement_score").desc_nulls_last(), "account", "domain").limit(limit).drop("engagement_score")
    )
