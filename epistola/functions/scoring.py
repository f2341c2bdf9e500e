"""The engagement score, and what it suggests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the engagement score.
REPLIED, INITIATED, IMPORTANT, READ_RATE, STARRED, RECENCY, BULK, NEVER_OPENED = 3.0, 3.0, 1.5, 1.5, 1.0, 0.5, -2.0, -2.0
HALF_LIFE_DAYS, VOLUME_SATURATION, COUNT_SATURATION = 60.0, 10.0, 3.0
IMPORTANT_AT, MUTED_AT = 2.0, -0.5
DAY_MS = 86_400_000.0


def saturate(count: Column, k: float) -> Column:
    return F.when(count <= 0, 0.0).otherwise(count / (count + k))


def engagement(now_ms: int) -> Column:
    """Over the columns of a contact and its bulk_count; absent counts are 0."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("msgs_received", "msgs_sent", "read_count", "replied_count", "initiated_count", "starred_count", "important_count", "bulk_count")}
    got, volume = n["msgs_received"], n["msgs_received"] + n["msgs_sent"]
    age = F.greatest(F.lit(float(now_ms)) - F.col("last_seen"), F.lit(0.0)) / DAY_MS
    counts = sum((w * saturate(n[c], COUNT_SATURATION) for w, c in ((REPLIED, "replied_count"), (INITIATED, "initiated_count"), (STARRED, "starred_count"), (IMPORTANT, "important_count"))), F.lit(0.0))
    read = F.when(got > 0, READ_RATE * F.least(F.greatest(n["read_count"] / got, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    recency = F.when(F.col("last_seen").isNotNull() & (volume > 0), RECENCY * F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS) * saturate(volume, VOLUME_SATURATION)).otherwise(0.0)
    bulk = F.when(got > 0, BULK * F.least(n["bulk_count"] / got, F.lit(1.0))).otherwise(0.0)
    never = F.when((got > 0) & (n["read_count"] == 0) & (n["replied_count"] == 0) & (n["initiated_count"] == 0), NEVER_OPENED).otherwise(0.0)
    return counts + read + recency + bulk + never


def suggestion(score: Column, mostly_list: Column) -> Column:
    """important outranks list mail."""
    return F.when(score.isNull(), "none").when(score >= IMPORTANT_AT, "important").when(mostly_list | (score <= MUTED_AT), "muted").otherwise("none")


def read_rate(read: Column, received: Column) -> Column:
    return F.when(received > 0, F.least(F.greatest(read / received, F.lit(0.0)), F.lit(1.0)))
