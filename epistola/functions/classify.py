"""Category, list mail and direction of a message, from labels, headers and sender."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract_address

# Category labels in their order of precedence.
CATEGORY_LABELS = ("personal", "social", "promotions", "updates", "forums")


def category(labels: Column) -> Column:
    out = F.when(F.array_contains(labels, "INBOX"), "primary")
    for name in reversed(CATEGORY_LABELS):
        out = F.when(F.array_contains(labels, f"CATEGORY_{name.upper()}"), name).otherwise(out)
    return out


def is_list(headers: Column) -> Column:
    """A List-Id or List-Unsubscribe header is there, in any case, even if empty."""
    named = F.exists(F.map_entries(headers), lambda e: F.lower(e["key"]).isin("list-id", "list-unsubscribe") & e["value"].isNotNull())
    return F.coalesce(named, F.lit(False))


def direction(labels: Column, sender: Column, own: Column) -> Column:
    """sent: labelled so, or from one of the own addresses (an array)."""
    mine = F.array_contains(F.transform(own, F.lower), extract_address(sender))
    return F.when(F.array_contains(labels, "SENT") | F.coalesce(mine, F.lit(False)), "sent").otherwise("received")


def flags(labels: Column) -> dict[str, Column]:
    return {"unread": F.array_contains(labels, "UNREAD"), "starred": F.array_contains(labels, "STARRED"), "important": F.array_contains(labels, "IMPORTANT")}


def is_bulk_digest(list_mail: Column, cat: Column) -> Column:
    """Bulk as the digest has it."""
    return list_mail | F.coalesce(cat.isin("promotions", "social", "updates", "forums"), F.lit(False))


def is_bulk(list_mail: Column, cat: Column) -> Column:
    """Bulk as the score and compaction have it: updates and forums aren't."""
    return list_mail | F.coalesce(cat.isin("promotions", "social"), F.lit(False))
