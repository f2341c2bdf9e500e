"""Table schemas, enumerations and their guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 2

# Enumerations of the data model, the ladder in its order.
BODY_STATES = ("meta", "full", "summary-only")
DIRECTIONS = ("sent", "received")
CATEGORIES = ("primary", "personal", "social", "promotions", "updates", "forums")
CURATIONS = ("important", "muted", "blocked")
SYNC_PHASES = ("sync", "enrich")

MESSAGES = (
    "account string, message_id string, thread_id string, internal_date bigint, date_header string, from_addr string, to_addr string, cc_addr string, "
    "subject string, labels array<string>, category string, is_list boolean, direction string, unread boolean, starred boolean, important boolean, "
    "size_estimate bigint, snippet string, body_state string, body_text string, body_html string, url string"
)
SUMMARIES = "account string, message_id string, summary_text string, summary_is_model boolean, summarized_at bigint"
CONTACTS = (
    "account string, address string, display_name string, domain string, msgs_received bigint, msgs_sent bigint, read_count bigint, replied_count bigint, "
    "initiated_count bigint, starred_count bigint, important_count bigint, first_seen bigint, last_seen bigint"
)
CONTACT_CURATION = "account string, address string, curation string"
DOMAIN_OVERLAY = "account string, domain string, curation string, category string, category_note string, categorized_at bigint"
THREAD_SUMMARIES = "account string, thread_id string, summary_text string, summary_is_model boolean, summarized_at bigint"
INTEREST_PROFILE = "account string, keywords array<string>, updated_at bigint"
SNAPSHOTS = "account string, address string, taken_at bigint, msgs_received bigint, read_count bigint, replied_count bigint, engagement_score double"
SYNC_RUNS = "id bigint, account string, phase string, selector string, started_at bigint, finished_at bigint, fetched bigint, indexed bigint, error string"
IDENTITY = "account string, address string, provider string, first_seen bigint, last_verified bigint"
LABELS = "account string, label_id string, name string, type string, updated_at bigint"
IMAGES = "array<struct<src:string,width:int,height:int,alt:string,linkedHref:string,kind:string,score:int,reasons:array<string>>>"


def body_rank(state: Column) -> Column:
    """meta < full < summary-only; an unknown state ranks lowest."""
    rank = F.lit(-1)
    for i, s in enumerate(BODY_STATES):
        rank = F.when(state == s, i).otherwise(rank)
    return rank


def guarded(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """``value``; a row whose value isn't allowed fails the query. Null passes."""
    bad = F.raise_error(F.concat(F.lit(f"{what} is none of {', '.join(allowed)}: "), value))
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(bad)
