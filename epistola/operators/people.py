"""Lists and look-ups of contacts and threads; feeds, digests and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_bulk_digest
from ..functions.text import host_of
from ..schemas import BODY_STATES, CURATIONS
from .aggregate import with_addresses

SORTS = {
    "engagement": lambda: [F.col("engagement_score").desc_nulls_last()],
    "volume": lambda: [(F.col("msgs_received") + F.col("msgs_sent")).desc_nulls_last()],
    "recency": lambda: [F.col("last_seen").desc_nulls_last()],
    "community": lambda: [F.col("community_id").asc_nulls_last(), F.col("centrality").desc_nulls_last()],
}


def list_contacts(contacts: DataFrame, sort: str = "engagement", only: str | None = None, limit: int = 20) -> DataFrame:
    """only: ``correspondents`` or a curation; any other value is ignored."""
    c = contacts
    if only == "correspondents":
        c = c.where("msgs_sent > 0")
    elif only in CURATIONS and "curation" in c.columns:
        c = c.where(F.col("curation") == only)
    return c.withColumn("correspondent", F.col("msgs_sent") > 0).orderBy(*SORTS[sort](), "address", "account").limit(limit)


def find_person(contacts: DataFrame, hint: str, limit: int = 10) -> DataFrame:
    """Contacts whose name, address or domain holds the hint; correspondents first."""
    text = F.lower(F.concat_ws(" ", "display_name", "address", "domain"))
    c = contacts.where(F.instr(text, hint.lower()) > 0).withColumn("correspondent", F.col("msgs_sent") > 0)
    return c.orderBy(F.col("correspondent").desc(), F.col("engagement_score").desc_nulls_last(), "address", "account").limit(limit)


def threads_of_contact(threads: DataFrame, address: str, limit: int = 20) -> DataFrame:
    return threads.where(F.array_contains("participants", address.lower())).orderBy(F.col("last_at").desc_nulls_last(), "account", "thread_id").limit(limit)


def threads_of_hits(threads: DataFrame, hits: DataFrame, limit: int = 20) -> DataFrame:
    t = threads.join(hits.select("account", "thread_id").distinct(), ["account", "thread_id"], "left_semi")
    return t.orderBy(F.col("last_at").desc_nulls_last(), "account", "thread_id").limit(limit)


def labeled(messages: DataFrame, label: str, limit: int = 15) -> DataFrame:
    return messages.where(F.array_contains("labels", label)).orderBy(F.col("internal_date").desc_nulls_last(), "message_id").limit(limit)


# -- feeds -----------------------------------------------------------------------------------------


def from_important(messages: DataFrame, contacts: DataFrame, domains: DataFrame, since: int, limit: int = 25) -> DataFrame:
    """Received since then from a contact or domain curated important.

    Joined on the sender's extracted address and host: equal keys where the reference compares by pattern.
    """
    m = with_addresses(messages).where((F.col("direction") == "received") & (F.col("internal_date") >= since))
    c = contacts.where("curation = 'important'").select("account", F.col("address").alias("sender"), F.lit(True).alias("by_contact")).distinct()
    d = domains.where("curation = 'important'").select("account", F.col("domain").alias("host"), F.lit(True).alias("by_domain")).distinct()
    m = m.withColumn("host", host_of(F.col("sender"))).join(c, ["account", "sender"], "left").join(d, ["account", "host"], "left")
    return m.where("by_contact or by_domain").drop("by_contact", "by_domain").orderBy(F.col("internal_date").desc(), "message_id").limit(limit)


def in_own_threads(messages: DataFrame, threads: DataFrame, since: int, limit: int = 25) -> DataFrame:
    """Received since then in threads that the user wrote in."""
    t = threads.where("user_participated").select("account", "thread_id")
    m = messages.where((F.col("direction") == "received") & (F.col("internal_date") >= since))
    return m.join(t, ["account", "thread_id"], "left_semi").orderBy(F.col("internal_date").desc(), "message_id").limit(limit)


def digest_sources(messages: DataFrame, contacts: DataFrame, since: int = 0, limit: int = 20) -> DataFrame:
    """Senders of bulk mail: issues, how many are unread, how many lack a summary."""
    m = with_addresses(messages).where((F.col("direction") == "received") & (F.col("internal_date") >= since) & is_bulk_digest(F.col("is_list"), F.col("category")))
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g = m.groupBy("account", F.col("sender").alias("address")).agg(F.count(F.lit(1)).alias("issues"), flag(F.col("unread")).alias("unread"), flag(F.col("summary_text").isNull()).alias("unsummarized"))
    out = g.join(contacts.select("account", "address", "display_name", "engagement_score"), ["account", "address"])
    return out.orderBy(F.col("engagement_score").desc_nulls_last(), F.col("issues").desc(), "address", "account").limit(limit)


# -- status ----------------------------------------------------------------------------------------


def accounts(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("account")
    for t in tables[1:]:
        out = out.union(t.select("account"))
    return out.distinct().orderBy("account")


def body_states(messages: DataFrame) -> DataFrame:
    """Messages by body state, zero where there are none; one row an account."""
    return messages.groupBy("account").pivot("body_state", list(BODY_STATES)).count().na.fill(0)


def totals(messages: DataFrame) -> DataFrame:
    """A row for each account and one, of account null, for all."""
    return messages.rollup("account").agg(F.count(F.lit(1)).alias("messages"))


def index_as_of(runs: DataFrame) -> DataFrame:
    """The latest successful run of each account."""
    return runs.where("finished_at is not null and error is null").groupBy("account").agg(F.max("finished_at").alias("as_of"))


def index_as_of_all(runs: DataFrame) -> DataFrame:
    """Over accounts, the earliest of their latest runs."""
    return index_as_of(runs).agg(F.min("as_of").alias("as_of"))


def freshness(runs: DataFrame, now_ms: int, stale_ms: int = 3 * 3_600_000, lock_ms: int = 6 * 3_600_000) -> DataFrame:
    """By account: as_of, age_ms, stale, syncing, and the days that a refresh should cover."""
    done = (F.col("finished_at").isNotNull()) & F.col("error").isNull()
    busy = F.col("finished_at").isNull() & (F.col("started_at") >= now_ms - lock_ms)
    g = runs.groupBy("account").agg(F.max(F.when(done, F.col("finished_at"))).alias("as_of"), F.coalesce(F.bool_or(busy), F.lit(False)).alias("syncing"))
    age = F.lit(now_ms) - F.col("as_of")
    return g.withColumn("age_ms", age).withColumn("stale", F.coalesce(age > stale_ms, F.lit(True))).withColumn("since_days", (F.ceil(age / 86_400_000) + 1).cast("long"))


def completed_syncs(runs: DataFrame) -> DataFrame:
    return runs.where("phase = 'sync' and finished_at is not null and error is null").groupBy("account").agg(F.count(F.lit(1)).alias("completed"))


# -- categorising ----------------------------------------------------------------------------------


def domains_to_categorize(contacts: DataFrame, overlay: DataFrame, include_categorized: bool = False, limit: int = 20) -> DataFrame:
    """Domains that the user writes to, by correspondents, then volume."""
    g = contacts.where("msgs_sent > 0 and domain is not null").groupBy("account", "domain").agg(F.count(F.lit(1)).alias("correspondents"), F.sum(F.col("msgs_received") + F.col("msgs_sent")).cast("long").alias("msgs"))
    g = g.join(overlay.select("account", "domain", "category"), ["account", "domain"], "left")
    if not include_categorized:
        g = g.where("category is null")
    return g.orderBy(F.col("correspondents").desc(), F.col("msgs").desc(), "domain", "account").limit(limit)


def categorize_samples(candidates: DataFrame, contacts: DataFrame, messages: DataFrame, senders: int = 5, subjects: int = 3) -> DataFrame:
    """For each candidate domain its first senders, each with newest subjects."""
    c = contacts.join(candidates.select("account", "domain"), ["account", "domain"], "left_semi")
    by = Window.partitionBy("account", "domain").orderBy((F.col("msgs_sent") > 0).desc(), (F.col("msgs_received") + F.col("msgs_sent")).desc(), "address")
    c = c.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= senders).select("account", "domain", "address", "display_name", "rank")
    m = with_addresses(messages).where("direction = 'received' and subject is not null").select("account", F.col("sender").alias("address"), "subject", "internal_date", "message_id")
    newest = Window.partitionBy("account", "address").orderBy(F.col("internal_date").desc_nulls_last(), "message_id")
    m = m.join(c.select("account", "address"), ["account", "address"], "left_semi").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= subjects)
    m = m.groupBy("account", "address").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "subject"))), lambda x: x["subject"]).alias("subjects"))
    return c.join(m, ["account", "address"], "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def thread_messages(messages: DataFrame, account: str, thread_id: str) -> DataFrame:
    return messages.where((F.col("account") == account) & (F.col("thread_id") == thread_id)).orderBy(F.col("internal_date").asc_nulls_first(), "message_id")

