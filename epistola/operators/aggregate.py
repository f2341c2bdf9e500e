"""Contacts, domains and threads, rolled up from messages.

Order within a thread is (internal_date, message_id), a null date first. Own addresses are no contacts;
an address in both To and Cc of a message counts twice; people in To and Cc of received mail count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, display_name, extract_address, host_of, recipient_addresses, registrable_domain, split_recipients
from ..scratch import few


def with_addresses(messages: DataFrame) -> DataFrame:
    return messages.withColumn("sender", extract_address(F.col("from_addr")))


def touches(messages: DataFrame, own: DataFrame) -> DataFrame:
    """A row for each received message's sender and each sent message's recipient.

    replied: someone got mail from the address earlier in the thread. initiated: the thread's first message, unless replied.
    own: account, address.
    """
    # mail without a thread, however much there is of it, is a thread of its own each: no task gathers it
    threaded = F.coalesce(F.col("thread_id") != "", F.lit(False))
    m = messages.withColumn("thread", F.struct(F.when(threaded, F.col("thread_id")).alias("id"), F.when(~threaded, F.col("message_id")).alias("alone")))
    in_thread = Window.partitionBy("account", "thread").orderBy(F.col("internal_date").asc_nulls_first(), "message_id")
    # people are cut out of the headers before rows are dealt: one shuffle, by thread, which serves both windows
    got, sent = F.col("direction") == "received", F.col("direction") == "sent"
    people = F.when(got, F.array("from_addr")).when(sent, F.concat(split_recipients(F.col("to_addr")), split_recipients(F.col("cc_addr"))))
    common = ["account", "message_id", "thread_id", "thread", "internal_date", "unread", "starred", "important", "direction"]
    m = m.select(*common, people.alias("people")).withColumn("first", threaded & (F.row_number().over(in_thread) == 1))
    each = m.select(*common, "first", F.posexplode("people").alias("pos", "part"))
    each = each.select(*common, "first", extract_address(F.col("part")).alias("address"), display_name(F.col("part")).alias("name"), "pos").where("address is not null")
    both = each.join(few(own.select("account", "address").distinct()), ["account", "address"], "left_anti")
    before = Window.partitionBy("account", "thread", "address").orderBy(F.col("internal_date").asc_nulls_first(), F.col("message_id"), F.col("pos")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(F.col("direction") == "received").over(before), F.lit(False)) & threaded
    replied = (F.col("direction") == "sent") & earlier
    return both.withColumn("replied", replied).withColumn("initiated", (F.col("direction") == "sent") & F.col("first") & ~replied)


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


_COUNTS = ("msgs_received", "msgs_sent", "read_count", "replied_count", "initiated_count", "starred_count", "important_count")


def _contact_counts() -> dict[str, Column]:
    got, sent = F.col("direction") == "received", F.col("direction") == "sent"
    return dict(zip(_COUNTS, (got, sent, got & ~F.col("unread"), F.col("replied"), F.col("initiated"), got & F.col("starred"), got & F.col("important")), strict=True))


def contact_rollup(messages: DataFrame, own: DataFrame) -> DataFrame:
    t = touches(messages, own)
    order = F.struct(F.col("internal_date").isNotNull(), "internal_date", "message_id", "pos")
    return t.groupBy("account", "address").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), order)).alias("display_name"),
        F.first(host_of(F.col("address"))).alias("domain"),
        *(_count(c).alias(n) for n, c in _contact_counts().items()),
        F.min("internal_date").alias("first_seen"), F.max("internal_date").alias("last_seen"),
    )


def contact_parts(messages: DataFrame, own: DataFrame) -> DataFrame:
    """What each thread, or message without one, adds to each contact: account, fold, address, name with its place in order, and what ``contact_rollup`` counts.
    messages: with ``fold``, and whole threads."""
    t = touches(messages, own)
    fold = F.when(F.col("thread.id").isNotNull(), F.concat(F.lit("t:"), F.col("thread.id"))).otherwise(F.concat(F.lit("m:"), F.col("thread.alone")))
    order = F.struct(F.col("internal_date").isNotNull().alias("dated"), "internal_date", "message_id", "pos")
    named = F.when(F.col("name").isNotNull(), order)
    parts = t.groupBy("account", "thread", "address").agg(  # as the touches are dealt and sorted
        F.min_by("name", named).alias("name"), F.min(named).alias("named"), F.first(host_of(F.col("address"))).alias("domain"),
        *(_count(c).alias(n) for n, c in _contact_counts().items()), F.min("internal_date").alias("first_seen"), F.max("internal_date").alias("last_seen"),
    )
    return parts.withColumn("fold", fold).drop("thread")


def combine_contacts(parts: DataFrame) -> DataFrame:
    """Contacts as the sums of their parts: what ``contact_rollup`` gives of all the messages."""
    return parts.groupBy("account", "address").agg(
        F.min_by("name", "named").alias("display_name"), F.first("domain").alias("domain"), *(F.sum(n).alias(n) for n in _COUNTS), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def domain_rollup(contacts: DataFrame) -> DataFrame:
    return contacts.where("domain is not null").groupBy("account", "domain").agg(
        F.sum(F.col("msgs_received") + F.col("msgs_sent")).cast("long").alias("msgs"), F.count(F.lit(1)).alias("distinct_contacts"),
        F.first(registrable_domain(F.col("domain"))).alias("registrable_domain"),
    )


def thread_rollup(messages: DataFrame) -> DataFrame:
    """Own addresses are participants of threads with sent mail."""
    m = with_addresses(messages).where("coalesce(thread_id, '') <> ''")
    people = F.when(F.col("direction") == "sent", F.array_union(F.filter(F.array("sender"), lambda x: x.isNotNull()), recipient_addresses(F.col("to_addr"), F.col("cc_addr"))))
    m = m.withColumn("people", F.coalesce(people, F.filter(F.array("sender"), lambda x: x.isNotNull())))
    newest = F.when(F.col("subject").isNotNull(), F.struct(F.coalesce("internal_date", F.lit(0)), "message_id"))
    return m.groupBy("account", "thread_id").agg(
        F.max_by("subject", newest).alias("subject"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("people")))).alias("participants"),
        F.count(F.lit(1)).alias("msg_count"), _count(F.col("unread")).alias("unread_count"),
        F.bool_or(F.col("direction") == "sent").alias("user_participated"), F.bool_or("is_list").alias("any_list"),
        F.min("internal_date").alias("first_at"), F.max("internal_date").alias("last_at"),
    )


def bulk_counts(messages: DataFrame) -> DataFrame:
    """account, address, bulk_count of received bulk mail."""
    from ..functions.classify import is_bulk

    m = with_addresses(messages).where((F.col("direction") == "received") & is_bulk(F.col("is_list"), F.col("category")))
    return m.where("sender is not null").groupBy("account", F.col("sender").alias("address")).agg(F.count(F.lit(1)).alias("bulk_count"))


def cadence(messages: DataFrame, domains: DataFrame | None = None, category: str | None = None, since: int | None = None) -> DataFrame:
    """How often each brand writes. domains: account, domain, category, registrable_domain (a dimension)."""
    m = with_addresses(messages).where("direction = 'received'").withColumn("host", host_of(F.col("sender"))).where("host is not null")
    if since is not None:
        m = m.where(F.col("internal_date") >= since)
    if domains is not None:
        d = domains.select("account", F.col("domain").alias("host"), F.col("category").alias("brand_category"), F.col("registrable_domain").alias("known"))
        m = m.join(d, ["account", "host"], "left")
    else:
        m = m.withColumn("brand_category", F.lit(None).cast("string")).withColumn("known", F.lit(None).cast("string"))
    if category is not None:
        m = m.where(F.col("brand_category") == category)
    brand = F.coalesce(blank_to_null(F.col("known")), registrable_domain(F.col("host")), F.col("host"))
    g = m.groupBy("account", brand.alias("domain")).agg(
        F.max("brand_category").alias("category"), F.count(F.lit(1)).alias("msgs"), F.count_distinct("sender").alias("senders"),
        F.min("internal_date").alias("first_at"), F.max("internal_date").alias("last_at"),
    )
    span = F.coalesce(F.greatest(F.lit(1.0), (F.col("last_at") - F.col("first_at")) / 86_400_000.0), F.lit(1.0))
    return g.withColumn("per_week", F.col("msgs") * 7.0 / span).withColumn("per_month", F.col("msgs") * 30.0 / span)


def cadence_ordered(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.col("msgs").desc(), F.col("domain"))
    return out.limit(limit) if limit else out
