"""State changes as pure functions of tables: upserts, reconciliation, label edits, enrichment, compaction.

A run reads tables, derives their next state and writes it to a new place; running it again on its own result
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import category, flags, is_bulk
from ..functions.text import edit_labels, extract_address, host_of
from ..schemas import body_rank
from ..scratch import few

KEY = ["account", "message_id"]
BODY_COLUMNS = ("body_state", "body_text", "body_html")


def upsert_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata of the newest arrival, body of the highest state that ever arrived; at equal state the newest body.

    One pass and one shuffle: both sides are stacked and reduced by key. ``new`` may hold a key several times, later
    ``arrival`` (a number) winning.
    """
    n = new if "arrival" in new.columns else new.withColumn("arrival", F.lit(1).cast("long"))
    both = old.withColumn("arrival", F.lit(0).cast("long")).unionByName(n.withColumn("arrival", F.col("arrival") + 1), allowMissingColumns=True)
    return reduce_arrivals(both).select(*old.columns)


def reduce_arrivals(rows: DataFrame) -> DataFrame:
    """A row a key, without ``arrival``: the rule of ``upsert_messages`` over all that ever arrived."""
    names = [c for c in rows.columns if c != "arrival"]
    rest = [c for c in names if c not in KEY and c not in BODY_COLUMNS]
    body = [c for c in BODY_COLUMNS if c in names]
    g = rows.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), F.struct("arrival")).alias("meta"),
        F.max_by(F.struct(*body), F.struct(body_rank(F.col("body_state")), "arrival")).alias("body"),
    )
    return g.select(*KEY, "meta.*", "body.*").select(*names)


def enrich_candidates(messages: DataFrame, rule: str | None = None, sender: str | None = None, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Messages without a body. rule direct: no list mail, promotions or social; a null category passes."""
    m = messages.where("body_state = 'meta'")
    if rule == "direct":
        m = m.where(~is_bulk(F.col("is_list"), F.col("category")))
    if sender:
        m = m.where(extract_address(F.col("from_addr")) == sender.lower())
    if ids is not None:
        m = m.join(ids.select(*KEY).distinct(), KEY, "left_semi")
    m = m.orderBy(F.col("internal_date").desc_nulls_last(), "message_id")
    return m.limit(limit) if limit else m


def profile_candidates(messages: DataFrame, contacts: DataFrame, domains: DataFrame, keyword_hits: DataFrame | None = None) -> DataFrame:
    """From important contacts or domains or with a keyword, unless the sender or their domain is muted or blocked."""
    m = messages.where("body_state = 'meta'").withColumn("address", extract_address(F.col("from_addr"))).withColumn("domain", host_of(F.col("address")))
    wanted = [contacts.where("curation = 'important'").select("account", "address").distinct(), domains.where("curation = 'important'").select("account", "domain").distinct()]
    keys = [["account", "address"], ["account", "domain"]]
    parts = [m.join(w, k, "left_semi").select(*messages.columns, "address", "domain") for w, k in zip(wanted, keys, strict=True)]
    if keyword_hits is not None:
        parts.append(m.join(keyword_hits.select(*KEY).distinct(), KEY, "left_semi").select(*messages.columns, "address", "domain"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.dropDuplicates(KEY)
    for table, k in ((contacts, keys[0]), (domains, keys[1])):
        out = out.join(table.where("curation in ('muted', 'blocked')").select(*k).distinct(), k, "left_anti")
    return out.select(*messages.columns).orderBy(F.col("internal_date").desc_nulls_last(), "message_id")


def promote(messages: DataFrame, bodies: DataFrame, ids: DataFrame) -> DataFrame:
    """Candidates with their distilled bodies; those that the source lacks are skipped. bodies: account, message_id, body_text, body_html."""
    from ..functions.html import distill

    b = bodies.select(*KEY, distill(F.col("body_text"), F.col("body_html")).alias("distilled"), F.col("body_html").alias("raw"))
    m = messages.join(ids.select(*KEY).distinct(), KEY, "left_semi").join(b, KEY)
    keep = {"body_state": F.lit("full"), "body_text": F.col("distilled"), "body_html": F.col("raw")}
    return m.select(*(keep.get(c, F.col(c)).alias(c) for c in messages.columns))


def reconcile_inbox(messages: DataFrame, live: DataFrame, label: str = "INBOX") -> DataFrame:
    """What a full listing of a label changes: account, message_id, change (archived, restored or fetch).

    live: account, message_id. Only accounts that were listed are compared.
    """
    stored = messages.where(F.array_contains("labels", label)).select(*KEY).join(few(live.select("account").distinct()), "account", "left_semi")
    known = messages.select(*KEY)
    listed = live.select(*KEY).distinct()
    change = lambda df, name: df.select(*KEY, F.lit(name).alias("change"))
    archived = change(stored.join(listed, KEY, "left_anti"), "archived")
    restored = change(listed.join(known, KEY, "left_semi").join(stored, KEY, "left_anti"), "restored")
    return archived.unionByName(restored).unionByName(change(listed.join(known, KEY, "left_anti"), "fetch"))


def apply_reconciled(messages: DataFrame, changes: DataFrame, label: str = "INBOX") -> DataFrame:
    """Labels and category follow; other flags stay as they are."""
    m = messages.join(changes.where("change <> 'fetch'"), KEY, "left")
    one = F.array(F.lit(label))
    labels = F.when(F.col("change") == "archived", F.array_except("labels", one)).when(F.col("change") == "restored", F.array_union("labels", one)).otherwise(F.col("labels"))
    m = m.withColumn("labels", labels).withColumn("category", F.when(F.col("change").isNotNull(), category(F.col("labels"))).otherwise(F.col("category")))
    return m.select(*messages.columns)


def apply_label_changes(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: account, message_id, add, remove (arrays). Category and flags are derived anew where a change applies."""
    m = messages.join(changes.select(*KEY, "add", "remove"), KEY, "left").withColumn("changed", F.col("add").isNotNull() | F.col("remove").isNotNull())
    none = F.array().cast("array<string>")
    m = m.withColumn("labels", F.when(F.col("changed"), edit_labels(F.col("labels"), F.coalesce("add", none), F.coalesce("remove", none))).otherwise(F.col("labels")))
    derived: dict[str, Column] = {"category": category(F.col("labels"))} | flags(F.col("labels"))
    for c, value in derived.items():
        m = m.withColumn(c, F.when(F.col("changed"), value).otherwise(F.col(c)))
    return m.select(*messages.columns)


def replace_labels(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """A fetched account's labels replace the old; an account of which nothing came keeps its own. Nameless entries go."""
    new = fetched.where("label_id <> '' and name <> ''").dropDuplicates(["account", "label_id"])
    return old.join(new.select("account").distinct(), "account", "left_anti").unionByName(new, allowMissingColumns=True)


def label_ids(labels: DataFrame) -> DataFrame:
    """Lower-cased name to id; of equal names the smallest id."""
    return labels.groupBy("account", F.lower("name").alias("name")).agg(F.min("label_id").alias("label_id"))


def compact_eligible(messages: DataFrame, contacts: DataFrame, domains: DataFrame, threads: DataFrame, cutoff_ms: int) -> DataFrame:
    """Summarised bulk bodies past the grace period; not from curated-important senders or domains, not in own threads."""
    m = messages.where((F.col("body_state") == "full") & F.col("summary_text").isNotNull() & (F.col("summarized_at") <= cutoff_ms) & is_bulk(F.col("is_list"), F.col("category")))
    m = m.withColumn("address", extract_address(F.col("from_addr"))).withColumn("domain", host_of(F.col("address")))
    m = m.join(contacts.where("curation = 'important'").select("account", "address").distinct(), ["account", "address"], "left_anti")
    m = m.join(domains.where("curation = 'important'").select("account", "domain").distinct(), ["account", "domain"], "left_anti")
    m = m.join(threads.where("user_participated").select("account", "thread_id"), ["account", "thread_id"], "left_anti")
    return m.select(*messages.columns)


def demote(messages: DataFrame, ids: DataFrame) -> DataFrame:
    m = messages.join(ids.select(*KEY, F.lit(True).alias("gone")).distinct(), KEY, "left")
    m = m.withColumn("body_state", F.when(F.col("gone"), "summary-only").otherwise(F.col("body_state")))
    for c in ("body_text", "body_html"):
        if c in messages.columns:
            m = m.withColumn(c, F.when(F.col("gone"), F.lit(None)).otherwise(F.col(c)))
    return m.select(*messages.columns)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
