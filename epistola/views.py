"""The driver's tables as mail: the same mapping as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.classify import category, direction, flags, is_list
from .operators.aggregate import bulk_counts, contact_rollup, domain_rollup, thread_rollup
from .operators.interest import score_contacts
from .operators.search import search_row
from .scratch import bound_batches, delete_at_exit, exists, few, held_path
from .streaming.segments import StoredIndex
from .streaming.store import Store

#: "Now" in queries: 2024-02-01T00:00:00Z. The events are of January 2024.
NOW = 1_706_745_600_000
DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt over all cores where a scan has no more splits than those, of which small files' fill only some; left alone otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores else df


_HOST = "CASE {u} % 4 WHEN 0 THEN concat('mail.b', {u} % 20, '.co.uk') WHEN 1 THEN concat('news.b', {u} % 20, '.com') WHEN 2 THEN concat('b', {u} % 20, '.org') ELSE concat('x.y.b', {u} % 20, '.com.au') END"
_USER = "concat('User ', {u}, ' <U', {u}, '@', " + _HOST + ", '>')"


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source yields for ``events``: headers, labels and bodies, nothing classified."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", "props"), "event_id").selectExpr(
        "event_id", "user_id AS u", "event_type", "value", "unix_micros(cast(ts AS timestamp)) div 1000 AS ms", "cast(get_json_object(props, '$.k') AS bigint) AS k",
        "date_format(ts, 'yyyy-MM-dd') AS day",
    ).withColumn("v", F.expr("u + 3 * (1 + k % 5)"))
    user, other = F.expr(_USER.format(u="u")), F.expr(_USER.format(u="v"))
    sent = F.col("event_type") == "purchase"
    account = F.concat(F.lit("a"), (F.col("u") % 3).cast("string"))
    own = F.concat(F.lit("Me <me@"), account, F.lit(".example.net>"))
    labels = F.filter(
        F.array(
            F.when(sent, "SENT").otherwise("INBOX"),
            F.when(F.col("event_type") == "view", "CATEGORY_UPDATES").when(F.col("event_type") == "click", "CATEGORY_PROMOTIONS").when(F.col("event_type") == "signup", "CATEGORY_PERSONAL"),
            F.when((F.col("k") % 2 == 0) & ~sent, "UNREAD"), F.when(F.col("k") % 7 == 0, "STARRED"), F.when(F.col("k") % 5 == 0, "IMPORTANT"),
        ),
        lambda x: x.isNotNull(),
    )
    headers = F.when(F.col("event_type") == "error", F.create_map(F.lit("LIST-ID"), F.lit(""))).otherwise(F.create_map(F.lit("X-Kind"), F.col("event_type")))
    return e.select(
        account.alias("account"), F.col("event_id").cast("string").alias("message_id"), F.format_string("t%d-%s", "u", "day").alias("thread_id"), F.col("ms").alias("internal_date"),
        F.when(sent, own).otherwise(user).alias("from_addr"), F.when(sent, user).otherwise(own).alias("to_addr"), F.when(sent & (F.col("k") % 3 == 0), other).alias("cc_addr"),
        F.when(F.col("k") % 11 > 0, F.format_string("Re: %s %d", "event_type", F.col("k") % 10)).alias("subject"), labels.alias("labels"), headers.alias("headers"),
        F.floor("value").cast("long").alias("size_estimate"), F.format_string("Order %d: %s invoice of user %d", "event_id", "event_type", "u").alias("snippet"),
        F.when(F.col("k") % 3 == 0, "meta").when(F.col("k") % 3 == 1, "full").otherwise("summary-only").alias("body_state"),
        F.when(F.col("k") % 3 == 1, F.format_string("Flight %d for receipt %d", "k", F.col("k") % 4)).alias("body_text"),
        F.when((F.col("k") % 3 == 2) | (F.col("k") % 6 == 1), F.lit("summary")).alias("summary_text"), (F.lit(NOW - 20 * DAY) + F.col("k") * (DAY // 4)).alias("summarized_at"),
    )


def classified(raw: DataFrame, own: DataFrame) -> DataFrame:
    """own: account, address."""
    mine = own.groupBy("account").agg(F.collect_set("address").alias("own"))
    m = raw.join(few(mine), "account", "left")
    out = m.withColumns({"category": category(F.col("labels")), "is_list": is_list(F.col("headers")), "direction": direction(F.col("labels"), F.col("from_addr"), F.coalesce("own", F.array().cast("array<string>")))} | flags(F.col("labels")))
    return out.drop("own", "headers")


def own_addresses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"a{i}", f"me@a{i}.example.net") for i in range(3)], "account string, address string")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(raw_messages(spark, sf_dir), own_addresses(spark))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as threads: user writes, assistant is the own side, system is list mail."""
    c = table(spark, sf_dir, "conversations")
    own = F.lit("assistant@own.example.net")
    user = F.format_string("User <c%d@mail.example.com>", F.col("conv_id") % 50)
    sent = F.col("role") == "assistant"
    return c.select(
        F.lit("c").alias("account"), F.format_string("%d-%d", "conv_id", "turn").alias("message_id"), F.format_string("v%d", "conv_id").alias("thread_id"), F.col("turn").alias("internal_date"),
        F.when(sent, own).otherwise(user).alias("from_addr"), F.when(sent, user).otherwise(own).alias("to_addr"), F.lit(None).cast("string").alias("cc_addr"),
        F.col("role").alias("subject"), F.when(sent, "sent").otherwise("received").alias("direction"), (F.col("role") == "system").alias("is_list"),
        F.lit(False).alias("unread"), F.lit(False).alias("starred"), F.lit(False).alias("important"), F.lit("primary").alias("category"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as searched messages: subject the first line, sender the source, account the language."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return d.select(
        F.col("lang").alias("account"), F.col("doc_id").cast("string").alias("message_id"), F.format_string("d%d", F.col("doc_id") % 100).alias("thread_id"), F.col("doc_id").alias("internal_date"),
        F.col("source").alias("from_addr"), F.lit(None).cast("string").alias("to_addr"), F.lit(None).cast("string").alias("cc_addr"), F.split(F.col("text"), "\n")[0].alias("subject"),
        F.lit(None).cast("string").alias("snippet"), F.lit("full").alias("body_state"), F.col("text").alias("body_text"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_rollup(messages(spark, sf_dir), own_addresses(spark))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread_rollup(messages(spark, sf_dir))


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("events",)) -> DataFrame:
    """A table of the engine's store, as derived from the driver's tables in their present state: written by the first query of the application that needs it, opened by the others, which
    then read the columns and rows that they need."""
    path = held_path(spark, name, [f"{sf_dir}/{t}.parquet" for t in tables])
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
        delete_at_exit(spark, path)
    return spark.read.parquet(path)


def stored_index(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame], stemmed: bool, tables: tuple[str, ...]) -> StoredIndex:
    """The stored search index of ``rows``, built by the first query of the application that needs it."""
    path = held_path(spark, name, [f"{sf_dir}/{t}.parquet" for t in tables])
    index = StoredIndex(Store(spark, path), stemmed=stemmed)
    if not index.segments():
        delete_at_exit(spark, path)
        index.rebuild(rows())
    return index


def document_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    return stored_index(spark, sf_dir, "documents", lambda: search_row(document_messages(spark, sf_dir)), False, ("documents",))


class Opened:
    """A search index that is opened, and built where it isn't yet, by the first look-up, so that tools that look nothing up build none."""

    def __init__(self, open_: Callable[[], StoredIndex]):
        self._open = open_

    @cached_property
    def stored(self) -> StoredIndex:
        return self._open()

    @property
    def postings(self) -> DataFrame:
        return self.stored.postings

    @property
    def lengths(self) -> DataFrame:
        return self.stored.lengths

    def hits(self, *args, **named) -> DataFrame:
        return self.stored.hits(*args, **named)


class Mail:
    """Messages and what is derived from them. Messages and contacts are opened where the engine's store holds them (``held``); the rest is derived from those."""

    def __init__(self, spark: SparkSession, sf_dir: str, hold_contacts: bool = True):
        self.spark, self.sf_dir, self.hold_contacts = spark, sf_dir, hold_contacts

    @cached_property
    def messages(self) -> DataFrame:
        return held(self.spark, self.sf_dir, "messages", lambda: messages(self.spark, self.sf_dir))

    @cached_property
    def contacts(self) -> DataFrame:
        make = lambda: contact_rollup(self.messages, own_addresses(self.spark))
        return held(self.spark, self.sf_dir, "contacts", make) if self.hold_contacts else make()

    def index(self, stemmed: bool = True) -> StoredIndex:
        """The stored search index of the messages."""
        return stored_index(self.spark, self.sf_dir, "stemmed" if stemmed else "unstemmed", lambda: search_row(self.messages), stemmed, ("events",))

    @cached_property
    def threads(self) -> DataFrame:
        return thread_rollup(self.messages)

    @cached_property
    def scored(self) -> DataFrame:
        """Contacts with score and a curation that stands in for the user's: important, muted or blocked by user number."""
        s = score_contacts(self.contacts, bulk_counts(self.messages), NOW)
        n = F.regexp_extract("address", r"u(\d+)@", 1).try_cast("long")
        return s.withColumn("curation", F.when(n % 10 == 0, "important").when(n % 10 == 1, "muted").when(n % 10 == 2, "blocked"))

    @cached_property
    def domains(self) -> DataFrame:
        d = domain_rollup(self.contacts)
        n = F.regexp_extract("domain", r"b(\d+)\.", 1).try_cast("long")
        return d.withColumn("curation", F.when(n == 7, "important").when(n == 9, "muted")).withColumn("category", F.when(n % 2 == 0, F.format_string("cat%d", n % 4)))


def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that stand in for the audit table: one for each account, user modulo 5, and event type."""
    e = table(spark, sf_dir, "events").selectExpr("user_id AS u", "event_type", "unix_micros(cast(ts AS timestamp)) div 1000 AS ms")
    return e.groupBy(F.concat(F.lit("a"), (F.col("u") % 3).cast("string")).alias("account"), (F.col("u") % 5).alias("g"), F.col("event_type")).agg(F.min("ms").alias("started_at"), F.max("ms").alias("last")).select(
        "account", F.when(F.col("event_type") == "view", "enrich").otherwise("sync").alias("phase"), "started_at",
        F.when(F.col("event_type") != "click", F.col("last")).alias("finished_at"), F.when(F.col("event_type") == "error", "failed").alias("error"),
    )


# -- the same for DuckDB ---------------------------------------------------------------------------

_D_HOST = "CASE {u} % 4 WHEN 0 THEN 'mail.b' || ({u} % 20) || '.co.uk' WHEN 1 THEN 'news.b' || ({u} % 20) || '.com' WHEN 2 THEN 'b' || ({u} % 20) || '.org' ELSE 'x.y.b' || ({u} % 20) || '.com.au' END"

SQL_MESSAGES = f"""
ev AS (SELECT event_id, user_id AS u, event_type, value, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day FROM events),
ev2 AS (SELECT *, u + 3 * (1 + k % 5) AS v FROM ev),
msgs AS (SELECT 'a' || (u % 3) AS account, CAST(event_id AS VARCHAR) AS message_id, 't' || u || '-' || day AS thread_id, ms AS internal_date, u, k, event_type, event_id,
  CASE WHEN event_type = 'purchase' THEN 'sent' ELSE 'received' END AS direction,
  'u' || u || '@' || ({_D_HOST.format(u="u")}) AS user_address, {_D_HOST.format(u="u")} AS host,
  CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'u' || v || '@' || ({_D_HOST.format(u="v")}) END AS cc_address, 'User ' || u AS user_name, 'User ' || v AS cc_name,
  CASE WHEN event_type = 'purchase' THEN 'me@a' || (u % 3) || '.example.net' ELSE 'u' || u || '@' || ({_D_HOST.format(u="u")}) END AS sender,
  CASE WHEN k % 11 > 0 THEN 'Re: ' || event_type || ' ' || (k % 10) END AS subject,
  CASE event_type WHEN 'view' THEN 'updates' WHEN 'click' THEN 'promotions' WHEN 'signup' THEN 'personal' WHEN 'purchase' THEN NULL ELSE 'primary' END AS category,
  event_type = 'error' AS is_list, k % 2 = 0 AND event_type <> 'purchase' AS unread, k % 7 = 0 AS starred, k % 5 = 0 AS important,
  CASE k % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'full' ELSE 'summary-only' END AS body_state,
  CASE WHEN k % 3 = 1 THEN 'Flight ' || k || ' for receipt ' || (k % 4) END AS body_text,
  CASE WHEN k % 3 = 2 OR k % 6 = 1 THEN 'summary' END AS summary_text, {NOW - 20 * DAY} + k * {DAY // 4} AS summarized_at,
  'Order ' || event_id || ': ' || event_type || ' invoice of user ' || u AS snippet
  FROM ev2)"""

SQL_CONTACTS = f"""{SQL_MESSAGES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY account, thread_id ORDER BY internal_date, message_id) = 1 AS first FROM msgs),
touch AS (SELECT account, message_id, thread_id, internal_date, first, unread, starred, important, direction, user_address AS address, user_name AS name, 0 AS pos FROM ranked
  UNION ALL SELECT account, message_id, thread_id, internal_date, first, unread, starred, important, direction, cc_address, cc_name, 1 FROM ranked WHERE cc_address IS NOT NULL),
touch2 AS (SELECT *, coalesce(max(CASE WHEN direction = 'received' THEN 1 ELSE 0 END) OVER (PARTITION BY account, thread_id, address ORDER BY internal_date, message_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS earlier FROM touch),
contacts AS (SELECT account, address, arg_min(name, row(internal_date, message_id, pos)) AS display_name, split_part(min(address), '@', 2) AS domain,
  count(*) FILTER (direction = 'received') AS msgs_received, count(*) FILTER (direction = 'sent') AS msgs_sent, count(*) FILTER (direction = 'received' AND NOT unread) AS read_count,
  count(*) FILTER (direction = 'sent' AND earlier) AS replied_count, count(*) FILTER (direction = 'sent' AND first AND NOT earlier) AS initiated_count,
  count(*) FILTER (direction = 'received' AND starred) AS starred_count, count(*) FILTER (direction = 'received' AND important) AS important_count,
  min(internal_date) AS first_seen, max(internal_date) AS last_seen FROM touch2 GROUP BY account, address)"""

_SAT = "CASE WHEN {c} <= 0 THEN 0 ELSE {c} / ({c} + {k}e0) END"
SQL_SCORED = f"""{SQL_CONTACTS},
bulk AS (SELECT account, sender AS address, count(*) AS bulk_count FROM msgs WHERE direction = 'received' AND (is_list OR category = 'promotions') GROUP BY 1, 2),
joined AS (SELECT c.*, coalesce(b.bulk_count, 0) AS bulk_count FROM contacts c LEFT JOIN bulk b USING (account, address)),
scored AS (SELECT *, CAST(regexp_extract(address, 'u(\\d+)@', 1) AS BIGINT) AS n,
  3e0 * ({_SAT.format(c="replied_count", k=3)}) + 3e0 * ({_SAT.format(c="initiated_count", k=3)}) + 1e0 * ({_SAT.format(c="starred_count", k=3)}) + 1.5e0 * ({_SAT.format(c="important_count", k=3)})
  + CASE WHEN msgs_received > 0 THEN 1.5e0 * read_count / msgs_received ELSE 0 END
  + 0.5e0 * power(2e0, -(({NOW} - last_seen) / 86400000e0) / 60e0) * ({_SAT.format(c="(msgs_received + msgs_sent)", k=10)})
  - CASE WHEN msgs_received > 0 THEN 2e0 * least(1e0, bulk_count * 1e0 / msgs_received) ELSE 0 END
  - CASE WHEN msgs_received > 0 AND read_count = 0 AND replied_count = 0 AND initiated_count = 0 THEN 2e0 ELSE 0 END AS engagement_score FROM joined),
curated AS (SELECT *, CASE n % 10 WHEN 0 THEN 'important' WHEN 1 THEN 'muted' WHEN 2 THEN 'blocked' END AS curation FROM scored)"""

_REG = "CASE WHEN regexp_matches({h}, '\\.(co\\.uk|com\\.au)$') THEN regexp_extract({h}, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) END"
SQL_DOMAINS = f"""doms AS (SELECT account, domain, CAST(sum(msgs_received + msgs_sent) AS BIGINT) AS msgs, count(*) AS distinct_contacts, {_REG.format(h="domain")} AS registrable_domain,
  CAST(regexp_extract(domain, 'b(\\d+)\\.', 1) AS BIGINT) AS n FROM contacts GROUP BY account, domain),
domains AS (SELECT *, CASE n WHEN 7 THEN 'important' WHEN 9 THEN 'muted' END AS curation, CASE WHEN n % 2 = 0 THEN 'cat' || (n % 4) END AS category FROM doms)"""

SQL_THREADS = """people AS (SELECT account, thread_id, sender AS p FROM msgs UNION SELECT account, thread_id, user_address FROM msgs WHERE direction = 'sent' UNION SELECT account, thread_id, cc_address FROM msgs WHERE cc_address IS NOT NULL),
who AS (SELECT account, thread_id, list_sort(list(DISTINCT p)) AS participants FROM people GROUP BY 1, 2),
thr AS (SELECT account, thread_id, arg_max(subject, row(internal_date, message_id)) FILTER (subject IS NOT NULL) AS subject, count(*) AS msg_count, count(*) FILTER (unread) AS unread_count,
  bool_or(direction = 'sent') AS user_participated, bool_or(is_list) AS any_list, min(internal_date) AS first_at, max(internal_date) AS last_at FROM msgs GROUP BY 1, 2),
threads AS (SELECT * FROM thr JOIN who USING (account, thread_id))"""

SQL_RUNS = """runs AS (SELECT 'a' || (user_id % 3) AS account, CASE WHEN event_type = 'view' THEN 'enrich' ELSE 'sync' END AS phase, min(epoch_us(ts) // 1000) AS started_at,
  CASE WHEN event_type <> 'click' THEN max(epoch_us(ts) // 1000) END AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events GROUP BY 'a' || (user_id % 3), user_id % 5, event_type)"""
