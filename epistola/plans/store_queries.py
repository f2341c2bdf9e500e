"""Queries of the stored state: parallel syncs, the change feed, folds of what was touched. Docstrings name the operators that run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import merge as M
from ..schemas import IDENTITY, MESSAGES, SYNC_RUNS
from ..scratch import scratch_path
from ..sources import mail as S
from ..streaming import fold as D
from ..streaming import sync as Y
from ..streaming.store import Store
from ..views import NOW, SQL_CONTACTS, SQL_MESSAGES, SQL_THREADS
from .tool_queries import source_of

QUERIES = {}
ORACLE_SQL = {}
ACCOUNTS = ("a0", "a1", "a2")


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def _stored(mail: DataFrame) -> DataFrame:
    """Rows of the message table."""
    held = set(mail.columns)
    return mail.select(*((F.col(n) if n in held else F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in MESSAGES.split(", "))))


@query(
    f"WITH {SQL_MESSAGES} SELECT account, message_id, direction, category, is_list, unread, starred, important, 'meta' AS body_state FROM msgs WHERE direction = 'received'"
)
def sync_messages(spark: SparkSession, d: str) -> DataFrame:
    """All accounts at the same time, from sources without sent mail, in several batches, and again"""
    store = Store(spark, scratch_path(spark, "store"))
    jobs = {a: (source_of(spark, d, a), S.Scope(include_sent=False)) for a in ACCOUNTS}
    batch = max(1, V.table(spark, d, "events").count() // 9)
    for turn in (0, 1):
        done = Y.sync_all(store, jobs, NOW + turn, parallel=3, batch_ids=batch)
        failed = [r for r in done.values() if isinstance(r, str)]
        if failed:
            raise RuntimeError("; ".join(failed))
    return store.read("messages", MESSAGES).select("account", "message_id", "direction", "category", "is_list", "unread", "starred", "important", "body_state")


@query(
    f"WITH {SQL_MESSAGES} SELECT account, 'sync' AS phase, count(*) AS fetched, count(*) AS indexed, CAST(NULL AS VARCHAR) AS error FROM msgs WHERE account <> 'a2' GROUP BY 1 UNION ALL SELECT 'a2', 'sync', 0, 0, 'RuntimeError: away'"
)
def sync_runs_audit(spark: SparkSession, d: str) -> DataFrame:
    """Accounts at the same time; one fails by itself, every run is closed"""

    class Away(S.TableSource):
        def list_ids(self, scope: S.Scope) -> DataFrame:
            raise RuntimeError("away")

    store = Store(spark, scratch_path(spark, "store"))
    sources = {a: source_of(spark, d, a) for a in ACCOUNTS}
    sources["a2"] = Away(sources["a2"].rows)
    Y.sync_all(store, {a: (s, S.Scope()) for a, s in sources.items()}, NOW, parallel=3)
    return store.read("sync_runs", SYNC_RUNS).where("finished_at is not null").select("account", "phase", "fetched", "indexed", "error")


def _laddered(spark: SparkSession, d: str) -> Store:
    """Version 1: all messages without bodies. Then bodies come, summarised ones lose theirs, and the rest comes again as it is."""
    store = Store(spark, scratch_path(spark, "store"))
    mail = _stored(V.Mail(spark, d).messages)
    bare = mail.withColumns({"body_state": F.lit("meta"), "body_text": F.lit(None).cast("string")})
    store.put("messages", bare)
    store.put("messages", mail.where("body_state = 'full'"))
    gone = mail.where("body_state = 'summary-only'")
    store.put("messages", M.demote(bare.join(gone.select(*M.KEY), M.KEY, "left_semi"), gone))
    store.put("messages", bare.join(mail.where("body_state = 'meta'").select(*M.KEY), M.KEY, "left_semi"))
    return store


@query(
    f"WITH {SQL_MESSAGES} SELECT account, message_id, CASE WHEN body_state = 'full' THEN 'updated' ELSE 'demoted' END AS change, 'meta' AS was, body_state AS now, body_text FROM msgs WHERE body_state <> 'meta'"
)
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """What changed since the first version, with before and after; what came again as it was didn't"""
    changes = _laddered(spark, d).changes("messages", MESSAGES, 1)
    return changes.select(*M.KEY, "change", F.col("before.body_state").alias("was"), F.col("after.body_state").alias("now"), F.col("after.body_text").alias("body_text"))


@query(f"WITH {SQL_MESSAGES} SELECT account, body_state, count(*) AS n, count(body_text) AS bodies FROM msgs GROUP BY 1, 2")
def merged_versions(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of every message, merged for good, by state"""
    store = _laddered(spark, d)
    for account in ACCOUNTS:
        store.compact("messages", account)
    return store.read("messages", MESSAGES).groupBy("account", "body_state").agg(F.count(F.lit(1)).alias("n"), F.count("body_text").alias("bodies"))


def _folded(spark: SparkSession, d: str) -> Store:
    """Received mail is folded first, then what was sent."""
    store = Store(spark, scratch_path(spark, "store"))
    own = V.own_addresses(spark)
    store.write("account_identity", own.select("account", "address", F.lit("table").alias("provider"), *(F.lit(0).cast("long").alias(c) for c in ("first_seen", "last_verified"))).select(*(f.split()[0] for f in IDENTITY.split(", "))))
    mail = _stored(V.Mail(spark, d).messages)
    for direction in ("received", "sent"):
        store.put("messages", mail.where(F.col("direction") == direction))
        D.fold(store)
    return store


@query(f"WITH {SQL_CONTACTS} SELECT account, address, display_name, domain, msgs_received, msgs_sent, read_count, replied_count, initiated_count, starred_count, important_count, first_seen, last_seen FROM contacts")
def folded_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts after two commits, each folded by the threads it touched"""
    return D.contacts(_folded(spark, d))


@query(f"WITH {SQL_MESSAGES}, {SQL_THREADS} SELECT account, thread_id, subject, array_to_string(participants, ',') AS participants, msg_count, unread_count, user_participated, any_list, first_at, last_at FROM threads")
def folded_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads after two commits, only touched ones folded anew"""
    return D.threads(_folded(spark, d)).withColumn("participants", F.array_join("participants", ","))
