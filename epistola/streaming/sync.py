"""Sync runs: micro-batches of messages into the message table, then derived tables. Batch and streaming forms.

The streaming form, with event time and watermarks, is an extension.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SyncError
from ..operators.merge import upsert_messages
from ..schemas import IDENTITY, MESSAGES, SYNC_RUNS
from ..scratch import numbered, scratch_path, written
from ..sources.mail import MailSource, Scope, to_messages
from .store import Store

LOCK_MS = 6 * 3_600_000
#: Ids that are fetched at once.
BATCH_IDS = 500_000


@dataclass
class SyncResult:
    fetched: int
    indexed: int


def guard_identity(store: Store, account: str, address: str | None, now_ms: int, provider: str = "table") -> None:
    """A label stays with the mailbox that it was first used for. Looking and entering are one commit."""

    def enter(known: DataFrame) -> DataFrame | None:
        held = known.where(F.col("account") == account).select("address").first()
        if held and address and held["address"].lower() != address.lower():
            raise SyncError(f"account {account} is {held['address']}, not {address}")
        if held or not address:
            return None
        return known.unionByName(store.spark.createDataFrame([(account, address.lower(), provider, now_ms, now_ms)], IDENTITY))

    store.update("account_identity", IDENTITY, enter)


def acquire(store: Store, account: str, phase: str, selector: str | None, now_ms: int) -> int:
    """An open run is the account's lock; one older than six hours is taken for dead. Looking and entering are one commit, and
    drivers that enter runs of other accounts at the same time only make it look again."""
    ident = 0

    def enter(runs: DataFrame) -> DataFrame:
        nonlocal ident
        open_run = F.col("account").eqNullSafe(account) & F.col("finished_at").isNull() & (F.col("started_at") >= now_ms - LOCK_MS)
        seen = runs.agg(F.max("id").alias("id"), F.bool_or(open_run).alias("open")).first()
        if seen["open"]:
            raise SyncError(f"a run of {account} is under way")
        ident = (seen["id"] or 0) + 1
        return runs.unionByName(store.spark.createDataFrame([(ident, account, phase, selector or None, now_ms, None, None, None, None)], SYNC_RUNS)).coalesce(1)

    store.update("sync_runs", SYNC_RUNS, enter)
    return ident


def finish(store: Store, ident: int, now_ms: int, fetched: int, indexed: int, error: str | None = None) -> None:
    mine = F.col("id") == ident
    values = {"finished_at": F.lit(now_ms).cast("long"), "fetched": F.lit(fetched).cast("long"), "indexed": F.lit(indexed).cast("long"), "error": F.lit(error).cast("string")}
    store.update("sync_runs", SYNC_RUNS, lambda runs: runs.select(*(F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in runs.columns)))


def sync_account(store: Store, source: MailSource, account: str, scope: Scope, now_ms: int, after: Callable[[Store, str], None] | None = None, batch_ids: int = BATCH_IDS, progress: Callable[[int, int], None] | None = None) -> SyncResult:
    """Scan, fetch in batches of ids, newest first, classify, add to the store; the audit row is closed whatever happens. Each batch is a commit of its own, so those before a
    failure are kept, and costs what its rows cost. A source with ``one_pass`` is joined with all ids at once, and batches are cut from what that gave; others are asked a batch at a time.
    ``progress`` gets the ids fetched and their total after each batch; ``after`` rebuilds derived tables."""
    probe = source.check()
    if probe.get("ok"):
        guard_identity(store, account, probe.get("address"), now_ms)
    ident = acquire(store, account, "sync", str(scope), now_ms)
    done = indexed = 0
    try:
        ids = numbered(source.list_ids(scope).withColumn("_k", F.monotonically_increasing_id()), "_k").select("id", "n")
        ids = written(ids.withColumn("batch", F.floor(F.col("n") / batch_ids).cast("int")), "ids")
        total = ids.count()
        own = [r["address"] for r in store.read("account_identity", IDENTITY).where(F.col("account") == account).collect()]
        fetch = lambda some: to_messages(source.get_metadata(some).withColumn("bodyText", F.lit(None)), account, own)
        numbers = range(-(-total // batch_ids))
        staged: dict[int, list[dict]] = {}
        if source.one_pass and total:
            of = ids.groupBy(F.col("id").alias("message_id")).agg(F.min("batch").alias("batch"))
            staged = store.stage("messages", fetch(ids.select("id")).join(of, "message_id").select(*store_columns(), "batch"), "batch")
        for k in numbers:
            if not source.one_pass:
                staged = store.stage("messages", fetch(ids.where(F.col("batch") == k).select("id")).withColumn("batch", F.lit(k)).select(*store_columns(), "batch"), "batch")
            if k in staged:
                store.add("messages", staged[k])
                indexed += store.rows_of("messages", staged[k])
            done = min(total, (k + 1) * batch_ids)
            if progress:
                progress(done, total)
        if after:
            after(store, account)
    except Exception as e:
        finish(store, ident, now_ms, done, indexed, f"{type(e).__name__}: {e}"[:500])
        raise
    finish(store, ident, now_ms, done, indexed)
    return SyncResult(done, indexed)


def store_columns() -> list:
    """What a synced message brings; the columns of the message table that a source hasn't are null."""
    given = {f.split()[0] for f in MESSAGES.split(", ")} - {"url"}
    return [F.col(f.split()[0]) if f.split()[0] in given else F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in MESSAGES.split(", ")]


def sync_all(store: Store, jobs: dict[str, tuple[MailSource, Scope]], now_ms: int, parallel: int = 1, batch_ids: int = BATCH_IDS) -> dict[str, SyncResult | str]:
    """One account's failure is its own. ``parallel`` accounts at a time."""

    def one(account: str) -> SyncResult | str:
        source, scope = jobs[account]
        try:
            return sync_account(store, source, account, scope, now_ms, batch_ids=batch_ids)
        except Exception as e:  # reported with its account, and in its audit row
            return f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return dict(zip(jobs, pool.map(one, jobs), strict=True))


def stream_messages(stream: DataFrame, store: Store, checkpoint: str, now_ms: int):
    """Arriving message rows, with ``arrival``, into the message table; the query of an available-now run. A batch adds its own rows, reduced by key; one that comes again after a failure
    changes nothing, as a merge of the same rows is the same table."""
    names = [f.split()[0] for f in MESSAGES.split(", ")]

    def upsert(batch: DataFrame, epoch: int) -> None:
        none = store.spark.createDataFrame([], MESSAGES)
        store.put("messages", upsert_messages(none, batch).select(*names))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Messages by account and day, each message once; rows later than ``late`` don't count."""
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["account", "message_id"])
    return once.groupBy("account", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("messages")).select("account", F.col("w.start").alias("day"), "messages")


def scratch_checkpoint(spark: SparkSession) -> str:
    """A folder for a stream's progress, in the shared folder that the session names."""
    return scratch_path(spark, "stream")
