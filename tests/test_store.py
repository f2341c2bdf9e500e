"""The versioned store: commits that don't wait, costs in proportion, the change feed, folds of what was touched."""

import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epistola.errors import StoreError, SyncError
from epistola.operators import aggregate as A
from epistola.schemas import CONTACTS, IDENTITY, MESSAGES, SYNC_RUNS
from epistola.sources import mail as M
from epistola.streaming import fold as D
from epistola.streaming import store as T
from epistola.streaming import sync as Y

NOW = 1_781_481_600_000
NAMES = [f.split()[0] for f in MESSAGES.split(", ")]


def full_rows(spark, account, n, first=0):
    rows = [(f"{account}-{i}", f"t{i % 7}", NOW - i, f"P{i % 5} <p{i % 5}@x.org>", f"me@{account}.net", "s" * 50, ["INBOX"]) for i in range(first, first + n)]
    given = spark.createDataFrame(rows, "id string, threadId string, internalDate bigint, `from` string, `to` string, subject string, labels array<string>")
    return spark.createDataFrame([], M.FULL).unionByName(given, allowMissingColumns=True)


def messages(spark, *rows, account="a"):
    base = {"account": account, "direction": "received", "is_list": False, "unread": False, "starred": False, "important": False, "labels": [], "body_state": "meta"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in NAMES) for r in rows], MESSAGES)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_accounts_sync_at_the_same_time(spark, tmp_path):
    """Eight drivers, one store: all mail is there, all runs are closed, no identity is lost."""
    path = f"file://{tmp_path}/store"
    T.Store(spark, path)
    names = [f"a{k}" for k in range(8)]
    start = threading.Barrier(8)

    def one(name):
        store = T.Store(spark, path)
        start.wait()
        return Y.sync_account(store, M.TableSource(full_rows(spark, name, 40), f"me@{name}.net"), name, M.Scope(), NOW, batch_ids=15)

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(one, names)) == [Y.SyncResult(40, 40)] * 8
    store = T.Store(spark, path)
    assert {(r["account"], r["count"]) for r in store.read("messages", MESSAGES).groupBy("account").count().collect()} == {(n, 40) for n in names}
    runs = store.read("sync_runs", SYNC_RUNS)
    assert runs.where("finished_at is null").count() == 0 and sorted(r["id"] for r in runs.collect()) == list(range(1, 9))
    assert store.read("account_identity", IDENTITY).count() == 8


def test_a_commit_leaves_the_files_of_others_alone(spark, tmp_path):
    """An account's file is being written while another's commit ends: no row of it is lost."""
    store, go = T.Store(spark, f"file://{tmp_path}/store"), tmp_path / "go"

    def waiting(batches):
        for k, batch in enumerate(batches):
            yield batch
            for _ in range(300):
                if k < 2 or go.exists():  # a batch's last bytes leave the worker with the next
                    break
                time.sleep(0.1)

    rows = lambda account, n: messages(spark, *({"message_id": f"{account}-{i}", "internal_date": i, "snippet": "s" * 2000} for i in range(n)), account=account)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100", "spark.sql.maxConcurrentOutputFileWriters": "4"}  # rows go to the file as they come, unsorted
    before = {k: spark.conf.get(k) for k in settings}
    slow = rows("slow", 500).coalesce(1).mapInPandas(waiting, MESSAGES)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        with ThreadPoolExecutor(1) as pool:
            put = pool.submit(store.put, "messages", slow)
            while not (put.done() or list(tmp_path.glob("store/messages/**/_temporary/**/*.parquet"))):
                time.sleep(0.05)
            try:
                store.put("messages", rows("quick", 5))
            finally:
                go.touch()
            put.result()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["account"], r["count"]) for r in store.read("messages", MESSAGES).groupBy("account").count().collect()} == {("slow", 500), ("quick", 5)}
    assert not list(tmp_path.glob("store/messages/draft/*"))


def test_one_run_of_an_account(spark, tmp_path):
    """Of two drivers that enter the same account at once, one gets it."""
    path = f"file://{tmp_path}/store"
    stores = [T.Store(spark, path) for _ in range(4)]
    start = threading.Barrier(4)

    def one(store):
        start.wait()
        try:
            return Y.acquire(store, "a", "sync", None, NOW)
        except SyncError:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(x is None for x in pool.map(one, stores)) == [False, True, True, True]
    assert stores[0].read("sync_runs", SYNC_RUNS).count() == 1


def test_all_accounts_in_parallel(spark, tmp_path):
    store = T.Store(spark, f"file://{tmp_path}/store")

    class Away(M.TableSource):
        def list_ids(self, scope):
            raise RuntimeError("away")

    jobs = {n: (M.TableSource(full_rows(spark, n, 9)), M.Scope()) for n in "abc"} | {"d": (Away(full_rows(spark, "d", 9)), M.Scope())}
    out = Y.sync_all(store, jobs, NOW, parallel=4)
    assert [out[n] for n in "abc"] == [Y.SyncResult(9, 9)] * 3 and out["d"] == "RuntimeError: away"
    assert store.read("messages", MESSAGES).count() == 27 and store.read("sync_runs", SYNC_RUNS).where("finished_at is null").count() == 0


def test_a_sync_writes_its_own_rows_only(spark, tmp_path):
    store, data = T.Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/store/messages/data"
    Y.sync_account(store, M.TableSource(full_rows(spark, "big", 20_000)), "big", M.Scope(), NOW)
    before = size(data)
    Y.sync_account(store, M.TableSource(full_rows(spark, "small", 20)), "small", M.Scope(), NOW)
    first = size(data) - before
    Y.sync_account(store, M.TableSource(full_rows(spark, "big", 20, 20_000)), "big", M.Scope(), NOW)
    assert first < before / 5 and size(data) - before - first < before / 5  # mostly footers
    assert store.read("messages", MESSAGES).count() == 20_040 and store.read("messages", MESSAGES, accounts={"small"}).count() == 20


def test_merge_on_read_and_compaction(spark, tmp_path):
    """Versions merge as one upsert after the other would, before and after parts are merged for good."""
    from epistola.operators.merge import upsert_messages

    store, rng = T.Store(spark, f"file://{tmp_path}/store"), random.Random(1)
    expected = spark.createDataFrame([], MESSAGES)
    for turn in range(T.MOST_PARTS + 3):
        rows = [{"message_id": str(i), "subject": f"s{turn}", "body_state": rng.choice(("meta", "full", "summary-only")), "body_text": f"b{turn}"} for i in rng.sample(range(30), 10)]
        new = messages(spark, *rows)
        store.put("messages", new)
        expected = upsert_messages(expected, new)
        if turn in (3, T.MOST_PARTS + 2):
            assert rows_of(store.read("messages", MESSAGES)) == rows_of(expected.select(*NAMES))
            expected = spark.createDataFrame(expected.collect(), MESSAGES)
    assert len(store.manifest("messages")["parts"]) <= T.MOST_PARTS
    assert not T.Store(spark, store.path).compact("messages", "nobody")


def test_compaction_loses_no_commit(spark, tmp_path, monkeypatch):
    """Parts that come while others are merged stay; a second merge of the same parts gives up."""
    store = T.Store(spark, f"file://{tmp_path}/store")
    for k in range(3):
        store.put("messages", messages(spark, {"message_id": str(k)}))
    stage = store._stage

    def slow(name, rows, batch=None):
        out = stage(name, rows, batch)
        other = T.Store(spark, store.path)
        other.put("messages", messages(spark, {"message_id": "late"}, {"message_id": "0", "subject": "newer"}))
        assert other.compact("messages", "a")
        return out

    monkeypatch.setattr(store, "_stage", slow)
    assert not store.compact("messages", "a")
    monkeypatch.undo()
    got = {r["message_id"]: r["subject"] for r in store.read("messages", MESSAGES).collect()}
    assert got == {"0": "newer", "1": None, "2": None, "late": None}


def test_earlier_versions_and_failed_changes(spark, tmp_path):
    store = T.Store(spark, f"file://{tmp_path}/store")
    store.put("messages", messages(spark, {"message_id": "1", "subject": "old"}))
    store.put("messages", messages(spark, {"message_id": "1", "subject": "new"}))
    assert [store.read("messages", MESSAGES, v).first()["subject"] for v in (1, 2)] == ["old", "new"] and store.read("messages", MESSAGES, 0).count() == 0
    with pytest.raises(ZeroDivisionError):
        store.update("sync_runs", SYNC_RUNS, lambda runs: 1 / 0)
    assert store.versions("sync_runs") == [] and store.update("sync_runs", SYNC_RUNS, lambda runs: None) is None
    assert not T.create_once(spark, f"file://{tmp_path}/store/messages/log/v00000002.json", "other")
    for _ in range(3):
        store.put("messages", messages(spark, {"message_id": "2"}))
    assert store.vacuum("messages", 2) == 0 and store.versions("messages") == [4, 5]  # the parts are all still read
    with pytest.raises(StoreError, match="no version 1"):
        store.changes("messages", MESSAGES, 0)
    store.compact("messages", "a")
    assert store.vacuum("messages", 1) == 5 and store.read("messages", MESSAGES).count() == 2


def test_change_feed(spark, tmp_path):
    """Between any two versions: what full snapshots say."""
    store, rng = T.Store(spark, f"file://{tmp_path}/store"), random.Random(3)
    for turn in range(5):
        for account in rng.sample("abc", 2):
            rows = [{"message_id": str(i), "subject": f"s{rng.randrange(3)}", "body_state": rng.choice(("meta", "full", "summary-only")), "labels": ["X"] if rng.random() < 0.5 else []} for i in rng.sample(range(12), 5)]
            store.put("messages", messages(spark, *rows, account=account))
        if turn == 2:
            store.compact("messages", "a")
    last = store.version("messages")
    snapshot = lambda v: {(r["account"], r["message_id"]): r for r in store.read("messages", MESSAGES, v).collect()}
    for since, until in ((0, last), (2, last), (3, 6), (last, last)):
        old, new = snapshot(since), snapshot(until)
        expected = {}
        for k, r in new.items():
            was = old.get(k)
            if was != r:
                expected[k] = "inserted" if was is None else "demoted" if r["body_state"] == "summary-only" != was["body_state"] else "updated"
        got = store.changes("messages", MESSAGES, since, until).collect()
        assert {(r["account"], r["message_id"]): r["change"] for r in got} == expected
        assert all(r["after"]["subject"] == new[r["account"], r["message_id"]]["subject"] and (r["before"] is None) == (r["change"] == "inserted") for r in got)


def test_folds_equal_a_rebuild(spark, tmp_path):
    """After random commits, threads and contacts are those of a rebuild; only touched threads are folded."""
    store, rng = T.Store(spark, f"file://{tmp_path}/store"), random.Random(5)
    own = spark.createDataFrame([("a", "me@x.org", "table", 0, 0), ("b", "me@y.org", "table", 0, 0)], IDENTITY)
    store.write("account_identity", own)
    person = lambda: f"N{rng.randrange(9)} <p{rng.randrange(6)}@h{rng.randrange(3)}.org>"

    def some(n):
        out = []
        for _ in range(n):
            sent = rng.random() < 0.4
            out.append({
                "account": rng.choice("ab"), "message_id": str(rng.randrange(60)), "thread_id": rng.choice([None, "", *(f"t{k}" for k in range(12))]), "internal_date": rng.choice([None, *range(20)]), "direction": "sent" if sent else "received",
                "from_addr": "me@x.org" if sent else person(), "to_addr": f"{person()}, {person()}" if sent else "me@x.org", "cc_addr": person() if sent and rng.random() < 0.5 else None, "subject": rng.choice([None, "s1", "s2"]), "unread": rng.random() < 0.5,
                "starred": rng.random() < 0.3, "important": rng.random() < 0.3, "is_list": rng.random() < 0.2,
            })
        return list({(r["account"], r["message_id"]): r for r in out}.values())

    addresses = own.select("account", "address")
    for turn in range(5):
        store.put("messages", messages(spark, *some(25 if turn == 0 else 4)))
        done = D.fold(store)
        m = store.read("messages", MESSAGES)
        assert rows_of(D.threads(store).select(*A.thread_rollup(m).columns)) == rows_of(A.thread_rollup(m))
        assert rows_of(D.contacts(store).select(*A.contact_rollup(m, addresses).columns)) == rows_of(A.contact_rollup(m, addresses))
        assert turn == 0 or done["folds"] <= 8
    assert D.fold(store) == {"folds": 0, "contacts": 0}
    store.put("messages", store.read("messages", MESSAGES).limit(5))  # rows that come again as they are
    assert D.fold(store) == {"folds": 0, "contacts": 0} and D.folded_version(store) == store.version("messages")
    assert [f.split()[0] for f in CONTACTS.split(", ")] == D.contacts(store).columns


def test_messages_are_read_as_merged(spark, tmp_path, monkeypatch):
    """Whether the keys with several rows are few or many; rows of one key in one part are merged, too."""
    store, rng = T.Store(spark, f"file://{tmp_path}/store"), random.Random(11)
    for turn in range(4):
        rows = [{"message_id": str(i), "subject": f"s{turn}", "body_state": rng.choice(("meta", "full")), "thread_id": f"t{i % 3}"} for i in rng.sample(range(40), 15)]
        for account in rng.sample("abc", 2):
            store.put("messages", messages(spark, *rows, account=account).unionByName(messages(spark, rows[0], account=account)))
        if turn == 1:
            store.compact("messages", "a")
    last = store.version("messages")
    for version in (2, last):
        expected = rows_of(store.read("messages", D.MAIL, version, {"a", "b"}))
        assert rows_of(store.messages(D.MAIL, version, {"a", "b"}).select(*(f.split()[0] for f in D.MAIL.split(", ")))) == expected
        monkeypatch.setattr(T, "FEW_ROWS", 0)
        assert rows_of(store.messages(D.MAIL, version, {"a", "b"})) == expected
        monkeypatch.undo()


def test_a_fold_compares_only_what_was_known(spark, tmp_path, monkeypatch):
    """New mail is folded without merging rows to compare them; known mail is compared, and what came again as it was isn't folded."""
    store = T.Store(spark, f"file://{tmp_path}/store")
    store.write("account_identity", spark.createDataFrame([("a", "me@x.org", "table", 0, 0)], IDENTITY))
    asked, changes = [], store.changes
    monkeypatch.setattr(store, "changes", lambda *args: asked.append(args) or changes(*args))
    mail = lambda ids, **more: messages(spark, *({"message_id": str(i), "thread_id": f"t{i % 4}", "from_addr": f"P <p{i}@x.org>", "internal_date": i} | more for i in ids))
    for k, ids in enumerate((range(8), range(8, 12))):
        store.put("messages", mail(ids))
        assert D.fold(store)["folds"] == 4 and not asked, k
    store.put("messages", mail([0, 5]).unionByName(mail([6], subject="new")))
    assert D.fold(store)["folds"] == 1 and len(asked) == 1
    m = store.read("messages", MESSAGES)
    assert rows_of(D.threads(store).select(*A.thread_rollup(m).columns)) == rows_of(A.thread_rollup(m))
