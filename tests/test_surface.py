import base64
import json

import pytest
from pyspark.sql import functions as F

from epistola import render
from epistola.api import TOOLS, Index, Tools, parse_ref, parse_since, quote_arg
from epistola.config import parse_config, resolve_account
from epistola.errors import ConfigError, StoreError, SyncError, ToolError, WriteUnsupportedError
from epistola.operators import aggregate as A
from epistola.operators import graph as G
from epistola.operators import interest as I
from epistola.operators import search as S
from epistola.schemas import CONTACT_CURATION, MESSAGES, SNAPSHOTS, SUMMARIES, SYNC_RUNS
from epistola.sources import mail as M
from epistola.streaming import derive as D
from epistola.sources import files as R
from epistola.streaming import store as T
from epistola.streaming import sync as Y

from .test_operators import ME, by, conversation, mail, own

NOW = 1_781_481_600_000


def full_rows(spark):
    rows = [
        ("d1", "t1", 30, "Jo <jo@p.com>", ["INBOX", "IMPORTANT"], {"Subject": "x"}), ("l1", "t2", 20, "n@x.org", ["INBOX", "UNREAD", "CATEGORY_UPDATES"], {"List-Id": ""}), ("s1", "t1", 10, ME, ["SENT"], {}),
    ]
    return spark.createDataFrame([(i, t, at, None, f, "jo@p.com", None, f"about {i}", ls, "snip", 10, h, f"body {i}", None, "text/plain") for i, t, at, f, ls, h in rows], M.FULL)


def contract(source):
    """Any source: ids newest first, unknown ids left out, metadata without bodies."""
    ids = [r["id"] for r in source.list_ids(M.Scope()).collect()]
    assert ids and source.list_ids(M.Scope(limit=1)).count() == 1
    some = source.list_ids(M.Scope(limit=2)).unionByName(source.list_ids(M.Scope(limit=1)).select(F.lit("unknown").alias("id")))
    assert source.get_full(some).count() == 2 and "bodyText" not in source.get_metadata(some).columns
    return ids


def test_table_source(spark):
    s = M.TableSource(full_rows(spark), "al@example.com")
    assert contract(s) == ["d1", "l1", "s1"]
    assert [r["id"] for r in s.list_ids(M.Scope(query="in:inbox")).collect()] == ["d1", "l1"] and s.list_ids(M.Scope(include_sent=False)).count() == 2
    change = spark.createDataFrame([("d1", ["STARRED", " "], []), ("l1", [""], [])], "id string, add array<string>, remove array<string>")
    assert [(r["id"], r["add"]) for r in s.modify(change).collect()] == [("d1", ["STARRED"])]
    with pytest.raises(WriteUnsupportedError):
        M.MailSource().modify(change)


def test_scopes():
    assert M.provider_query(M.Scope("from:x", "1mo", include_sent=False)) == "from:x newer_than:1m -in:sent" and M.provider_query(M.Scope()) == ""
    policy = M.Scope("q", "3d", 5, False)
    assert M.compose_scope(policy, since="1w") == M.Scope("q", "1w", 5, False) and M.compose_scope(policy, everything=True) == M.Scope("q", None, None, False)
    assert str(policy) == "query=q since=3d limit=5 includeSent=false" and M.describe_selector("direct", limit=3) == "rule=direct limit=3"


def test_payloads(spark):
    code = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    leaf = lambda kind, t: {"mimeType": kind, "body": {"data": code(t), "size": 1}}
    message = {
        "id": "1", "threadId": "t", "internalDate": "", "labelIds": None, "snippet": "s", "sizeEstimate": 3,
        "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "FROM", "value": "a@b.c"}, {"name": "X", "value": "1"}, {"name": "X", "value": "2"}], "body": {}, "parts": [{"mimeType": "multipart/alternative", "body": {}, "parts": [leaf("text/html", "<p>é</p>"), leaf("text/plain", "ü >?")]}, leaf("text/plain", "second")]},
    }
    raw = spark.createDataFrame([(json.dumps(message),)], "j string").select(F.from_json("j", M.PAYLOAD).alias("m")).select("m.*")
    r = M.to_full(raw).first()
    assert (r["internalDate"], r["from"], r["headers"]["X"], r["bodyText"], r["bodyHtml"], r["mimeType"], r["labels"]) == (None, "a@b.c", "2", "ü >?", "<p>é</p>", "text/plain", [])


def test_bodies_nest_to_any_depth(spark):
    code = lambda t: base64.urlsafe_b64encode(t.encode()).decode()
    part = {"mimeType": "text/plain", "body": {"data": code("deep")}}
    for _ in range(60):
        part = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {}}, part, {"mimeType": "text/plain", "body": {"data": code("later")}}, {"mimeType": "text/html", "body": {"data": code("<b>")}}]}
    rows = [json.dumps(part), json.dumps({"parts": None, "mimeType": "TEXT/HTML", "body": {"data": code("x")}}), "{broken", None, json.dumps({"mimeType": "text/plain", "body": {"data": "!!"}})]
    got = [tuple(r["b"]) for r in spark.createDataFrame([(r,) for r in rows], "p string").select(M.extract_bodies(F.col("p")).alias("b")).collect()]
    assert got == [("deep", "<b>", "text/plain"), (None, "x", "text/html"), (None, None, None), (None, None, None), (None, None, None)]


def test_json_lines_are_split(spark, tmp_path):
    R.register(spark)
    rows = [{"id": f"é{i}" + "x" * (i % 7), "threadId": "t", "internalDate": str(i)} for i in range(200)]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    for split in (1, 37, 1000, 1 << 20):
        df = spark.read.format("mail_jsonl").option("split_bytes", split if split > 1 else 200).load(f"file://{tmp_path}")
        assert sorted(r["id"] for r in df.collect()) == sorted(r["id"] for r in rows)
    assert spark.read.format("mail_jsonl").option("split_bytes", 1000).load(f"file://{tmp_path}").rdd.getNumPartitions() > 5


def test_json_lines_source(spark, tmp_path):
    R.register(spark)
    for k in range(2):
        rows = [{"id": f"{k}{i}", "threadId": "t", "internalDate": str(i * 10), "labelIds": ["SENT"] if i == 2 else ["INBOX"], "payload": {"mimeType": "text/plain"}} for i in range(4)]
        (tmp_path / f"p{k}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    read = lambda **o: spark.read.format("mail_jsonl").options(**o).load(f"file://{tmp_path}")
    assert read().count() == 8 and read().rdd.getNumPartitions() == 2
    assert sorted(r["id"] for r in read(since_ms=10, include_sent="false").collect()) == ["01", "03", "11", "13"]


def test_sync_runs(spark, tmp_path):
    store = T.Store(spark, f"file://{tmp_path}/store")
    source = M.TableSource(full_rows(spark), "al@example.com")
    assert Y.sync_account(store, source, "a", M.Scope(), NOW) == Y.SyncResult(3, 3)
    m = by(store.read("messages", MESSAGES), "message_id")
    assert (m["s1"]["direction"], m["d1"]["important"], m["l1"]["is_list"], m["l1"]["category"], m["d1"]["body_state"]) == ("sent", True, True, "updates", "meta")
    Y.sync_account(store, source, "a", M.Scope(), NOW + 1)
    assert by(store.read("messages", MESSAGES), "message_id") == m
    with pytest.raises(SyncError, match="is al@example.com"):
        Y.sync_account(store, M.TableSource(full_rows(spark), "other@x.y"), "a", M.Scope(), NOW)

    class Exploding(M.TableSource):
        def get_metadata(self, ids):
            raise RuntimeError("boom")

    out = Y.sync_all(store, {"b": (Exploding(full_rows(spark)), M.Scope()), "c": (M.TableSource(full_rows(spark)), M.Scope(limit=1))}, NOW)
    assert out["b"] == "RuntimeError: boom" and out["c"] == Y.SyncResult(1, 1)
    runs = store.read("sync_runs", SYNC_RUNS)
    assert runs.where("finished_at is null").count() == 0 and runs.where("account = 'b'").first()["error"] == "RuntimeError: boom"
    Y.acquire(store, "a", "sync", None, NOW + 2)
    with pytest.raises(SyncError, match="under way"):
        Y.acquire(store, "a", "sync", None, NOW + 3)
    assert Y.acquire(store, "a", "sync", None, NOW + 7 * 3_600_000)


def test_sync_in_batches(spark, tmp_path):
    store, steps = T.Store(spark, f"file://{tmp_path}/store"), []
    source = M.TableSource(full_rows(spark), "al@example.com")
    assert Y.sync_account(store, source, "a", M.Scope(), NOW, batch_ids=2, progress=lambda *x: steps.append(x)) == Y.SyncResult(3, 3) and steps == [(2, 3), (3, 3)]

    class Failing(M.TableSource):
        one_pass = False

        def get_metadata(self, ids):
            if ids.where("id = 's1'").count():
                raise RuntimeError("late")
            return super().get_metadata(ids)

    with pytest.raises(RuntimeError):
        Y.sync_account(store, Failing(full_rows(spark)), "b", M.Scope(), NOW, batch_ids=2)
    assert {r["message_id"] for r in store.read("messages", MESSAGES).where("account = 'b'").collect()} == {"d1", "l1"}  # the newest two came
    run = store.read("sync_runs", SYNC_RUNS).where("account = 'b'").first()
    assert (run["fetched"], run["indexed"], run["error"]) == (2, 2, "RuntimeError: late")
    assert Y.acquire(store, "c", "sync", None, NOW)


def test_migrations_run_in_order(spark, tmp_path):
    path, ran = f"file://{tmp_path}/store", []
    store = T.Store(spark, path)
    store.write("schema_version", spark.createDataFrame([(1,)], "version int"))
    steps = {k: lambda s, k=k: ran.append(k) for k in (4, 2, 3)}
    T.Store(spark, path, steps)
    assert ran == [2, 3, 4] and T.Store(spark, path, steps) and ran == [2, 3, 4]
    with pytest.raises(StoreError):
        T.Store(spark, path)


def test_stored_search_index(spark, tmp_path):
    """Brought up to date by key: what a fresh build gives; an old schema gets its index when it is opened."""
    path = f"file://{tmp_path}/store"
    store = T.Store(spark, path)
    m = mail(spark, {"message_id": "1", "subject": "needle one"}, {"message_id": "2", "subject": "needle two"}, {"message_id": "3", "subject": "hay"}).drop("summary_text", "summarized_at")
    m = spark.createDataFrame([], MESSAGES).unionByName(m, allowMissingColumns=True)
    store.write("messages", m)
    store.write("schema_version", spark.createDataFrame([(1,)], "version int"))
    store = T.Store(spark, path)
    found = lambda: {r["message_id"] for r in S.bm25(D.read_index(store), S.parse("needle")).collect()}
    assert found() == {"1", "2"}
    store.write("messages", m.where("message_id <> '2'").withColumn("subject", F.when(F.col("message_id") == "3", "needles").otherwise(F.col("subject"))))
    D.update_index(store, m.where("message_id <> '1'"))
    assert found() == {"1", "3"}
    rows = lambda ix: (sorted(map(repr, ix.postings.collect())), sorted(map(repr, ix.lengths.collect())))
    updated = rows(D.read_index(store))
    D.update_index(store)
    assert rows(D.read_index(store)) == updated


def test_derived_tables(spark, tmp_path):
    store = T.Store(spark, f"file://{tmp_path}/store")
    Y.sync_account(store, M.TableSource(full_rows(spark), "al@example.com"), "a", M.Scope(), NOW)
    assert D.should_build_graph(store, "a") and D.rebuild(store, NOW) == {"contacts": 2, "compacted": 0}
    store.write("contact_curation", spark.createDataFrame([("a", "jo@p.com", "important")], CONTACT_CURATION))
    assert D.build_graph(store, 3) == {"nodes": 1, "edges": 0, "communities": 1}  # list threads are no part of it
    assert D.rebuild(store, NOW + 1)["contacts"] == 2
    jo = D.contacts(store).where("address = 'jo@p.com'").first()
    assert (jo["curation"], jo["replied_count"], jo["initiated_count"]) == ("important", 0, 1) and jo["centrality"] == pytest.approx(1)
    assert store.read("contact_stats_snapshot", SNAPSHOTS).count() == 4
    store.write("message_summaries", spark.createDataFrame([("a", "l1", "short", True, NOW - 8 * 86_400_000)], SUMMARIES))
    full = store.read("messages", MESSAGES).withColumn("body_state", F.lit("full")).withColumn("body_text", F.lit("x"))
    store.write("messages", full)
    assert D.rebuild(store, NOW + 2)["compacted"] == 1 and by(store.read("messages", MESSAGES), "message_id")["l1"]["body_state"] == "summary-only"
    store.write("schema_version", spark.createDataFrame([(99,)], "version int"))
    with pytest.raises(StoreError):
        T.Store(spark, f"file://{tmp_path}/store")


def test_search_enriching(tools, spark):
    source = M.TableSource(full_rows(spark).withColumn("id", F.when(F.col("id") == "d1", "a-recv").otherwise(F.col("id"))))
    with_source = Tools(spark, tools.ix, NOW, {"a": source})
    hits, promoted = with_source.search_enriching("deposit")
    assert promoted == 1 and {r["ref"]: r["body_state"] for r in hits.collect()} == {"a:a-recv": "full", "a:a-sent": "meta"}
    assert tools.search_enriching("deposit")[1] == 0


def test_streams(spark, tmp_path):
    rows = mail(spark, {"message_id": "1", "internal_date": 5}, {"message_id": "1", "internal_date": 5}, {"message_id": "2", "internal_date": 3 * 86_400_000})
    rows.withColumn("at", F.timestamp_millis("internal_date")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    Y.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert [r["messages"] for r in spark.table("counts").collect()] == [1]
    store = T.Store(spark, f"file://{tmp_path}/store")
    cut = stream.drop("at", "summary_text", "summarized_at")
    Y.stream_messages(cut, store, f"{tmp_path}/c2", NOW).awaitTermination()
    assert store.read("messages", MESSAGES).count() == 2


@pytest.fixture(scope="module")
def tools(spark):
    m = conversation(spark).withColumn("body_html", F.lit(None).cast("string")).withColumn("labels", F.when(F.col("message_id") == "a-recv", F.array(F.lit("INBOX"), F.lit("L1"))).otherwise(F.array().cast("array<string>"))).cache()
    m = m.withColumn("internal_date", F.col("internal_date") + NOW - 100_000)
    c = I.score_contacts(A.contact_rollup(m, own(spark)), A.bulk_counts(m), NOW)
    c = c.withColumn("curation", F.when(F.col("address").startswith("jordan"), "important")).cache()
    t = A.thread_rollup(m).cache()
    people = G.participants(t, c)
    nodes, e = people.select("account", "address").distinct(), G.edges(people)
    d = A.domain_rollup(c).withColumns({k: F.lit(None).cast("string") for k in ("curation", "category", "category_note")}).withColumn("categorized_at", F.lit(None).cast("long")).cache()
    runs = spark.createDataFrame([("a", "sync", NOW - 9, NOW - 5, None)], "account string, phase string, started_at bigint, finished_at bigint, error string")
    labels = spark.createDataFrame([("a", "L1", "Review")], "account string, label_id string, name string")
    profile = spark.createDataFrame([("a", ["deposit terms"], 1)], "account string, keywords array<string>, updated_at bigint")
    ix = Index(m, G.with_metrics(c, G.pagerank(nodes, e, 2), G.communities(nodes, e)).cache(), d, t, runs, labels, S.build_index(S.search_row(m)), profile)
    return Tools(spark, ix, NOW)


def test_tools_read(tools):
    assert len(TOOLS) == 23 and all(callable(getattr(tools, t)) for t in TOOLS)
    hits = tools.search("deposits")
    assert {r["ref"] for r in hits.collect()} == {"a:a-recv", "a:a-sent"} and "body_text" not in hits.columns
    assert [r["labels"] for r in tools.list_labeled("review", "a").collect()] == [["INBOX", "Review"]] and tools.list_labeled("review").count() == 0
    assert tools.refresh_inbox()[1] == {"refreshed": False}
    assert tools.get_message("a:a-recv").first()["subject"] == "Deposit terms"
    thread, found = tools.get_thread("a:t-a")
    assert thread.count() == 1 and [r["ref"] for r in found.collect()] == ["a:a-recv", "a:a-sent"]
    assert tools.list_contacts(only="correspondents").count() == 2 and tools.list_contacts(sort="community").count() == 3
    got = tools.get_contact("Jordan@partner.example.com")
    assert got["contact"].count() == 1 and got["threads"].count() == 1 and "candidates" in tools.get_contact("jord@nowhere")
    assert [r["address"] for r in tools.find_person("VENDOR").collect()] == ["casey@vendor.example.com"]
    assert tools.list_threads(query="deposit").count() == 1 and tools.list_threads(contact="casey@vendor.example.com").count() == 1
    assert [r["shared_threads"] for r in tools.graph_neighbors("jordan@elsewhere").collect()] == [0]
    assert tools.graph_communities()[1] is None
    assert tools.cadence().count() == 2 and tools.sync_status()[1].first()["stale"] is False
    feeds = tools.catch_up("1d")
    assert [r["ref"] for r in feeds["important"].collect()] == ["a:a-recv"] and feeds["threads"].count() == 1 and feeds["keywords"].count() == 2
    assert tools.digest_sources().count() == 1 and tools.call("search", query="zzz").count() == 0


def test_tools_write(tools, spark):
    people, domains = tools.interest_propose()
    assert people.count() == 3 and domains.count() == 3
    r = tools.interest_set("a", {"casey@vendor.example.com": "muted", "no@one": "muted"}, {"x.org": "blocked"}, ["visa"])
    assert r.skipped == 1 and tools.interest_get()[0].count() == 1
    found, samples = tools.domains_to_categorize()
    assert found.count() == 2 and samples.count() == 2
    overlay = spark.createDataFrame([], "account string, thread_id string, summary_text string, summary_is_model boolean, summarized_at bigint")
    assert tools.save_summary(overlay, "a:t-a", "short", "thread").count() == 1
    empty = spark.createDataFrame([], "account string, domain string, curation string, category string, category_note string, categorized_at bigint")
    assert tools.save_domain_category(empty, "a", "p.com", "travel").first()["category"] == "travel"
    assert tools.archive_message("a:a-recv").ix.messages.where("array_contains(labels, 'INBOX')").count() == 0
    assert tools.modify_labels("a:n-1", add=["Review"]).ix.messages.where("array_contains(labels, 'L1')").count() == 2
    for bad in (lambda: tools.modify_labels("a:n-1"), lambda: tools.get_message("a:zz"), lambda: tools.get_thread("a:zz"), lambda: tools.list_threads(), lambda: tools.call("nope"), lambda: tools.list_contacts(sort="x")):
        with pytest.raises(ToolError):
            bad()


def test_arguments():
    assert parse_since("2w", NOW) == NOW - 14 * 86_400_000 and parse_since("1mo", NOW) == NOW - 30 * 86_400_000 and parse_since("30m", NOW) == NOW - 1_800_000
    assert parse_since("1970-01-02", NOW) == 86_400_000 and parse_ref("a:b:c") == ("a", "b:c") and quote_arg("a b") == '"a b"'
    for bad in (lambda: parse_since("soon", NOW), lambda: parse_ref("x"), lambda: parse_ref(":y")):
        with pytest.raises(ToolError):
            bad()


def test_config():
    accounts = parse_config({"accounts": {"a": {"adapter": "table", "syncPolicy": {"since": "3d", "limit": 5, "includeSent": False}}}})
    assert resolve_account(accounts, None).policy == M.Scope(None, "3d", 5, False)
    for bad in ({}, {"accounts": {}}, {"accounts": {"a": {}}}, {"accounts": {"a": {"adapter": "x", "syncPolicy": {"limit": 0}}}}):
        with pytest.raises(ConfigError):
            parse_config(bad)
    with pytest.raises(ConfigError):
        resolve_account(accounts, "b")


def test_rendering(tools):
    lines = [r["value"] for r in render.hit_lines(tools.search("deposit")).collect()]
    assert all(" · " in x and "Deposit terms" in x for x in lines)
    assert json.loads(render.as_json(tools.sync_status()[0]).first()["value"])["meta"] == 4
    rows = lambda df: [r["value"] for r in df.collect()]
    table = rows(render.cadence_lines(tools.cadence(), "a", since="1w"))
    assert table[0].startswith("Inbound cadence — a (2 brands, ") and table[2].split() == ["DOMAIN", "MSGS", "SNDRS", "FIRST", "LAST", "/MO"] and len(table) == 5 and len({len(x) for x in table[2:]}) == 1
    assert rows(render.cadence_lines(tools.cadence().limit(0), "a", "shop", "1w")) == ["No inbound mail for a category=shop since 1w."]
    status = rows(render.status_lines(tools.sync_status()[0], tools.sync_status()[1], tools.ix.contacts))
    assert "bodies: meta 4, full 0, summary-only 0\n  messages: 4, contacts: 3" in status[0] and status[1] == "\nTotal: 4 messages, 3 contacts (meta 4, full 0, summary-only 0)"
    hits = tools.list_labeled("INBOX")
    labelled = rows(render.label_lines(tools.search("deposit"), "INBOX"))
    assert labelled[0] == f"{len(lines)} messages labeled INBOX:" and labelled[1:] == lines and rows(render.label_lines(hits.limit(0), "X")) == ["No messages labeled X."] and rows(render.result_lines(hits.limit(0), ["a", "b"])) == ['No matches for "a b".']


def test_rendering_of_messages_and_runs(spark):
    m = mail(spark, {"message_id": "1", "subject": "S", "from_addr": "f@x.y", "internal_date": 60_000, "unread": True, "is_list": True, "body_state": "full", "body_text": "text"}, {"message_id": "2", "snippet": "snip"})
    images = F.when(F.col("message_id") == "2", F.array(F.struct(F.lit("i.png").alias("src"), F.lit(3).alias("width"), F.lit(4).alias("height")))).otherwise(F.array().cast("array<struct<src:string,width:int,height:int>>"))
    shown = {r["value"].split("\n")[0]: r["value"] for r in render.show_text(m.withColumn("images", images), True).collect()}
    assert shown["ref:      a:1"] == "ref:      a:1\nsubject:  S\nfrom:     f@x.y\ndate:     1970-01-01 00:01\nflags:    unread, list, received\nbody:     full (just enriched)\n\ntext"
    assert shown["ref:      a:2"] == "ref:      a:2\ndate:     ?\nflags:    received\nbody:     meta (just enriched)\nimages:   1 OCR candidate(s) — offer likely in images, not text\n            • i.png (3x4)\n\n(no distilled body available — snippet: snip)"
    runs = spark.createDataFrame([("a", 3, 2, "since=3d"), ("b", 1, 1, None)], "account string, fetched long, indexed long, selector string")
    assert [r["value"] for r in render.sync_lines(runs).collect()] == ["a: fetched 3, indexed 2 (since=3d)", "b: fetched 1, indexed 1 (whole mailbox)"]
    changed = spark.createDataFrame([("a", "1", ["X", "Y"]), ("a", "2", []), ("a", "3", None)], "account string, message_id string, names array<string>")
    assert [r["value"] for r in render.change_lines("archived", changed).collect()] == ["archived a:1 — local labels now: X, Y", "archived a:2 — local labels now: ∅", "archived a:3 — message not in local index (provider updated; will reconcile on next sync)"]
    assert render.graph_line("a", {"nodes": 1, "edges": 2, "communities": 3}) == "a: 1 contacts, 2 co-recipiency edges, 3 communities"
