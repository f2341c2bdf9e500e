import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistola.functions.text import extract_address
from epistola.operators import aggregate as A
from epistola.operators import curation as C
from epistola.operators import graph as G
from epistola.operators import interest as I
from epistola.operators import merge as M
from epistola.operators import people as P
from epistola.operators import search as S

COLUMNS = {
    "account": "string", "message_id": "string", "thread_id": "string", "internal_date": "bigint", "from_addr": "string", "to_addr": "string", "cc_addr": "string", "subject": "string", "labels": "array<string>",
    "category": "string", "is_list": "boolean", "direction": "string", "unread": "boolean", "starred": "boolean", "important": "boolean", "snippet": "string", "body_state": "string", "body_text": "string",
    "summary_text": "string", "summarized_at": "bigint",
}
DEFAULTS = {"account": "a", "labels": [], "is_list": False, "direction": "received", "unread": False, "starred": False, "important": False, "body_state": "meta"}
ME = "Al <al@example.com>"


def mail(spark, *rows):
    return spark.createDataFrame([tuple({**DEFAULTS, **r}.get(c) for c in COLUMNS) for r in rows], ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def own(spark):
    return spark.createDataFrame([("a", "al@example.com")], "account string, address string")


def conversation(spark):
    return mail(
        spark,
        {"message_id": "n-1", "thread_id": "n", "internal_date": 900, "from_addr": "news@bulletin.example.org", "to_addr": "subs@x.org", "is_list": True, "category": "updates", "unread": True},
        {"message_id": "a-recv", "thread_id": "t-a", "internal_date": 1000, "from_addr": "Jordan <jordan@partner.example.com>", "to_addr": ME, "important": True, "subject": "Deposit terms"},
        {"message_id": "b-sent", "thread_id": "t-b", "internal_date": 1500, "direction": "sent", "from_addr": ME, "to_addr": "casey@vendor.example.com"},
        {"message_id": "a-sent", "thread_id": "t-a", "internal_date": 2000, "direction": "sent", "from_addr": ME, "to_addr": "jordan@partner.example.com", "subject": "Re: Deposit terms"},
    )


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_conversation(spark):
    m = conversation(spark)
    c = by(A.contact_rollup(m, own(spark)), "address")
    assert set(c) == {"jordan@partner.example.com", "casey@vendor.example.com", "news@bulletin.example.org"}
    j, k, n = (c[a] for a in ("jordan@partner.example.com", "casey@vendor.example.com", "news@bulletin.example.org"))
    assert (j["msgs_received"], j["msgs_sent"], j["replied_count"], j["initiated_count"], j["display_name"]) == (1, 1, 1, 0, "Jordan")
    assert (k["msgs_sent"], k["initiated_count"], n["read_count"], n["msgs_received"]) == (1, 1, 0, 1)
    t = by(A.thread_rollup(m), "thread_id")
    assert t["t-a"]["subject"] == "Re: Deposit terms" and t["t-a"]["user_participated"] and t["n"]["unread_count"] == 1
    assert t["t-a"]["participants"] == ["al@example.com", "jordan@partner.example.com"]
    assert [r["address"] for r in P.list_contacts(A.contact_rollup(m, own(spark)).withColumn("engagement_score", F.lit(1.0)), "recency").collect()][0] == "jordan@partner.example.com"


def test_ties_and_quirks(spark):
    sent = {"direction": "sent", "from_addr": ME, "thread_id": "t", "internal_date": 5}
    m = mail(spark, sent | {"message_id": "1", "to_addr": "x@y.z"}, sent | {"message_id": "2", "to_addr": "x@y.z"})
    x = by(A.contact_rollup(m, own(spark)), "address")["x@y.z"]
    assert (x["msgs_sent"], x["initiated_count"]) == (2, 1)
    both = mail(spark, sent | {"message_id": "1", "to_addr": "x@y.z", "cc_addr": "X <x@y.z>"})
    assert by(A.contact_rollup(both, own(spark)), "address")["x@y.z"]["msgs_sent"] == 2
    loose = mail(spark, {"message_id": "1", "from_addr": "q@r.s", "internal_date": None})
    assert by(A.contact_rollup(loose, own(spark)), "address")["q@r.s"]["msgs_received"] == 1 and A.thread_rollup(loose).count() == 0
    assert A.contact_rollup(mail(spark), own(spark)).count() == 0


def test_rollup_ignores_row_order_and_partitions(spark):
    m = conversation(spark)
    one = sorted(map(str, A.contact_rollup(m.coalesce(1).orderBy(F.desc("message_id")), own(spark)).collect()))
    assert one == sorted(map(str, A.contact_rollup(m.repartition(7), own(spark)).collect()))


def test_cadence(spark):
    day, t0 = 86_400_000, 1_767_225_600_000
    rows = [("s1", "a@email.silversea.com", 0), ("s2", "b@silversea.com", 10), ("s3", "a@email.silversea.com", 30), ("q1", "c@email.quark.com", 5)]
    m = mail(spark, *({"message_id": i, "from_addr": f, "internal_date": t0 + d * day} for i, f, d in rows), {"message_id": "x", "direction": "sent", "from_addr": ME})
    c = by(A.cadence(m), "domain")
    assert (c["silversea.com"]["msgs"], c["silversea.com"]["senders"]) == (3, 2)
    assert c["silversea.com"]["per_week"] == pytest.approx(0.7) and c["silversea.com"]["per_month"] == pytest.approx(3) and c["quark.com"]["per_week"] == 7
    assert by(A.cadence(m, since=t0 + 20 * day), "domain")["silversea.com"]["msgs"] == 1


def test_interest_order(spark):
    now = 2_000_000
    jordan = {"thread_id": "j", "from_addr": "jordan@p.com", "important": True, "internal_date": now - 10}
    rows = [jordan | {"message_id": "j1"}, {"message_id": "j2", "thread_id": "j", "direction": "sent", "from_addr": ME, "to_addr": "jordan@p.com", "internal_date": now}]
    rows += [{"message_id": f"d{i}", "thread_id": f"d{i}", "from_addr": "deals@x.com", "is_list": True, "category": "promotions", "unread": True, "internal_date": now - 100 + i} for i in range(5)]
    m = mail(spark, *rows)
    s = I.score_contacts(A.contact_rollup(m, own(spark)), A.bulk_counts(m), now)
    c = by(s, "address")
    assert c["jordan@p.com"]["engagement_score"] > 0 > c["deals@x.com"]["engagement_score"] and c["deals@x.com"]["bulk_count"] == 5
    assert [(r["address"], r["suggested"]) for r in I.propose_contacts(s).collect()] == [("jordan@p.com", "important"), ("deals@x.com", "muted")]
    one = I.snapshot(s, now)
    again = I.append_snapshot(one, I.snapshot(s, now))
    assert again.count() == 2 and I.append_snapshot(again, I.snapshot(s, now + 1)).count() == 4


def circles(spark):
    sent = [("h1", "hub@x.com, w1@x.com"), ("h2", "hub@x.com, w2@x.com"), ("h3", "hub@x.com, w3@x.com"), ("f", "f1@y.com, f2@y.com, f3@y.com")]
    rows = [{"message_id": i, "thread_id": i, "direction": "sent", "from_addr": ME, "to_addr": to, "internal_date": 1} for i, to in sent]
    rows.append({"message_id": "l", "thread_id": "l", "direction": "sent", "from_addr": ME, "to_addr": "hub@x.com, w1@x.com, f1@y.com, f2@y.com", "is_list": True, "internal_date": 1})
    return mail(spark, *rows)


def test_graph(spark):
    m = circles(spark)
    c = A.contact_rollup(m, own(spark))
    people = G.participants(A.thread_rollup(m), c)
    e, nodes = G.edges(people), people.select("account", "address").distinct()
    assert nodes.count() == 7 and e.count() == 6 and all(r["weight"] == 1 for r in e.collect())
    ranks = by(G.pagerank(nodes, e, 10), "address")
    assert max(ranks, key=lambda a: ranks[a]["centrality"]) == "hub@x.com" and sum(r["centrality"] for r in ranks.values()) == pytest.approx(1)
    groups = G.communities(nodes, e)
    first = {r["address"]: r["community_id"] for r in groups.collect()}
    assert len(set(first.values())) == 2 and len({first[a] for a in ("hub@x.com", "w1@x.com", "w2@x.com", "w3@x.com")}) == 1
    assert first == {r["address"]: r["community_id"] for r in G.communities(nodes.repartition(5), e.repartition(3)).collect()}
    assert G.modularity(e, groups).first()["modularity"] > 0.4
    scored = c.withColumn("engagement_score", F.lit(0.0))
    assert [r["address"] for r in G.neighbours(e, scored, "HUB@x.com").collect()] == ["w1@x.com", "w2@x.com", "w3@x.com"]
    top = G.community_overview(G.with_metrics(c, G.pagerank(nodes, e, 5), groups), 2).collect()
    assert [r["size"] for r in top] == [4, 3] and top[0]["members"][0] == "hub@x.com"
    none = people.limit(0)
    assert G.edges(none).count() == 0 and G.communities(none.select("account", "address"), G.edges(none)).count() == 0 and G.pagerank(none.select("account", "address"), G.edges(none)).count() == 0


def test_louvain_without_edges_is_singletons(spark):
    nodes = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "x")], "account string, address string")
    none = nodes.select("account", F.col("address").alias("a"), F.col("address").alias("b"), F.lit(1).alias("weight")).limit(0)
    for held in (10, 0):
        assert sorted(map(tuple, G.communities(nodes, none, held).collect())) == [("a", "x", 0), ("a", "y", 1), ("b", "x", 0)]


def random_graph(spark, seed=3, n=48, groups=4):
    rng = random.Random(seed)
    pairs = {}
    for _ in range(160):
        i = rng.randrange(n)
        j = (i + groups * rng.randrange(1, n // groups)) % n if rng.random() < 0.9 else rng.randrange(n)
        if i != j:
            k = (f"n{min(i, j):02}", f"n{max(i, j):02}")
            pairs[k] = pairs.get(k, 0) + 1
    e = spark.createDataFrame([("p", *k, w) for k, w in pairs.items()] + [("q", "x", "y", 2)], "account string, a string, b string, weight bigint")
    nodes = spark.createDataFrame([("p", f"n{i:02}") for i in range(n)] + [("p", "alone"), ("q", "x"), ("q", "y")], "account string, address string")
    return nodes, e, pairs


def test_large_graphs_like_small_ones(spark):
    """By joins and in one task: the same communities, the same ranks; modularity near that of the planted groups."""
    nodes, e, pairs = random_graph(spark)
    one, many = (sorted(map(tuple, G.communities(nodes, e, held).collect())) for held in (1000, 0))
    assert one == many and len({c for a, _, c in one if a == "p"}) < 12
    planted = nodes.where("account = 'p'").withColumn("community_id", F.when(F.col("address") == "alone", 9).otherwise(F.regexp_extract("address", "n(.*)", 1).try_cast("long") % 4))
    q = lambda m: G.modularity(e.where("account = 'p'"), m).first()["modularity"]
    assert q(G.communities(nodes, e).where("account = 'p'")) > 0.9 * q(planted) > 0.3
    ranks = [{(r["account"], r["address"]): r["centrality"] for r in G.pagerank(nodes, e, held_edges=held).collect()} for held in (1000, 0)]
    assert ranks[0].keys() == ranks[1].keys() and all(abs(ranks[0][k] - ranks[1][k]) < 1e-12 for k in ranks[0])


def test_pagerank_converges(spark):
    """Against the solution of the linear equations."""
    nodes, e, pairs = random_graph(spark, 5)
    names = [f"n{i:02}" for i in range(48)] + ["alone"]
    w = np.zeros((49, 49))
    for (a, b), k in pairs.items():
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = k
    out = w.sum(1)
    step = np.where(out[:, None] > 0, w / np.maximum(out, 1)[:, None], 1 / 49)
    exact = np.linalg.solve(np.eye(49) - 0.85 * step.T, np.full(49, 0.15 / 49))
    got = {r["address"]: r["centrality"] for r in G.pagerank(nodes, e).where("account = 'p'").collect()}
    assert max(abs(got[n] - x) for n, x in zip(names, exact, strict=True)) < 49e-6
    assert abs(got["alone"] - exact[48]) < 1e-5


def test_edges_of_a_large_thread(spark):
    people = spark.range(300).select(F.lit("a").alias("account"), F.lit("t").alias("thread_id"), F.format_string("p%03d", "id").alias("address")).unionByName(spark.createDataFrame([("a", "u", "p001"), ("a", "u", "p002"), ("a", "v", "p001")], "account string, thread_id string, address string"))
    one, dealt = (sorted(map(tuple, G.edges(people, most).collect())) for most in (1000, 40))
    assert one == dealt and len(one) == 300 * 299 // 2 and ("a", "p001", "p002", 2) in one


def test_upsert_never_downgrades(spark):
    old = mail(spark, {"message_id": "1", "body_state": "full", "body_text": "body", "subject": "old", "unread": True}, {"message_id": "2", "body_state": "summary-only"})
    new = mail(spark, {"message_id": "1", "subject": "new"}, {"message_id": "2", "body_state": "full", "body_text": "again"}, {"message_id": "3"})
    got = by(M.upsert_messages(old, new), "message_id")
    assert (got["1"]["subject"], got["1"]["unread"], got["1"]["body_state"], got["1"]["body_text"]) == ("new", False, "full", "body")
    assert (got["2"]["body_state"], got["2"]["body_text"], got["3"]["body_state"]) == ("summary-only", None, "meta")
    again = M.upsert_messages(M.upsert_messages(old, new), new)
    assert by(again, "message_id") == got


def test_reconcile(spark):
    m = mail(spark, {"message_id": "kept", "labels": ["INBOX", "UNREAD"], "category": "primary", "unread": True}, {"message_id": "archived", "labels": ["INBOX"], "category": "primary"}, {"message_id": "back", "labels": ["STARRED"]})
    live = spark.createDataFrame([("a", "kept"), ("a", "back"), ("a", "fresh")], "account string, message_id string")
    changes = M.reconcile_inbox(m, live)
    assert {(r["message_id"], r["change"]) for r in changes.collect()} == {("archived", "archived"), ("back", "restored"), ("fresh", "fetch")}
    after = M.apply_reconciled(m, changes)
    got = by(after, "message_id")
    assert (got["archived"]["labels"], got["archived"]["category"], got["back"]["labels"], got["back"]["category"], got["kept"]["unread"]) == ([], None, ["STARRED", "INBOX"], "primary", True)
    assert {(r["message_id"], r["change"]) for r in M.reconcile_inbox(after, live).collect()} == {("fresh", "fetch")}


def test_label_edits(spark):
    m = mail(spark, {"message_id": "1", "labels": ["INBOX", "UNREAD"], "unread": True, "category": "primary"}, {"message_id": "2", "labels": ["INBOX"]})
    change = spark.createDataFrame([("a", "1", ["STARRED"], ["INBOX", "UNREAD"])], "account string, message_id string, add array<string>, remove array<string>")
    got = by(M.apply_label_changes(m, change), "message_id")
    assert (got["1"]["labels"], got["1"]["unread"], got["1"]["starred"], got["1"]["category"], got["2"]["labels"]) == (["STARRED"], False, True, None, ["INBOX"])


def test_enrich_and_profile(spark):
    m = mail(
        spark,
        {"message_id": "direct", "from_addr": "jo@p.com", "internal_date": 3}, {"message_id": "list", "from_addr": "n@x.com", "is_list": True, "internal_date": 2},
        {"message_id": "promo", "from_addr": "s@shop.com", "category": "promotions", "internal_date": 1}, {"message_id": "done", "from_addr": "jo@p.com", "body_state": "full"},
    )
    ids = lambda df: [r["message_id"] for r in df.collect()]
    assert ids(M.enrich_candidates(m, "direct")) == ["direct"] and ids(M.enrich_candidates(m, limit=2)) == ["direct", "list"]
    assert ids(M.enrich_candidates(m, sender="S@shop.com")) == ["promo"]
    contacts = spark.createDataFrame([("a", "jo@p.com", "important"), ("a", "n@x.com", "muted")], "account string, address string, curation string")
    domains = spark.createDataFrame([("a", "x.com", "important"), ("a", "shop.com", None)], "account string, domain string, curation string")
    assert ids(M.profile_candidates(m, contacts, domains)) == ["direct"]
    hits = m.where("message_id = 'promo'").select("account", "message_id")
    assert ids(M.profile_candidates(m, contacts, domains, hits)) == ["direct", "promo"]
    bodies = spark.createDataFrame([("a", "direct", "Hello\n-- \nsig", None)], "account string, message_id string, body_text string, body_html string")
    full = M.promote(m, bodies, m.select("account", "message_id")).collect()
    assert [(r["message_id"], r["body_state"], r["body_text"]) for r in full] == [("direct", "full", "Hello")]


def test_compaction(spark):
    base = {"body_state": "full", "body_text": "x", "summary_text": "s", "summarized_at": 10, "is_list": True, "category": "promotions"}
    rows = [("news1", "n@news.com", "t1"), ("vip1", "v@vip.com", "t2"), ("part1", "n@news.com", "t3")]
    m = mail(spark, *(base | {"message_id": i, "from_addr": f, "thread_id": t} for i, f, t in rows), base | {"message_id": "direct1", "is_list": False, "category": "primary", "from_addr": "d@d.com"}, {"message_id": "own", "thread_id": "t3", "direction": "sent", "from_addr": ME})
    contacts = spark.createDataFrame([], "account string, address string, curation string")
    domains = spark.createDataFrame([("a", "vip.com", "important")], "account string, domain string, curation string")
    gone = M.compact_eligible(m, contacts, domains, A.thread_rollup(m), 10)
    assert [r["message_id"] for r in gone.collect()] == ["news1"]
    after = by(M.demote(m, gone), "message_id")
    assert (after["news1"]["body_state"], after["news1"]["body_text"], after["vip1"]["body_state"]) == ("summary-only", None, "full")
    assert M.compact_eligible(M.demote(m, gone), contacts, domains, A.thread_rollup(m), 10).count() == 0


def test_labels(spark):
    schema = "account string, label_id string, name string, type string, updated_at bigint"
    old = spark.createDataFrame([("a", "INBOX", "INBOX", "system", 0)], schema)
    new = spark.createDataFrame([("a", "Label_99", "Coverage Review", "user", 1), ("a", "", "x", "user", 1)], schema)
    assert [r["label_id"] for r in M.replace_labels(old, new).collect()] == ["Label_99"]
    assert M.replace_labels(old, new.limit(0)).count() == 1
    assert by(M.label_ids(new.where("label_id <> ''")), "name")["coverage review"]["label_id"] == "Label_99"


def test_curation(spark):
    known = spark.createDataFrame([("a", "jo@p.com"), ("a", "x@y.z")], "account string, address string")
    contacts = spark.createDataFrame([("a", "x@y.z", "muted")], "account string, address string, curation string")
    domains = spark.createDataFrame([("a", "p.com", None, "travel", None, 1)], "account string, domain string, curation string, category string, category_note string, categorized_at bigint")
    profile = spark.createDataFrame([("a", ["old"], 1)], "account string, keywords array<string>, updated_at bigint")
    r = C.set_curation(spark, known, contacts, domains, profile, "a", 9, contact_labels={"jo@p.com": "important", "x@y.z": None, "who@q.r": "muted"}, domain_labels={"new.org": "blocked", "p.com": "important"}, keywords=["Visa", "visa ", ""])
    got_c, got_d, got_p = C.get_curation(r.contacts, r.domains, r.profile)
    assert r.skipped == 1 and [tuple(x) for x in got_c.collect()] == [("a", "jo@p.com", "important")]
    assert [tuple(x) for x in got_d.collect()] == [("a", "new.org", "blocked"), ("a", "p.com", "important")] and got_p.first()["keywords"] == ["Visa"]
    assert by(r.domains, "domain")["p.com"]["category"] == "travel"
    with pytest.raises(Exception, match="curation must be"):
        C.set_curation(spark, known, contacts, domains, profile, "a", 9, contact_labels={"jo@p.com": "great"})
    answers = spark.createDataFrame([("a", 1, "jo@p.com", ""), ("a", 2, "x@y.z", "k"), ("a", 3, "z@z.z", "q")], "account string, n int, address string, answer string")
    hints = spark.createDataFrame([("a", x, "important") for x in ("jo@p.com", "x@y.z", "z@z.z")], "account string, address string, suggested string")
    assert {(x["address"], x["curation"]) for x in C.apply_decisions(answers, hints).collect()} == {("jo@p.com", "important"), ("x@y.z", None)}


def test_overlays_survive_rebuilds(spark):
    domains = spark.createDataFrame([("a", "p.com", None, None, "why", None)], "account string, domain string, curation string, category string, category_note string, categorized_at bigint")
    saved = C.save_domain_category(domains, "a", " P.com ", "travel", 5)
    assert saved.collect()[0].asDict() == {"account": "a", "domain": "p.com", "curation": None, "category": "travel", "category_note": "why", "categorized_at": 5}
    derived = spark.createDataFrame([("a", "p.com", 3)], "account string, domain string, msgs bigint")
    assert C.with_overlay(derived, saved, ["account", "domain"]).first()["category"] == "travel"
    assert C.with_overlay(derived.limit(0), saved, ["account", "domain"], keep_orphans=True).count() == 1
    m = mail(spark, {"message_id": "1"})
    empty = spark.createDataFrame([], "account string, message_id string, summary_text string, summary_is_model boolean, summarized_at bigint")
    assert C.save_summary(empty, m, "a", "1", " short ", 7).first()["summary_text"] == "short"
    for ident, text in (("1", " "), ("2", "x")):
        with pytest.raises(Exception, match="blank|no message_id"):
            C.save_summary(empty, m, "a", ident, text, 7)


def test_bm25_by_hand(spark):
    import math

    m = mail(spark, {"message_id": "1", "subject": "invoice due", "internal_date": 1}, {"message_id": "2", "snippet": "your invoices and more words here", "internal_date": 2}, {"message_id": "3", "subject": "hello", "internal_date": 3}, {"message_id": "4", "subject": "other", "internal_date": 4}, {"message_id": "5", "subject": "thing", "internal_date": 5})
    ix = S.build_index(S.search_row(m))
    got = {r["message_id"]: r["score"] for r in S.bm25(ix, S.parse("invoicing")).collect()}
    idf, avg = math.log((5 - 2 + 0.5) / 2.5), (2 + 6 + 1 + 1 + 1) / 5
    part = lambda f, d: -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg))
    assert got == pytest.approx({"1": part(10, 2), "2": part(1, 6)})
    assert [r["message_id"] for r in S.search(m, ix, "invoice").collect()] == ["1", "2"]
    assert S.search(m, ix, "  ").count() == 0 and S.search(m, ix, "invoice", account="b").count() == 0
    assert [r["message_id"] for r in S.keyword_search(m, ix, ["more words"]).collect()] == ["2"] and S.keyword_search(m, ix, []).count() == 0


def test_query_building():
    assert S.match_expression(["a", 'b"c', " "]) == '"a"* OR "b""c"*'
    assert S.expand(["Invoice", "receipt"]) == ["Invoice", "receipt", "bill"]
    assert S.match_expression(["OR"]) == '"OR"*' and S.match_expression([]) == ""
    assert S.parse("a-b", prefix=True)[0] == S.Phrase(("a", "b"), True)


def test_demoted_text_stops_matching(spark):
    m = mail(spark, {"message_id": "1", "body_state": "full", "body_text": "needle"})
    found = lambda x: S.bm25(S.build_index(S.search_row(x)), S.parse("needle")).count()
    assert found(m) == 1 and found(M.demote(m, m)) == 0


def test_feeds_join_on_extracted_addresses(spark):
    m = mail(spark, {"message_id": "1", "from_addr": "J <j_o@p.com>", "internal_date": 5}, {"message_id": "2", "from_addr": "jxo@p.com", "internal_date": 6}, {"message_id": "3", "from_addr": "z@vip.com", "internal_date": 4}, {"message_id": "4", "from_addr": "z@vip.com", "internal_date": None})
    contacts = spark.createDataFrame([("a", "j_o@p.com", "important")], "account string, address string, curation string")
    domains = spark.createDataFrame([("a", "vip.com", "important")], "account string, domain string, curation string")
    assert [r["message_id"] for r in P.from_important(m, contacts, domains, 0).collect()] == ["1", "3"]
    assert m.select(extract_address(F.col("from_addr"))).first()[0] == "j_o@p.com"


def test_status(spark):
    runs = spark.createDataFrame([("a", "sync", 1, 10, None), ("a", "sync", 20, None, None), ("b", "sync", 1, 5, "boom"), ("b", "enrich", 2, 7, None)], "account string, phase string, started_at bigint, finished_at bigint, error string")
    assert {r["account"]: r["as_of"] for r in P.index_as_of(runs).collect()} == {"a": 10, "b": 7} and P.index_as_of_all(runs).first()["as_of"] == 7
    f = by(P.freshness(runs, 20 + 3 * 3_600_000), "account")
    assert f["a"]["syncing"] and f["a"]["stale"] and not f["b"]["syncing"]
    assert by(P.completed_syncs(runs), "account") == {"a": {"account": "a", "completed": 1}}
