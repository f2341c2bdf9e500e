"""Derived tables after a sync: contacts, domains, threads, scores with their snapshot, compaction, and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import graph as G
from ..operators import interest as I
from ..operators import merge as M
from ..operators import search as S
from ..operators.curation import with_overlay
from ..operators.people import completed_syncs
from ..schemas import CONTACT_CURATION, DOMAIN_OVERLAY, IDENTITY, MESSAGES, SNAPSHOTS, SUMMARIES, SYNC_RUNS
from ..scratch import drop, written
from .segments import StoredIndex
from .store import Store

GRACE_MS = 7 * 86_400_000
METRICS = "account string, address string, centrality double, community_id bigint"


def messages(store: Store) -> DataFrame:
    """Messages with the users' summaries."""
    return with_overlay(store.read("messages", MESSAGES), store.read("message_summaries", SUMMARIES), M.KEY)


def contacts(store: Store) -> DataFrame:
    """Contacts as derived, with curation and graph metrics."""
    own = store.read("account_identity", IDENTITY).select("account", "address")
    c = A.contact_rollup(store.read("messages", MESSAGES), own)
    c = with_overlay(c, store.read("contact_curation", CONTACT_CURATION), ["account", "address"])
    return with_overlay(c, store.read("graph_metrics", METRICS), ["account", "address"])


def rebuild(store: Store, now_ms: int, grace_ms: int = GRACE_MS) -> dict[str, int]:
    """Overwrites what is derived, appends one snapshot generation, demotes what may be; user-owned tables aren't touched."""
    m, c = messages(store), contacts(store)
    threads = A.thread_rollup(m)
    scored = I.score_contacts(c, A.bulk_counts(m), now_ms)
    store.write("contacts", scored)
    store.write("domains", with_overlay(A.domain_rollup(c), store.read("domain_overlay", DOMAIN_OVERLAY), ["account", "domain"], keep_orphans=True))
    store.write("threads", threads)
    store.write("contact_stats_snapshot", I.append_snapshot(store.read("contact_stats_snapshot", SNAPSHOTS), I.snapshot(scored, now_ms)))
    curated = store.read("domain_overlay", DOMAIN_OVERLAY)
    gone = written(M.compact_eligible(m, c, curated, threads, now_ms - grace_ms).select(*M.KEY), "gone")
    n = gone.count()
    if n:
        store.put("messages", M.demote(store.read("messages", MESSAGES).join(gone, M.KEY, "left_semi"), gone))  # only the demoted rows are written
    return {"contacts": scored.count(), "compacted": n}


def should_build_graph(store: Store, account: str, everything: bool = False) -> bool:
    """On a full sync, and on an account's first completed one."""
    done = completed_syncs(store.read("sync_runs", SYNC_RUNS)).where(F.col("account") == account).first()
    return everything or done is None or done["completed"] <= 1


def build_graph(store: Store, rounds: int = G.ROUNDS) -> dict[str, int]:
    """Writes centrality and communities; an empty graph writes nothing."""
    c = contacts(store)
    people = G.participants(A.thread_rollup(store.read("messages", MESSAGES)), c)
    nodes, edges = people.select("account", "address").distinct(), G.edges(people)
    n = nodes.count()
    if not n:
        return {"nodes": 0, "edges": 0, "communities": 0}
    found = G.pagerank(nodes, edges, rounds).join(G.communities(nodes, edges), ["account", "address"])
    store.write("graph_metrics", found.select("account", "address", "centrality", "community_id"))
    metrics = store.read("graph_metrics", METRICS)
    return {"nodes": n, "edges": edges.count(), "communities": metrics.select("account", "community_id").distinct().count()}


def read_index(store: Store) -> S.SearchIndex:
    return StoredIndex(store).as_index()


def update_index(store: Store, keys: DataFrame | None = None) -> None:
    """The stored search index, brought up to date for the messages of ``keys`` (account, message_id; those that are gone leave it), or built anew."""
    m = messages(store)
    if keys is None:
        StoredIndex(store).rebuild(S.search_row(m))
    else:
        changed = written(keys.select(*S.KEY).distinct(), "changed")
        StoredIndex(store).update(S.search_row(m.join(changed, S.KEY, "left_semi")), changed)
        drop(changed)
