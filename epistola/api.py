"""The query surface: 23 tools over the index, each a function that gives a DataFrame or a small result.

Bounded, compact answers: hits never carry bodies. ``fresh`` describes how current the index is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ToolError
from .functions.html import classify_images, image_only, ocr_candidates, parse_images
from .functions.text import compact_snippet, iso_millis, label_names, message_ref
from .operators import curation as C
from .operators import graph as G
from .operators import interest as I
from .operators import merge as M
from .operators import people as P
from .operators import search as S
from .operators.aggregate import cadence, cadence_ordered
from .scratch import few
from .sources.mail import MailSource, Scope

TOOLS = (
    "search", "list_labeled", "refresh_inbox", "get_message", "get_thread", "list_contacts", "get_contact", "find_person", "list_threads", "graph_neighbors", "graph_communities",
    "interest_propose", "interest_set", "interest_get", "save_summary", "domains_to_categorize", "save_domain_category", "cadence", "sync_status", "catch_up", "digest_sources",
    "archive_message", "modify_labels",
)
_UNITS = {"d": 86_400_000, "w": 7 * 86_400_000, "h": 3_600_000, "m": 60_000, "mo": 30 * 86_400_000}


def parse_since(text: str, now_ms: int) -> int:
    """``3d``, ``2w``, ``12h``, ``30m`` (minutes), ``1mo`` (30 days) before now, or a date; epoch milliseconds."""
    if m := re.fullmatch(r"(\d+)\s*(mo|[dwhm])", text.strip()):
        return now_ms - int(m[1]) * _UNITS[m[2]]
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise ToolError(f"not a time: {text!r}; use 3d, 2w, 12h, 30m, 1mo or an ISO date") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def parse_ref(ref: str) -> tuple[str, str]:
    account, colon, ident = ref.partition(":")
    if not (colon and account and ident):
        raise ToolError(f"not a reference: {ref!r}; it has the form account:id")
    return account, ident


def quote_arg(arg: str) -> str:
    return '"' + arg.replace('"', '\\"') + '"' if re.search(r"\s", arg) else arg


def handback(*args: str) -> str:
    """A command line that a person may run."""
    return " ".join(quote_arg(a) for a in args)


@dataclass(frozen=True)
class Index:
    """The tables that the tools read. messages carry summary columns; contacts score, curation and graph metrics."""

    messages: DataFrame
    contacts: DataFrame
    domains: DataFrame
    threads: DataFrame
    runs: DataFrame
    labels: DataFrame
    postings: S.SearchIndex
    profile: DataFrame
    bulk: DataFrame | None = None


class Tools:
    def __init__(self, spark: SparkSession, index: Index, now_ms: int, sources: dict[str, MailSource] | None = None):
        self.spark, self.ix, self.now, self.sources = spark, index, now_ms, sources or {}

    # -- helpers

    def fresh(self, account: str | None = None) -> DataFrame:
        f = P.freshness(self.ix.runs, self.now)
        return f.where(F.col("account") == account) if account else f

    def _sole(self, account: str | None) -> str:
        if account:
            return account
        names = [r["account"] for r in P.accounts(self.ix.messages, self.ix.runs).limit(3).collect()]
        if len(names) != 1:
            raise ToolError("name an account: " + (", ".join(names) if names else "there is none"))
        return names[0]

    def _in(self, df: DataFrame, account: str | None) -> DataFrame:
        return df.where(F.col("account") == account) if account else df

    def _hits(self, rows: DataFrame) -> DataFrame:
        names = self.ix.labels.groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("label_id", "name"))).alias("_names"))
        none = F.create_map().cast("map<string,string>")
        out = rows.join(few(names), "account", "left")
        return out.select(
            message_ref(F.col("account"), F.col("message_id")).alias("ref"), "account", "thread_id", F.col("from_addr").alias("from"), "subject", iso_millis(F.col("internal_date")).alias("date"),
            label_names(F.col("labels"), F.coalesce("_names", none)).alias("labels"), "category", compact_snippet(F.col("snippet")).alias("snippet"), "body_state", F.col("summary_text").isNotNull().alias("has_summary"), "unread",
        )

    # -- reading

    def search(self, query: str, account: str | None = None, limit: int = 15) -> DataFrame:
        return self._hits(S.search(self.ix.messages, self.ix.postings, query, synonyms=True, account=account, limit=limit))

    def search_enriching(self, query: str, account: str | None = None, limit: int = 15) -> tuple[DataFrame, int]:
        """Search; fetch the bodies that hits lack, where a source has them; search again if any came."""
        hits = S.search(self.ix.messages, self.ix.postings, query, synonyms=True, account=account, limit=limit).where("body_state = 'meta'").select("account", "message_id")
        come = None
        for name, source in self.sources.items():
            wanted = hits.where(F.col("account") == name)
            bodies = source.get_full(wanted.select(F.col("message_id").alias("id"))).select(F.lit(name).alias("account"), F.col("id").alias("message_id"), F.col("bodyText").alias("body_text"), F.col("bodyHtml").alias("body_html"))
            got = M.promote(self.ix.messages, bodies, wanted)
            come = got if come is None else come.unionByName(got)
        promoted = come.count() if come is not None else 0
        if not promoted:
            return self.search(query, account, limit), 0
        messages = M.upsert_messages(self.ix.messages, come)
        ix = replace(self.ix, messages=messages, postings=S.with_messages(self.ix.postings, S.search_row(messages.join(come.select(*S.KEY), S.KEY, "left_semi"))))
        return Tools(self.spark, ix, self.now, self.sources).search(query, account, limit), promoted

    def list_labeled(self, label: str, account: str | None = None, limit: int = 15) -> DataFrame:
        """By id; by name, too, where an account is given."""
        if account:
            found = M.label_ids(self.ix.labels).where((F.col("account") == account) & (F.col("name") == label.lower())).first()
            label = found["label_id"] if found else label
        return self._hits(P.labeled(self._in(self.ix.messages, account), label, limit))

    def refresh_inbox(self, account: str | None = None, limit: int = 15) -> tuple[DataFrame, dict]:
        """Reconciles with the source where there is one that answers; else the index as it is."""
        name, info = self._sole(account), {"refreshed": False}
        m = self._in(self.ix.messages, name)
        source = self.sources.get(name)
        if source and source.check().get("ok"):
            live = source.list_ids(Scope(query="in:inbox")).select(F.lit(name).alias("account"), F.col("id").alias("message_id"))
            changes = M.reconcile_inbox(m, live)
            m = M.apply_reconciled(m, changes)
            info = {"refreshed": True, **{r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}}
        return self._hits(P.labeled(m, "INBOX", limit)), info

    def get_message(self, ref: str, level: str = "summary") -> DataFrame:
        if level not in ("meta", "summary", "body"):
            raise ToolError("level is meta, summary or body")
        account, ident = parse_ref(ref)
        m = self.ix.messages.where((F.col("account") == account) & (F.col("message_id") == ident))
        if not m.limit(1).count():
            raise ToolError(f"no message {ref}")
        html = F.col("body_html") if "body_html" in m.columns else F.lit(None).cast("string")
        images = ocr_candidates(classify_images(parse_images(F.coalesce(html, F.lit("")))))
        body = F.when(F.col("body_state") == "full", F.col("body_text")) if level == "body" else F.lit(None).cast("string")
        hit = self._hits(m)
        more = m.select(
            message_ref(F.col("account"), F.col("message_id")).alias("ref"), F.col("to_addr").alias("to"), F.col("cc_addr").alias("cc"), body.alias("body"),
            (F.col("summary_text") if level != "meta" else F.lit(None).cast("string")).alias("summary"), image_only(F.col("body_text"), images).alias("needsOcr"), images.alias("ocrImages"),
        )
        return hit.join(more, "ref")

    def get_thread(self, ref: str) -> tuple[DataFrame, DataFrame]:
        account, ident = parse_ref(ref)
        thread = self.ix.threads.where((F.col("account") == account) & (F.col("thread_id") == ident))
        found = P.thread_messages(self.ix.messages, account, ident)
        if not thread.limit(1).count() and not found.limit(1).count():
            raise ToolError(f"no thread {ref}")
        return thread, self._hits(found)

    def list_contacts(self, account: str | None = None, sort: str = "engagement", only: str | None = None, limit: int = 20) -> DataFrame:
        if sort not in P.SORTS:
            raise ToolError(f"sort is one of {', '.join(P.SORTS)}")
        return P.list_contacts(self._in(self.ix.contacts, account), sort, only, limit)

    def get_contact(self, address: str, account: str | None = None) -> dict[str, DataFrame]:
        """The contact and recent threads; without a match, candidates."""
        c = self._in(self.ix.contacts, account).where(F.col("address") == address.strip().lower()).orderBy("account").limit(1)
        found = c.first()
        if found is None:
            return {"candidates": self.find_person(address.split("@")[0], account)}
        return {"contact": c, "threads": P.threads_of_contact(self._in(self.ix.threads, found["account"]), address, 10)}

    def find_person(self, hint: str, account: str | None = None, limit: int = 10) -> DataFrame:
        return P.find_person(self._in(self.ix.contacts, account), hint, limit)

    def list_threads(self, contact: str | None = None, query: str | None = None, account: str | None = None, limit: int = 20) -> DataFrame:
        t = self._in(self.ix.threads, account)
        if contact:
            return P.threads_of_contact(t, contact, limit)
        if not query:
            raise ToolError("give a contact or a query")
        hits = S.bm25(self.ix.postings, S.parse(query))
        return P.threads_of_hits(t, self.ix.messages.join(hits, ["account", "message_id"], "left_semi"), limit)

    def graph_neighbors(self, address: str, account: str | None = None, limit: int = 15) -> DataFrame:
        """Neighbours; where there are none, people like the hint with no shared thread."""
        people = G.participants(self._in(self.ix.threads, account), self.ix.contacts)
        near = G.neighbours(G.edges(people), self.ix.contacts, address, limit).select("account", "address", "display_name", "shared_threads")
        if near.limit(1).count():
            return near
        like = self.find_person(address.split("@")[0], account, limit).where(F.col("address") != address.lower())
        return like.select("account", "address", "display_name", F.lit(0).cast("long").alias("shared_threads"))

    def graph_communities(self, account: str | None = None, member_limit: int = 10) -> tuple[DataFrame, str | None]:
        c = self._in(self.ix.contacts, account)
        if "community_id" not in c.columns or not c.where("community_id is not null").limit(1).count():
            return self.spark.createDataFrame([], "account string, community_id long, size long, members array<string>"), handback("graph", "build")
        return G.community_overview(c, member_limit), None

    def cadence(self, account: str | None = None, category: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
        at = parse_since(since, self.now) if since else None
        return cadence_ordered(cadence(self._in(self.ix.messages, account), self.ix.domains, category, at), limit)

    def sync_status(self, account: str | None = None) -> tuple[DataFrame, DataFrame]:
        return P.body_states(self._in(self.ix.messages, account)), self.fresh(account)

    def catch_up(self, since: str, account: str | None = None) -> dict[str, DataFrame]:
        name, at = self._sole(account), parse_since(since, self.now)
        m = self._in(self.ix.messages, name)
        words = self.ix.profile.where(F.col("account") == name).select("keywords").first()
        return {
            "important": self._hits(P.from_important(m, self.ix.contacts, self.ix.domains, at)),
            "threads": self._hits(P.in_own_threads(m, self.ix.threads, at)),
            "keywords": self._hits(S.keyword_search(m, self.ix.postings, list(words["keywords"]) if words else [], at)),
        }

    def digest_sources(self, account: str | None = None, since: str | None = None) -> DataFrame:
        at = parse_since(since, self.now) if since else 0
        return P.digest_sources(self._in(self.ix.messages, self._sole(account)), self.ix.contacts, at)

    # -- writing: each gives the table as it should be

    def interest_propose(self, account: str | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        c = self._in(self.ix.contacts, account)
        return I.propose_contacts(c.drop("curation"), c.select("account", "address", "curation"), limit), I.propose_domains(c, limit)

    def interest_set(self, account: str, contacts: dict[str, str | None] | None = None, domains: dict[str, str | None] | None = None, keywords: list[str] | None = None) -> C.CurationResult:
        own = self.ix.contacts.select("account", "address", "curation")
        return C.set_curation(self.spark, self.ix.contacts, own, self.ix.domains, self.ix.profile, account, self.now, contact_labels=contacts, domain_labels=domains, keywords=keywords)

    def interest_get(self, account: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return C.get_curation(*(self._in(t, account) for t in (self.ix.contacts, self.ix.domains, self.ix.profile)))

    def save_summary(self, overlay: DataFrame, ref: str, text: str, level: str = "message") -> DataFrame:
        account, ident = parse_ref(ref)
        if level not in ("message", "thread"):
            raise ToolError("level is message or thread")
        known, key = (self.ix.messages, "message_id") if level == "message" else (self.ix.threads, "thread_id")
        return C.save_summary(overlay, known, account, ident, text, self.now, key)

    def domains_to_categorize(self, account: str | None = None, include_categorized: bool = False, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        c = self._in(self.ix.contacts, account)
        found = P.domains_to_categorize(c, self.ix.domains, include_categorized, limit)
        return found, P.categorize_samples(found, c, self.ix.messages)

    def save_domain_category(self, overlay: DataFrame, account: str, domain: str, category: str, note: str | None = None) -> DataFrame:
        return C.save_domain_category(overlay, account, domain, category, self.now, note)

    def modify_labels(self, ref: str, add: list[str] | None = None, remove: list[str] | None = None) -> Tools:
        """The provider first, then the index; names are resolved where they are known."""
        account, ident = parse_ref(ref)
        add, remove = ([x for x in (y or []) if x.strip()] for y in (add, remove))
        if not add and not remove:
            raise ToolError("give a label to add or remove")
        ids = {r["name"]: r["label_id"] for r in M.label_ids(self.ix.labels).where(F.col("account") == account).collect()}
        add, remove = ([ids.get(x.lower(), x) for x in y] for y in (add, remove))
        change = self.spark.createDataFrame([(account, ident, add, remove)], "account string, message_id string, add array<string>, remove array<string>")
        if account in self.sources:
            self.sources[account].modify(change)
        return Tools(self.spark, replace(self.ix, messages=M.apply_label_changes(self.ix.messages, change)), self.now, self.sources)

    def archive_message(self, ref: str) -> Tools:
        return self.modify_labels(ref, remove=["INBOX"])

    def call(self, tool: str, **args):
        """Dispatch by name."""
        if tool not in TOOLS:
            raise ToolError(f"no tool {tool!r}")
        return getattr(self, tool)(**args)
