"""Queries of the library's own operators. Each docstring names the operators that it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import html as H
from ..functions import text as X
from ..functions.classify import is_bulk_digest
from ..functions.scoring import suggestion
from ..operators import aggregate as A
from ..operators import graph as G
from ..operators import interest as I
from ..operators import merge as M
from ..operators import people as P
from ..operators import search as S
from ..scratch import few, scratch_path, written
from ..streaming.segments import StoredIndex
from ..streaming.store import Store

QUERIES = {}
SINCE = V.NOW - 10 * V.DAY


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("account", "message_id", "thread_id", "internal_date")


# -- aggregation and scores


@query
def cadence_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """E4, C2, I1, I3, I5, G5"""
    return A.cadence_ordered(A.cadence(V.messages(spark, d))).select("account", "domain", "msgs", "senders", "first_at", "last_at", *_r("per_week", "per_month"))


@query
def cadence_by_category(spark: SparkSession, d: str) -> DataFrame:
    """E4, D6, C3"""
    mail = V.Mail(spark, d)
    rows = A.cadence(mail.messages, mail.domains, category="cat2", since=SINCE)
    return rows.select("account", "domain", "category", "msgs", "senders", *_r("per_week", "per_month"))


@query
def contact_rollup(spark: SparkSession, d: str) -> DataFrame:
    """E1, D10, F1, F2, F4, I1, I2, I4"""
    return V.contacts(spark, d)


@query
def domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    """E2, I5"""
    return A.domain_rollup(V.contacts(spark, d))


@query
def thread_rollup(spark: SparkSession, d: str) -> DataFrame:
    """E3, F3"""
    return V.threads(spark, d).withColumn("participants", F.array_join("participants", ","))


@query
def reply_initiate(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2, D10 over conversations"""
    own = spark.createDataFrame([("c", "assistant@own.example.net")], "account string, address string")
    return A.contact_rollup(V.conversation_messages(spark, d), own).select("address", "msgs_received", "msgs_sent", "replied_count", "initiated_count")


@query
def engagement_scores(spark: SparkSession, d: str) -> DataFrame:
    """M1, I22, I23, D11, E9, C10"""
    mail = V.Mail(spark, d)
    return mail.scored.select("account", "address", "bulk_count", *_r("engagement_score"))


@query
def snapshot_trend(spark: SparkSession, d: str) -> DataFrame:
    """J12, F6 (an extension): two generations, the change between them"""
    m = V.Mail(spark, d).messages
    c, b = A.contact_rollup(m, V.own_addresses(spark)), A.bulk_counts(m)
    one, two = (I.snapshot(I.score_contacts(c, b, t), t) for t in (V.NOW, V.NOW + 30 * V.DAY))
    return I.snapshot_trend(I.append_snapshot(one, two)).select("account", "address", "taken_at", *_r("engagement_score", "change"))


@query
def curation_proposal(spark: SparkSession, d: str) -> DataFrame:
    """N2, G9, B11, I24, I25"""
    mail = V.Mail(spark, d)
    return I.propose_contacts(mail.scored.drop("curation"), None, 50).drop("curation")


@query
def curation_proposal_domains(spark: SparkSession, d: str) -> DataFrame:
    """N2, G9, I24"""
    mail = V.Mail(spark, d)
    return I.propose_domains(mail.scored, 50)


# -- feeds and status


@query
def digest_sources(spark: SparkSession, d: str) -> DataFrame:
    """D3, E5, G4, C9"""
    mail = V.Mail(spark, d)
    return P.digest_sources(mail.messages, mail.scored, SINCE).select("account", "address", "display_name", "issues", "unread", "unsummarized", *_r("engagement_score"))


@query
def catch_up_important(spark: SparkSession, d: str) -> DataFrame:
    """D4, D5, C7, C8, G3"""
    mail = V.Mail(spark, d)
    return _shown(P.from_important(mail.messages, mail.scored, mail.domains, SINCE, 50))


@query
def catch_up_threads(spark: SparkSession, d: str) -> DataFrame:
    """D2, G3"""
    mail = V.Mail(spark, d)
    return _shown(P.in_own_threads(mail.messages, mail.threads, SINCE, 50))


@query
def catch_up_keywords(spark: SparkSession, d: str) -> DataFrame:
    """L6, C3"""
    mail = V.Mail(spark, d)
    return _shown(S.keyword_search(mail.messages, mail.index(False), ["signup invoice", "flight 7"], SINCE, 40, False))


@query
def status_body_states(spark: SparkSession, d: str) -> DataFrame:
    """E6"""
    return P.body_states(V.messages(spark, d)).withColumnRenamed("summary-only", "summary_only")


@query
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    """E7"""
    return P.totals(V.messages(spark, d)).withColumn("account", F.coalesce("account", F.lit("*")))


@query
def index_as_of(spark: SparkSession, d: str) -> DataFrame:
    """E8, C16, G15, B10"""
    runs = V.sync_runs(spark, d)
    each = P.index_as_of(runs).unionByName(P.index_as_of_all(runs).withColumn("account", F.lit("*")))
    return each.select("account", "as_of", X.iso_millis(F.col("as_of")).alias("iso"))


@query
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """C17, C18, J8"""
    return P.freshness(V.sync_runs(spark, d), V.NOW)


@query
def completed_syncs(spark: SparkSession, d: str) -> DataFrame:
    """E12"""
    return P.completed_syncs(V.sync_runs(spark, d))


@query
def accounts_union(spark: SparkSession, d: str) -> DataFrame:
    """H1, E14"""
    return P.accounts(V.messages(spark, d), V.sync_runs(spark, d), V.contacts(spark, d))


# -- labels and state


@query
def classify_messages(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what classification gives"""
    m = V.messages(spark, d).withColumn("bulk", is_bulk_digest(F.col("is_list"), F.col("category")))
    return m.groupBy("account", "category", "is_list", "direction", "unread", "starred", "important", "bulk").agg(F.count(F.lit(1)).alias("n"))


@query
def label_membership(spark: SparkSession, d: str) -> DataFrame:
    """C4, G2"""
    return _shown(P.labeled(V.messages(spark, d), "STARRED", 30))


@query
def label_names(spark: SparkSession, d: str) -> DataFrame:
    """D7, B13, J5"""
    old = spark.createDataFrame([("a0", "INBOX", "Old", "system", 0), ("a1", "STARRED", "Kept", "system", 0)], "account string, label_id string, name string, type string, updated_at bigint")
    new = spark.createDataFrame([("a0", "INBOX", "Inbox", "system", 1), ("a0", "UNREAD", "Unread", "system", 1), ("a0", "", "none", "user", 1)], "account string, label_id string, name string, type string, updated_at bigint")
    names = M.replace_labels(old, new).groupBy("account").agg(F.map_from_entries(F.collect_list(F.struct("label_id", "name"))).alias("names"))
    m = V.messages(spark, d).join(few(names), "account", "left")
    shown = X.label_names(F.col("labels"), F.coalesce("names", F.create_map().cast("map<string,string>")))
    return m.select("account", F.explode(shown).alias("label")).groupBy("account", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def label_edit(spark: SparkSession, d: str) -> DataFrame:
    """H4, N5, I6"""
    m = V.Mail(spark, d).messages
    changes = m.where("starred").select("account", "message_id", F.array(F.lit("CATEGORY_SOCIAL")).alias("add"), F.array(F.lit("UNREAD"), F.lit("INBOX")).alias("remove"))
    out = M.apply_label_changes(m, changes)
    return out.select("message_id", F.array_join(F.array_sort("labels"), ",").alias("labels"), "category", "unread", "starred", "important")


@query
def inbox_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """J4, D9, H2, E13"""
    m = V.Mail(spark, d).messages
    k = F.col("message_id").cast("long")
    live = m.where((F.array_contains("labels", "INBOX") & (k % 3 > 0)) | (k % 10 == 1)).select("account", "message_id").unionByName(m.where(k % 50 == 0).select("account", F.concat(F.lit("new"), "message_id").alias("message_id")))
    changes = M.reconcile_inbox(m, live)
    after = M.apply_reconciled(m, changes).where(F.array_contains("labels", "INBOX")).groupBy("account").agg(F.count(F.lit(1)).alias("n")).select("account", F.lit("inbox after").alias("change"), "n")
    return changes.groupBy("account", "change").agg(F.count(F.lit(1)).alias("n")).unionByName(after)


@query
def upsert_no_downgrade(spark: SparkSession, d: str) -> DataFrame:
    """Bodies never go back; metadata follows the newest arrival"""
    m = V.messages(spark, d).select("account", "message_id", "subject", "unread", "body_state", "body_text")
    k = F.col("message_id").cast("long")
    new = m.where(k % 2 == 0).select("account", "message_id", F.lit("again").alias("subject"), (~F.col("unread")).alias("unread"), F.when(k % 4 == 0, "full").otherwise("meta").alias("body_state"), F.when(k % 4 == 0, "fetched").alias("body_text"))
    return M.upsert_messages(m, new)


@query
def enrich_candidates_direct(spark: SparkSession, d: str) -> DataFrame:
    """C11, G11"""
    return _shown(M.enrich_candidates(V.messages(spark, d), "direct", limit=100))


@query
def enrich_candidates_profile(spark: SparkSession, d: str) -> DataFrame:
    """C13, H3"""
    mail = V.Mail(spark, d)
    return _shown(M.profile_candidates(mail.messages, mail.scored, mail.domains))


@query
def compact_eligible(spark: SparkSession, d: str) -> DataFrame:
    """States before and after"""
    mail = V.Mail(spark, d)
    m = mail.messages
    gone = M.compact_eligible(m, mail.scored, mail.domains, mail.threads, V.NOW - 7 * V.DAY)
    return M.demote(m, gone).groupBy("account", "body_state").agg(F.count(F.lit(1)).alias("n"), F.count("body_text").alias("bodies"))


# -- people


def _people(rows: DataFrame) -> DataFrame:
    return rows.select("account", "address", "display_name", "msgs_received", "msgs_sent", "correspondent")


@query
def find_person(spark: SparkSession, d: str) -> DataFrame:
    """C20, G7"""
    mail = V.Mail(spark, d)
    return _people(P.find_person(mail.scored, "USER 1", 25))


@query
def list_contacts_engagement(spark: SparkSession, d: str) -> DataFrame:
    """G6, B5, C6"""
    mail = V.Mail(spark, d)
    return _people(P.list_contacts(mail.scored, "engagement", "important", 20))


@query
def list_contacts_volume(spark: SparkSession, d: str) -> DataFrame:
    """G6, B5"""
    mail = V.Mail(spark, d)
    return _people(P.list_contacts(mail.scored, "volume", None, 20))


@query
def list_contacts_recency(spark: SparkSession, d: str) -> DataFrame:
    """G6, B5"""
    mail = V.Mail(spark, d)
    return _people(P.list_contacts(mail.scored, "recency", None, 20))


@query
def correspondents(spark: SparkSession, d: str) -> DataFrame:
    """C5"""
    return V.contacts(spark, d).where("msgs_sent > 0").select("account", "address", "msgs_sent")


@query
def threads_for_contact(spark: SparkSession, d: str) -> DataFrame:
    """D15, G13"""
    t = V.threads(spark, d)
    return P.threads_of_contact(t, "me@a1.example.net", 20).select("account", "thread_id", "subject", "msg_count", "last_at")


@query
def threads_for_query(spark: SparkSession, d: str) -> DataFrame:
    """D16, L8"""
    mail = V.Mail(spark, d)
    m = mail.messages
    hits = mail.index(False).hits(S.parse("receipt", False, True, False))
    return P.threads_of_hits(mail.threads, m.join(hits, ["account", "message_id"], "left_semi"), 20).select("account", "thread_id", "msg_count", "last_at")


@query
def categorize_candidates(spark: SparkSession, d: str) -> DataFrame:
    """D13, N4, G10"""
    mail = V.Mail(spark, d)
    return P.domains_to_categorize(mail.contacts, mail.domains, limit=30).select("account", "domain", "correspondents", "msgs")


@query
def categorize_samples(spark: SparkSession, d: str) -> DataFrame:
    """D14, F5, B12"""
    mail = V.Mail(spark, d)
    c = mail.contacts
    some = P.domains_to_categorize(c, mail.domains, limit=30)
    return P.categorize_samples(some, c, mail.messages).select("account", "domain", "address", "rank", F.array_join("subjects", "|").alias("subjects"))


# -- search


@query
def search_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of all documents, built anew; its terms by how many documents hold them"""
    index = StoredIndex(Store(spark, scratch_path(spark, "index")), stemmed=False)
    index.rebuild(S.search_row(V.document_messages(spark, d)))
    return index.terms().orderBy(F.col("n").desc(), "term").limit(200)


@query
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Two prefix terms over the stored index of documents, unstemmed"""
    return S.search(V.document_messages(spark, d), V.document_index(spark, d), "thre ando", synonyms=False, limit=30, stemmed=False).select("account", "message_id", *_r("score"))


@query
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    """L3, L4: a term with punctuation is a phrase, its last word a prefix; hits of one account, statistics of all"""
    return S.search(V.document_messages(spark, d), V.document_index(spark, d), "licensed-under-the", synonyms=False, account="en", limit=20, stemmed=False).select("account", "message_id", *_r("score"))


@query
def search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole words, by block bounds: blocks with the highest first, then only those that reach the threshold"""
    phrases = S.parse("licensed worthless", False, False, False)
    hits = V.document_index(spark, d).search(phrases, 25, few_blocks=0, first_blocks=2).hits
    m = V.document_messages(spark, d).select("account", "message_id", "internal_date")
    return m.join(hits, ["account", "message_id"]).orderBy("score", F.col("internal_date").desc_nulls_last(), "message_id").limit(25).select("account", "message_id", *_r("score"))


@query
def search_updated(spark: SparkSession, d: str) -> DataFrame:
    """An index of subjects only, then the French bodies come and Spanish documents go; all hits"""
    m = V.document_messages(spark, d)
    index = StoredIndex(Store(spark, scratch_path(spark, "index")), stemmed=False)
    index.rebuild(S.search_row(m.withColumn("body_state", F.lit("meta"))))
    changed = m.where("account in ('fr', 'es')")
    index.update(S.search_row(m.where("account = 'fr'")), changed.select("account", "message_id"))
    return index.hits(S.parse("les the de", False, True, False)).select("account", "message_id", *_r("score"))


@query
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed, with synonyms; all hits"""
    mail = V.Mail(spark, d)
    return S.search(mail.messages, mail.index(), "flight receipt", synonyms=True, limit=None).select("account", "message_id", *_r("score"))


# -- graph


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """D8, E10, M3, M4, C15, I32"""
    mail = V.Mail(spark, d)
    return G.edges(G.participants(mail.threads, mail.contacts))


@query
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of one address, in every account"""
    mail = V.Mail(spark, d)
    c = mail.scored
    e = G.edges(G.participants(mail.threads, c))
    return G.neighbours(e, c, "u3@x.y.b3.com.au", 15).select("account", "address", "shared_threads", "msgs_sent")


@query
def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """M5: to convergence"""
    mail = V.Mail(spark, d)
    people = G.participants(mail.threads, mail.contacts)
    return G.pagerank(people.select("account", "address").distinct(), G.edges(people)).select("account", "address", *_r("centrality"))


@query
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """M6, E11, M7"""
    mail = V.Mail(spark, d)
    people = G.participants(mail.threads, mail.contacts)
    nodes, e = written(people.select("account", "address").distinct(), "nodes"), written(G.edges(people), "edges")
    found = G.with_metrics(mail.contacts, G.pagerank(nodes, e), G.communities(nodes, e))
    return G.community_overview(found).select("account", "community_id", "size", F.array_join("members", ",").alias("members"))


# -- text


@query
def address_parse(spark: SparkSession, d: str) -> DataFrame:
    """I1, I2, I3, I4"""
    m = V.messages(spark, d)
    a = X.extract_address(F.col("from_addr"))
    return m.select("message_id", a.alias("address"), X.display_name(F.col("from_addr")).alias("name"), X.host_of(a).alias("host"), F.size(X.recipient_addresses(F.col("to_addr"), F.col("cc_addr"))).alias("recipients"))


@query
def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    """I5 over page hosts"""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return V.table(spark, d, "pages").groupBy(X.registrable_domain(host).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Markup and white space only; entities stay"""
    return V.spread(V.table(spark, d, "pages"), "page_id").select("page_id", F.md5(H.normalize_whitespace(X.strip_invisibles(H.strip_markup(F.col("html"))))).alias("text_md5"))


@query
def distill_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole distillation with entities"""
    return V.spread(V.table(spark, d, "pages"), "page_id").select("page_id", F.length(H.distill(F.lit(None).cast("string"), F.col("html"))).alias("chars"))


@query
def deboilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Over documents with markers put in at line ends by id"""
    line = F.when(F.col("doc_id") % 3 == 0, "\n> quoted\nrest").when(F.col("doc_id") % 3 == 1, "\nTo unsubscribe click\nrest").otherwise("\n-- \nrest")
    return V.spread(V.table(spark, d, "documents"), "doc_id").select("doc_id", F.md5(H.deboilerplate(F.concat("text", line))).alias("text_md5"))


@query
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    """I16"""
    t = F.concat(F.replace("text", F.lit(" "), F.lit(" \t")), F.lit("\r\n\n\n\n end "))
    return V.spread(V.table(spark, d, "documents"), "doc_id").select("doc_id", F.md5(H.normalize_whitespace(t)).alias("text_md5"))


@query
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """B9, B1, B2"""
    return V.spread(V.table(spark, d, "documents"), "doc_id").select("doc_id", X.compact_snippet(F.col("text")).alias("snippet"), F.length(X.project_body(F.col("lang"), F.lit(""), F.col("source"))).alias("projected"))


@query
def meaningful_length(spark: SparkSession, d: str) -> DataFrame:
    """I21"""
    return V.spread(V.table(spark, d, "documents"), "doc_id").select("doc_id", H.meaningful_length(F.concat("text", F.lit("&nbsp; &#8203;x"))).alias("n"))


@query
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """B10"""
    ms = F.col("internal_date")
    return V.messages(spark, d).select("message_id", X.iso_millis(ms).alias("iso"), X.iso_day(ms, "?").alias("day"), X.iso_minute(ms).alias("minute"))


@query
def refs(spark: SparkSession, d: str) -> DataFrame:
    """B8, B4"""
    ref = X.message_ref(F.col("account"), F.col("thread_id"))
    return V.messages(spark, d).select("message_id", ref.alias("ref"), X.parse_ref(ref)["account"].alias("account"), X.parse_ref(ref)["id"].alias("id"))


_IMAGES = """<p><img src="https://x/pixel.gif" width=1 height="1"><a href="https://shop/sale"><img src="https://x/hero-sale.jpg" width="600" height='300' alt=" Summer ">
</a><img src="https://x/logo.png" width="120" height="40"><img src="https://x/rule.png" width="600" height="3"><a href="u"><img src="a.jpg" style="width: 250px; height:100px"></a>
<img src="a.jpg" width=300><img src="b.jpg" width="50px" height="60"><img src="plain.jpg"></p>"""


@query
def image_triage(spark: SparkSession, d: str) -> DataFrame:
    """A body with one image of each kind beside each page"""
    verdicts = H.classify_images(H.parse_images(F.concat(F.lit(_IMAGES), F.col("html"))))
    v = V.spread(V.table(spark, d, "pages"), "page_id").select("page_id", F.posexplode(verdicts).alias("n", "v"))
    return v.select("page_id", "n", "v.src", "v.width", "v.height", "v.alt", "v.linkedHref", "v.kind", "v.score")


@query
def image_candidates(spark: SparkSession, d: str) -> DataFrame:
    """G12, C19"""
    images = H.ocr_candidates(H.classify_images(H.parse_images(F.concat(F.lit(_IMAGES), F.col("html")))))
    return V.spread(V.table(spark, d, "pages"), "page_id").select("page_id", F.array_join(F.transform(images, lambda x: x["src"]), ",").alias("sources"), H.image_only(F.lit("short"), images).alias("image_only"))


@query
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """I24 by account"""
    mail = V.Mail(spark, d)
    s = mail.scored.withColumn("suggested", suggestion(F.col("engagement_score"), F.col("bulk_count") * 2 > F.col("msgs_received")))
    return s.groupBy("account", "suggested").agg(F.count(F.lit(1)).alias("n"))
