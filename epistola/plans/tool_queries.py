"""Queries of the tools, of provider payloads and of state changes, each with its DuckDB SQL. Docstrings name the operators that run."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..api import Index, Tools
from ..functions import html as H
from ..functions import text as X
from ..operators import curation as C
from ..operators import merge as M
from ..schemas import CONTACT_CURATION, DOMAIN_OVERLAY, INTEREST_PROFILE, LABELS, SUMMARIES
from ..sources import mail as S
from ..views import DAY, NOW, SQL_CONTACTS, SQL_DOMAINS, SQL_MESSAGES, SQL_RUNS, SQL_SCORED, SQL_THREADS
from .oracles import bm25_sql, GRAPH_SQL

QUERIES = {}
ORACLE_SQL = {}
_EDGES = GRAPH_SQL[len(SQL_CONTACTS) :]


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def _tools(spark: SparkSession, d: str, people: bool = True) -> tuple[V.Mail, Tools]:
    """people: whether the tool reads contacts, so that the engine's store should hold them."""
    mail = V.Mail(spark, d, hold_contacts=people)
    labels = spark.createDataFrame([("a0", "STARRED", "Kept", "system", 0), ("a1", "STARRED", "Marked", "system", 0)], LABELS)
    profile = spark.createDataFrame([(f"a{i}", [f"flight {i}", "signup invoice"], 0) for i in range(3)], INTEREST_PROFILE)
    domains = mail.domains.withColumns({"category_note": F.lit(None).cast("string"), "categorized_at": F.lit(None).cast("long")})
    return mail, Tools(spark, Index(mail.messages, mail.scored, domains, mail.threads, V.sync_runs(spark, d), labels, V.Opened(mail.index), profile), NOW)


def _first(mail: V.Mail):
    """The message of the smallest number."""
    return mail.messages.orderBy(F.col("message_id").cast("long")).select("account", "message_id", "thread_id", "from_addr").first()


_HIT = ("ref", "thread_id", "date", "subject", "category", "body_state", "has_summary", "unread")
_HIT_SQL = "account || ':' || message_id AS ref, thread_id, strftime(make_timestamp(internal_date * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS date, subject, category, body_state, summary_text IS NOT NULL AS has_summary, unread"
_PEOPLE = ("account", "address", "display_name", "msgs_received", "msgs_sent")


# -- tools


@query(f"WITH {SQL_MESSAGES} SELECT {_HIT_SQL} FROM msgs WHERE account = 'a1' AND starred ORDER BY internal_date DESC, message_id LIMIT 25")
def tool_list_labeled(spark: SparkSession, d: str) -> DataFrame:
    """O list_labeled, C1, C4: by name, within an account"""
    return _tools(spark, d)[1].list_labeled("marked", "a1", 25).select(*_HIT)


@query(f"WITH {SQL_MESSAGES} SELECT {_HIT_SQL}, CASE WHEN body_state = 'full' THEN body_text END AS body, summary_text AS summary, false AS \"needsOcr\" FROM msgs ORDER BY event_id LIMIT 1")
def tool_get_message(spark: SparkSession, d: str) -> DataFrame:
    """O get_message, B7, C1"""
    mail, tools = _tools(spark, d)
    r = _first(mail)
    return tools.get_message(f"{r['account']}:{r['message_id']}", "body").select(*_HIT, "body", "summary", "needsOcr")


@query(f"WITH {SQL_MESSAGES}, one AS (SELECT account, thread_id FROM msgs ORDER BY event_id LIMIT 1) SELECT {_HIT_SQL} FROM msgs SEMI JOIN one USING (account, thread_id)")
def tool_get_thread(spark: SparkSession, d: str) -> DataFrame:
    """O get_thread, B6"""
    mail, tools = _tools(spark, d)
    r = _first(mail)
    return tools.get_thread(f"{r['account']}:{r['thread_id']}")[1].select(*_HIT)


@query(f"WITH {SQL_SCORED} SELECT {', '.join(_PEOPLE)} FROM scored WHERE account = 'a2' AND msgs_sent > 0 ORDER BY last_seen DESC, address LIMIT 15")
def tool_list_contacts(spark: SparkSession, d: str) -> DataFrame:
    """O list_contacts, G6, B5, C6"""
    return _tools(spark, d)[1].list_contacts("a2", "recency", "correspondents", 15).select(*_PEOPLE)


@query(
    f"WITH {SQL_CONTACTS}, {SQL_THREADS}, c AS (SELECT account, address FROM contacts ORDER BY address, account LIMIT 1) "
    "SELECT t.account, address, thread_id, msg_count, last_at FROM threads t JOIN c ON c.account = t.account AND list_contains(t.participants, c.address) ORDER BY last_at DESC, thread_id LIMIT 10"
)
def tool_get_contact(spark: SparkSession, d: str) -> DataFrame:
    """O get_contact, D18, D15, G13: the first account that knows the address"""
    mail, tools = _tools(spark, d)
    address = mail.contacts.agg(F.min("address")).first()[0]
    found = tools.get_contact(address.upper())
    return found["threads"].join(found["contact"].select("account", "address"), "account").select("account", "address", "thread_id", "msg_count", "last_at")


@query(f"WITH {SQL_SCORED} SELECT {', '.join(_PEOPLE)} FROM scored WHERE account = 'a0' AND contains(lower(concat_ws(' ', display_name, address, domain)), 'b1') ORDER BY (msgs_sent > 0) DESC, engagement_score DESC NULLS LAST, address LIMIT 10")
def tool_find_person(spark: SparkSession, d: str) -> DataFrame:
    """O find_person, C20, G7"""
    return _tools(spark, d)[1].find_person("B1", "a0").select(*_PEOPLE)


@query(f"WITH {SQL_MESSAGES}, {SQL_THREADS} SELECT account, thread_id, subject, msg_count, unread_count, last_at FROM threads WHERE account = 'a0' AND list_contains(participants, 'me@a0.example.net') ORDER BY last_at DESC, thread_id LIMIT 12")
def tool_list_threads(spark: SparkSession, d: str) -> DataFrame:
    """O list_threads, D15, G13, B6"""
    return _tools(spark, d)[1].list_threads("ME@a0.example.net", account="a0", limit=12).select("account", "thread_id", "subject", "msg_count", "unread_count", "last_at")


_SINCE = NOW - 10 * DAY


@query(
    f"WITH {SQL_SCORED}, {SQL_DOMAINS}, {SQL_THREADS}, m AS (SELECT * FROM msgs WHERE account = 'a0' AND direction = 'received' AND internal_date >= {_SINCE}), "
    "i AS (SELECT 'important' AS feed, account, message_id, internal_date FROM m WHERE EXISTS (SELECT 1 FROM curated c WHERE c.account = m.account AND c.address = m.sender AND c.curation = 'important') OR EXISTS (SELECT 1 FROM domains d WHERE d.account = m.account AND d.domain = m.host AND d.curation = 'important') ORDER BY internal_date DESC, message_id LIMIT 25), "
    "t AS (SELECT 'threads' AS feed, m.account, message_id, internal_date FROM m JOIN threads t ON t.account = m.account AND t.thread_id = m.thread_id WHERE user_participated ORDER BY internal_date DESC, message_id LIMIT 25), "
    "k AS (SELECT 'keywords' AS feed, account, message_id, internal_date FROM msgs WHERE account = 'a0' AND internal_date >= " + str(_SINCE) + " AND (regexp_matches(lower(concat_ws(' ', snippet, body_text)), '\\bsignup invoice\\b') OR regexp_matches(lower(coalesce(body_text, '')), '\\bflight 0\\b')) ORDER BY internal_date DESC, message_id LIMIT 25) "
    "SELECT feed, account || ':' || message_id AS ref FROM i UNION ALL SELECT feed, account || ':' || message_id FROM t UNION ALL SELECT feed, account || ':' || message_id FROM k"
)
def tool_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """O catch_up, D2, D4, D5, G3, I26, L6: the three feeds of ten days"""
    feeds = _tools(spark, d)[1].catch_up("2024-01-22", "a0")
    return reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("feed"), "ref") for k, f in feeds.items()))


_MAIL_ROWS = f"{SQL_MESSAGES}, r AS (SELECT account, message_id, internal_date, subject, CASE WHEN direction = 'sent' THEN 'Me <' || sender || '>' ELSE user_name || ' <' || sender || '>' END AS sender, concat_ws(' ', CASE WHEN direction = 'sent' THEN user_name || ' <' || user_address || '>' ELSE 'Me <me@' || account || '.example.net>' END, cc_name || ' <' || cc_address || '>') AS recipients, concat_ws(' ', snippet, body_text, summary_text) AS body FROM msgs)"


def _starting(*stems: str) -> list[str]:
    return [f"len(list_filter({{t}}, lambda x: starts_with(x, '{s}')))" for s in stems]


@query("SELECT account || ':' || message_id AS ref FROM (" + bm25_sql(_MAIL_ROWS, _starting("purchas", "user"), "WHERE account = 'a1'", 15) + ")")
def tool_search(spark: SparkSession, d: str) -> DataFrame:
    """O search, D1, G1, L2, L3, L5, I28: one account's best hits over the stored index"""
    return _tools(spark, d, people=False)[1].search("purchases user", "a1").select("ref")


@query(
    f"WITH {SQL_MESSAGES}, x AS (SELECT *, (direction <> 'sent' AND event_id % 3 > 0) OR event_id % 10 = 1 AS live FROM msgs WHERE account = 'a0') SELECT account || ':' || message_id AS ref, "
    "(SELECT count(*) FILTER (direction <> 'sent' AND NOT live) FROM x) AS archived, (SELECT count(*) FILTER (direction = 'sent' AND live) FROM x) AS restored FROM x WHERE live ORDER BY internal_date DESC, message_id LIMIT 15"
)
def tool_refresh_inbox(spark: SparkSession, d: str) -> DataFrame:
    """O refresh_inbox, H2, J4, D9, C1: the provider's inbox differs from the index: some mail was archived there, some sent mail is in it"""
    mail, tools = _tools(spark, d)
    k = F.col("id").cast("long")
    rows = source_of(spark, d, "a0").rows
    there = ((~F.array_contains("labels", "SENT")) & (k % 3 > 0)) | (k % 10 == 1)
    provider = S.TableSource(rows.withColumn("labels", F.when(there, F.array_union("labels", F.array(F.lit("INBOX")))).otherwise(F.array_remove("labels", "INBOX"))), "me@a0.example.net")
    hits, info = Tools(spark, tools.ix, NOW, {"a0": provider}).refresh_inbox("a0")
    return hits.select("ref", F.lit(info["archived"]).cast("long").alias("archived"), F.lit(info["restored"]).cast("long").alias("restored"))


@query(
    f"WITH {SQL_SCORED}{_EDGES}, e AS (SELECT account, CASE WHEN a = 'u3@x.y.b3.com.au' THEN b ELSE a END AS address, weight FROM edges WHERE account = 'a0' AND 'u3@x.y.b3.com.au' IN (a, b)) "
    "SELECT account, address, display_name, weight AS shared_threads FROM e JOIN scored USING (account, address) ORDER BY weight DESC, engagement_score DESC NULLS LAST, address LIMIT 15"
)
def tool_graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """O graph_neighbors, D12, M8, G8: one account's"""
    return _tools(spark, d)[1].graph_neighbors("U3@x.y.b3.com.au".lower(), "a0")


@query(
    f"WITH {SQL_SCORED}, c AS (SELECT account, address, n % 3 AS community_id, msgs_received * 1e0 AS centrality FROM scored WHERE account = 'a1' AND n % 5 < 4), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY centrality DESC, address) AS r FROM c) "
    "SELECT community_id, count(*) AS size, string_agg(address, ',' ORDER BY r) FILTER (r <= 4) AS members FROM k GROUP BY 1"
)
def tool_graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """O graph_communities, E11: sizes and most central members of communities that are given"""
    _, tools = _tools(spark, d)
    n = F.regexp_extract("address", r"u(\d+)@", 1).try_cast("long")
    contacts = tools.ix.contacts.withColumn("community_id", F.when(n % 5 < 4, n % 3)).withColumn("centrality", F.col("msgs_received").cast("double"))
    found, hint = Tools(spark, replace(tools.ix, contacts=contacts), NOW).graph_communities("a1", 4)
    return found.select("community_id", "size", F.array_join("members", ",").alias("members"))


@query(
    f"WITH {SQL_SCORED}, {SQL_DOMAINS} SELECT 'contact' AS what, address AS name, curation FROM curated WHERE account = 'a2' AND curation IS NOT NULL UNION ALL SELECT 'domain', domain, curation FROM domains WHERE account = 'a2' AND curation IS NOT NULL "
    "UNION ALL SELECT 'keywords', 'flight 2|signup invoice', NULL"
)
def tool_interest_get(spark: SparkSession, d: str) -> DataFrame:
    """O interest_get, N1: what an account has curated"""
    contacts, domains, profile = _tools(spark, d)[1].interest_get("a2")
    rows = [contacts.select(F.lit("contact").alias("what"), F.col("address").alias("name"), "curation"), domains.select(F.lit("domain").alias("what"), F.col("domain").alias("name"), "curation")]
    return rows[0].unionByName(rows[1]).unionByName(profile.select(F.lit("keywords").alias("what"), F.array_join("keywords", "|").alias("name"), F.lit(None).cast("string").alias("curation")))


@query(
    f"WITH {SQL_SCORED} SELECT s.account, s.address, issues, d.unread, unsummarized FROM (SELECT account, sender AS address, count(*) AS issues, count(*) FILTER (unread) AS unread, count(*) FILTER (summary_text IS NULL) AS unsummarized FROM msgs "
    f"WHERE account = 'a1' AND direction = 'received' AND internal_date >= {NOW - 14 * DAY} AND (is_list OR category IN ('promotions', 'social', 'updates', 'forums')) GROUP BY 1, 2) d JOIN scored s USING (account, address) ORDER BY engagement_score DESC NULLS LAST, issues DESC, s.address LIMIT 20"
)
def tool_digest_sources(spark: SparkSession, d: str) -> DataFrame:
    """O digest_sources, D3, E5, G4, I26"""
    return _tools(spark, d)[1].digest_sources("a1", "2w").select("account", "address", "issues", "unread", "unsummarized")


@query(f"WITH {SQL_CONTACTS}, {SQL_DOMAINS} SELECT d.registrable_domain AS domain, max(d.category) AS category, count(*) AS msgs, count(DISTINCT sender) AS senders FROM msgs m JOIN domains d ON d.account = m.account AND d.domain = m.host WHERE direction = 'received' AND m.account = 'a2' AND internal_date >= {NOW - 14 * DAY} AND d.category = 'cat0' GROUP BY 1")
def tool_cadence(spark: SparkSession, d: str) -> DataFrame:
    """O cadence, E4, D6, C2, C3, I26"""
    return _tools(spark, d)[1].cadence("a2", "cat0", "14d").select("domain", "category", "msgs", "senders")


@query(
    f"WITH {SQL_MESSAGES}, {SQL_RUNS}, s AS (SELECT account, count(*) FILTER (body_state = 'meta') AS meta, count(*) FILTER (body_state = 'full') AS bodies FROM msgs GROUP BY 1), "
    "f AS (SELECT account, max(finished_at) FILTER (error IS NULL) AS as_of FROM runs GROUP BY 1) SELECT account, meta, bodies, as_of FROM s JOIN f USING (account)"
)
def tool_sync_status(spark: SparkSession, d: str) -> DataFrame:
    """O sync_status, E6, C17"""
    states, fresh = _tools(spark, d)[1].sync_status()
    return states.select("account", "meta", F.col("full").alias("bodies")).join(fresh.select("account", "as_of"), "account")


@query(
    f"WITH {SQL_SCORED}, p AS (SELECT account, address, floor(engagement_score * 100 + 0.5e0) / 100 AS score, curation FROM curated WHERE account = 'a1' ORDER BY engagement_score DESC, address LIMIT 10) SELECT account, address, score, curation FROM p"
)
def tool_interest_propose(spark: SparkSession, d: str) -> DataFrame:
    """O interest_propose, N2, G9, B11"""
    return _tools(spark, d)[1].interest_propose("a1", 10)[0].select("account", "address", "score", "curation")


_PICKED = "picked AS (SELECT account, address, row_number() OVER (ORDER BY address) AS k FROM contacts WHERE account = 'a0' ORDER BY address LIMIT 3)"


@query(
    f"WITH {SQL_SCORED}, {_PICKED}, after AS (SELECT c.account, c.address, CASE WHEN k = 1 THEN 'important' WHEN k = 2 THEN NULL WHEN k = 3 THEN 'muted' ELSE curation END AS curation FROM curated c LEFT JOIN picked USING (account, address)) "
    "SELECT 'contact' AS what, account, address AS name, curation, CAST(NULL AS BIGINT) AS skipped FROM after WHERE account = 'a0' AND curation IS NOT NULL UNION ALL SELECT 'keywords', 'a0', 'One|two', NULL, 1"
)
def tool_interest_set(spark: SparkSession, d: str) -> DataFrame:
    """O interest_set, N1, G14, H5, C1: labels set, cleared and skipped; keywords without repeats"""
    mail, tools = _tools(spark, d)
    names = [r["address"] for r in mail.contacts.where("account = 'a0'").orderBy("address").limit(3).collect()]
    out = tools.interest_set("a0", {**dict(zip(names, ("important", None, "muted"), strict=True)), "nobody@nowhere.org": "blocked"}, keywords=[" One", "two", "ONE", " "])
    contacts, _, profile = C.get_curation(out.contacts.where("account = 'a0'"), out.domains, out.profile)
    none = F.lit(None).cast("long")
    words = profile.where("account = 'a0'").select(F.lit("keywords").alias("what"), "account", F.array_join("keywords", "|").alias("name"), F.lit(None).cast("string").alias("curation"), F.lit(out.skipped).cast("long").alias("skipped"))
    return contacts.select(F.lit("contact").alias("what"), "account", F.col("address").alias("name"), "curation", none.alias("skipped")).unionByName(words)


@query(f"WITH {SQL_MESSAGES}, one AS (SELECT account, message_id FROM msgs ORDER BY event_id LIMIT 1) SELECT account, message_id, 'the new one' AS summary_text, true AS summary_is_model, CAST({NOW} AS BIGINT) AS summarized_at FROM one UNION ALL SELECT 'z', '1', 'kept', false, 7")
def tool_save_summary(spark: SparkSession, d: str) -> DataFrame:
    """O save_summary, N3"""
    mail, tools = _tools(spark, d)
    r = _first(mail)
    held = spark.createDataFrame([("z", "1", "kept", False, 7), (r["account"], r["message_id"], "old", False, 1)], SUMMARIES)
    return tools.save_summary(held, f"{r['account']}:{r['message_id']}", " the new one ")


@query(
    f"WITH {SQL_CONTACTS}, {SQL_DOMAINS}, one AS (SELECT account, domain FROM domains ORDER BY account, domain LIMIT 1) SELECT d.account, d.domain, curation, CASE WHEN o.domain IS NOT NULL THEN 'travel' ELSE category END AS category, 'n' || n AS category_note, CASE WHEN o.domain IS NOT NULL THEN {NOW} ELSE n END AS categorized_at "
    f"FROM domains d LEFT JOIN one o ON o.account = d.account AND o.domain = d.domain UNION ALL SELECT 'a9', 'new.org', NULL, 'news', 'first', {NOW}"
)
def tool_save_domain_category(spark: SparkSession, d: str) -> DataFrame:
    """O save_domain_category, N7: of the table's domains, one is filed anew; what isn't given stays, an unknown domain is entered"""
    mail, tools = _tools(spark, d)
    n = F.regexp_extract("domain", r"b(\d+)\.", 1).try_cast("long")
    held = mail.domains.select("account", "domain", "curation", "category", F.concat(F.lit("n"), n.cast("string")).alias("category_note"), n.alias("categorized_at"))
    r = held.orderBy("account", "domain").first()
    once = tools.save_domain_category(held, r["account"], f" {r['domain'].upper()}", "travel")
    return tools.save_domain_category(once, "a9", "new.org", "news", "first")


@query(f"WITH {SQL_CONTACTS}, {SQL_DOMAINS} SELECT c.account, c.domain, count(*) AS correspondents FROM contacts c JOIN domains d ON d.account = c.account AND d.domain = c.domain WHERE msgs_sent > 0 AND c.account = 'a1' GROUP BY 1, 2 ORDER BY 3 DESC, sum(msgs_received + msgs_sent) DESC, 2 LIMIT 20")
def tool_domains_to_categorize(spark: SparkSession, d: str) -> DataFrame:
    """O domains_to_categorize, D13, N4, G10: categorised ones included"""
    return _tools(spark, d)[1].domains_to_categorize("a1", True)[0].select("account", "domain", "correspondents")


@query(
    f"WITH {SQL_MESSAGES}, one AS (SELECT account AS oa, message_id AS om FROM msgs WHERE direction <> 'sent' AND unread ORDER BY event_id LIMIT 1), x AS (SELECT account, direction <> 'sent' AND NOT (account = oa AND message_id = om) AS inbox, starred OR (account = oa AND message_id = om) AS kept, unread FROM msgs, one) "
    "SELECT account, count(*) FILTER (inbox) AS inbox, count(*) FILTER (kept) AS kept, count(*) FILTER (unread) AS unread FROM x GROUP BY 1"
)
def tool_modify_labels(spark: SparkSession, d: str) -> DataFrame:
    """O modify_labels, O archive_message, H4, N5: the first unread message is starred and archived"""
    mail, tools = _tools(spark, d)
    r = mail.messages.where("direction <> 'sent' and unread").orderBy(F.col("message_id").cast("long")).select("account", "message_id").first()
    ref = f"{r['account']}:{r['message_id']}"
    after = tools.modify_labels(ref, add=["STARRED", " "]).archive_message(ref).ix.messages
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return after.groupBy("account").agg(count(F.array_contains("labels", "INBOX")).alias("inbox"), count(F.col("starred")).alias("kept"), count(F.col("unread")).alias("unread"))


# -- payloads, bodies and state


@query(
    f"WITH {SQL_MESSAGES} SELECT message_id AS id, sender AS \"from\", account AS extra, 'Text of ' || event_id || ' ü' AS \"bodyText\", CASE WHEN event_id % 3 = 0 THEN '<p>' || event_id || '</p>' END AS \"bodyHtml\", 'text/plain' AS \"mimeType\", CASE WHEN event_id % 5 > 0 THEN internal_date END AS \"internalDate\" FROM msgs"
)
def provider_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as JSON, their parts nested up to ten deep"""
    m = V.messages(spark, d)
    k = F.col("message_id").cast("long")
    code = lambda t: F.translate(F.base64(F.encode(t, "UTF-8")), "+/=", "-_")
    leaf = lambda kind, t: F.concat(F.lit(f'{{"mimeType":"{kind}","body":{{"data":"'), code(t), F.lit('"}}'))
    depth = (k % 10).cast("int")
    inner = F.concat(F.repeat(F.lit('{"mimeType":"multipart/mixed","parts":[{"mimeType":"text/plain","body":{}},'), depth), leaf("text/plain", F.concat(F.lit("Text of "), "message_id", F.lit(" ü"))), F.repeat(F.lit("]}"), depth))
    html = F.when(k % 3 == 0, F.concat(F.lit(","), leaf("text/html", F.concat(F.lit("<p>"), "message_id", F.lit("</p>"))))).otherwise("")
    headers = F.concat(F.lit('[{"name":"FROM","value":"'), X.extract_address(F.col("from_addr")), F.lit('"},{"name":"X-A","value":"old"},{"name":"X-A","value":"'), "account", F.lit('"}]'))
    payload = F.concat(F.lit('{"mimeType":"multipart/alternative","headers":'), headers, F.lit(',"parts":['), inner, html, F.lit("]}"))
    when = F.when(k % 5 > 0, F.col("internal_date").cast("string")).otherwise("")
    raw = m.select(F.col("message_id").alias("id"), F.col("thread_id").alias("threadId"), "snippet", when.alias("internalDate"), F.col("labels").alias("labelIds"), F.lit(1).cast("long").alias("sizeEstimate"), payload.alias("payload"))
    full = S.to_full(raw)
    return full.select("id", "from", F.col("headers")["X-A"].alias("extra"), "bodyText", "bodyHtml", "mimeType", "internalDate")


def source_of(spark: SparkSession, d: str, account: str) -> S.TableSource:
    m = V.raw_messages(spark, d).where(F.col("account") == account)
    none = F.lit(None).cast("string")
    rows = m.select(
        F.col("message_id").alias("id"), F.col("thread_id").alias("threadId"), F.col("internal_date").alias("internalDate"), none.alias("dateHeader"), F.col("from_addr").alias("from"), F.col("to_addr").alias("to"), F.col("cc_addr").alias("cc"),
        "subject", "labels", "snippet", F.col("size_estimate").alias("sizeEstimate"), "headers", none.alias("bodyText"), none.alias("bodyHtml"), none.alias("mimeType"),
    )
    return S.TableSource(rows, f"me@{account}.example.net")


@query(
    f"WITH {SQL_MESSAGES} SELECT account, message_id, 'full' AS body_state, 'Body ' || message_id || chr(10) || 'end' AS body_text, unread, category FROM msgs WHERE body_state = 'meta' AND NOT (is_list OR coalesce(category = 'promotions', false)) AND event_id % 2 = 0"
)
def promote_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the direct rule, whose bodies half are there, distilled"""
    m = V.Mail(spark, d).messages.withColumn("body_html", F.lit(None).cast("string"))
    ids = M.enrich_candidates(m, "direct")
    has = m.where(F.col("message_id").cast("long") % 2 == 0)
    bodies = has.select("account", "message_id", F.concat(F.lit("Body  "), "message_id", F.lit("\r\n> quoted\r\nend \n--\nme")).alias("body_text"), F.lit("<p>x</p>").alias("body_html"))
    return M.promote(m, bodies, ids).select("account", "message_id", "body_state", "body_text", "unread", "category")


@query(f"WITH {SQL_MESSAGES}, one AS (SELECT user_address AS a FROM msgs WHERE direction = 'received' ORDER BY event_id LIMIT 1) SELECT account, message_id FROM msgs, one WHERE body_state = 'meta' AND sender = a AND contains(coalesce(subject, ''), 'Re:') AND event_id % 3 < 2")
def enrich_candidates_all(spark: SparkSession, d: str) -> DataFrame:
    """Sender, matches and state together"""
    m = V.Mail(spark, d).messages
    sender = m.where("direction = 'received'").orderBy(F.col("message_id").cast("long")).select(X.extract_address(F.col("from_addr"))).first()[0]
    found = m.where(F.contains("subject", F.lit("Re:")) & (F.col("message_id").cast("long") % 3 < 2))
    return M.enrich_candidates(m, "all", sender.upper(), found).select("account", "message_id")


@query(f"WITH {SQL_CONTACTS} SELECT account, address, msgs_received, CASE WHEN msgs_sent > 0 THEN 'muted' END AS curation FROM contacts UNION ALL SELECT 'a9', 'gone@x.org', NULL, 'important'")
def curation_survives_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows are new, what users own stays, also of contacts that vanished"""
    c = V.Mail(spark, d).contacts
    own = c.where("msgs_sent > 0").select("account", "address", F.lit("muted").alias("curation")).unionByName(spark.createDataFrame([("a9", "gone@x.org", "important")], CONTACT_CURATION))
    return C.with_overlay(c, own, ["account", "address"], keep_orphans=True).select("account", "address", "msgs_received", "curation")


@query(
    f"WITH {SQL_SCORED}, s AS (SELECT account, address, CASE WHEN engagement_score >= 2e0 THEN 'important' WHEN bulk_count * 2 > msgs_received OR engagement_score <= -0.5e0 THEN 'muted' ELSE 'none' END AS suggested, n FROM scored), "
    "d AS (SELECT account, address, CASE n % 4 WHEN 0 THEN suggested WHEN 1 THEN 'important' WHEN 2 THEN 'blocked' ELSE NULL END AS curation FROM s WHERE n % 5 < 4) SELECT * FROM d WHERE curation IS NULL OR curation IN ('important', 'muted', 'blocked')"
)
def curation_answers(spark: SparkSession, d: str) -> DataFrame:
    """Blank takes the suggestion; letters and words; anything else keeps"""
    from ..functions.scoring import suggestion

    s = V.Mail(spark, d).scored.withColumn("suggested", suggestion(F.col("engagement_score"), F.col("bulk_count") * 2 > F.col("msgs_received")))
    n = F.regexp_extract("address", r"u(\d+)@", 1).try_cast("long")
    answers = s.where(n % 5 < 4).select("account", "address", n.alias("n"), F.when(n % 4 == 0, " ").when(n % 4 == 1, "I").when(n % 4 == 2, "blocked").otherwise("k").alias("answer"))
    return C.apply_decisions(answers, s)


# -- text


@query("SELECT doc_id, md5(text) AS text_md5, true AS coded FROM documents WHERE text <> ''")
def quoted_printable(spark: SparkSession, d: str) -> DataFrame:
    """Coded here, decoded by the operator"""
    t = F.replace(F.replace(F.col("text"), F.lit("="), F.lit("=3D")), F.lit("é"), F.lit("=C3=A9"))
    coded = F.concat(F.lit("=\r\n"), F.replace(F.replace(t, F.lit("ü"), F.lit("=c3=bc")), F.lit("e"), F.lit("=65=\n")))
    return V.table(spark, d, "documents").where("text <> ''").select("doc_id", F.md5(H.decode_quoted_printable(coded)).alias("text_md5"), H.looks_quoted_printable(coded).alias("coded"))


@query("SELECT doc_id, md5(text || ' € — x') AS text_md5, md5(replace(text, 'a', '&#97;')) AS padded_md5 FROM documents")
def entities(spark: SparkSession, d: str) -> DataFrame:
    """Coded here as decimal, hexadecimal and named, decoded by the operator; padding goes, visible entities stay"""
    t = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    coded = F.concat(F.replace(F.replace(t, F.lit("o"), F.lit("&#000000000111;")), F.lit("e"), F.lit("&#X65;")), F.lit(" &Euro; &mdash; &#x78;&zwnj;&#8203;"))
    padded = F.concat(F.lit("&shy;&#x200b;"), F.replace(F.col("text"), F.lit("a"), F.lit("&#97;")), F.lit("&#0173;"))
    return V.table(spark, d, "documents").select("doc_id", F.md5(H.decode_entities(coded)).alias("text_md5"), F.md5(H.strip_padding_entities(padded)).alias("padded_md5"))


@query(f"WITH {SQL_MESSAGES} SELECT message_id, CASE WHEN k % 3 > 0 THEN 'https://m.example.org/' || message_id ELSE 'https://mail.example.com/#all/' || message_id END AS url, CASE WHEN k % 2 = 0 THEN account || '|' || thread_id ELSE '' END AS labels FROM msgs")
def urls_and_json(spark: SparkSession, d: str) -> DataFrame:
    """Stored or built addresses; arrays from JSON, anything else being empty"""
    k = F.regexp_extract("body", r"k=(\d+)", 1).cast("long")
    m = V.raw_messages(spark, d).withColumn("body", F.concat(F.lit("k="), ((F.col("summarized_at") - F.lit(NOW - 20 * DAY)) / (DAY // 4)).cast("long").cast("string")))
    url = F.when(k % 3 == 1, F.concat(F.lit("https://m.example.org/"), "message_id")).when(k % 3 == 2, F.concat(F.lit("https://m.example.org/"), "message_id")).otherwise("")
    raw = F.when(k % 2 == 0, F.to_json(F.array("account", "thread_id"))).otherwise('{"not": "an array"')
    return m.select("message_id", X.provider_url(url, F.col("message_id"), "https://mail.example.com/#all/").alias("url"), F.array_join(X.json_strings(raw), "|").alias("labels"))


def _tag() -> object:
    """An image whose name, size, link and text vary with the page."""
    n, pid = F.col("page_id") % 7, F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, ("photo", "hero", "logo", "spacer", "pic&#38;x", "pic&#x2F;deal", "plain"))), (n + 1).cast("int"))
    size = lambda c, v: F.concat(F.lit(f' {c}="'), v.cast("string"), F.when(pid % 2 == 0, "px").otherwise(""), F.lit('"'))
    image = F.concat(F.lit("<img src='https://i.example.com/"), name, F.lit("-"), pid.cast("string"), F.lit(".jpg'"), F.when(pid % 5 > 0, F.concat(size("width", pid * 37 % 900), size("height", pid * 11 % 400))).otherwise(""), F.when(pid % 3 == 0, F.lit(' alt="A &amp; B"')).otherwise(""), F.lit(">"))
    return F.when(pid % 4 == 0, F.concat(F.lit('<a href="https://shop.example.com/&#63;">'), image, F.lit("</a>"))).otherwise(image)


_IMAGE_SQL = """i AS (SELECT page_id, ['photo', 'hero', 'logo', 'spacer', 'pic&x', 'pic/deal', 'plain'][page_id % 7 + 1] AS name, CASE WHEN page_id % 5 > 0 THEN page_id * 37 % 900 END AS w, CASE WHEN page_id % 5 > 0 THEN page_id * 11 % 400 END AS h, page_id % 3 = 0 AS has_alt, page_id % 4 = 0 AS linked FROM pages),
j AS (SELECT *, name IN ('hero', 'pic/deal') AS named, least(w, h) AS lo, greatest(w, h) AS hi FROM i),
v AS (SELECT *, CASE WHEN w <= 2 OR h <= 2 OR w * h <= 16 THEN 'pixel' WHEN name = 'spacer' THEN 'spacer' WHEN lo <= 6 AND hi / lo >= 20 THEN 'divider' WHEN name = 'logo' THEN 'icon' WHEN hi <= 64 THEN 'icon' WHEN coalesce(hi >= 200, false) OR named OR (linked AND coalesce(hi >= 64, false)) THEN 'content' ELSE 'unknown' END AS kind FROM j),
s AS (SELECT *, 'https://i.example.com/' || name || '-' || page_id || '.jpg' AS src, CASE WHEN kind = 'content' THEN floor(coalesce(least(w * h, 1e6) / 1000e0, 50e0) + CASE WHEN named THEN 300 ELSE 0 END + CASE WHEN has_alt THEN 40 ELSE 0 END + CASE WHEN linked THEN 60 ELSE 0 END + 0.5e0) ELSE 0 END AS score FROM v)"""


@query(
    f"WITH {_IMAGE_SQL} SELECT page_id, src, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CASE WHEN has_alt THEN 'A & B' END AS alt, CASE WHEN linked THEN 'https://shop.example.com/?' END AS link, kind, CAST(score AS INTEGER) AS score FROM s"
)
def images_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """An image for each page, of every size, name, link and text"""
    v = V.table(spark, d, "pages").select("page_id", F.explode(H.classify_images(H.parse_images(_tag()))).alias("v"))
    return v.select("page_id", "v.src", "v.width", "v.height", "v.alt", F.col("v.linkedHref").alias("link"), "v.kind", "v.score")


@query(f"WITH {_IMAGE_SQL} SELECT page_id, CASE WHEN kind = 'content' THEN src ELSE '' END AS sources, kind = 'content' AS image_only FROM s")
def image_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for text recognition"""
    images = H.ocr_candidates(H.classify_images(H.parse_images(_tag())))
    return V.table(spark, d, "pages").select("page_id", F.array_join(F.transform(images, lambda x: x["src"]), ",").alias("sources"), H.image_only(F.lit("short"), images).alias("image_only"))
