"""DuckDB SQL for the library's own queries, written from their definitions."""

from __future__ import annotations

from ..operators.graph import DAMPING, ROUNDS, TOLERANCE
from ..operators.search import B, IDF_FLOOR, K1
from ..views import DAY, NOW, SQL_CONTACTS, SQL_DOMAINS, SQL_MESSAGES, SQL_RUNS, SQL_SCORED, SQL_THREADS
from .queries import _IMAGES, SINCE

_REG = "CASE WHEN regexp_matches({h}, '\\.(co\\.uk|com\\.au)$') THEN regexp_extract({h}, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) END"
_SHOWN = "account, message_id, thread_id, internal_date"
_RATE = f"round(count(*) * {{n}}e0 / greatest(1e0, (max(internal_date) - min(internal_date)) / {DAY}e0), 6)"
_ROUND2 = "floor({x} * 100 + 0.5e0) / 100"


def _suggested(score: str, mostly: str) -> str:
    return f"CASE WHEN {score} >= 2e0 THEN 'important' WHEN {mostly} OR {score} <= -0.5e0 THEN 'muted' ELSE 'none' END"


def _cut(c: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(rows: str, phrases: list[str], where: str = "", limit: int | None = 30, order: str = "internal_date DESC") -> str:
    """rows: a CTE r (account, message_id, internal_date, subject, sender, recipients, body). phrases: SQL over lists of tokens t, giving the number of places."""
    cut = _cut
    count = lambda p, c: p.replace("{t}", c)
    parts = " UNION ALL ".join(
        f"SELECT account, message_id, internal_date, d, {i} AS phrase, 10e0 * {count(p, 't1')} + 8e0 * {count(p, 't2')} + 4e0 * {count(p, 't3')} + 1e0 * {count(p, 't4')} AS f FROM toks" for i, p in enumerate(phrases)
    )
    return f"""WITH {rows},
    toks0 AS (SELECT account, message_id, internal_date, {cut("subject")} AS t1, {cut("sender")} AS t2, {cut("recipients")} AS t3, {cut("body")} AS t4 FROM r),
    toks AS (SELECT *, len(t1) + len(t2) + len(t3) + len(t4) AS d FROM toks0),
    stats AS (SELECT count(*) AS n, avg(d) AS avgdl FROM toks WHERE d > 0),
    hit AS (SELECT * FROM ({parts}) WHERE f > 0),
    freq AS (SELECT phrase, count(*) AS n_i FROM hit GROUP BY 1),
    scored AS (SELECT account, message_id, internal_date, -sum(greatest(ln((n - n_i + 0.5e0) / (n_i + 0.5e0)), {IDF_FLOOR}) * f * {K1 + 1}e0 / (f + {K1}e0 * ({1 - B}e0 + {B}e0 * d / avgdl))) AS score FROM hit JOIN freq USING (phrase), stats GROUP BY 1, 2, 3)
    SELECT account, message_id, round(score, 6) AS score FROM scored {where} ORDER BY score, {order}, message_id{f" LIMIT {limit}" if limit else ""}"""


_DOC_ROWS = "r AS (SELECT lang AS account, CAST(doc_id AS VARCHAR) AS message_id, doc_id AS internal_date, string_split(text, chr(10))[1] AS subject, source AS sender, NULL AS recipients, text AS body FROM documents)"
_PREFIX = "len(list_filter({{t}}, lambda x: starts_with(x, '{p}')))"
_TRIM = "regexp_replace(regexp_replace({x}, '^[\\s\\x{{A0}}]+', ''), '[\\s\\x{{A0}}]+$', '')"
_COLLAPSED = "regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')"
_UNSEEN = "'[\\x{AD}\\x{34F}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]'"
# The markers of deboilerplate, as one expression.
_STOPS = (
    "(?i)^\\s*on\\b.*\\bwrote:\\s*$|^\\s*-{2,}\\s*original message\\s*-{2,}\\s*$|^\\s*from:\\s.+$|^--\\s*$|\\bunsubscribe\\b|\\bupdate (your )?(email )?preferences\\b|"
    "\\bmanage (your )?(email )?(subscription|preferences)\\b|\\bview (this email )?in (your )?browser\\b|\\byou (are )?receiv(e|ing) this (email|message)\\b|\\bsent to you by\\b|^\\s*©\\s*\\d{4}\\b|\\ball rights reserved\\b"
)
_NORMAL = (
    "regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{A0}}]+', ' ', 'g'), chr(10)), "
    "lambda l: regexp_replace(regexp_replace(l, '^[\\s\\x{{A0}}]+', ''), '[\\s\\x{{A0}}]+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x{{A0}}]+', ''), '[\\s\\x{{A0}}]+$', '')"
)
_MARKUP = "html"
for _p, _to in (
    ("<!--.*?-->", "' '"), ("<script\\b[^>]*>.*?</script>", "' '"), ("<style\\b[^>]*>.*?</style>", "' '"), ("<head\\b[^>]*>.*?</head>", "' '"), ("<title\\b[^>]*>.*?</title>", "' '"),
    ("<\\s*br\\s*/?\\s*>", "chr(10)"), ("<\\s*/\\s*(p|div|tr|li|h[1-6]|table|ul|ol|blockquote|section|article|header|footer)\\s*>", "chr(10)"),
    ("<\\s*(p|div|tr|li|h[1-6]|table|ul|ol|blockquote|section|article|header|footer)\\b[^>]*>", "chr(10)"), ("<[^>]+>", "''"),
):
    _MARKUP = f"regexp_replace({_MARKUP}, '{_p}', {_to}, 'gis')"

# The images of the fixed body beside each page; the pages themselves have none.
_TRIAGED = """(0, 'https://x/pixel.gif', 1, 1, NULL, NULL, 'pixel', 0), (1, 'https://x/hero-sale.jpg', 600, 300, 'Summer', 'https://shop/sale', 'content', 580), (2, 'https://x/logo.png', 120, 40, NULL, NULL, 'icon', 0),
(3, 'https://x/rule.png', 600, 3, NULL, NULL, 'divider', 0), (4, 'a.jpg', 250, 100, NULL, 'u', 'content', 85), (5, 'a.jpg', 300, NULL, NULL, NULL, 'unknown', 0), (6, 'b.jpg', 50, 60, NULL, NULL, 'icon', 0), (7, 'plain.jpg', NULL, NULL, NULL, NULL, 'unknown', 0)"""
assert _IMAGES.count("<img") == 8

_BULK = "(is_list OR coalesce(category = 'promotions', false))"
GRAPH_SQL = f"""{SQL_CONTACTS}, {SQL_THREADS},
members AS (SELECT DISTINCT t.account, t.thread_id, p.address FROM (SELECT account, thread_id, unnest(participants) AS address FROM threads WHERE NOT any_list) p JOIN threads t USING (account, thread_id) JOIN contacts c ON c.account = t.account AND c.address = p.address),
edges AS (SELECT x.account, x.address AS a, y.address AS b, count(*) AS weight FROM members x JOIN members y ON x.account = y.account AND x.thread_id = y.thread_id AND x.address < y.address GROUP BY 1, 2, 3)"""


_PAGERANK = f"""WITH RECURSIVE {GRAPH_SQL},
    nodes AS (SELECT account, address, count(*) OVER (PARTITION BY account) AS n FROM (SELECT DISTINCT account, address FROM members)),
    arcs0 AS (SELECT account, a AS src, b AS dst, weight FROM edges UNION ALL SELECT account, b, a, weight FROM edges),
    outs AS (SELECT account, src, sum(weight) AS o FROM arcs0 GROUP BY 1, 2),
    arcs AS (SELECT account, src, dst, weight / o AS share FROM arcs0 JOIN outs USING (account, src)),
    walk AS (SELECT account, address, n, 1e0 / n AS r, 0 AS round, true AS moving FROM nodes
      UNION ALL SELECT account, address, n, new, round + 1, sum(abs(new - r)) OVER (PARTITION BY account) >= n * {TOLERANCE} FROM (
        SELECT w.account, w.address, w.n, w.r, w.round, {1 - DAMPING}e0 / w.n + {DAMPING}e0 * (coalesce(got, 0) + loose / w.n) AS new FROM walk w
        LEFT JOIN (SELECT x.account, dst AS address, sum(r * share) AS got FROM arcs x JOIN walk y ON y.account = x.account AND y.address = x.src GROUP BY 1, 2) g ON g.account = w.account AND g.address = w.address
        JOIN (SELECT z.account, coalesce(sum(r) FILTER (o IS NULL), 0) AS loose FROM walk z LEFT JOIN outs ON outs.account = z.account AND outs.src = z.address GROUP BY 1) l ON l.account = w.account
        WHERE w.moving AND w.round < {ROUNDS}))
    SELECT account, address, round(arg_max(r, round), 6) AS centrality FROM walk GROUP BY 1, 2"""


_DOC = "account, address, display_name, msgs_received, msgs_sent, msgs_sent > 0 AS correspondent"

ORACLE_SQL = {
    "cadence_by_brand": f"WITH {SQL_MESSAGES} SELECT account, {_REG.format(h='host')} AS domain, count(*) AS msgs, count(DISTINCT sender) AS senders, min(internal_date) AS first_at, max(internal_date) AS last_at, {_RATE.format(n=7)} AS per_week, {_RATE.format(n=30)} AS per_month FROM msgs WHERE direction = 'received' GROUP BY 1, 2",
    "cadence_by_category": f"WITH {SQL_CONTACTS}, {SQL_DOMAINS}, m AS (SELECT msgs.*, d.category AS cat, d.registrable_domain AS reg FROM msgs LEFT JOIN domains d ON d.account = msgs.account AND d.domain = msgs.host WHERE direction = 'received' AND internal_date >= {SINCE}) "
    f"SELECT account, reg AS domain, max(cat) AS category, count(*) AS msgs, count(DISTINCT sender) AS senders, {_RATE.format(n=7)} AS per_week, {_RATE.format(n=30)} AS per_month FROM m WHERE cat = 'cat2' GROUP BY 1, 2",
    "contact_rollup": f"WITH {SQL_CONTACTS} SELECT * FROM contacts",
    "domain_rollup": f"WITH {SQL_CONTACTS}, {SQL_DOMAINS} SELECT account, domain, msgs, distinct_contacts, registrable_domain FROM domains",
    "thread_rollup": f"WITH {SQL_MESSAGES}, {SQL_THREADS} SELECT account, thread_id, subject, array_to_string(participants, ',') AS participants, msg_count, unread_count, user_participated, any_list, first_at, last_at FROM threads",
    "reply_initiate": """WITH m AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || turn AS id, role, 'c' || (conv_id % 50) || '@mail.example.com' AS address, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CAST(conv_id AS VARCHAR) || '-' || turn) AS rn,
      coalesce(max(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, CAST(conv_id AS VARCHAR) || '-' || turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM conversations)
      SELECT address, count(*) FILTER (role <> 'assistant') AS msgs_received, count(*) FILTER (role = 'assistant') AS msgs_sent, count(*) FILTER (role = 'assistant' AND earlier = 1) AS replied_count, count(*) FILTER (role = 'assistant' AND earlier = 0 AND rn = 1) AS initiated_count FROM m GROUP BY 1""",
    "engagement_scores": f"WITH {SQL_SCORED} SELECT account, address, bulk_count, round(engagement_score, 6) AS engagement_score FROM scored",
    "snapshot_trend": f"WITH {SQL_SCORED}, later AS (SELECT *, engagement_score + 0.5e0 * (power(2e0, -(({NOW + 30 * DAY} - last_seen) / 86400000e0) / 60e0) - power(2e0, -(({NOW} - last_seen) / 86400000e0) / 60e0)) * (msgs_received + msgs_sent) / (msgs_received + msgs_sent + 10e0) AS s2 FROM scored) "
    f"SELECT account, address, {NOW} AS taken_at, round(engagement_score, 6) AS engagement_score, NULL AS change FROM later UNION ALL SELECT account, address, {NOW + 30 * DAY}, round(s2, 6), round(s2 - engagement_score, 6) FROM later",
    "curation_proposal": f"WITH {SQL_SCORED} SELECT account, address, display_name, domain, {_ROUND2.format(x='engagement_score')} AS score, msgs_received, CASE WHEN msgs_received > 0 THEN {_ROUND2.format(x='(read_count * 1e0 / msgs_received)')} END AS read_rate, bulk_count * 2 > msgs_received AS is_list, {_suggested('engagement_score', 'bulk_count * 2 > msgs_received')} AS suggested FROM scored ORDER BY engagement_score DESC, account, address LIMIT 50",
    "curation_proposal_domains": f"WITH {SQL_SCORED}, g AS (SELECT account, domain, count(*) AS contacts, avg(engagement_score) AS s, sum(msgs_received) AS r, sum(read_count) AS rd, sum(bulk_count) AS b FROM scored GROUP BY 1, 2) "
    f"SELECT account, domain, contacts, {_ROUND2.format(x='s')} AS score, CASE WHEN r > 0 THEN {_ROUND2.format(x='(rd * 1e0 / r)')} END AS read_rate, b * 2 > r AS is_list, {_suggested('s', 'b * 2 > r')} AS suggested FROM g ORDER BY s DESC, account, domain LIMIT 50",
    "digest_sources": f"WITH {SQL_SCORED} SELECT s.account, s.address, display_name, issues, d.unread, unsummarized, round(engagement_score, 6) AS engagement_score FROM (SELECT account, sender AS address, count(*) AS issues, count(*) FILTER (unread) AS unread, count(*) FILTER (summary_text IS NULL) AS unsummarized FROM msgs WHERE direction = 'received' AND internal_date >= {SINCE} AND (is_list OR category IN ('promotions', 'social', 'updates', 'forums')) GROUP BY 1, 2) d JOIN scored s ON s.account = d.account AND s.address = d.address ORDER BY s.engagement_score DESC NULLS LAST, issues DESC, s.address, s.account LIMIT 20",
    "catch_up_important": f"WITH {SQL_SCORED}, {SQL_DOMAINS} SELECT {_SHOWN} FROM msgs m WHERE direction = 'received' AND internal_date >= {SINCE} AND (EXISTS (SELECT 1 FROM curated c WHERE c.account = m.account AND c.address = m.sender AND c.curation = 'important') OR EXISTS (SELECT 1 FROM domains d WHERE d.account = m.account AND d.domain = m.host AND d.curation = 'important')) ORDER BY internal_date DESC, message_id LIMIT 50",
    "catch_up_threads": f"WITH {SQL_MESSAGES}, {SQL_THREADS} SELECT m.account, message_id, m.thread_id, internal_date FROM msgs m JOIN threads t ON t.account = m.account AND t.thread_id = m.thread_id WHERE user_participated AND direction = 'received' AND internal_date >= {SINCE} ORDER BY internal_date DESC, message_id LIMIT 50",
    "catch_up_keywords": f"WITH {SQL_MESSAGES} SELECT {_SHOWN} FROM msgs WHERE internal_date >= {SINCE} AND (regexp_matches(lower(concat_ws(' ', snippet, body_text)), '\\bsignup invoice\\b') OR regexp_matches(lower(coalesce(body_text, '')), '\\bflight 7\\b')) ORDER BY internal_date DESC, message_id LIMIT 40",
    "status_body_states": f"WITH {SQL_MESSAGES} SELECT account, count(*) FILTER (body_state = 'meta') AS meta, count(*) FILTER (body_state = 'full') AS \"full\", count(*) FILTER (body_state = 'summary-only') AS summary_only FROM msgs GROUP BY 1",
    "status_totals": f"WITH {SQL_MESSAGES} SELECT account, count(*) AS messages FROM msgs GROUP BY 1 UNION ALL SELECT '*', count(*) FROM msgs",
    "index_as_of": f"WITH {SQL_RUNS}, a AS (SELECT account, max(finished_at) AS as_of FROM runs WHERE finished_at IS NOT NULL AND error IS NULL GROUP BY 1), b AS (SELECT * FROM a UNION ALL SELECT '*', min(as_of) FROM a) SELECT account, as_of, strftime(make_timestamp(as_of * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM b",
    "freshness": f"WITH {SQL_RUNS}, g AS (SELECT account, max(finished_at) FILTER (error IS NULL) AS as_of, bool_or(finished_at IS NULL AND started_at >= {NOW - 6 * 3_600_000}) AS syncing FROM runs GROUP BY 1) SELECT account, as_of, syncing, {NOW} - as_of AS age_ms, coalesce({NOW} - as_of > {3 * 3_600_000}, true) AS stale, CAST(ceil(({NOW} - as_of) / {DAY}e0) + 1 AS BIGINT) AS since_days FROM g",
    "completed_syncs": f"WITH {SQL_RUNS} SELECT account, count(*) AS completed FROM runs WHERE phase = 'sync' AND finished_at IS NOT NULL AND error IS NULL GROUP BY 1",
    "accounts_union": f"WITH {SQL_MESSAGES}, {SQL_RUNS} SELECT account FROM msgs UNION SELECT account FROM runs",
    "classify_messages": f"WITH {SQL_MESSAGES} SELECT account, category, is_list, direction, unread, starred, important, is_list OR coalesce(category IN ('promotions', 'social', 'updates', 'forums'), false) AS bulk, count(*) AS n FROM msgs GROUP BY ALL",
    "label_membership": f"WITH {SQL_MESSAGES} SELECT {_SHOWN} FROM msgs WHERE starred ORDER BY internal_date DESC, message_id LIMIT 30",
    "label_names": f"""WITH {SQL_MESSAGES}, l AS (SELECT account, unnest(list_filter([CASE WHEN direction = 'sent' THEN 'SENT' ELSE 'INBOX' END, CASE event_type WHEN 'view' THEN 'CATEGORY_UPDATES' WHEN 'click' THEN 'CATEGORY_PROMOTIONS' WHEN 'signup' THEN 'CATEGORY_PERSONAL' END, CASE WHEN unread THEN 'UNREAD' END, CASE WHEN starred THEN 'STARRED' END, CASE WHEN important THEN 'IMPORTANT' END], lambda x: x IS NOT NULL)) AS label FROM msgs)
      SELECT account, CASE WHEN account = 'a0' AND label = 'INBOX' THEN 'Inbox' WHEN account = 'a0' AND label = 'UNREAD' THEN 'Unread' WHEN account = 'a1' AND label = 'STARRED' THEN 'Kept' ELSE label END AS label, count(*) AS n FROM l GROUP BY 1, 2""",
    "label_edit": f"""WITH {SQL_MESSAGES}, l AS (SELECT *, list_filter([CASE WHEN direction = 'sent' THEN 'SENT' WHEN NOT starred THEN 'INBOX' END, CASE event_type WHEN 'view' THEN 'CATEGORY_UPDATES' WHEN 'click' THEN 'CATEGORY_PROMOTIONS' WHEN 'signup' THEN 'CATEGORY_PERSONAL' END, CASE WHEN unread AND NOT starred THEN 'UNREAD' END, CASE WHEN starred THEN 'STARRED' END, CASE WHEN important THEN 'IMPORTANT' END, CASE WHEN starred THEN 'CATEGORY_SOCIAL' END], lambda x: x IS NOT NULL) AS ls FROM msgs)
      SELECT message_id, array_to_string(list_sort(ls), ',') AS labels, CASE WHEN starred THEN CASE WHEN event_type = 'signup' THEN 'personal' ELSE 'social' END ELSE category END AS category, unread AND NOT starred AS unread, starred, important FROM l""",
    "inbox_reconcile": f"""WITH {SQL_MESSAGES}, x AS (SELECT account, event_id, direction <> 'sent' AS stored, (direction <> 'sent' AND event_id % 3 > 0) OR event_id % 10 = 1 AS live FROM msgs),
      c AS (SELECT account, 'archived' AS change FROM x WHERE stored AND NOT live UNION ALL SELECT account, 'restored' FROM x WHERE live AND NOT stored UNION ALL SELECT account, 'fetch' FROM x WHERE event_id % 50 = 0 UNION ALL SELECT account, 'inbox after' FROM x WHERE live)
      SELECT account, change, count(*) AS n FROM c GROUP BY 1, 2""",
    "upsert_no_downgrade": f"""WITH {SQL_MESSAGES} SELECT account, message_id, CASE WHEN event_id % 2 = 0 THEN 'again' ELSE subject END AS subject, CASE WHEN event_id % 2 = 0 THEN NOT unread ELSE unread END AS unread,
      CASE WHEN event_id % 4 = 0 AND body_state <> 'summary-only' THEN 'full' ELSE body_state END AS body_state, CASE WHEN event_id % 4 = 0 AND body_state <> 'summary-only' THEN 'fetched' ELSE body_text END AS body_text FROM msgs""",
    "enrich_candidates_direct": f"WITH {SQL_MESSAGES} SELECT {_SHOWN} FROM msgs WHERE body_state = 'meta' AND NOT {_BULK} ORDER BY internal_date DESC, message_id LIMIT 100",
    "enrich_candidates_profile": f"""WITH {SQL_SCORED}, {SQL_DOMAINS}, x AS (SELECT m.*, c.curation AS cc, d.curation AS dc FROM msgs m LEFT JOIN curated c ON c.account = m.account AND c.address = m.sender LEFT JOIN domains d ON d.account = m.account AND d.domain = split_part(m.sender, '@', 2) WHERE body_state = 'meta')
      SELECT {_SHOWN} FROM x WHERE (cc = 'important' OR dc = 'important') AND coalesce(cc, '') NOT IN ('muted', 'blocked') AND coalesce(dc, '') NOT IN ('muted', 'blocked')""",
    "compact_eligible": f"""WITH {SQL_SCORED}, {SQL_DOMAINS}, {SQL_THREADS}, x AS (SELECT m.*, body_state = 'full' AND summary_text IS NOT NULL AND summarized_at <= {NOW - 7 * DAY} AND (m.is_list OR coalesce(m.category = 'promotions', false)) AND coalesce(c.curation, '') <> 'important' AND coalesce(d.curation, '') <> 'important' AND NOT t.user_participated AS gone
      FROM msgs m LEFT JOIN curated c ON c.account = m.account AND c.address = m.sender LEFT JOIN domains d ON d.account = m.account AND d.domain = split_part(m.sender, '@', 2) JOIN threads t ON t.account = m.account AND t.thread_id = m.thread_id)
      SELECT account, CASE WHEN gone THEN 'summary-only' ELSE body_state END AS body_state, count(*) AS n, count(CASE WHEN NOT gone THEN body_text END) AS bodies FROM x GROUP BY 1, 2""",
    "find_person": f"WITH {SQL_SCORED} SELECT {_DOC} FROM scored WHERE contains(lower(concat_ws(' ', display_name, address, domain)), 'user 1') ORDER BY (msgs_sent > 0) DESC, engagement_score DESC NULLS LAST, address, account LIMIT 25",
    "list_contacts_engagement": f"WITH {SQL_SCORED} SELECT {_DOC} FROM curated WHERE curation = 'important' ORDER BY engagement_score DESC NULLS LAST, address, account LIMIT 20",
    "list_contacts_volume": f"WITH {SQL_SCORED} SELECT {_DOC} FROM scored ORDER BY msgs_received + msgs_sent DESC, address, account LIMIT 20",
    "list_contacts_recency": f"WITH {SQL_SCORED} SELECT {_DOC} FROM scored ORDER BY last_seen DESC, address, account LIMIT 20",
    "correspondents": f"WITH {SQL_CONTACTS} SELECT account, address, msgs_sent FROM contacts WHERE msgs_sent > 0",
    "threads_for_contact": f"WITH {SQL_MESSAGES}, {SQL_THREADS} SELECT account, thread_id, subject, msg_count, last_at FROM threads WHERE list_contains(participants, 'me@a1.example.net') ORDER BY last_at DESC, account, thread_id LIMIT 20",
    "threads_for_query": f"WITH {SQL_MESSAGES}, {SQL_THREADS}, h AS (SELECT DISTINCT account, thread_id FROM msgs WHERE contains(coalesce(body_text, ''), 'receipt')) SELECT account, thread_id, msg_count, last_at FROM threads JOIN h USING (account, thread_id) ORDER BY last_at DESC, account, thread_id LIMIT 20",
    "categorize_candidates": f"WITH {SQL_CONTACTS}, {SQL_DOMAINS} SELECT c.account, c.domain, count(*) AS correspondents, CAST(sum(msgs_received + msgs_sent) AS BIGINT) AS msgs FROM contacts c JOIN domains d ON d.account = c.account AND d.domain = c.domain WHERE msgs_sent > 0 AND d.category IS NULL GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 2, 1 LIMIT 30",
    "categorize_samples": f"""WITH {SQL_CONTACTS}, {SQL_DOMAINS}, picked AS (SELECT c.account, c.domain, count(*) AS n1, sum(msgs_received + msgs_sent) AS n2 FROM contacts c JOIN domains d ON d.account = c.account AND d.domain = c.domain WHERE msgs_sent > 0 AND d.category IS NULL GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 2, 1 LIMIT 30),
      s AS (SELECT c.account, c.domain, c.address, row_number() OVER (PARTITION BY c.account, c.domain ORDER BY (msgs_sent > 0) DESC, msgs_received + msgs_sent DESC, address) AS rank FROM contacts c JOIN picked ON picked.account = c.account AND picked.domain = c.domain),
      t AS (SELECT account, sender, subject, row_number() OVER (PARTITION BY account, sender ORDER BY internal_date DESC, message_id) AS n FROM msgs WHERE direction = 'received' AND subject IS NOT NULL),
      u AS (SELECT account, sender, string_agg(subject, '|' ORDER BY n) AS subjects FROM t WHERE n <= 3 GROUP BY 1, 2)
      SELECT s.account, s.domain, s.address, s.rank, coalesce(subjects, '') AS subjects FROM s LEFT JOIN u ON u.account = s.account AND u.sender = s.address WHERE rank <= 5""",
    "search_bm25": bm25_sql(_DOC_ROWS, [_PREFIX.format(p="thre"), _PREFIX.format(p="ando")]),
    "search_index": f"WITH {_DOC_ROWS}, t AS (SELECT message_id, unnest(list_distinct(list_concat({_cut('subject')}, {_cut('sender')}, {_cut('body')}))) AS term FROM r) SELECT term, count(*) AS n FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200",
    "search_blocks": bm25_sql(_DOC_ROWS, [f"len(list_filter({{t}}, lambda x: x = '{w}'))" for w in ("licensed", "worthless")], limit=25),
    "search_updated": bm25_sql(
        "r AS (SELECT lang AS account, CAST(doc_id AS VARCHAR) AS message_id, doc_id AS internal_date, string_split(text, chr(10))[1] AS subject, source AS sender, NULL AS recipients, CASE WHEN lang = 'fr' THEN text END AS body FROM documents WHERE lang <> 'es')",
        [_PREFIX.format(p=p) for p in ("les", "the", "de")], limit=None,
    ),
    "search_phrase": bm25_sql(_DOC_ROWS, ["len(list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = 'licensed' AND {t}[i + 1] = 'under' AND starts_with({t}[i + 2], 'the')))"], "WHERE account = 'en'", 20),
    "search_stemmed": bm25_sql(
        f"{SQL_MESSAGES}, r AS (SELECT account, message_id, internal_date, subject, CASE WHEN direction = 'sent' THEN 'Me <' || sender || '>' ELSE user_name || ' <' || sender || '>' END AS sender, concat_ws(' ', CASE WHEN direction = 'sent' THEN user_name || ' <' || user_address || '>' ELSE 'Me <me@' || account || '.example.net>' END, cc_name || ' <' || cc_address || '>') AS recipients, concat_ws(' ', snippet, body_text, summary_text) AS body FROM msgs)",
        ["len(list_filter({t}, lambda x: starts_with(x, 'flight')))", "len(list_filter({t}, lambda x: starts_with(x, 'airfar')))", "len(list_filter({t}, lambda x: starts_with(x, 'itinerari')))", "len(list_filter({t}, lambda x: starts_with(x, 'receipt')))", "len(list_filter({t}, lambda x: starts_with(x, 'invoic')))", "len(list_filter({t}, lambda x: starts_with(x, 'bill')))"],
        limit=None,
    ),
    "graph_edges": f"WITH {GRAPH_SQL} SELECT * FROM edges",
    "graph_neighbors": f"WITH {SQL_SCORED}{GRAPH_SQL[len(SQL_CONTACTS):]}, e AS (SELECT account, CASE WHEN a = 'u3@x.y.b3.com.au' THEN b ELSE a END AS address, weight FROM edges WHERE a = 'u3@x.y.b3.com.au' OR b = 'u3@x.y.b3.com.au') SELECT account, address, weight AS shared_threads, msgs_sent FROM e JOIN scored USING (account, address) ORDER BY weight DESC, engagement_score DESC NULLS LAST, address LIMIT 15",
    "graph_pagerank": _PAGERANK,
    "address_parse": f"WITH {SQL_MESSAGES} SELECT message_id, sender AS address, CASE WHEN direction = 'sent' THEN 'Me' ELSE user_name END AS name, split_part(sender, '@', 2) AS host, CAST(1 + CASE WHEN cc_address IS NULL THEN 0 ELSE 1 END AS INTEGER) AS recipients FROM msgs",
    "registrable_domain": f"WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), ':.*$', '') AS h FROM pages) SELECT {_REG.format(h='h')} AS domain, count(*) AS pages FROM h GROUP BY 1",
    "html_to_text": f"SELECT page_id, md5({_NORMAL.format(x='t')}) AS text_md5 FROM (SELECT page_id, regexp_replace({_MARKUP}, {_UNSEEN}, '', 'g') AS t FROM pages)",
    "deboilerplate": f"""WITH t AS (SELECT doc_id, string_split(text || CASE doc_id % 3 WHEN 0 THEN chr(10) || '> quoted' || chr(10) || 'rest' WHEN 1 THEN chr(10) || 'To unsubscribe click' || chr(10) || 'rest' ELSE chr(10) || '-- ' || chr(10) || 'rest' END, chr(10)) AS ls FROM documents),
      u AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda l: regexp_matches(l, '{_STOPS}')), true) AS p FROM t)
      SELECT doc_id, md5(array_to_string(list_filter(CASE WHEN p > 0 THEN ls[1:p - 1] ELSE ls END, lambda l: NOT regexp_matches(l, '^\\s*>')), chr(10))) AS text_md5 FROM u""",
    "normalize_ws": f"SELECT doc_id, md5({_NORMAL.format(x='t')}) AS text_md5 FROM (SELECT doc_id, replace(text, ' ', ' ' || chr(9)) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || ' end ' AS t FROM documents)",
    "snippets": f"WITH t AS (SELECT doc_id, lang, source, {_TRIM.format(x=_COLLAPSED)} AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 160 THEN substr(s, 1, 159) || '…' WHEN s <> '' THEN s END AS snippet, CAST(length(lang || ' ' || source) AS INTEGER) AS projected FROM t",
    "meaningful_length": "SELECT doc_id, CAST(length(regexp_replace(regexp_replace(text, '(?i)&(?:[a-z]+|#\\d+|#x[0-9a-f]+);', '', 'g') || 'x', '[\\s\\x{A0}\\x{AD}\\x{200B}-\\x{200F}\\x{FEFF}]', '', 'g')) + 0 AS INTEGER) AS n FROM documents",
    "iso_dates": f"WITH {SQL_MESSAGES}, t AS (SELECT message_id, make_timestamp(internal_date * 1000) AS ts FROM msgs) SELECT message_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM t",
    "refs": f"WITH {SQL_MESSAGES} SELECT message_id, account || ':' || thread_id AS ref, account, thread_id AS id FROM msgs",
    "image_triage": f"SELECT page_id, CAST(n AS INTEGER) AS n, src, width, height, alt, \"linkedHref\", kind, score FROM pages, (VALUES {_TRIAGED}) v(n, src, width, height, alt, \"linkedHref\", kind, score)",
    "image_candidates": "SELECT page_id, 'https://x/hero-sale.jpg,a.jpg' AS sources, true AS image_only FROM pages",
    "suggestions": f"WITH {SQL_SCORED} SELECT account, {_suggested('engagement_score', 'bulk_count * 2 > msgs_received')} AS suggested, count(*) AS n FROM scored GROUP BY 1, 2",
}
