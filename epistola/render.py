"""Rows as JSON or as lines of text, one column ``value``; a line a row unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.html import image_only
from .functions.text import blank_to_null, compact_snippet, iso_day, iso_minute

# Separators, words and widths of the lines.
DOT, UNKNOWN_SENDER, NO_SUBJECT, NO_DATE, NOTHING = " · ", "(unknown sender)", "(no subject)", "?", "∅"
BODY_STATES = ("meta", "full", "summary-only")
MOST_IMAGES = 6


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def _put(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _line(*parts: Column | str) -> Column:
    return _put(*parts).alias("value")


def hit_lines(hits: DataFrame) -> DataFrame:
    """Sender, subject, day, snippet where there is one, and ref."""
    day = F.coalesce(F.substring("date", 1, 10), F.lit(NO_DATE))
    return hits.select(F.concat_ws(DOT, F.coalesce("from", F.lit(UNKNOWN_SENDER)), F.coalesce("subject", F.lit(NO_SUBJECT)), day, compact_snippet(F.col("snippet"), 100), F.col("ref")).alias("value"))


def _or_notice(lines: DataFrame, notice: str) -> DataFrame:
    return lines.sparkSession.createDataFrame([(notice,)], "value string") if lines.isEmpty() else lines


def result_lines(hits: DataFrame, terms: list[str]) -> DataFrame:
    return _or_notice(hit_lines(hits), f'No matches for "{" ".join(terms)}".')


def label_lines(hits: DataFrame, label: str) -> DataFrame:
    """A line that counts, then the hits."""
    n = hits.count()
    if not n:
        return hits.sparkSession.createDataFrame([(f"No messages labeled {label}.",)], "value string")
    head = hits.sparkSession.createDataFrame([(f"{n} message{'s' if n > 1 else ''} labeled {label}:",)], "value string")
    return head.union(hit_lines(hits))


def cadence_lines(rows: DataFrame, account: str = "", category: str | None = None, since: str | None = None) -> DataFrame:
    """A title, a head and an aligned line for each brand, in the order of ``rows``."""
    spark, scope = rows.sparkSession, f" category={category}" if category else ""
    size = rows.agg(F.count(F.lit(1)), F.sum("msgs"), F.max(F.length("domain"))).first()
    if not size[0]:
        return spark.createDataFrame([(f"No inbound mail for {account}{scope}{f' since {since}' if since else ''}.",)], "value string")
    width = max(6, size[2])
    right = lambda c, w: F.lpad(c, F.greatest(F.length(c), F.lit(w)), F.lit(" "))
    cells = [F.rpad("domain", width, " "), right(F.col("msgs").cast("string"), 5), right(F.col("senders").cast("string"), 5), iso_day(F.col("first_at"), " " * 10), iso_day(F.col("last_at"), " " * 10), right(F.format_string("%.1f", "per_month"), 6)]
    title = f"Inbound cadence — {account}{scope} ({size[0]} brands, {size[1]} messages)"
    head = "  ".join(("DOMAIN".ljust(width), " MSGS", "SNDRS", "FIRST".ljust(10), "LAST".ljust(10), "   /MO"))
    return spark.createDataFrame([(title,), ("",), (head,)], "value string").union(rows.select(F.concat_ws("  ", *cells)))


def _bodies(of: str = "") -> list[Column | str]:
    return [p for i, s in enumerate(BODY_STATES) for p in (f"{', ' if i else ''}{s} ", F.col(f"`{of}{s}`"))]


def status_lines(states: DataFrame, fresh: DataFrame | None = None, contacts: DataFrame | None = None) -> DataFrame:
    """states: body states by account. A text of lines for each account and, where contacts are given, a total; with ``fresh`` also when it was last synced."""
    s = states.withColumn("n_messages", sum((F.col(f"`{b}`") for b in BODY_STATES), F.lit(0)))
    s = s.join(fresh.select("account", "as_of", "syncing"), "account", "left") if fresh is not None else s.withColumns({"as_of": F.lit(None).cast("long"), "syncing": F.lit(False)})
    known = contacts.groupBy("account").agg(F.count(F.lit(1)).alias("n_contacts")) if contacts is not None else s.select("account", F.lit(0).cast("long").alias("n_contacts"))
    s = s.join(known, "account", "left").withColumn("n_contacts", F.coalesce("n_contacts", F.lit(0)))
    as_of = F.coalesce(F.date_format(F.timestamp_millis("as_of"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("never synced"))
    text = _line(F.col("account"), F.when(F.col("syncing"), " [sync running]").otherwise(""), "\n  index_as_of: ", as_of, "\n  bodies: ", *_bodies(), "\n  messages: ", F.col("n_messages"), ", contacts: ", F.col("n_contacts"))
    each = s.orderBy("account").select(text)
    if contacts is None:
        return _or_notice(each, "No accounts indexed yet.")
    total = s.agg(*(F.sum(f"`{c}`").alias(c) for c in (*BODY_STATES, "n_messages", "n_contacts"))).where("n_messages is not null")
    return each.union(total.select(_line("\nTotal: ", F.col("n_messages"), " messages, ", F.col("n_contacts"), " contacts (", *_bodies(), ")")))


def show_text(messages: DataFrame, enriched: bool = False) -> DataFrame:
    """A text for each message: its fields that are there, flags, images worth reading, and the body or what there is of it. messages may have ``images``
    (structs of src, width and height)."""
    c = F.col
    field = lambda name, v: F.when(blank_to_null(v).isNotNull(), _put(f"{name + ':':<10}", v))
    flags = F.concat_ws(", ", *(F.when(c(k), F.lit(v)) for k, v in (("unread", "unread"), ("starred", "starred"), ("important", "important"), ("is_list", "list"))), c("direction"))
    lines = [
        _put("ref:      ", c("account"), ":", c("message_id")), field("subject", c("subject")), field("from", c("from_addr")), field("to", c("to_addr")), field("cc", c("cc_addr")), _put("date:     ", iso_minute(c("internal_date"), NO_DATE)),
        field("thread", c("thread_id")), field("category", c("category")), _put("flags:    ", flags), _put("body:     ", c("body_state"), " (just enriched)" if enriched else ""),
    ]
    if "images" in messages.columns:
        dim = lambda x: F.when(x["width"].isNotNull() & x["height"].isNotNull(), _put(" (", x["width"], "x", x["height"], ")")).otherwise("")
        count = _put("images:   ", F.size("images"), " OCR candidate(s)", F.when(image_only(c("body_text"), c("images")), " — offer likely in images, not text").otherwise(""))
        listed = F.array_join(F.transform(F.slice("images", 1, MOST_IMAGES), lambda x: _put("            • ", x["src"], dim(x))), "\n")
        lines.append(F.when(F.size("images") > 0, F.concat_ws("\n", count, listed)))
    body = F.coalesce(blank_to_null(c("body_text")), _put("(no distilled body available — snippet: ", F.coalesce("snippet", F.lit(NOTHING)), ")"))
    return messages.select(F.concat_ws("\n", *lines, F.lit(""), body).alias("value"))


def sync_lines(runs: DataFrame) -> DataFrame:
    """runs: account, fetched, indexed, selector."""
    scope = F.coalesce(_put(" (", blank_to_null(F.col("selector")), ")"), F.lit(" (whole mailbox)"))
    return runs.select(_line(F.col("account"), ": fetched ", F.col("fetched"), ", indexed ", F.col("indexed"), scope))


def graph_line(account: str, built: dict[str, int]) -> str:
    return f"{account}: {built['nodes']} contacts, {built['edges']} co-recipiency edges, {built['communities']} communities"


def change_lines(verb: str, changed: DataFrame) -> DataFrame:
    """changed: account, message_id, names (of its labels now; null where the index doesn't hold the message)."""
    now = F.coalesce(blank_to_null(F.array_join("names", ", ")), F.lit(NOTHING))
    where = F.when(F.col("names").isNull(), "message not in local index (provider updated; will reconcile on next sync)").otherwise(_put("local labels now: ", now))
    return changed.select(_line(f"{verb} ", F.col("account"), ":", F.col("message_id"), " — ", where))
