"""Sources of messages: provider payloads and a source over a table; ``files`` has those over folders.

Scope (query, since, includeSent, limit) is a pushed-down predicate: ``provider_query`` for a remote provider, a filter
and limit here.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..errors import ConfigError, WriteUnsupportedError

FULL = (
    "id string, threadId string, internalDate bigint, dateHeader string, `from` string, `to` string, cc string, subject string, labels array<string>, snippet string, "
    "sizeEstimate bigint, headers map<string,string>, bodyText string, bodyHtml string, mimeType string"
)
#: A provider's message. The payload, whose parts nest to any depth, stays JSON.
PAYLOAD = "id string, threadId string, snippet string, internalDate string, labelIds array<string>, sizeEstimate bigint, payload string"


@dataclass(frozen=True)
class Scope:
    query: str | None = None
    since: str | None = None
    limit: int | None = None
    include_sent: bool = True

    def __str__(self) -> str:
        """For the audit: given fields, in a fixed order."""
        parts = [("query", self.query), ("since", self.since), ("limit", self.limit), ("includeSent", None if self.include_sent else "false")]
        return " ".join(f"{k}={v}" for k, v in parts if v is not None)


def normalise_since(since: str) -> str:
    """Providers write months as m."""
    m = re.fullmatch(r"(\d+)\s*mo", since.strip())
    return f"{m[1]}m" if m else since.strip()


_SINCE_MS = {"h": 3_600_000, "d": 86_400_000, "w": 7 * 86_400_000, "m": 30 * 86_400_000, "y": 365 * 86_400_000}


def since_ms(since: str, now_ms: int) -> int:
    """``12h``, ``3d``, ``2w``, ``6mo`` (or ``6m``, as providers write it) and ``1y`` before now, or an ISO date; epoch milliseconds."""
    if m := re.fullmatch(r"(\d+)\s*([hdwmy])", normalise_since(since)):
        return now_ms - int(m[1]) * _SINCE_MS[m[2]]
    try:
        at = datetime.fromisoformat(since.strip().replace("Z", "+00:00"))
    except ValueError:
        raise ConfigError(f"not a time: {since!r}; use 12h, 3d, 2w, 6mo, 1y or an ISO date") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def provider_query(scope: Scope) -> str:
    parts = [scope.query.strip() if scope.query else "", f"newer_than:{normalise_since(scope.since)}" if scope.since else "", "" if scope.include_sent else "-in:sent"]
    return " ".join(p for p in parts if p)


def compose_scope(policy: Scope, *, query: str | None = None, since: str | None = None, limit: int | None = None, everything: bool = False) -> Scope:
    """Flags over policy, field by field; ``everything`` clears since and limit first."""
    base = replace(policy, since=None, limit=None) if everything else policy
    given = {k: v for k, v in (("query", query), ("since", since), ("limit", limit)) if v is not None}
    return replace(base, **given)


def describe_selector(rule: str | None = None, sender: str | None = None, match: str | None = None, limit: int | None = None) -> str:
    return " ".join(f"{k}={v}" for k, v in (("rule", rule), ("sender", sender), ("match", match), ("limit", limit)) if v is not None)


# -- payloads --------------------------------------------------------------------------------------


def header(headers: Column, name: str) -> Column:
    """The first header of that name, in any case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def header_bag(headers: Column) -> Column:
    """Name to value, the last of equal names. Independent of the session's policy for duplicate keys."""
    last = F.filter(headers, lambda h, i: ~F.exists(F.slice(headers, i + 2, F.size(headers)), lambda g: g["name"] == h["name"]))
    return F.map_from_entries(F.transform(last, lambda h: F.struct(h["name"], h["value"])))


def decode_body(data: Column) -> Column:
    """URL-safe base64 to text, padded or not; what isn't base64 gives null."""
    plain = F.translate(F.regexp_replace(data, r"[=\s]", ""), "-_", "+/")
    return F.decode(F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="), F.lit("base64")), "UTF-8")


_TOKENS = re.compile(r'\s*([{}\[\],:]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)', re.S)


def parse_json(text: str):
    """JSON of any depth. What Python's parser gives up on, as nested too deep, is parsed with a stack."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    top: list = []
    open_: list = [top]  # containers being filled
    keys: list = []  # of each open object: the key that waits for its value
    at, end = 0, len(text.rstrip())
    expect_key = False
    while at < end:
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError("not JSON")
        t, at = m[1], m.end()
        if t in "]}":
            if len(open_) == 1 or isinstance(open_[-1], dict) != (t == "}"):
                raise ValueError("not JSON")
            if isinstance(open_.pop(), dict):
                keys.pop()
            expect_key = False
        elif t == ",":
            expect_key = isinstance(open_[-1], dict)
        elif t == ":":
            expect_key = False
        elif expect_key:
            keys[-1] = json.loads(t)
        else:
            value = {} if t == "{" else [] if t == "[" else json.loads(t)
            if isinstance(open_[-1], dict):
                open_[-1][keys[-1]] = value
            else:
                open_[-1].append(value)
            if t in "{[":
                open_.append(value)
                if t == "{":
                    keys.append(None)
                    expect_key = True
    if len(open_) != 1 or len(top) != 1:
        raise ValueError("not JSON")
    return top[0]


def first_parts(payload: str | None) -> dict:
    """The data of the first text/plain and text/html parts that have some, in document order, however deep, and the headers of the message. What isn't a payload has none."""
    found: dict = {"plain": None, "html": None, "headers": None}
    try:
        top = parse_json(payload) if payload else None
    except ValueError:
        return found
    listed = lambda x: x if isinstance(x, list) else []
    waiting = [top]
    if isinstance(top, dict) and isinstance(top.get("headers"), list):
        found["headers"] = [{k: None if h.get(k) is None else str(h[k]) for k in ("name", "value")} for h in top["headers"] if isinstance(h, dict)]
    while waiting and (found["plain"] is None or found["html"] is None):
        part = waiting.pop()
        if not isinstance(part, dict):
            continue
        kind = str(part.get("mimeType") or "").lower().removeprefix("text/")
        body = part.get("body")
        data = body.get("data") if isinstance(body, dict) else None
        if kind in ("plain", "html") and str(part.get("mimeType")).lower() == f"text/{kind}" and data and isinstance(data, str) and found[kind] is None:
            found[kind] = data
        waiting.extend(reversed(listed(part.get("parts"))))
    return found


_HEADER_LIST = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))


@F.pandas_udf(StructType([StructField("plain", StringType()), StructField("html", StringType()), StructField("headers", _HEADER_LIST)]))
def _first_parts(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([first_parts(p) for p in payloads], columns=["plain", "html", "headers"])


def _bodies(parts: Column) -> Column:
    text, html = decode_body(parts["plain"]), decode_body(parts["html"])
    return F.struct(text.alias("bodyText"), html.alias("bodyHtml"), F.when(text.isNotNull(), "text/plain").when(html.isNotNull(), "text/html").alias("mimeType"))


def extract_bodies(payload: Column) -> Column:
    """struct(bodyText, bodyHtml, mimeType) of a payload as JSON."""
    return _bodies(_first_parts(payload))


def to_full(payloads: DataFrame) -> DataFrame:
    """Provider messages as ``FULL`` rows. A payload is parsed once."""
    payloads = payloads.withColumn("_parts", _first_parts("payload")).withColumns({"_headers": F.col("_parts.headers"), "_bodies": _bodies(F.col("_parts"))})
    h, b = F.col("_headers"), F.col("_bodies")
    named = {k: header(h, k) for k in ("Date", "From", "To", "Cc", "Subject")}
    return payloads.select(
        "id", "threadId", F.expr("try_cast(nullif(internalDate, '') as bigint)").alias("internalDate"), named["Date"].alias("dateHeader"), named["From"].alias("from"), named["To"].alias("to"), named["Cc"].alias("cc"),
        named["Subject"].alias("subject"), F.coalesce("labelIds", F.array().cast("array<string>")).alias("labels"), "snippet", "sizeEstimate", header_bag(h).alias("headers"), b["bodyText"].alias("bodyText"),
        b["bodyHtml"].alias("bodyHtml"), b["mimeType"].alias("mimeType"),
    )


def parse_label_list(labels: DataFrame) -> DataFrame:
    return labels.where("coalesce(id, '') <> '' and coalesce(name, '') <> ''")


def to_messages(full: DataFrame, account: str, known: list[str]) -> DataFrame:
    """Classified message rows in state meta; bodies stay with the source until they are fetched."""
    from ..functions.classify import category, direction, flags, is_list

    own = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    return full.select(
        F.lit(account).alias("account"), F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), F.col("internalDate").alias("internal_date"), F.col("dateHeader").alias("date_header"),
        F.col("from").alias("from_addr"), F.col("to").alias("to_addr"), F.col("cc").alias("cc_addr"), "subject", "labels", category(F.col("labels")).alias("category"), is_list(F.col("headers")).alias("is_list"),
        direction(F.col("labels"), F.col("from"), own).alias("direction"), *(c.alias(n) for n, c in flags(F.col("labels")).items()), F.col("sizeEstimate").alias("size_estimate"), "snippet",
        F.lit("meta").alias("body_state"), F.lit(None).cast("string").alias("body_text"), F.lit(None).cast("string").alias("body_html"),
    )


# -- sources ---------------------------------------------------------------------------------------


class MailSource:
    """A pluggable source. Ids come newest first; ids that it doesn't know are left out."""

    #: Whether many ids are best fetched at once, as from a table, or in batches.
    one_pass = False

    def check(self) -> dict:
        raise NotImplementedError

    def list_ids(self, scope: Scope) -> DataFrame:
        raise NotImplementedError

    def get_metadata(self, ids: DataFrame) -> DataFrame:
        raise NotImplementedError

    def get_full(self, ids: DataFrame) -> DataFrame:
        raise NotImplementedError

    def list_labels(self) -> DataFrame | None:
        return None

    def modify(self, changes: DataFrame) -> DataFrame:
        raise WriteUnsupportedError(f"{type(self).__name__} takes no changes")


class TableSource(MailSource):
    """Over a DataFrame of ``FULL`` rows. Label changes are logged in ``changes``; blank labels and empty changes are dropped."""

    one_pass = True

    def __init__(self, rows: DataFrame, address: str | None = None, labels: DataFrame | None = None, reason: str | None = None, now_ms: int | None = None):
        self.rows, self.address, self.labels, self.reason, self.now_ms = rows, address, labels, reason, now_ms
        self.changes: DataFrame | None = None

    def check(self) -> dict:
        return {"ok": False, "reason": self.reason} if self.reason else {"ok": True, "address": self.address}

    def list_ids(self, scope: Scope) -> DataFrame:
        r = self.rows
        if not scope.include_sent:
            r = r.where(~F.array_contains("labels", "SENT"))
        if scope.query and "in:inbox" in scope.query:
            r = r.where(F.array_contains("labels", "INBOX"))
        if scope.since:
            now = int(time.time() * 1000) if self.now_ms is None else self.now_ms
            r = r.where(F.col("internalDate") >= since_ms(scope.since, now))
        r = r.orderBy(F.col("internalDate").desc_nulls_last(), "id").select("id")
        return r.limit(scope.limit) if scope.limit is not None else r

    def get_metadata(self, ids: DataFrame) -> DataFrame:
        return self.get_full(ids).drop("bodyText", "bodyHtml", "mimeType")

    def get_full(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids.select("id").distinct(), "id", "left_semi")

    def list_labels(self) -> DataFrame | None:
        return self.labels

    def modify(self, changes: DataFrame) -> DataFrame:
        clean = lambda c: F.filter(c, lambda x: F.trim(x) != "")
        done = changes.withColumn("add", clean("add")).withColumn("remove", clean("remove")).where("size(add) > 0 or size(remove) > 0")
        self.changes = done if self.changes is None else self.changes.unionByName(done)
        return done
