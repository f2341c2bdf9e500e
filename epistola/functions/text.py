"""Addresses, domains, references, dates and snippets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-label public suffixes, under which a domain keeps three labels.
MULTIPART_SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "ac.uk", "gov.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "govt.nz",
    "co.jp", "or.jp", "ne.jp", "co.kr", "or.kr", "com.cn", "com.hk", "com.sg", "com.tw",
    "com.br", "com.mx", "com.ar", "com.co",
    "co.za", "com.tr", "co.in", "com.ua",
)
# Code points that show nothing.
INVISIBLES = "­͏​‌‍‎‏⁠﻿"
#: White space as JavaScript has it: Unicode's and the byte order mark.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


_SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


# Expressions name their input once, so projections that are merged don't repeat it.


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def first_match(value: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.get(F.regexp_extract_all(value, F.lit(pattern), F.lit(group)), F.lit(0))


def extract_address(value: Column) -> Column:
    """The bare, lower-cased address in a header value, or null: in the first angle brackets, if there are any."""
    plain = rf"[^<>@{SPACE[1:-1]}]+"
    return F.lower(first_match(F.coalesce(first_match(value, "<[^>]+>"), value), f"{plain}@{plain}"))


def display_name(value: Column) -> Column:
    """What stands before the first <, without quotes around it; null if there is no such part."""
    name = js_trim(F.regexp_extract(value, r"(?s)\A([^<]+)<", 1))
    return blank_to_null(js_trim(F.regexp_replace(name, r'\A"|"\z', "")))


def host_of(address: Column) -> Column:
    """After the last @, lower-cased; null if it is missing or last."""
    return F.lower(first_match(address, r"(?s)@([^@]+)\z", 1))


def split_recipients(value: Column) -> Column:
    """The parts between commas, trimmed, without empty ones; null gives none."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), js_trim)
    return F.filter(parts, lambda x: x != "")


def recipient_addresses(*values: Column) -> Column:
    """Addresses of all recipients, in order; one named twice is there twice."""
    parts = F.concat(*(split_recipients(v) for v in values))
    return F.filter(F.transform(parts, extract_address), lambda x: x.isNotNull())


_SUFFIXES = "|".join(x.replace(".", r"\.") for x in MULTIPART_SUFFIXES)


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a two-label public suffix; empty labels, a port and a final dot play no part."""
    ends = r"(?=\.*(?::|\z))"
    found = first_match(F.lower(js_trim(host)), rf"(?:[^.:]+\.+)?(?:{_SUFFIXES}){ends}|(?:[^.:]+\.+)?[^.:]+{ends}")
    return F.replace(F.replace(found, F.lit(".."), F.lit(".")), F.lit(".."), F.lit("."))


def strip_invisibles(c: Column) -> Column:
    return F.translate(c, INVISIBLES, "")


def compact_snippet(c: Column, most: int = 160) -> Column:
    """One line of at most ``most`` characters; an ellipsis ends what was cut; blank text gives null."""
    one = js_trim(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(blank_to_null(one))


def message_ref(account: Column, ident: Column) -> Column:
    return F.concat_ws(":", account, ident)


def provider_url(url: Column, ident: Column, template: str) -> Column:
    """The stored address of a message, or the template with its id at the end."""
    return F.coalesce(blank_to_null(url), F.concat(F.lit(template), ident))


def parse_ref(ref: Column) -> Column:
    """struct(account, id), split at the first colon; null unless both sides are there."""
    at = F.instr(ref, ":")
    ok = (at > 1) & (at < F.length(ref))
    return F.when(ok, F.struct(F.substr(ref, F.lit(1), at - 1).alias("account"), F.substr(ref, at + 1).alias("id")))


def iso_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_day(ms: Column, missing: str | None = None) -> Column:
    day = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    return F.coalesce(day, F.lit(missing)) if missing else day


def iso_minute(ms: Column, missing: str = "—") -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm"), F.lit(missing))


def joined(sep: str, *parts: Column) -> Column:
    """Non-empty parts with ``sep`` between them; none gives null."""
    return blank_to_null(F.concat_ws(sep, *(blank_to_null(p) for p in parts)))


def project_body(snippet: Column, body: Column, summary: Column) -> Column:
    return joined("\n", snippet, body, summary)


def project_recipients(to: Column, cc: Column) -> Column:
    return joined(" ", to, cc)


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Halves go towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def json_strings(c: Column) -> Column:
    """A JSON array of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def label_names(labels: Column, names: Column) -> Column:
    """Each label's name from the map ``names``; unknown ones as they are."""
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), x))


def edit_labels(labels: Column, add: Column, remove: Column) -> Column:
    return F.array_except(F.array_union(labels, add), remove)
