"""From mail bodies to plain text: markup, entities, quoted-printable, boilerplate; and image triage.

Line and markup work is column expressions; entity and quoted-printable decoding need a callback for each match and
are Arrow UDFs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import INVISIBLES, SPACE, blank_to_null, js_trim, strip_invisibles

# Named entities of prose.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘",
    "rdquo": "”", "ldquo": "“", "sbquo": "‚", "bdquo": "„", "laquo": "«", "raquo": "»", "deg": "°", "euro": "€", "pound": "£",
    "cent": "¢", "yen": "¥", "sect": "§", "para": "¶", "dagger": "†", "permil": "‰", "prime": "′",
    "shy": "­", "zwnj": "‌", "zwj": "‍", "lrm": "‎", "rlm": "‏",
}
BLOCKS = "p|div|tr|li|h[1-6]|table|ul|ol|blockquote|section|article|header|footer"
# Lines that begin quoted history, a signature or a footer; what follows goes with them.
QUOTE_HEADERS = (r"(?i)\A\s*On\b.*\bwrote:\s*\z", r"(?i)\A\s*-{2,}\s*Original Message\s*-{2,}\s*\z", r"(?i)\A\s*From:\s.+\z")
SIGNATURES = (r"\A--\s*\z",)
FOOTERS = (
    r"(?i)\bunsubscribe\b", r"(?i)\bupdate (your )?(email )?preferences\b", r"(?i)\bmanage (your )?(email )?(subscription|preferences)\b",
    r"(?i)\bview (this email )?in (your )?browser\b", r"(?i)\byou (are )?receiv(e|ing) this (email|message)\b", r"(?i)\bsent to you by\b",
    r"\A\s*©\s*\d{4}\b", r"(?i)\ball rights reserved\b",
)
# What file names say of images.
SPACER_NAME = r"(?i)spacer|pixel|1x1|blank|clear\.gif|transparent|\bpx\.gif|/p\.gif|beacon|open\.aspx|track"
ICON_NAME = r"(?i)icon|logo|favicon|sprite|social|facebook|twitter|x-logo|instagram|youtube|linkedin|tiktok|pinterest|app-?store|google-?play|badge|bullet|arrow|chevron|star\b|flag-"
CONTENT_NAME = r"(?i)promo|offer|deal|hero|banner|header|content|sale|save|fare|price|special|expedition|voyage|itinerar|feature|cta|button"
MIN_CONTENT, MAX_ICON, THIN_TEXT, OCR_LIMIT = 200, 64, 200, 6


def strip_markup(html: Column) -> Column:
    """Markup off, block edges as line breaks; entities stay."""
    s = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style|head|title)\b[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)<\s*br\s*/?\s*>", "\n")
    s = F.regexp_replace(s, rf"(?i)<\s*/\s*({BLOCKS})\s*>", "\n")
    s = F.regexp_replace(s, rf"(?i)<\s*({BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(s, r"<[^>]+>", "")


def _character(code: int) -> str:
    return chr(code) if 0 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else ""


_HEX, _DEC, _NAMED = re.compile(r"&#x([0-9a-f]+);", re.I | re.A), re.compile(r"&#([0-9]+);"), re.compile(r"&([a-z]+);", re.I | re.A)
_UNSEEN = str.maketrans("", "", INVISIBLES)


def decode_entities_text(s: str) -> str:
    """Hexadecimal, then decimal, then named; each pass sees what the one before made."""
    if "&" in s:
        s = _HEX.sub(lambda m: _character(int(m[1], 16)), s)
        s = _DEC.sub(lambda m: _character(int(d or 0)) if len(d := m[1].lstrip("0")) < 9 else "", s)
        s = _NAMED.sub(lambda m: ENTITIES.get(m[1].lower(), m[0]), s)
    return s.translate(_UNSEEN)


@F.pandas_udf(StringType())
def decode_entities(values: pd.Series) -> pd.Series:
    return values.map(decode_entities_text, na_action="ignore")


_SOFT, _RUN = re.compile(r"=\r?\n"), re.compile(r"(?:=[0-9A-Fa-f]{2})+")


def decode_quoted_printable_text(s: str) -> str:
    """Soft breaks go; each run of =XX is read as UTF-8, bad bytes as U+FFFD."""
    return _RUN.sub(lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), _SOFT.sub("", s))


@F.pandas_udf(StringType())
def decode_quoted_printable(values: pd.Series) -> pd.Series:
    return values.map(decode_quoted_printable_text, na_action="ignore")


def looks_quoted_printable(c: Column) -> Column:
    return c.rlike(r"=\r?\n|(?:=[0-9A-Fa-f]{2}){2,}")


def html_to_text(html: Column) -> Column:
    return decode_entities(strip_markup(html))


def strip_padding_entities(c: Column) -> Column:
    """Only entities of invisible characters go, and those characters; visible entities stay as written."""
    points = [ord(x) for x in INVISIBLES]
    named = "|".join(k for k, v in ENTITIES.items() if v in INVISIBLES)
    pattern = f"(?i)&(?:#x0*(?:{'|'.join(f'{p:x}' for p in points)})|#0*(?:{'|'.join(map(str, points))})|{named});"
    return strip_invisibles(F.regexp_replace(c, pattern, ""))


def deboilerplate(text: Column) -> Column:
    """Lines up to the first marker of quoted history, a signature or a footer, without > lines."""
    stop = "|".join(f"(?:{p})" for p in (*QUOTE_HEADERS, *SIGNATURES, *FOOTERS))
    lines = F.split(text, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(stop)), F.lit(True))
    kept = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(kept, lambda x: ~x.rlike(r"\A\s*>")), "\n")


def normalize_whitespace(text: Column) -> Column:
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[ \t\x{A0}]+", " ")
    s = F.array_join(F.transform(F.split(s, "\n", -1), js_trim), "\n")
    return js_trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def distill(body_text: Column, body_html: Column) -> Column:
    """The plain body, or else the text of the HTML one, without boilerplate."""
    decoded = lambda c: F.when(looks_quoted_printable(c), decode_quoted_printable(c)).otherwise(c)
    plain = F.when(js_trim(F.coalesce(body_text, F.lit(""))) != "", strip_padding_entities(decoded(body_text)))
    html = F.when(js_trim(F.coalesce(body_html, F.lit(""))) != "", html_to_text(decoded(body_html)))
    return normalize_whitespace(deboilerplate(F.coalesce(plain, html, F.lit(""))))


def meaningful_length(text: Column) -> Column:
    """Visible characters that are no white space and no part of an entity."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)&(?:[a-z]+|#\d+|#x[0-9a-f]+);", "")
    return F.length(F.regexp_replace(strip_invisibles(s), f"{SPACE}+", ""))


# -- images ----------------------------------------------------------------------------------------


def _character_of(digits: Column, base: int) -> Column:
    """The character of a code point written in ``base`` without leading zeros; nothing where there is none."""
    code = F.conv(F.when(F.length(digits) <= 7, F.concat(F.lit("0"), digits)), base, 10).cast("long")
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.when((code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), wide), F.lit(""))


def _numeric(s: Column, prefix: str, digit: str, base: int) -> Column:
    """Numeric references decoded: what follows each ``&#`` that begins one starts with it."""

    def put(part: Column, i: Column) -> Column:
        digits = F.regexp_extract(part, rf"(?i)\A{prefix}0*({digit}*);", 1)
        return F.when(i == 0, part).otherwise(F.concat(_character_of(digits, base), F.regexp_replace(part, rf"(?i)\A{prefix}{digit}+;", "")))

    parts = F.split(s, rf"(?i)&#(?={prefix}{digit}+;)", -1)
    return F.array_join(F.transform(parts, put), "")


def _unquoted(s: Column) -> Column:
    return F.regexp_replace(s, r"""(?s)\A"([^"]*)"\z|\A'([^']*)'\z""", "$1$2")


def _value(tag: Column, name: str) -> Column:
    """An attribute in any of its three quoting forms, its entities decoded; null where it is absent."""
    found = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)

    def decoded(raw: Column) -> Column:
        s = F.replace(js_trim(_unquoted(raw)), F.lit("&amp;"), F.lit("&"))
        numbers = lambda x: F.when(F.contains(x, F.lit("&#")), _numeric(_numeric(x, "x", "[0-9a-f]", 16), "", "[0-9]", 10)).otherwise(x)
        s = F.get(F.transform(F.array(s), numbers), F.lit(0))
        return F.replace(F.replace(s, F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'"))

    return F.get(F.transform(F.array(found), lambda raw: F.when(raw != "", decoded(raw))), F.lit(0))


def _pixels(tag: Column, name: str) -> Column:
    number = F.regexp_extract(_value(tag, name), r"(?s)\A(\d+(?:\.\d+)?)\s*(?:px)?\z", 1)
    style = F.regexp_extract(_value(tag, "style"), rf"(?i)(?:^|;)\s*{name}\s*:\s*(\d+(?:\.\d+)?)\s*px", 1)
    px = F.coalesce(blank_to_null(number), blank_to_null(style)).cast("double")
    return F.floor(px + 0.5).cast("int")


def parse_images(html: Column) -> Column:
    """Images with a source, in document order: src, width, height, alt, linkedHref (of the open link around it)."""
    tokens = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>|</a>|<img\b[^>]*>"), F.lit(0))
    opening = lambda t: t.rlike(r"(?i)\A<a\b")
    closing = lambda t: t.rlike(r"(?i)\A</a")

    def around(tokens: Column, i: Column) -> Column:
        """The last link token before place i, if it opens a link."""
        last = F.element_at(F.concat(F.array(F.lit("</a>")), F.filter(F.slice(tokens, F.lit(1), i), lambda t: opening(t) | closing(t))), -1)
        return F.when(opening(last), _value(last, "href"))

    images = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].rlike(r"(?i)\A<img"))
    each = F.transform(
        images,
        lambda x: F.struct(
            _value(x["t"], "src").alias("src"), _pixels(x["t"], "width").alias("width"), _pixels(x["t"], "height").alias("height"),
            blank_to_null(_value(x["t"], "alt")).alias("alt"), around(tokens, x["i"]).alias("linkedHref"),
        ),
    )
    return F.filter(each, lambda x: F.coalesce(x["src"], F.lit("")) != "")


def triage_image(x: Column, min_content: int = MIN_CONTENT, max_icon: int = MAX_ICON) -> Column:
    """kind, score and reasons of one parsed image."""
    w, h, src = x["width"], x["height"], x["src"]
    area, minor, major = w.cast("double") * h, F.when(w.isNotNull() & h.isNotNull(), F.least(w, h)), F.when(w.isNotNull() & h.isNotNull(), F.greatest(w, h))
    size = F.concat(w.cast("string"), F.lit("x"), h.cast("string"))
    false = F.lit(False)
    yes = lambda c: F.coalesce(c, false)
    named, linked = src.rlike(CONTENT_NAME), x["linkedHref"].isNotNull()
    has_alt, has_link = x["alt"].isNotNull(), F.coalesce(x["linkedHref"] != "", false)
    content = yes(major >= min_content) | named | (linked & yes(major >= max_icon))
    score = F.floor(F.coalesce(F.least(area, F.lit(1e6)) / 1000, F.lit(50.0)) + F.when(named, 300).otherwise(0) + F.when(has_alt, 40).otherwise(0) + F.when(has_link, 60).otherwise(0) + 0.5).cast("int")
    why = F.filter(
        F.array(
            F.when(area.isNotNull(), F.concat(F.lit("content-sized ("), size, F.lit(")"))), F.when(named, F.lit("content-y filename")),
            F.when(has_alt, F.lit("has alt text")), F.when(has_link, F.lit("wrapped in a link (CTA)")),
        ),
        lambda r: r.isNotNull(),
    )
    verdict = lambda kind, reasons, s=None: F.struct(F.lit(kind).alias("kind"), (F.lit(0) if s is None else s).alias("score"), reasons.alias("reasons"))
    one = lambda *text: F.array(F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text)))
    return (
        F.when(yes(w <= 2) | yes(h <= 2) | yes(area <= 16), verdict("pixel", one("near-zero dimensions (tracking pixel)")))
        .when(src.rlike(SPACER_NAME), verdict("spacer", one("spacer/beacon filename")))
        .when(yes(minor <= 6) & yes(major / minor >= 20), verdict("divider", one("divider aspect ratio (", size, ")")))
        .when(src.rlike(ICON_NAME), verdict("icon", one("icon/logo/social filename")))
        .when(yes(major <= max_icon), verdict("icon", one("small image (", size, f" ≤ {max_icon}px)")))
        .when(content, verdict("content", why, score))
        .otherwise(verdict("unknown", one("no size signal and no decisive name hint")))
    )


def classify_images(images: Column) -> Column:
    def full(x: Column) -> Column:
        # the verdict is bound to an argument, so it is made once
        put = lambda v: F.struct(*(x[c].alias(c) for c in ("src", "width", "height", "alt", "linkedHref")), v["kind"].alias("kind"), v["score"].alias("score"), v["reasons"].alias("reasons"))
        return F.get(F.transform(F.array(triage_image(x)), put), F.lit(0))

    return F.transform(images, full)


def ocr_candidates(verdicts: Column, most: int = OCR_LIMIT) -> Column:
    """Content images, the first of each source, by score; equal scores in document order."""
    placed = F.transform(F.filter(verdicts, lambda x: x["kind"] == "content"), lambda x, i: F.struct((-x["score"]).alias("rank"), i.alias("i"), x.alias("image")))
    first = F.filter(placed, lambda p: ~F.exists(placed, lambda q: (q["image"]["src"] == p["image"]["src"]) & (q["i"] < p["i"])))
    return F.slice(F.transform(F.array_sort(first), lambda p: p["image"]), 1, most)


def image_only(text: Column, candidates: Column, threshold: int = THIN_TEXT) -> Column:
    return (F.size(candidates) > 0) & (meaningful_length(text) < threshold)
