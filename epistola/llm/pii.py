"""Information-theoretic sanitisation of personal data and secrets (op6).

Protected entities are what the base patterns find, e-mail and IP addresses, card and phone numbers, and secrets: long runs of
letters and digits whose characters carry at least ``SECRET_BITS`` bits each. Words near an entity may reveal it, or that one is there, even where the entity
itself is masked. An entity belongs to two classes, itself and its kind. For a word t within ``WINDOW`` words of an entity of class c,
over all documents, with n(t, c) documents that hold both near each other and n(t), n(c) documents that hold either:

* point-wise mutual information: log2(N n(t, c) / (n(t) n(c)));
* information of c: log2(N / n(c)).

Their ratio says which part of c's information t discloses; 1 means that t gives c away. A word with a
ratio of at least ``DISCLOSURE`` that stands near c in at least ``SUPPORT`` different surroundings discloses
c, and all its places in documents that hold c become ``term`` spans. Surroundings are told apart by a hash of
their words without entities, so copies alone support nothing. Words of under ``MIN_LETTERS`` letters, and those with anything but letters in them, are never taken as disclosing: they
are articles, numbers and parts of entities, which stand everywhere.

Counts cover all documents. The first pass reads each whole text once and keeps little beside spans, and of texts that have some their words: these bound from below how
many documents hold a word. Words that can still reach the threshold are counted over all documents by a second pass, and where any word discloses a class, a last one lists its
places in all texts that hold the class, however far apart. Counts are combined by batch and task before they shuffle, also those of kinds, which all entities share. Candidate
words and tellings are sent to the workers where they take up to ``held_bytes`` and joined beyond.

Sanitising generalises a span to its kind (``[EMAIL]``) and removes disclosing terms or, with
``generalise``, replaces them by ``[TERM]``.

Defined results: null and empty texts have no spans; rows that repeat each get their spans, whatever their ids; an empty
table gives no rows. Only the id and text columns are read; no column name clashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, fresh_name, join_spread, materialize, table
from .wordhash import words

KINDS = ("email", "ip", "card", "phone", "secret", "term")
WINDOW, SUPPORT, DISCLOSURE, MIN_LETTERS = 5, 4, 0.9, 4
#: A secret's least number of characters, of its letters and digits each, and bits a character.
SECRET_CHARS, SECRET_EACH, SECRET_BITS = 20, 4, 3.0
HELD_BYTES = 32 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, so looking behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SECRET = re.compile(rf"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{{{SECRET_CHARS},}}")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[Span]:
    """Spans in code points, by start and then kind."""
    if not text:
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def bits(text: str) -> float:
    """Shannon entropy of the characters, in bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def secret_spans(text: str | None, base: list[Span]) -> list[Span]:
    """Runs that look drawn at random, apart from base spans."""
    out = []
    for m in _SECRET.finditer(text or ""):
        run = m[0].strip("=-/+_")
        letters = sum(c.isalpha() for c in run)
        digits = sum(c.isdigit() for c in run)
        a = m.start() + m[0].index(run) if run else m.start()
        b = a + len(run)
        if len(run) >= SECRET_CHARS and min(letters, digits) >= SECRET_EACH and bits(run) >= SECRET_BITS and not any(x < b and a < y for _, x, y in base):
            out.append(("secret", a, b))
    return out


def protected_spans(text: str | None) -> list[Span]:
    base = base_spans(text)
    return sorted(base + secret_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> int:
    """A number for the entity: case, spaces and punctuation of numbers don't matter."""
    plain = value.lower() if kind in ("email", "ip", "near", "kind") else value if kind == "secret" else "".join(_DIGITS.findall(value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode("utf-8", "replace")) - (1 << 63)


#: The classes that all entities of a kind share.
KIND_CLASSES = {k: entity("kind", k) for k in KINDS[:-1]}


def classes(text: str, spans: list[Span]) -> set[int]:
    return {x for k, a, b in spans for x in (entity(k, text[a:b]), KIND_CLASSES[k])}


def _words_and_spans(text: str, spans: list[Span]) -> tuple[list[tuple[str, int, int]], np.ndarray, list[tuple[int, int]]]:
    """The words with their places, which of them lie in spans, and each span's range of words."""
    w = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([x[1] for x in w], np.int64)
    inside = np.zeros(len(w), bool)
    bounds = []
    for _, a, b in spans:
        i, j = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))
        inside[i:j] = True
        bounds.append((i, j))
    return w, inside, bounds


def _may_tell(word: str) -> bool:
    return len(word) >= MIN_LETTERS and word.isalpha()


def near_terms(text: str, spans: list[Span], window: int = WINDOW) -> set[tuple[int, str, int]]:
    """(class, word, hash of the surroundings) triples within the window."""
    w, inside, bounds = _words_and_spans(text, spans)
    out = set()
    for (kind, a, b), (i, j) in zip(spans, bounds, strict=True):
        around = [k for k in (*range(max(0, i - window), i), *range(j, min(len(w), j + window))) if not inside[k]]
        c = entity("near", " ".join(w[k][0] for k in around))
        for k in around:
            if _may_tell(w[k][0]):
                out |= {(entity(kind, text[a:b]), w[k][0], c), (KIND_CLASSES[kind], w[k][0], c)}
    return out


def term_places(text: str, spans: list[Span], terms: set[str] | None = None) -> list[Span]:
    """All places in the text, outside spans, of ``terms``, or of every word that could be one."""
    w, inside, _ = _words_and_spans(text, spans)
    return [(t, a, b) for k, (t, a, b) in enumerate(w) if (t in terms if terms is not None else _may_tell(t)) and not inside[k]]


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


_FOUND = "row long, doc_id long, key long, spans array<struct<kind:string,start:long,end:long>>, classes array<long>, pairs array<struct<e:long,t:string,c:long,one:int>>, words array<string>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PAIRS = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.string()), ("c", pa.int64()), ("one", pa.int32())]))


def _scan(window: int):
    """row, doc_id, text -> ``_FOUND``. ``one`` is 1 in one triple of each class and word, so its sum counts documents; words
    are those that may tell, of documents with spans."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("spans", _SPANS), ("classes", pa.list_(pa.int64())), ("pairs", _PAIRS), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for value in batch.column(2):
                text = value.as_py() or ""
                spans = protected_spans(text)
                out["key"].append(_key(text))
                out["spans"].append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                out["classes"].append(sorted(classes(text, spans)) if spans else [])
                pairs, before = [], None
                for e, t, c in sorted(near_terms(text, spans, window)) if spans else ():
                    pairs.append({"e": e, "t": t, "c": c, "one": int((e, t) != before)})
                    before = e, t
                out["pairs"].append(pairs)
                out["words"].append(sorted(t for w in set(words(text.lower())) if _may_tell(t := w.decode("utf-8", "replace"))) if spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(out[f.name], f.type) for f in list(schema)[2:])], schema=schema)

    return run


def _told_places(docs: DataFrame, telling: DataFrame, held_bytes: int) -> DataFrame:
    """key, start, end: all places of a telling word in the texts that hold its class anywhere. A pass over
    the texts, with the tellings sent to the workers where they take up to ``held_bytes`` and joined beyond."""
    spark = docs.sparkSession
    size = telling.agg(F.coalesce(F.sum(F.octet_length("t") + 200), F.lit(0)).alias("b")).first()["b"]
    if not size:
        return spark.createDataFrame([], "key long, start long, end long")
    held = None
    if size <= held_bytes:
        of: dict[int, set[str]] = defaultdict(set)
        for r in telling.collect():
            of[r["e"]].add(r["t"])
        held = spark.sparkContext.broadcast(dict(of))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, set[int], str, list[Span]]]:
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                if spans := protected_spans(text):
                    yield _key(text), classes(text, spans), text, spans

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for key, es, text, spans in texts(batches):
            if terms := set().union(*(held.value.get(e, ()) for e in es)):
                out += [(key, a, b) for _, a, b in term_places(text, spans, terms)]
            if len(out) >= 10_000:
                yield rows(out, "key start end")
                out = []
        yield rows(out, "key start end")

    def held_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, es, _, _ in texts(batches):
            yield rows([(key, e) for e in es], "key e")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, text, spans in texts(batches):
            yield rows([(key, *p) for p in term_places(text, spans)], "key t start end")

    def rows(out: list[tuple], names: str) -> pa.RecordBatch:
        n = names.split()
        columns = zip(*out, strict=True) if out else [()] * len(n)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x == "t" else pa.int64()) for c, x in zip(columns, n, strict=True)], names=n)

    text = docs.select("text")
    if held:
        return text.mapInArrow(told, "key long, start long, end long").distinct()
    # places of words are joined by text and word, so the texts of a kind aren't one task
    own = text.mapInArrow(held_classes, "key long, e long").distinct()
    words_of = text.mapInArrow(places, "key long, t string, start long, end long").distinct()
    tell = telling.groupBy("t").agg(F.collect_set("e").alias("es"))  # classes of a word
    of_text = own.groupBy("key").agg(F.collect_set("e").alias("own"))  # classes of a text
    # a telling word that most texts hold is many tasks
    return join_spread(materialize(words_of, "word-places"), tell, ["t"]).join(of_text, "key").where(F.arrays_overlap("es", "own")).select("key", "start", "end")


def _document_frequency(docs: DataFrame, terms: DataFrame, held_bytes: int) -> DataFrame:
    """t, n_t: documents that hold each of ``terms``."""
    spark = docs.sparkSession
    size = terms.agg(F.coalesce(F.sum(F.octet_length("t") + 80), F.lit(0)).alias("b")).first()["b"]
    held = spark.sparkContext.broadcast(frozenset(r["t"].encode() for r in terms.collect())) if size <= held_bytes else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for value in batch.column(0):
                own = set(words((value.as_py() or "").lower()))
                found.update(own & held.value if held else own)
            yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["t", "n"])

    each = docs.select("text").mapInArrow(run, "t string, n long")
    each = each if held else each.join(terms, "t", "left_semi")
    return each.groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosing(found: DataFrame, docs: DataFrame, support: int, disclosure: float, held_bytes: int) -> DataFrame:
    """e, t, ratio: the words that disclose a class. found: as written by the first pass."""
    held = found.where(F.size("spans") > 0)
    near = held.select(F.explode("pairs").alias("p")).groupBy("p.e", "p.t", "p.c").agg(F.sum("p.one").alias("n")).groupBy("e", "t").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("near"))
    near = near.where(F.col("near") >= support).select("e", "t", "n_te")
    counts = held.select(F.explode("classes").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    counts = materialize(counts.join(near.select("e").distinct(), "e", "left_semi"), "counts")
    total = F.lit(float(found.count()))
    # the few classes of kinds, which most words are near, go by broadcast
    of_kind = F.col("e").isin(list(KIND_CLASSES.values()))
    each = near.where(of_kind).join(F.broadcast(counts.where(of_kind)), "e").unionByName(near.where(~of_kind).join(counts.where(~of_kind), "e")).where(F.col("n_e") < total)
    ratio = lambda n: F.log2(total * F.col("n_te") / (n * F.col("n_e"))) / F.log2(total / F.col("n_e"))
    # A word is in at least as many documents as in those with spans: few words can still reach the threshold, and only theirs are counted over all.
    beside = held.select(F.explode("words").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_beside"))
    able = materialize(each.join(beside, "t").where(ratio(F.col("n_beside")) >= disclosure).drop("n_beside"), "able")
    frequency = _document_frequency(docs, able.select("t").distinct(), held_bytes)
    return able.join(frequency, "t").select("e", "t", ratio(F.col("n_t")).alias("ratio")).where(F.col("ratio") >= disclosure)


def _found(d: DataFrame, window: int, support: int, disclosure: float, held_bytes: int) -> DataFrame:
    """d: row, doc_id, text -> row, doc_id, base, spans."""
    found = materialize(d.mapInArrow(_scan(window), _FOUND), "spans")
    telling = materialize(disclosing(found, d, support, disclosure, held_bytes).select("e", "t"), "telling")
    places = _told_places(d, telling, held_bytes)
    terms = places.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("terms"))
    held = found.where(F.size("spans") > 0)
    base = F.filter("spans", lambda s: s["kind"] != "secret").alias("base")
    all_spans = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast("array<struct<kind:string,start:long,end:long>>"))), _by_start)
    spanless = found.where(F.size("spans") == 0).select("row", "doc_id", F.col("spans").alias("base"), "spans")  # most rows, and no part of the join
    return held.join(terms, "key", "left").select("row", "doc_id", base, all_spans.alias("spans")).unionByName(spanless)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, base (spans by the base patterns) and spans (with secrets and disclosing terms)."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.lit(0).cast("long").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _found(d, window, support, disclosure, held_bytes).drop("row")


def _by_start(a, b):
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(order(a["start"], b["start"]), order(rank(a), rank(b)), order(a["end"], b["end"]), F.lit(0))


def sanitise(docs: DataFrame, *, text_col: str = "text", generalise: bool = False, window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs`` with spans generalised to their kind and disclosing terms removed or generalised; each row is treated by itself."""
    bound_batches(docs.sparkSession)
    row, spans_of, columns = fresh_name(docs, "row"), fresh_name(docs, "spans"), docs.columns
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    d = rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = _found(d, window, support, disclosure, held_bytes).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans_of))

    @F.pandas_udf("string")
    def masked(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None else mask(t, [(x["kind"], x["start"], x["end"]) for x in s], generalise))

    text = F.col(f"`{text_col}`")
    joined = rows.join(spans, row, "left")
    return joined.withColumn(text_col, F.when(F.col(spans_of).isNull(), text).otherwise(masked(text, F.col(spans_of)))).select(*(f"`{c}`" for c in columns))


def mask(text: str, spans: list[Span], generalise: bool = False) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], "" if kind == "term" and not generalise else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
