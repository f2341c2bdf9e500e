"""Quality rules with distribution divergence from language references (op7), DataFrame functions only.

One pass over each text writes its base measures and how often it has each of its words; everything else is derived from that table. The method then compares two
histograms of a document with its language's reference, by the Jensen-Shannon distance (square root of the divergence to
base 2, from 0 to 1):

* character classes: lower case, upper case, digits, white space, punctuation, symbols, and the bytes
  that non-ASCII characters take beyond one;
* common words: the words, of any length, that make up at least ``COMMON_SHARE`` of all words in their language, and
  one class for the rest. That share bounds their number: 1 / COMMON_SHARE a language. Words are held as 64-bit hashes.

References are sums over all documents of the language. Every language has one but for those with too
little text: under ``MIN_LANGUAGE_CHARS`` no class reference, under ``MIN_LANGUAGE_WORDS`` no common words
(from there on a common word was met ten times at least). Other languages play no part. References that
take up to ``held_bytes`` are broadcast; beyond that, only those of languages with at least
``LANGUAGE_SHARE`` of the corpus's characters are (at most 1 / LANGUAGE_SHARE), and the others are joined by
language. Documents too short for a histogram (``MIN_CHARS``, ``MIN_WORDS``) aren't judged by it.

Per-text work uses let-bindings (``_let``): a lambda's argument is computed once, where an expression
repeated in a lambda would be computed for each element.

Defined results: null text has no words and fails the base rule; an empty table gives no rows; rows
that repeat are judged alike and each returned; a null id changes nothing; a null language isn't judged. Only the id, text and language
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, table

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Character classes of regular expressions: white space; what ends a lower-cased token; what is neither upper case, digit, punctuation nor symbol.
_BLANKS = r"\x20\x09-\x0D"
_ENDS = r"^a-z0-9\x80-\x{10FFFF}"
_PLAIN = r"[a-z\x00-\x20\x7F-\x{10FFFF}]++"
CLASSES = ("lower", "upper", "digit", "blank", "punct", "symbol", "wide")

MIN_BASE_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
MIN_CHARS, MIN_WORDS = 200, 80
MIN_LANGUAGE_CHARS, MIN_LANGUAGE_WORDS = 10_000, 2_500
HELD_BYTES = 32 << 20
#: How the counts of words are written: hashes repeat across documents, so pages have a dictionary of them.
PACKED = {"parquet.dictionary.page.size": str(16 << 20), "compression": "zstd"}
COMMON_SHARE, LANGUAGE_SHARE = 0.004, 0.01
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.29, 0.34


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def words_of(text: Column, blank: str = _BLANKS) -> Column:
    """Maximal runs of characters outside the character class ``blank``."""
    return F.array_remove(F.split(text, f"[{blank}]+", -1), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that are found twice or more in the text, the first time included."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, window))),
        )
        return _let(windows, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.transform(s, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)))

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1), x + window) - x)), F.lit(0).cast("long"), lambda a, x: a + x))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes)


def word_counts(text: Column) -> Column:
    """h (a hash) and n of each lower-cased word, without punctuation and symbols."""

    def of_sorted(s: Column) -> Column:
        # places where a hash is first; numbers, since a struct for each word costs more than the rest
        first = F.array_compact(F.transform(s, lambda h, i: F.when(F.get(s, i - 1) == h, F.lit(None)).otherwise(i)))
        return _let(first, lambda f: F.transform(f, lambda x, i: F.struct(F.get(s, x).alias("h"), (F.coalesce(F.get(f, i + 1), F.size(s)) - x).alias("n"))))

    return _let(F.sort_array(F.transform(words_of(F.lower(text), _ENDS), lambda w: F.xxhash64(w))), of_sorted)


def measures(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, lang, counts (of words), the base measures and character classes."""
    t = F.col("text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{_BLANKS}]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")
    )
    # most of a text is lower case and blanks; the other classes are counted in what is left without them
    of_rest = lambda r: F.struct(*((F.length(r) - _without(r, chars)).cast("long").alias(c) for c, chars in (("symbol", SYMBOLS), ("upper", UPPER), ("digit", DIGITS), ("punct", PUNCTUATION))))
    m = docs.select(
        "doc_id", "lang", word_counts(t).alias("counts"),
        _let(words_of(t), of_words).alias("w"), _let(F.regexp_replace(t, _PLAIN, ""), of_rest).alias("c"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.length(t).cast("long").alias("n_chars"), (F.octet_length(t) - F.length(t)).cast("long").alias("wide"),
    )
    return m.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "counts", "w.n_words", "w.word_chars", F.col("c.symbol").alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", "n_chars", "c.*", "wide",
        (F.col("n_chars") - F.col("w.word_chars")).alias("blank"),
        F.greatest(F.col("w.word_chars") - F.col("c.upper") - F.col("c.digit") - F.col("c.punct") - F.col("c.symbol") - F.col("wide"), F.lit(0)).alias("lower"),
    )


def _part(p: Column, q: Column) -> Column:
    """One class's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(0.0)
    return half(p) + half(q)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


def _bytes(references: DataFrame, *texts: str) -> int:
    """About what a broadcast of ``references`` takes up, counted."""
    size = sum((F.octet_length(c) for c in texts), F.lit(120))
    return references.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def _refer(rows: DataFrame, references: DataFrame, on: list[str], how: str, large: list[str] | None) -> DataFrame:
    """``rows`` joined with references by ``lang`` and more; all are broadcast, or those of the ``large`` languages only."""
    if large is None:
        return rows.join(F.broadcast(references), on, how)
    # rows without a language go with the broadcast, where they make no group
    is_large = F.coalesce(F.col("lang").isin(large), F.lit(True))
    return rows.where(is_large).join(F.broadcast(references.where(is_large)), on, how).unionByName(rows.where(~is_large).join(references.where(~is_large), on, how))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The base measures, base_failed, class_distance, word_distance (null where not judged) and kept."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    m = materialize(measures(d), "measures", **PACKED)

    # references: sums over all documents of a language
    classes = m.where("lang is not null").groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words"), *(F.sum(c).alias(c) for c in CLASSES))
    classes = materialize(classes, "classes")
    all_chars = classes.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("all")).first()["all"] + m.where("lang is null").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("all")).first()["all"]
    large_only = lambda: [r["lang"] for r in classes.where(F.col("chars") >= LANGUAGE_SHARE * max(1, all_chars)).select("lang").collect()]
    large = None if _bytes(classes, "lang") <= held_bytes else large_only()
    total = sum((F.col(c) for c in CLASSES), F.lit(0))
    reference = classes.where(F.col("chars") >= MIN_LANGUAGE_CHARS).select(F.col("lang"), *((F.col(c) / total).alias(f"r_{c}") for c in CLASSES))
    sized = classes.where(F.col("words") >= MIN_LANGUAGE_WORDS).select("lang", "words")
    each = _refer(m.select("row", "lang", "n_words", "counts"), sized.select("lang"), ["lang"], "left_semi", large).select("row", "lang", "n_words", F.explode("counts").alias("c"))
    each = each.select("row", "lang", "n_words", F.col("c.h").alias("word"), F.col("c.n").alias("n"))
    counts = each.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    share = (F.col("n") / F.col("words")).alias("p")
    common = materialize(_refer(counts, sized, ["lang"], "inner", large).select("lang", "word", share).where(F.col("p") >= COMMON_SHARE), "common")
    if large is None and _bytes(common, "lang") > held_bytes:
        large = large_only()
    shares = common.groupBy("lang").agg(F.sum("p").alias("p_common"), F.count(F.lit(1)).alias("n_common"))

    # word histograms of documents, over common words only
    hits = _refer(each, common, ["lang", "word"], "inner", large).withColumn("q", F.least(F.col("n") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0)))
    words = hits.groupBy("row").agg(F.sum(_part(F.col("p"), F.col("q"))).alias("seen"), F.sum("p").alias("p_seen"), F.sum("q").alias("q_seen"))
    n_chars = sum((F.col(c) for c in CLASSES), F.lit(0))
    out = _refer(_refer(m.drop("counts"), reference, ["lang"], "left", large), shares, ["lang"], "left", large).join(words, "row", "left")
    class_distance = _distance(sum((_part(F.col(f"r_{c}"), F.col(c) / n_chars) for c in CLASSES), F.lit(0.0)))
    p_seen, q_seen, seen = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("p_seen", "q_seen", "seen"))
    # a common word that the document lacks adds half its share
    word_distance = _distance(seen + (F.col("p_common") - p_seen) / 2 + _part(F.greatest(1 - F.col("p_common"), F.lit(0.0)), F.greatest(1 - q_seen, F.lit(0.0))))
    base_failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        F.when(F.col("r_lower").isNotNull() & (F.col("n_chars") >= MIN_CHARS), class_distance).alias("class_distance"),
        F.when(F.col("n_common").isNotNull() & (F.col("n_words") >= MIN_WORDS), word_distance).alias("word_distance"),
    )
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return judge(table(spark, sf_dir, "documents")).withColumns(rounded)
