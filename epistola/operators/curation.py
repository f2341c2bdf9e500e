"""What users own: curation, keywords, categories, summaries; kept in overlays beside derived tables.

Derived tables are rebuilt from messages and overwritten; overlays are joined when read, so a rebuild can't lose them.
Each function takes the overlay as it is and returns it as it should be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ToolError
from ..functions.text import js_trim
from ..schemas import CURATIONS
from .merge import latest


def _checked(label: str | None) -> str | None:
    if label is not None and label not in CURATIONS:
        raise ToolError(f"curation must be one of {', '.join(CURATIONS)} or null, not {label!r}")
    return label


@dataclass(frozen=True)
class CurationResult:
    contacts: DataFrame
    domains: DataFrame
    profile: DataFrame
    skipped: int


def set_curation(spark: SparkSession, known: DataFrame, contacts: DataFrame, domains: DataFrame, profile: DataFrame, account: str, now_ms: int, *, contact_labels: dict[str, str | None] | None = None, domain_labels: dict[str, str | None] | None = None, keywords: list[str] | None = None) -> CurationResult:
    """All or nothing: labels are checked before anything changes.

    known: contacts as derived (account, address); labels of unknown contacts are skipped and counted. Domains are put in where
    absent. A null label clears. Keywords are replaced only if given.
    """
    for v in (*(contact_labels or {}).values(), *(domain_labels or {}).values()):
        _checked(v)
    skipped = 0
    if contact_labels:
        new = spark.createDataFrame([(account, a.lower(), v, 1) for a, v in contact_labels.items()], "account string, address string, curation string, at int")
        found = new.join(known.select("account", "address").distinct(), ["account", "address"], "left_semi")
        skipped = len(contact_labels) - found.count()
        contacts = latest(contacts.withColumn("at", F.lit(0)).unionByName(found), ["account", "address"], "at").drop("at")
    if domain_labels:
        new = spark.createDataFrame([(account, d.lower(), v) for d, v in domain_labels.items()], "account string, domain string, new string")
        merged = domains.join(new.withColumn("given", F.lit(True)), ["account", "domain"], "full")
        domains = merged.withColumn("curation", F.when(F.col("given"), F.col("new")).otherwise(F.col("curation"))).select(*domains.columns)
    if keywords is not None:
        own = spark.createDataFrame([(account, unique_keywords(keywords), now_ms)], "account string, keywords array<string>, updated_at bigint")
        profile = profile.where(F.col("account") != account).unionByName(own)
    return CurationResult(contacts, domains, profile, skipped)


def unique_keywords(keywords: list[str]) -> list[str]:
    """Trimmed, without blanks, the first of each in any case."""
    out: dict[str, str] = {}
    for k in keywords:
        if k.strip():
            out.setdefault(k.strip().lower(), k.strip())
    return list(out.values())


def get_curation(contacts: DataFrame, domains: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Curated contacts and domains in order of their key, and the keywords."""
    pick = lambda df, key: df.where("curation is not null").select("account", key, "curation").orderBy("account", key)
    return pick(contacts, "address"), pick(domains, "domain"), profile.orderBy("account")


def save_summary(overlay: DataFrame, known: DataFrame, account: str, ident: str, text: str, now_ms: int, key: str = "message_id", by_model: bool = True) -> DataFrame:
    """The overlay with a summary of a known message or thread (``key``); its source columns are never touched."""
    if not text or not text.strip():
        raise ToolError("a summary must not be blank")
    if known.where((F.col("account") == account) & (F.col(key) == ident)).limit(1).count() == 0:
        raise ToolError(f"no {key} {account}:{ident}")
    row = overlay.sparkSession.createDataFrame([(account, ident, text.strip(), by_model, now_ms)], f"account string, {key} string, summary_text string, summary_is_model boolean, summarized_at bigint")
    return overlay.where((F.col("account") != account) | (F.col(key) != ident)).unionByName(row)


def save_domain_category(overlay: DataFrame, account: str, domain: str, category: str, now_ms: int, note: str | None = None) -> DataFrame:
    """Any category; a note that isn't given keeps the one before."""
    if not category or not category.strip() or not domain.strip():
        raise ToolError("domain and category must not be blank")
    name = domain.strip().lower()
    row = overlay.sparkSession.createDataFrame([(account, name, category.strip(), note.strip() if note else None, now_ms)], "account string, domain string, c string, n string, t bigint")
    merged = overlay.join(row, ["account", "domain"], "full")
    return merged.select(
        "account", "domain", "curation", F.coalesce("c", "category").alias("category"), F.coalesce("n", "category_note").alias("category_note"), F.coalesce("t", "categorized_at").alias("categorized_at")
    ).select(*overlay.columns)


def with_overlay(derived: DataFrame, overlay: DataFrame, key: list[str], keep_orphans: bool = False) -> DataFrame:
    """A derived table with its user-owned columns; with ``keep_orphans`` also overlay rows that nothing derives any more."""
    own = [c for c in overlay.columns if c not in key]
    left = derived.drop(*[c for c in own if c in derived.columns])
    return left.join(overlay.select(*key, *own), key, "full" if keep_orphans else "left")


def apply_decisions(decisions: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A curation session as a table. decisions: account, address, answer. A blank answer takes the suggestion;
    i, m, b and k, or whole words, are important, muted, blocked and keep (null); q and all after it, by ``n``, count for nothing."""
    stop = decisions.where(F.lower(js_trim(F.col("answer"))).isin("q", "quit")).groupBy("account").agg(F.min("n").alias("stop"))
    d = decisions.join(stop, "account", "left").where("stop is null or n < stop").join(suggestions.select("account", "address", "suggested"), ["account", "address"])
    a = F.lower(js_trim(F.coalesce("answer", F.lit(""))))
    choice = F.when(a == "", F.col("suggested"))
    for word in CURATIONS:
        choice = F.when(a.isin(word, word[0]), word).otherwise(choice)
    return d.select("account", "address", choice.alias("curation")).where(F.col("curation").isin(*CURATIONS) | F.col("curation").isNull())
