"""Weighted BM25 search over an inverted index.

The index has two tables. Postings hold a row for each term of each column of a message, with its positions, dealt by ranges of the term and the message and sorted by
it, so a query's term or prefix skips files' row groups. Lengths hold a row a message. ``build_index`` writes both; queries then read only the postings of their
terms, without Python. ``without_messages`` and ``with_messages`` keep an index up to date by message key. Statistics (documents, mean length, document
frequency) are over all accounts; the account filter applies to hits only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import places, tokens
from ..functions.text import project_body, project_recipients
from ..scratch import bound_batches, written

# Column weights, BM25 constants, query synonyms.
WEIGHTS = {"subject": 10.0, "sender": 8.0, "recipients": 4.0, "body": 1.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SYNONYMS = {
    "invoice": ("receipt", "bill"),
    "receipt": ("invoice", "bill"),
    "bill": ("invoice", "receipt"),
    "flight": ("airfare", "itinerary"),
    "airfare": ("flight", "itinerary"),
    "refund": ("reimbursement", "credit"),
}
KEY = ["account", "message_id"]
#: Postings and positions from which a task hands on what it has located.
LOCATED_ROWS, LOCATED_PLACES = 1 << 15, 1 << 17


@dataclass(frozen=True)
class Phrase:
    """Consecutive stems; with ``prefix`` the last may go on."""

    terms: tuple[str, ...]
    prefix: bool


def expand(terms: list[str]) -> list[str]:
    """Each term and its synonyms, once each, in order."""
    out: dict[str, str] = {}
    for t in terms:
        for x in (t, *SYNONYMS.get(t.lower(), ())):
            out.setdefault(x.lower(), x)
    return list(out.values())


def match_expression(terms: list[str], synonyms: bool = False) -> str:
    """The query as text: quoted prefix terms, any of which may match."""
    clean = [t.strip() for t in (expand(terms) if synonyms else terms)]
    return " OR ".join('"{}"*'.format(t.replace('"', '""')) for t in clean if t)


def parse(query: str, synonyms: bool = False, prefix: bool = True, stemmed: bool = True) -> list[Phrase]:
    terms = query.split()
    found = (tuple(tokens(t, stemmed)) for t in (expand(terms) if synonyms else terms))
    return list(dict.fromkeys(Phrase(t, prefix) for t in found if t))


def search_row(messages: DataFrame) -> DataFrame:
    """The four searched columns; the body only while it is held."""
    body = F.when(F.col("body_state") == "full", F.col("body_text"))
    summary = F.col("summary_text") if "summary_text" in messages.columns else F.lit(None).cast("string")
    return messages.select(
        *KEY, F.col("subject"), F.col("from_addr").alias("sender"), project_recipients(F.col("to_addr"), F.col("cc_addr")).alias("recipients"),
        project_body(F.col("snippet"), body, summary).alias("body"),
    )


@dataclass(frozen=True)
class SearchIndex:
    """postings: account, message_id, col, term, positions. lengths: account, message_id, length (tokens of the whole row)."""

    postings: DataFrame
    lengths: DataFrame

    def hits(self, phrases: list[Phrase], k: int | None = None, account: str | None = None) -> DataFrame:
        """account, message_id, score of all hits; an index that finds the ``k`` best without scoring all may give those and their ties only."""
        found = bm25(self, phrases)
        return found.where(F.col("account") == account) if account else found


POSTINGS = "account string, message_id string, col string, term string, positions array<int>"
LENGTHS = "account string, message_id string, length bigint"


#: ``doc`` numbers the messages; ``f`` is the message's count of the term over all columns, weighted, ``lead`` marks one row of each message and term; rows without a term hold the message's length.
LOCATED = "account string, message_id string, doc bigint, col string, term string, positions array<int>, f double, lead boolean, length bigint"


def _located(stemmed: bool):
    """account, message_id and the searched columns -> ``LOCATED``, in batches of a bounded size, whatever that of the input's is."""
    import pyarrow as pa
    from pyspark import TaskContext

    schema = pa.schema([
        ("account", pa.string()), ("message_id", pa.string()), ("doc", pa.int64()), ("col", pa.string()), ("term", pa.string()), ("positions", pa.list_(pa.int32())),
        ("f", pa.float64()), ("lead", pa.bool_()), ("length", pa.int64()),
    ])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            row, doc, col, term, flat, ends, f, lead, total = out = [], [], [], [], [], [0], [], [], []

            def handed(batch=batch, out=out):
                row, doc, col, term, flat, ends, f, lead, total = out
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                keys = (batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(KEY)))
                done = pa.RecordBatch.from_arrays([*keys, pa.array(doc, pa.int64()), pa.array(col, pa.string()), pa.array(term, pa.string()), positions, pa.array(f, pa.float64()), pa.array(lead, pa.bool_()), pa.array(total, pa.int64())], schema=schema)
                for own in out:
                    own.clear()
                ends.append(0)
                return done

            for i in range(batch.num_rows):
                if len(row) >= LOCATED_ROWS or len(flat) >= LOCATED_PLACES:
                    yield handed()
                found = [(name, places(values[i].as_py(), stemmed)) for name, values in zip(WEIGHTS, batch.columns[len(KEY) :], strict=True)]
                length = sum(len(at) for _, own in found for at in own.values())
                if not length:
                    continue
                weighted: dict[str, float] = {}
                for name, own in found:
                    for t, at in own.items():
                        weighted[t] = weighted.get(t, 0.0) + WEIGHTS[name] * len(at)
                led = set()
                rows = [(name, t, at) for name, own in found for t, at in own.items()]
                for name, t, at in [*rows, (None, None, ())]:
                    row.append(i)
                    doc.append(number)
                    col.append(name)
                    term.append(t)
                    flat += at
                    ends.append(len(flat))
                    f.append(weighted.get(t))
                    lead.append(t not in led)
                    total.append(length)
                    led.add(t)
                number += 1
            yield handed()

    return run


def _in_runs(run):
    """What ``run`` gives, sorted by term and message in runs of about ``LOCATED_ROWS``: rows of one term that lie together shrink where they are written and dealt.
    Of a message's rows only that with its length names it; the others have its number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def sort(held):
        table = pa.Table.from_batches(held)
        at = table.schema.get_field_index("message_id")
        named = pc.if_else(pc.is_null(table["term"]), table["message_id"], pa.scalar(None, pa.string()))
        return table.set_column(at, table.schema.field(at), named).sort_by([("term", "ascending"), ("doc", "ascending")]).to_batches()

    def runs(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= LOCATED_ROWS:
                yield from sort(held)
                held, n = [], 0
        if held:
            yield from sort(held)

    return runs


def located(rows: DataFrame, stemmed: bool = True, in_runs: bool = False) -> DataFrame:
    bound_batches(rows.sparkSession)
    run = _located(stemmed)
    return rows.select(*KEY, *WEIGHTS).mapInArrow(_in_runs(run) if in_runs else run, LOCATED)


def index_of(rows: DataFrame, stemmed: bool = True) -> SearchIndex:
    """The index of ``rows``, tokenised once into a written table."""
    t = written(located(rows, stemmed), "located")
    return SearchIndex(by_term(t.where("term is not null").select(*KEY, "col", "term", "positions")), t.where("term is null").select(*KEY, "length"))


def by_term(postings: DataFrame) -> DataFrame:
    """Dealt by ranges of (term, message), so that a common term is many tasks' and files'."""
    return postings.repartitionByRange("term", *KEY).sortWithinPartitions("term")


def build_index(rows: DataFrame, stemmed: bool = True) -> SearchIndex:
    """Written to the shared folder."""
    ix = index_of(rows, stemmed)
    return SearchIndex(written(ix.postings, "postings"), written(ix.lengths, "lengths"))


def without_messages(index: SearchIndex, keys: DataFrame) -> SearchIndex:
    """The index without the messages of ``keys`` (account, message_id)."""
    gone = keys.select(*KEY).distinct()
    return SearchIndex(index.postings.join(gone, KEY, "left_anti"), index.lengths.join(gone, KEY, "left_anti"))


def with_messages(index: SearchIndex, rows: DataFrame, stemmed: bool = True) -> SearchIndex:
    """The index with ``rows`` in place of what it had of their messages; read as both are, nothing is dealt or written anew but ``rows``."""
    kept, new = without_messages(index, rows), index_of(rows, stemmed)
    return SearchIndex(kept.postings.unionByName(new.postings), kept.lengths.unionByName(new.lengths))


def term_matches(term: Column, text: str, prefix: bool) -> Column:
    return term.startswith(text) if prefix else term == text


def phrase_counts(index: DataFrame, phrase: Phrase) -> DataFrame:
    """account, message_id, col, n: places of the phrase. index: postings."""
    steps = [(t, phrase.prefix and i == len(phrase.terms) - 1) for i, t in enumerate(phrase.terms)]
    if len(steps) == 1:
        hit = index.where(term_matches(F.col("term"), *steps[0]))
        return hit.groupBy(*KEY, "col").agg(F.sum(F.size("positions")).cast("long").alias("n"))
    out = None
    for i, (t, p) in enumerate(steps):
        shift = F.lit(i)
        at = index.where(term_matches(F.col("term"), t, p)).select(*KEY, "col", F.explode(F.transform("positions", lambda x: x - shift)).alias("start")).distinct()
        out = at if out is None else out.join(at, [*KEY, "col", "start"])
    return out.groupBy(*KEY, "col").agg(F.count(F.lit(1)).alias("n"))


def bm25(index: SearchIndex, phrases: list[Phrase], n_docs: DataFrame | None = None) -> DataFrame:
    """account, message_id, score; smaller is better. n_docs: one row (n, avgdl), taken from the index if absent."""
    lengths, index = index.lengths, index.postings
    if not phrases:
        return index.select(*KEY, F.lit(0.0).alias("score")).limit(0)
    stats = n_docs if n_docs is not None else lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))
    parts = None
    weight = F.coalesce(*(F.when(F.col("col") == c, w) for c, w in WEIGHTS.items()))
    for i, p in enumerate(phrases):
        f = phrase_counts(index, p).groupBy(*KEY).agg(F.sum(weight * F.col("n")).alias("f")).withColumn("phrase", F.lit(i))
        parts = f if parts is None else parts.unionByName(f)
    frequency = parts.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_i"))
    scored = parts.join(F.broadcast(frequency), "phrase").join(lengths, KEY).crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("n_i") + 0.5) / (F.col("n_i") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return scored.groupBy(*KEY).agg((-F.sum(part)).alias("score"))


def search(messages: DataFrame, index: SearchIndex, query: str, *, synonyms: bool = True, account: str | None = None, limit: int | None = 15, stemmed: bool = True) -> DataFrame:
    """The best ``limit`` hits, or all of them where it is None. index: or anything with ``hits``."""
    out = messages.join(index.hits(parse(query, synonyms, True, stemmed), limit, account), KEY)
    out = out.orderBy("score", F.col("internal_date").desc_nulls_last(), "message_id")
    return out if limit is None else out.limit(limit)


def keyword_search(messages: DataFrame, index: SearchIndex, keywords: list[str], since: int | None = None, limit: int = 25, stemmed: bool = True) -> DataFrame:
    """Whole words, no prefix, no synonyms; the newest first."""
    found = None
    for k in keywords:
        if terms := tuple(tokens(k, stemmed)):
            hit = phrase_counts(index.postings, Phrase(terms, False)).select(*KEY)
            found = hit if found is None else found.union(hit)
    m = messages.limit(0) if found is None else messages.join(found.distinct(), KEY, "left_semi")
    if since is not None:
        m = m.where(F.col("internal_date") >= since)
    return m.orderBy(F.col("internal_date").desc_nulls_last(), "message_id").limit(limit)
