"""N-gram Jaccard self-join by MinHash banding (op1).

1. Each text becomes its set of hashed n-word shingles. Two hashes of the sorted set name its class: texts
   of one class have equal sets and are copies (similarity 1). Classes are counted by one
   combining aggregation, so thousands of copies cost a row a task, and numbered in the order of their smallest id; all
   that follows is on one representative a class. Ids are labels only: nothing is joined by them alone.
2. MinHash values of the set are hashed in bands. Bands and rows are chosen by ``choose_bands`` for
   the recall at the threshold. Representatives shuffle on band hashes; a band hash held by two or more
   makes them candidates.
3. Candidates get a home, the smallest candidate beside them, and large homes are split into blocks of
   bounded total set size by a hash of the class. Blocks that share a band hash are compared: a block
   pair is one row, however many candidate pairs it stands for, and a worker compares the full
   sets of both blocks through an inverted index. So a group of near copies costs rows in proportion
   to blocks squared, no task holds more than two blocks, and no pair is left out. Block pairs of one band hash
   are dealt over tasks by chunks of blocks on either side.
4. Each block pair returns, for each text with links, their number (copies count) and one edge to the
   smallest class of its local group. Edges are joined into groups by ``connected_components``.

The number of links of a text is exact, so a group of g different near copies costs g * g / 2 comparisons of sets, block by block
and in parallel; groups of equal sets cost one.

Result: a row per document: doc_id, class_id (smallest doc_id of its group of linked documents; its
own where it has no link), copy_id (smallest doc_id with an equal set), n_copies (documents of equal set,
itself included), n_links (other documents of similarity at the threshold or above).

Defined results: a text of fewer than n words, but not none, has one shingle, all its words; null and
empty texts and texts without words have no set and no links, not even with each other; each row is a document of its own,
also where ids repeat or are null (a null id is never the smallest; a group of null ids alone has a null class_id); an empty table gives no
rows. Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import bound_batches, fresh_name, join_spread, materialize, release, table, without
from .wordhash import hash_words, mix, shingles

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9998
#: Shingles that a block holds, about: a worker has two blocks at a time.
BLOCK_SHINGLES = 100_000
#: Largest table of candidates' blocks that is sent to the workers; beyond it, texts are joined with it by id.
HELD_BYTES = 64 << 20
#: Blocks of one band hash on either side of a task that pairs them.
PAIRED_BLOCKS = 256
_SALT = np.uint64(0x5851F42D4C957F2D)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands by which a pair at the threshold becomes a candidate with the given probability."""
    hit = threshold**rows
    return int(np.ceil(np.log(1 - recall) / np.log(1 - hit))), rows


def _sets(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run of texts: shingles sorted and distinct within each text, and offsets."""
    for run in hash_words(texts):
        s, offsets = shingles(run, n)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.lexsort((s, text))
        s, text = s[order], text[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
        out = np.zeros(len(offsets), np.int64)
        np.cumsum(np.bincount(text[new], minlength=len(offsets) - 1), out=out[1:])
        yield s[new], out


def _signatures(s: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """Of the sets that aren't empty: their index, size, two set hashes and band hashes."""
    own = np.flatnonzero(np.diff(offsets))
    at = offsets[:-1][own]
    if not len(own):
        return own, own, own, own, np.zeros((0, bands), np.int64)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    band = np.zeros((len(own), bands), np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat((s ^ seeds[k]) * (seeds[k] | np.uint64(1)), at)
        band[:, k // rows] = mix(band[:, k // rows] ^ low)
    h1 = np.add.reduceat(mix(s), at)
    h2 = np.add.reduceat(mix(s ^ _SALT), at)
    return own, np.diff(offsets)[own], h1.view(np.int64), h2.view(np.int64), band.view(np.int64)


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs: row, doc_id, text -> row, doc_id, the set's two hashes and size, and its band hashes."""
    longs = [(c, pa.int64()) for c in ("row", "doc_id", "h1", "h2", "n_shingles")]
    schema = pa.schema([*longs, ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            first = 0
            for s, offsets in _sets(batch.column(2).to_pylist(), n):
                own, size, h1, h2, band = _signatures(s, offsets, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * bands, pa.int32()), pa.array(band.ravel()))
                ids = (batch.column(k).take(pa.array(own + first)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int64()) for c in (h1, h2, size)), lists], schema=schema)
                first += len(offsets) - 1

    return docs.mapInArrow(run, "row long, doc_id long, h1 long, h2 long, n_shingles long, bands array<long>")


_NULL_ID = np.iinfo(np.int64).min


def _packed_sets(n: int, held=None):
    """doc_id, text -> c, copies, block, s: sets of representatives as sorted unsigned 64-bit integers; with ``held``
    (sorted h1, h2, id, c, copies, block). Without it, doc_id, h1, h2, s of every set. A row stands for its class if it has the class's
    smallest id; a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy()
            first = 0
            for s, offsets in _sets(batch.column(1).to_pylist(), n):
                m = len(offsets) - 1
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)]) for x in (s, s ^ _SALT)]
                h1, h2 = ((x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in sums)
                own = ids[first : first + m]
                first += m
                if held:
                    known, k2, kid, *rest = held.value
                    at = np.minimum(np.searchsorted(known, h1), len(known) - 1)
                    # two classes of one h1 stand side by side
                    for step in (0, 1):
                        a = np.minimum(at + step, len(known) - 1)
                        mine = np.flatnonzero((known[a] == h1) & (k2[a] == h2) & (kid[a] == own) & (np.diff(offsets) > 0))
                        mine = np.array([k for k in mine if not (rest[0][a[k]] in seen or seen.add(rest[0][a[k]]))], np.int64)
                        yield _sets_batch(s, offsets, mine, [r[a[mine]] for r in rest], ["c", "copies", "block"])
                else:
                    mine = np.flatnonzero(np.diff(offsets))
                    yield _sets_batch(s, offsets, mine, [own[mine], h1[mine], h2[mine]], ["doc_id", "h1", "h2"])

    return run


def _sets_batch(s: np.ndarray, offsets: np.ndarray, own: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    packed = pa.array([s[offsets[k] : offsets[k + 1]].tobytes() for k in own], pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), packed], names=[*names, "s"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets in ``a`` with those in ``b``, over their common shingles only."""
    sa, sb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(sa, sb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out
    ka, kb = np.isin(sa, common, kind="sort"), np.isin(sb, common, kind="sort")
    ia, ib, ra, rb = np.searchsorted(common, sa[ka]), np.searchsorted(common, sb[kb]), ra[ka], rb[kb]
    step = max(64, 2_000_000 // (len(a) + len(b)))
    for low in range(0, len(common), step):
        xa, xb = (ia >= low) & (ia < low + step), (ib >= low) & (ib < low + step)
        width = min(step, len(common) - low)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ma[ra[xa], ia[xa] - low] = 1
        mb[rb[xb], ib[xb] - low] = 1
        out += ma @ mb.T
    return out


def _links(left: tuple, right: tuple | None, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Of a block, or of two: ids with links, their number of linked documents here, and the smallest id of their local group."""
    ids, copies, sets = left
    other = left if right is None else right
    inter = _overlaps(sets, other[2])
    na, nb = np.array([len(x) for x in sets]), np.array([len(x) for x in other[2]])
    union = na[:, None] + nb[None, :] - inter
    linked = inter >= threshold * union - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
        nodes, weight, degree = np.array(ids), np.array(copies), linked.astype(np.int64) @ np.array(copies)
        x, y = np.nonzero(linked)
    else:
        nodes = np.array([*ids, *other[0]])
        degree = np.concatenate([linked.astype(np.int64) @ np.array(other[1]), linked.T.astype(np.int64) @ np.array(copies)])
        x, y = np.nonzero(linked)
        y = y + len(ids)
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    root = rank.copy()
    while True:  # local groups: the smallest rank that can be reached
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(degree)
    return nodes[own].tolist(), degree[own].tolist(), nodes[order[root[own]]].tolist()


def _unpacked(rows: list) -> tuple[list[int], list[int], list[np.ndarray]]:
    rows = list({r["c"]: r for r in rows}.values())  # rows that repeat id and text give a class more than once
    return [r["c"] for r in rows], [r["copies"] for r in rows], [np.frombuffer(r["s"], np.uint64) for r in rows]


_LINK_SCHEMA = "c long, links long, root long"


def _block_pairs(bucket: DataFrame, most: int) -> DataFrame:
    """x, y (x < y): blocks that share a key. bucket: key, block, distinct and written."""
    sizes = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / most).cast("int").alias("parts"))
    b = bucket.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("block"), "parts").cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = b.select("key", F.col("mine").alias("i"), F.col("theirs").alias("j"), F.col("block").alias("x"))
    y = b.select("key", F.col("theirs").alias("i"), F.col("mine").alias("j"), F.col("block").alias("y"))
    return x.join(y, ["key", "i", "j"]).where("x < y").select("x", "y").distinct()


def _grouped(d: DataFrame, n: int, threshold: float, recall: float, rows: int, block_shingles: int, held_bytes: int, paired_blocks: int) -> DataFrame:
    """d: row, doc_id, text -> row, doc_id, class_id, copy_id, n_copies, n_links and g (a number of the group) of texts with words."""
    bands, rows = choose_bands(threshold, recall, rows)
    spark = d.sparkSession
    # 1. classes of equal sets, numbered by their smallest id
    signed = materialize(_signed(d, n, bands, rows), "signed")
    classes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = materialize(classes.orderBy(F.col("id").asc_nulls_last(), "h1", "h2").withColumn("c", F.monotonically_increasing_id()), "classes")

    # 2. band hashes held by two representatives or more
    keys = classes.select("c", F.posexplode("bands").alias("band", "key")).select("c", F.xxhash64("band", "key").alias("key"))
    shared = keys.groupBy("key").agg(F.min("c").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "low")
    members = materialize(keys.join(shared, "key"), "members")

    # 3. homes and blocks
    homes = members.groupBy("c").agg(F.min("low").alias("home"))
    homes = materialize(homes.join(classes.select("c", "h1", "h2", "id", "n_shingles", "copies"), "c"), "homes")
    wide = homes.groupBy("home").agg(F.sum("n_shingles").alias("total")).select("home", F.ceil(F.col("total") / block_shingles).alias("parts"))
    blocks = join_spread(homes, wide, ["home"]).select("c", "h1", "h2", "id", "copies", F.xxhash64("home", F.pmod(F.xxhash64("c"), "parts")).alias("block"))
    blocks = materialize(blocks, "blocks")
    bucket = materialize(members.select("c", "key").join(blocks.select("c", "block"), "c").select("key", "block").distinct(), "buckets")
    pairs = _block_pairs(bucket, paired_blocks)

    # 4. full sets by block, compared
    text = d.select("doc_id", "text")
    if blocks.count() * 48 <= held_bytes:
        got = blocks.toArrow().sort_by("h1")
        held = spark.sparkContext.broadcast(tuple(got.column(c).fill_null(_NULL_ID).to_numpy() for c in ("h1", "h2", "id", "c", "copies", "block")))
        texts = text.mapInArrow(_packed_sets(n, held if len(got) else None), "c long, copies long, block long, s binary") if len(got) else spark.createDataFrame([], "c long, copies long, block long, s binary")
    else:
        of = blocks.select("h1", "h2", F.coalesce("id", F.lit(int(_NULL_ID))).alias("doc_id"), "c", "copies", "block")
        texts = text.mapInArrow(_packed_sets(n), "doc_id long, h1 long, h2 long, s binary").join(of, ["h1", "h2", "doc_id"]).select("c", "copies", "block", "s")
    members_of = materialize(texts.groupBy("block").agg(F.collect_list(F.struct("c", "copies", "s")).alias("rows")), "sets")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for r in batch.column(0):
                rows_ = r.as_py()
                if len(rows_) > 1:
                    yield _link_batch(*_links(_unpacked(rows_), None, threshold))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                yield _link_batch(*_links(_unpacked(a.as_py()), _unpacked(b.as_py()), threshold))

    beside = pairs.join(members_of.select(F.col("block").alias("x"), F.col("rows").alias("a")), "x").join(members_of.select(F.col("block").alias("y"), F.col("rows").alias("b")), "y")
    links = members_of.select("rows").mapInArrow(within, _LINK_SCHEMA).union(beside.select("a", "b").mapInArrow(across, _LINK_SCHEMA))
    links = materialize(links, "links")
    groups = connected_components(links.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))

    # back to documents; a group's smallest class has its smallest id
    groups = materialize(groups.select(F.col("node").alias("c"), F.col("component").alias("g")), "groups")
    named = join_spread(groups, classes.select(F.col("c").alias("g"), F.col("id").alias("class_id")), ["g"])
    found = links.groupBy("c").agg(F.sum("links").alias("links")).join(named, "c")
    reps = classes.select("c", "h1", "h2", F.col("id").alias("copy_id"), "copies").join(found, "c", "left")
    reps = reps.select("h1", "h2", "copy_id", "copies", F.coalesce("g", "c").alias("g"), F.when(F.col("g").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    linked = join_spread(signed.select("row", "doc_id", "h1", "h2"), reps, ["h1", "h2"])
    return linked.select("row", "doc_id", "class_id", "copy_id", F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "g")


def _options(threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, rows: int = 5, block_shingles: int = BLOCK_SHINGLES, held_bytes: int = HELD_BYTES, paired_blocks: int = PAIRED_BLOCKS) -> dict:
    return {"threshold": threshold, "recall": recall, "n": n, "rows": rows, "block_shingles": block_shingles, "held_bytes": held_bytes, "paired_blocks": paired_blocks}


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """options: threshold, recall, n, rows (of a band), block_shingles, held_bytes, paired_blocks."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.lit(0).cast("long").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    linked = _grouped(d, **_options(**options)).drop("row", "g")
    bare = d.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    one = F.lit(1).cast("long")
    return linked.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), one.alias("n_copies"), (one - 1).alias("n_links")))


def _link_batch(ids: list[int], links: list[int], roots: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], names=["c", "links", "root"])


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the smallest id (a null id being the largest), of rows that
    repeat it one. Rows without words all stay."""
    bound_batches(docs.sparkSession)
    row, columns = fresh_name(docs, "row"), docs.columns
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    d = rows.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    linked = materialize(_grouped(d, **_options(**options)).where("n_links > 0").select("row", "doc_id", "g"), "linked")
    best = linked.groupBy("g").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")).select("row")
    gone = linked.select("row").join(best, "row", "left_anti")
    return without(rows, gone.select(F.col("row").alias("id")), row).select(*(f"`{c}`" for c in columns))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
