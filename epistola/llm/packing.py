"""Harmonic packing of token sequences (op4).

A document's token ids, ended by one end id, are cut into pieces and the pieces are packed into
sequences of ``capacity`` tokens. Piece lengths fall into reciprocal-capacity classes: class k holds
lengths in (capacity / (k + 1), capacity / k], and a sequence of class k takes exactly k pieces. Each
worker fills the sequences of each class on its own, so packing needs no shuffle and no state that
grows with the input: at most one open sequence a class, about ``2 * sqrt(capacity)`` of them.

Cutting: whole sequences go off the front of a long document. A rest that would waste more than
``slack`` of its class's slot gives its front to an exactly fitting slot of the next class; what is
left over is treated alike. Sequences still open at the end of a task are refilled by first fit,
longest piece first.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an
empty table gives no rows; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import keep, table

CAPACITY, END_ID, SLACK = 2048, 1, 1 / 64
#: Distinct chunks whose ids a worker remembers, in each of two generations: those of the younger one and those
#: that were met again since the older one was young.
REMEMBERED_CHUNKS = 350_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer file says whose pre-tokens are runs of letters, single digits or other visible characters, lower-cased after NFC.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _by_chunks(config: dict) -> bool:
    """Whether a tokenizer's file says that texts may be encoded chunk by chunk and that a run of letters ends with one ``</w>``."""
    pre = config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or []
    plain = len(steps) == 2 and steps[0] == _SPLIT and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    own = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in config.get("added_tokens") or [])
    return config.get("normalizer") == _NORMALIZER and plain and own and config["model"].get("end_of_word_suffix") == "</w>" and not config.get("truncation") and not config.get("padding")


def _is_word(chunk: str) -> bool:
    """All letters, also after normalisation and lower-casing, which makes letters and marks of some capitals."""
    return chunk.isalpha() and (chunk.isascii() or unicodedata.normalize("NFC", chunk).lower().isalpha())


class ChunkTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    Where the file says that its pre-tokenizer never joins characters across white space (see ``_by_chunks``), the ids of a text are
    those of its chunks between spaces and line ends, one after another; chunks repeat, and their ids
    are remembered. With any other tokenizer, texts are encoded whole.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self._remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._chunked = _by_chunks(json.load(f))
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._chunked:
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # Lower-casing first lets more chunks repeat. Not where Python's lower case depends on a letter's
        # neighbours, where special tokens may stand, or where normalisation would change letters before or after it.
        if "<|" not in text:
            if text.isascii():
                text = text.lower()
            elif "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low := text.lower()):
                text = low
        chunks = text.replace("\n", " ").split(" ")
        distinct = set(chunks)
        if len(self._known) > (self._remembered or REMEMBERED_CHUNKS):
            self._older, self._known = self._known, {"": b""}
        known, older = self._known, self._older
        if missing := distinct.difference(known):
            if older and (again := [c for c in missing if c in older]):
                known.update((c, older[c]) for c in again)
                missing.difference_update(again)
            if missing:
                self._learn(list(missing))
        return b"".join(map(known.__getitem__, chunks))

    def _learn(self, chunks: list[str]) -> None:
        """Most chunks are letters, with or without a full stop or comma, which is a token of its own."""
        known, letters, ended, rest = self._known, [], [], []
        for c in chunks:
            if _is_word(c):
                letters.append(c)
            elif c[-1] in ".," and _is_word(c[:-1]):
                ended.append(c)
            else:
                rest.append(c)
        if new := {c[:-1] for c in ended}.difference(known, letters):
            letters += new
        if letters and not self._learn_letters(letters):
            rest += letters
        rest += {c[-1] for c in ended}.difference(known)
        for c, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[c] = array("I", e.ids).tobytes()
        for c in ended:
            known[c] = known[c[:-1]] + known[c[-1]]

    def _learn_letters(self, chunks: list[str]) -> bool:
        """A run of letters is one pre-token, so its ids end with the first that ends a word: all are encoded at once."""
        ids = np.array(self._tokenizer.encode(" ".join(chunks), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self._ends_word[ids]) + 1
        if len(ends) != len(chunks):
            return False
        raw, start = ids.tobytes(), 0
        for c, end in zip(chunks, (4 * ends).tolist(), strict=True):
            self._known[c] = raw[start:end]
            start = end
        return True


def tokenizer(path: str, remembered: int | None = None) -> ChunkTokenizer:
    """One for each worker process, until a task of another operator runs there: what it remembers takes up to about 150 MB."""
    return keep((ChunkTokenizer, path, remembered), lambda: ChunkTokenizer(path, remembered))


def cut(tokens: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``tokens`` tokens, in its order."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= slack * slot or slot < 32:
            pieces.append(rest)
            break
        head = capacity // (k + 1)
        pieces.append(head)
        rest -= head
    return pieces


class HarmonicPacker:
    """Places pieces; ``add`` and ``finish`` return placements (piece, sequence, offset) of closed sequences."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self._open: dict[int, list[tuple[int, object]]] = {}

    def _close(self, pieces: list[tuple[int, object]]) -> list[tuple[object, int, int]]:
        out, offset = [], 0
        for length, piece in pieces:
            out.append((piece, self.sequences, offset))
            offset += length
        self.sequences += 1
        return out

    def add(self, length: int, piece: object) -> list[tuple[object, int, int]]:
        k = self.capacity // length
        if k == 1:
            return self._close([(length, piece)])
        pieces = self._open.setdefault(k, [])
        pieces.append((length, piece))
        return self._close(self._open.pop(k)) if len(pieces) == k else []

    def finish(self) -> list[tuple[object, int, int]]:
        left = sorted((p for pieces in self._open.values() for p in pieces), key=lambda p: -p[0])
        self._open = {}
        bins: list[list[tuple[int, object]]] = []
        room: list[int] = []
        for length, piece in left:
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                bins.append([])
                room.append(self.capacity)
                at = len(bins) - 1
            bins[at].append((length, piece))
            room[at] -= length
        return [x for pieces in bins for x in self._close(pieces)]


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``with_ids``, its ids as little-endian unsigned 32-bit integers. Sequence ids are unique over the
    result: the partition's number and a count within it. A task that runs again gives the same rows. remembered: chunks that a
    worker remembers in place of ``REMEMBERED_CHUNKS``; fewer take less memory and more time, and give the same rows."""
    path = tokenizer_path or default_tokenizer()
    end = end_id.to_bytes(4, "little")
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def rows(placed: list[tuple[tuple, int, int]], base: int) -> list[tuple]:
        return [(*p[:5], base + s, o, *p[5:]) for p, s, o in placed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, base, out = tokenizer(path, remembered), HarmonicPacker(capacity), TaskContext.get().partitionId() << 36, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity, slack):
                    part = ids[4 * start : 4 * (start + length)]
                    out.extend(rows(packer.add(length, (doc, start, length, zlib.crc32(part), n, *[part] * with_ids)), base))
                    start += length
                if len(out) >= 10_000:
                    yield flush()
        out.extend(rows(packer.finish(), base))
        yield flush()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
