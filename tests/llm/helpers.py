"""Fixtures and brute-force versions for the training-data operators."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def docs(spark, *texts, lang="en"):
    """doc_id, text, lang, source, n_chars; ids from 0."""
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i % 977} and-{i}" for i in range(20_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \t\n", "en", "s", 3), (3, long, "en", "s", len(long)), (4, "one two three", None, "s", 13), (4, "one two three", None, "s", 13),
        (5, "ONE two, three", "de", None, 14), (None, "no id here at all", "en", "s", 17), (6, "é" * 50 + " ΣΑΣ <|endoftext|> \x00 ퟿ x", "fr", "s", 80), (7, "a\n\na\nb\r\nB \n", "es", "s", 11),
    ]
    extra = [(*r, "x", 1, [1], 0.5, "t") for r in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, block int, bands array<int>, score double, n_lines string")


def empty(df):
    return df.limit(0)


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(texts, threshold=0.8):
    """links and smallest id of the group, for texts by id."""
    sets = [shingle_set(t) for t in texts]
    links, low = [0] * len(texts), list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return links, [root(i) for i in range(len(texts))]
