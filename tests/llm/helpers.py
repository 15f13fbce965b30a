"""Awkward documents: nulls anywhere, empty and long texts, repeated rows, and columns that clash with working names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, hi string, seed string, w string, h int, _q string, _masked string, root string"
CLASH = ("k1", "hi", "seed", "w", 3, "q", "m", "r")


def prose(n, seed=0, words=4000):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *CLASH) for i, t in rows], DOCS)


def awkward():
    long = prose(30_000, 9)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, prose(80, 1)), (None, None), (5, prose(80, 2)), (5, prose(80, 2)), (6, prose(80, 2)), (7, long), (8, "é ü 日本 !!"), (9, "!!! ???")]


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x or 0))
