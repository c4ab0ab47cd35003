"""Rows that every operator must survive."""

import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Documents with extra columns whose names operators use inside.
CLASHING = (
    "doc_id long, text string, row string, run int, class long, n long, kept string, _key string, _row string, "
    "score string, id long, key string, hash long, slot long, part int, toxic int"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def sentence(seed, length=40):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 9973}" for k in range(length))


def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"t{k % 5000}x{k % 7}" for k in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, sentence(1)), (7, sentence(1)),
        (8, sentence(1) + " tail"), (9, long), (10, long + " more"), (11, "\x00odd   sign \U0001f600 é"), (12, "."),
        (13, "a" * 50_000), (14, sentence(2)), (14, sentence(2)), (14, sentence(3)), (None, sentence(4)), (None, sentence(4)),
        (15, sentence(4) + " end"), (16, "word " * 3000),
    ]


def documents(spark, rows, partitions=3):
    full = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)


def clashing(spark, rows):
    full = [(i, t, "r", k, k, k, "yes", "k", "w", "s", k, "key", k, k, k, 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, CLASHING)
