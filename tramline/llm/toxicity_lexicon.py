"""Toxicity scores from a weighted lexicon.

Texts are folded first: lower case, look-alike letters and digits written as the letter they stand
for, invisible characters removed. The lexicon holds beginnings of folded words. It is learned from
labelled rows: the evidence for a beginning is the number of different words before it in toxic
texts, so that copies of one toxic text count once, against the number of clean texts with it. One
automaton finds all entries in a text; a hit counts only at the beginning of a word, and not as
part of an exception phrase, which is a pair of neighbouring words that clean texts use around an
entry (at most ``MAX_ENTRIES`` of them, as of the entries; words count by their first ``LONGEST`` letters). The sum of the weights, plain and per word of the text, goes through a logistic curve fitted
on the same rows.

Only texts, and for learning the labels, are looked at. Learning takes at most ``label_rows``
labelled rows, the first in the order of a hash of their id; scoring takes every row and whole text.

Results for unusual input: null or empty texts get the score of a text without hits; a null id
counts as the empty text when folds are drawn; labels without a verdict are left out, and of several
labels of a document the toxic one holds; without any toxic label every score is 0. Very long texts are
folded and scored whole; repeated rows are scored each and learned from each; an empty table gives no
rows, and columns other than the id and the text are not read.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .storage import cut, text_of

LABEL_ROWS = 40_000
MAX_ENTRIES = 4_000
SHORTEST, LONGEST = 3, 10
FLUSH_WORDS = 400_000

# Characters and the Latin letters they are taken for. The letter l, the digit 1 and
# their relatives all fold to i.
LOOK_ALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i",
    "а": "a", "в": "b", "с": "c", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ӏ": "i", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ⅼ": "i", "∣": "i",
}
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_FOLD = {ord(k): v for k, v in LOOK_ALIKES.items()} | {ord(k): None for k in INVISIBLE}
_FOLD |= {0xFF01 + k: chr(0x21 + k).lower().translate(_FOLD) for k in range(94)}  # full-width forms
_SIGN = re.compile(r"[@$!|€](?=[^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text):
    text = (text or "").lower()
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_FOLD)


class Lexicon(NamedTuple):
    weights: dict  # beginning of a word -> weight
    exceptions: frozenset  # pairs of neighbouring folded words
    curve: tuple  # intercept, factor of the sum, factor of the sum per word


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, weights, exceptions=frozenset()):
        import ahocorasick

        self.exceptions = exceptions
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (entry, weight))
        if weights:
            self.automaton.make_automaton()

    def hits(self, folded):
        """(weight, previous word, word, next word) of each hit that no exception covers."""
        if not len(self.automaton):
            return []
        found = {}
        for end, (entry, weight) in self.automaton.iter(folded):
            at = end + 1 - len(entry)
            if at and folded[at - 1].isalpha():
                continue
            found[at] = max(weight, found.get(at, 0.0))
        out = []
        for at, weight in found.items():
            word = _WORD.match(folded, at)[0]
            before = _last_word(folded, at)
            after = _next_word(folded, at + len(word))
            if (before, word) not in self.exceptions and (word, after) not in self.exceptions:
                out.append((weight, before, word, after))
        return out


def _last_word(text, end, reach=64):
    """The word before a place, however far away."""
    while True:
        start = max(0, end - reach)
        words = [m for m in _WORD.finditer(text, start, end)][-1:]
        if words and (words[0].start() > start or not start) or not start:
            return words[0][0] if words else ""
        reach *= 4


def _next_word(text, at):
    found = _WORD.search(text, at)
    return found[0] if found else ""


def count_words(folded):
    """Runs of anything but white space, so that more of it between words changes nothing."""
    return len(folded.split())


def features(hits, n_words):
    total = sum(hit[0] for hit in hits)
    return math.log1p(total), math.log1p(100.0 * total / max(n_words, 1))


def score_text(matcher, curve, text):
    folded = fold(text)
    hits = matcher.hits(folded)
    x, y = features(hits, count_words(folded))
    z = curve[0] + curve[1] * x + curve[2] * y
    return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def _count_words(batches):
    """Toxic rows: every word with a hash of the word before it. Clean rows: words and texts."""
    contexts, clean = set(), Counter()

    def rows():
        words = [w for w, _ in contexts] + list(clean)
        before = [c for _, c in contexts] + [None] * len(clean)
        counts = [0] * len(contexts) + list(clean.values())
        contexts.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(before, pa.int64()), pa.array(counts, pa.int64())],
            names=["word", "before", "clean"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = [w[:LONGEST] for w in _WORD.findall(fold(text.as_py()))]
            if toxic:
                contexts.update(zip(words, (crc32(w.encode()) for w in ["", *words]), strict=False))
            else:
                clean.update(set(words))
            if len(contexts) + len(clean) > FLUSH_WORDS:
                yield rows()
    yield rows()


def _choose(candidates, n_toxic, n_clean, strength=3.0):
    """Entries that speak for toxicity, without those that a shorter entry covers as well."""
    least = 4 + 0.002 * n_toxic
    weights = {}
    evidence = {entry: toxic for entry, toxic, _ in candidates}
    longer = {}
    for entry in evidence:  # a beginning stands for the longest one with nearly the same evidence
        for k in range(SHORTEST, len(entry)):
            if evidence[entry] >= 0.95 * evidence.get(entry[:k], math.inf) and len(entry) > len(longer.get(entry[:k], "")):
                longer[entry[:k]] = entry
    for entry, toxic, clean in sorted(candidates, key=lambda c: (len(c[0]), c[0])):
        odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if toxic < least or odds < strength:
            continue
        if entry not in weights and not any(weights.get(entry[:k], -9.0) >= odds - 2.0 for k in range(SHORTEST, len(entry))):
            weights[longer.get(entry, entry)] = odds
    return weights


def _fit(x, y, rounds=50, ridge=1e-2):
    """Logistic curve by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def labelled(docs, labels, in_fold, label_rows=LABEL_ROWS, id_column="doc_id", text_column="text"):
    """Text and label of at most ``label_rows`` labelled rows; the labels' bound allows a broadcast."""
    rows = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(in_fold(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(label_rows)
    )
    texts = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("text"))
    return texts.join(F.broadcast(rows), "_id").select("text", (F.col("toxic") > 0).alias("toxic"))


def learn(rows):
    """A lexicon from rows (text, toxic)."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic:
        return Lexicon({}, frozenset(), (-1000.0, 0.0, 0.0))
    words = (
        rows.mapInArrow(_count_words, "word string, before long, clean long")
        .groupBy("word").agg(F.countDistinct("before").alias("toxic"), F.sum("clean").alias("clean"))
    )
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    beginnings = (
        words.filter(F.length("word") >= SHORTEST)
        .withColumn("entry", F.explode(F.transform(lengths, lambda n: F.col("word").substr(F.lit(1), n))))
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= 4) & (F.col("toxic") * n_clean > 15.0 * F.col("clean") * n_toxic))
        .orderBy(F.desc("toxic"), "entry").limit(MAX_ENTRIES)
    )
    weights = _choose([tuple(r) for r in beginnings.collect()], n_toxic, n_clean)

    def find(batches):
        matcher = Matcher(weights)
        for batch in batches:
            out = []
            for number, (text, toxic) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                folded = fold(text.as_py())
                hits = [{"weight": h[0], "pairs": [f"{h[1]} {h[2]}", f"{h[2]} {h[3]}"]} for h in matcher.hits(folded)]
                out.append((toxic, count_words(folded), hits))
            if out:
                yield pa.RecordBatch.from_pylist(
                    [{"toxic": t, "n_words": n, "hits": h} for t, n, h in out],
                    schema=pa.schema([
                        ("toxic", pa.bool_()), ("n_words", pa.int64()),
                        ("hits", pa.list_(pa.struct([("weight", pa.float64()), ("pairs", pa.list_(pa.string()))]))),
                    ]),
                )

    found = cut(rows.mapInArrow(
        find, "toxic boolean, n_words long, hits array<struct<weight: double, pairs: array<string>>>"
    ))
    pairs = (
        found.select("toxic", F.explode("hits").alias("hit")).select("toxic", F.explode("hit.pairs").alias("pair"))
        .groupBy("pair").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c"))
        .filter((F.col("c") >= 3) & (F.col("c") * n_toxic > 3.0 * F.col("t") * n_clean))
        .orderBy(F.desc("c"), "pair").limit(MAX_ENTRIES)
    )
    exceptions = frozenset(tuple(r["pair"].split(" ")) for r in pairs.collect())
    listed = F.array(*[F.lit(" ".join(e)) for e in sorted(exceptions)]) if exceptions else F.array().cast("array<string>")
    total = F.aggregate(
        "hits", F.lit(0.0),
        lambda a, h: a + F.when(F.arrays_overlap(h["pairs"], listed), 0.0).otherwise(h["weight"]),
    )
    points = found.select(
        F.log1p(total).alias("x"), F.log1p(100.0 * total / F.greatest("n_words", F.lit(1))).alias("y"), F.col("toxic").cast("int").alias("t")
    ).groupBy("x", "y", "t").count().toPandas()
    repeat = points["count"].to_numpy()
    x = np.repeat(points[["x", "y"]].to_numpy(), repeat, axis=0)
    return Lexicon(weights, exceptions, _fit(x, np.repeat(points["t"].to_numpy(), repeat)))


def score(docs, lexicon, id_column="doc_id", text_column="text"):
    """doc_id and score of every row."""

    def task(batches):
        matcher = Matcher(lexicon.weights, lexicon.exceptions)
        for batch in batches:
            scores = [score_text(matcher, lexicon.curve, text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(
        task, "doc_id long, score double"
    )


def training_fold(doc_id, folds=5):
    return ~held_out(doc_id, folds)


def held_out(doc_id, folds=5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def drop_toxic(docs, lexicon, threshold=0.5, text_column="text"):
    """The rows with a score below the threshold, with all their columns."""

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon.weights, lexicon.exceptions)
        for batch in texts:
            yield batch.map(lambda text: score_text(matcher, lexicon.curve, text)).astype("float64")

    return docs.filter(toxicity(text_of(text_column)) < threshold)
