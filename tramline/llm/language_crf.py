"""Languages of the words of code-switched text, by a linear-chain conditional random field.

A word is a run of letters, lowered. Its features are its affixes, the letter n-grams of the word with
its two ends marked, and how strongly a learned lexicon ties it to each language; weights of hashed
features give a score per language, and learned transitions tie the labels of neighbours. Forward and
backward messages over the whole text give each word's distribution over the languages; a text's
language is the one with the largest expected share of its words, that share being the score.

A chain is not walked word by word: the words of many texts are laid out in blocks, the blocks' transfer
matrices are multiplied side by side, the messages go from block to block, and then through all blocks
at once. A text's first word resets the chain, so texts need not begin with a block. What is kept per
word of a long text is a number; scores and messages exist for a slice of it at a time.

The field is fitted on a sample of bounded size, whatever the input: of each language (the ``languages``
most frequent ones) ``per_language`` different labelled rows, the first in the order of a hash, and of
each row ``window`` words from a place that the hash names. Some windows are cut into runs and strung
together across languages, which is where the transitions are learned from. Prediction takes every row
and the whole text; it looks at nothing but the text.

Results for unusual input: a null text and one without letters are ``und`` with score 0, and so is every
text when no labelled row was there to learn from; ties go to the first language in order; a null id
counts as the empty text when folds are drawn; repeated rows are learned from once and predicted each;
an empty table gives no rows. Extra columns are not read, whatever their names.
"""

import re
from collections import Counter
from itertools import pairwise, repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .storage import text_of

PER_LANGUAGE = 1_500
LANGUAGES = 64
WINDOW = 64
BUCKETS = 1 << 17
LEXICON = 20_000
EPOCHS, CHAINS, RATE, RIDGE = 6, 400, 0.3, 1e-5
UNKNOWN = "und"

BLOCK = 128
SLICE_WORDS = 1 << 17
GROUP_CHARACTERS = 1 << 20
CACHED_WORDS = 200_000
LARGEST = 40.0  # of a word's score, either way

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


class Model(NamedTuple):
    languages: tuple  # in order
    weights: np.ndarray  # feature bucket x language
    lexicon: dict  # word -> buckets of its lexicon features
    transitions: np.ndarray  # from language x to language
    start: np.ndarray


def pieces(text, size=GROUP_CHARACTERS):
    """Offsets and parts of a text, none much longer than ``size``, cut between words."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.end() if gap else len(text)
        yield at, text[at:end]
        at = end


def words_of(text):
    """The words of a text, lowered; signs that are no letters though they count as such in patterns go."""
    for _, part in pieces(text or ""):
        for word in _WORD.findall(part.lower()):
            if any(map(str.isalpha, word)):
                yield word


def feature_buckets(word, lexicon):
    """Buckets of the features of a word: affixes, n-grams, ties to languages."""
    marked = f"^{word}$"
    names = [f"p{word[:k]}" for k in range(1, min(4, len(word)) + 1)]
    names += [f"s{word[-k:]}" for k in range(1, min(4, len(word)) + 1)]
    names += [marked[k : k + n] for n in (2, 3) for k in range(len(marked) - n + 1)]
    return [crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names] + list(lexicon.get(word, ()))


def learn_lexicon(windows, languages, limit=LEXICON, least=3):
    """The most frequent words, each with a feature per language: the band of its share there."""
    counts = {lang: Counter() for lang in languages}
    for lang, words in windows:
        counts[lang].update(words)
    sizes = {lang: max(1, c.total()) for lang, c in counts.items()}
    total = sum(counts.values(), Counter())
    chosen = sorted((w for w, n in total.items() if n >= least), key=lambda w: (-total[w], w))[:limit]
    lexicon = {}
    for word in chosen:
        rates = [counts[lang][word] / sizes[lang] for lang in languages]
        bands = [int(4 * rate / sum(rates)) for rate in rates]
        lexicon[word] = tuple(
            crc32(f"lexicon {k} {band}".encode()) % BUCKETS for k, band in enumerate(bands)
        )
    return lexicon


def make_chains(windows, languages, window=WINDOW, seed=7):
    """(words, label numbers) of one long row: windows as they are and, strung together, runs of others."""
    chance = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(languages)}
    runs = []
    for at in chance.permutation(len(windows)).tolist():
        lang, words = windows[at]
        step = len(words) if at % 2 else 1
        while words:
            size = step if at % 2 else int(chance.integers(3, 13))
            runs.append((number[lang], words[:size], at % 2))
            words = words[size:]
    whole = [run for run in runs if run[2]]
    mixed = [run for run in runs if not run[2]]
    order = [mixed[k] for k in chance.permutation(len(mixed)).tolist()]
    words, labels = [], []
    for label, run, _ in whole + order:
        words += run
        labels += [label] * len(run)
    return words, np.array(labels, dtype=np.int64)


class _Features:
    """Features of distinct words as one flat array with the place where each word's begin."""

    def __init__(self, words, lexicon):
        found = [feature_buckets(word, lexicon) for word in words]
        self.counts = np.array([len(f) for f in found], dtype=np.int64)
        self.flat = np.fromiter((b for f in found for b in f), dtype=np.int64, count=int(self.counts.sum()))
        self.begins = np.cumsum(self.counts) - self.counts

    def scores(self, weights):
        if not len(self.counts):
            return np.zeros((0, weights.shape[1]))
        return np.clip(np.add.reduceat(weights[self.flat], self.begins, axis=0), -LARGEST, LARGEST).astype(np.float64)

    def spread(self, gradient, n_buckets):
        """Gradient per word to gradient per feature bucket."""
        repeated = np.repeat(gradient, self.counts, axis=0)
        return np.column_stack(
            [np.bincount(self.flat, repeated[:, k], minlength=n_buckets) for k in range(gradient.shape[1])]
        )


def chain_marginals(scores, transitions, start):
    """Distributions per word and expected transitions of chains of equal length, (chains, words, languages)."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a, s = np.exp(transitions), np.exp(start)
    n, length, size = e.shape
    forward = np.empty_like(e)
    backward = np.ones_like(e)
    for t in range(length):
        v = e[:, t] * (s if t == 0 else forward[:, t - 1] @ a)
        forward[:, t] = v / v.sum(axis=1, keepdims=True)
    moves = np.zeros((size, size))
    for t in range(length - 2, -1, -1):
        ahead = e[:, t + 1] * backward[:, t + 1]
        v = ahead @ a.T
        moves += a * ((forward[:, t] / (forward[:, t] * v).sum(axis=1, keepdims=True)).T @ ahead)
        backward[:, t] = v / v.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=2, keepdims=True), moves


def fit(windows, window=WINDOW, epochs=EPOCHS, chains=CHAINS, rate=RATE, ridge=RIDGE, seed=7):
    """A model from (language, words) of a bounded number of windows, by stochastic gradient ascent."""
    languages = tuple(sorted({lang for lang, _ in windows}))
    size = len(languages)
    lexicon = learn_lexicon(windows, languages)
    words, labels = make_chains(windows, languages, window, seed)
    length = min(window, len(words)) or 1
    n = len(words) // length
    vocabulary = {}
    index = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), dtype=np.int64, count=len(words))
    index, labels = index[: n * length].reshape(n, length), labels[: n * length].reshape(n, length)
    spelled = list(vocabulary)
    weights = np.zeros((BUCKETS, size), dtype=np.float32)
    transitions, start = np.zeros((size, size)), np.zeros(size)
    squares = [np.full(x.shape, 1e-6) for x in (weights, transitions, start)]
    chance = np.random.default_rng(seed)
    for _ in range(epochs if size > 1 else 0):
        order = chance.permutation(n)
        for at in range(0, n, chains):
            rows = order[at : at + chains]
            used, places = np.unique(index[rows], return_inverse=True)
            places = places.reshape(len(rows), length)
            features = _Features([spelled[k] for k in used.tolist()], lexicon)
            scores = features.scores(weights)[places]
            expected, moves = chain_marginals(scores, transitions, start)
            truth = np.eye(size)[labels[rows]]
            missing = (truth - expected).reshape(-1, size)
            by_word = np.column_stack([np.bincount(places.ravel(), missing[:, k], minlength=len(used)) for k in range(size)])
            seen = np.zeros((size, size))
            np.add.at(seen, (labels[rows][:, :-1].ravel(), labels[rows][:, 1:].ravel()), 1.0)
            steps = (
                features.spread(by_word, BUCKETS) - ridge * weights, seen - moves, (truth[:, 0] - expected[:, 0]).sum(axis=0)
            )
            for value, square, step in zip((weights, transitions, start), squares, steps, strict=True):
                square += step**2
                value += (rate * step / np.sqrt(square)).astype(value.dtype)
    return Model(languages, weights, lexicon, transitions, start)


class Tagger:
    """Scores of words and messages along the words of many texts."""

    def __init__(self, model, slice_words=SLICE_WORDS, cached=CACHED_WORDS):
        self.model, self.slice_words, self.cached = model, max(BLOCK, slice_words // BLOCK * BLOCK), cached
        self.a, self.start = np.exp(model.transitions), np.exp(model.start - model.start.max())
        self._forget()

    def _forget(self):
        self.known = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def number(self, words):
        """Numbers of words for ``marginals``; those of earlier calls hold until ``settle``."""
        known = self.known
        return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64)

    def numbers_of(self, text):
        """Numbers of the words of a text; the same words as ``words_of`` gives, looked at once each."""
        known, found = self.known, []
        for _, part in pieces(text):
            words = _WORD.findall(part.lower())
            for word in set(words):
                if word not in known and any(map(str.isalpha, word)):
                    known[word] = len(known)
            numbers = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            found.append(numbers[numbers >= 0])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def _emissions(self):
        fresh = list(self.known)[len(self.table):]
        if fresh:
            scores = _Features(fresh, self.model.lexicon).scores(self.model.weights)
            self.table = np.concatenate([self.table, np.exp(scores - scores.max(axis=1, keepdims=True))])
        return self.table

    def settle(self):
        """Forget scores when there are many; numbers given before mean nothing then."""
        if len(self.known) > self.cached:
            self._forget()

    def marginals(self, numbers, first):
        """Slices (place, distributions) over all words; ``first`` marks the first word of each text."""
        size, n = len(self.model.languages), len(numbers)
        if not n:
            return
        table = self._emissions()
        table = np.concatenate([table, np.ones((1, size))])  # fills the last block
        blocks = -(-n // BLOCK)
        filled = np.full(blocks * BLOCK, len(table) - 1, dtype=np.int64)
        filled[:n] = numbers
        begins = np.ones(blocks * BLOCK, dtype=bool)  # what fills the last block says nothing about the words before
        begins[:n] = first
        per_slice = self.slice_words // BLOCK
        parts = [slice(b, min(b + per_slice, blocks)) for b in range(0, blocks, per_slice)]
        numbers, begins = filled.reshape(blocks, BLOCK), begins.reshape(blocks, BLOCK)
        product = np.concatenate([self._products(table[numbers[p]], begins[p]) for p in parts])
        into = np.empty((blocks, size))  # message that enters a block from the left
        out = np.ones((blocks, size))  # and from the right
        v = np.full(size, 1.0 / size)
        for b in range(blocks):
            into[b] = v
            v = v @ product[b]
            v = v / v.sum()
        v = np.ones(size)
        for b in range(blocks - 1, -1, -1):
            out[b] = v
            v = product[b] @ v
            v = v / v.sum()
        for p in parts:
            found = self._inside(table[numbers[p]], begins[p], into[p], out[p])
            at = p.start * BLOCK
            yield at, found.reshape(-1, size)[: n - at]

    def _products(self, e, begins):
        """Transfer matrices of blocks."""
        size = e.shape[2]
        m = np.broadcast_to(np.eye(size), (len(e), size, size)).copy()
        for t in range(BLOCK):
            reset = begins[:, t]
            moved = m @ self.a
            if reset.any():
                moved[reset] = m[reset].sum(axis=2, keepdims=True) * self.start
            m = moved * e[:, t, None, :]
            m /= m.max(axis=(1, 2), keepdims=True)
        return m

    def _inside(self, e, begins, into, out):
        forward, v = np.empty_like(e), into
        for t in range(BLOCK):
            v = np.where(begins[:, t, None], v.sum(axis=1, keepdims=True) * self.start, v @ self.a) * e[:, t]
            v = v / v.sum(axis=1, keepdims=True)
            forward[:, t] = v
        w = out
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= w
            ahead = e[:, t] * w
            w = np.where(begins[:, t, None], (ahead @ self.start)[:, None], ahead @ self.a.T)
            w = w / w.sum(axis=1, keepdims=True)
        return forward / forward.sum(axis=2, keepdims=True)

    def shares(self, texts):
        """(number of words, expected share of each language) of each text."""
        numbers = [self.numbers_of(text) for text in texts]
        counts = np.array([len(k) for k in numbers], dtype=np.int64)
        joined = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        begins = np.cumsum(counts) - counts
        first = np.zeros(len(joined), dtype=bool)
        first[begins[counts > 0]] = True
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = np.zeros((len(counts), len(self.model.languages)))
        for at, found in self.marginals(joined, first):
            mine = owner[at : at + len(found)]
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(mine, found[:, k], minlength=len(counts))
        self.settle()
        return counts, sums / np.maximum(counts, 1)[:, None]

    def spans(self, text):
        """(start, end, language, score) of the longest runs of words with one label; code points."""
        starts, ends, words = [], [], []
        for at, part in pieces(text or ""):
            for hit in _WORD.finditer(part):
                if any(map(str.isalpha, hit[0])):
                    starts.append(at + hit.start())
                    ends.append(at + hit.end())
                    words.append(hit[0].lower())
        if not words:
            return []
        first = np.zeros(len(words), dtype=bool)
        first[0] = True
        found = np.concatenate([part for _, part in self.marginals(self.number(words), first)])
        self.settle()
        label = found.argmax(axis=1)
        edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(words)]
        return [
            (starts[a], ends[b - 1], self.model.languages[label[a]], float(found[a:b, label[a]].mean()))
            for a, b in pairwise(edges)
        ]


def held_out(doc_id, folds=3, fold=1):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _window(batches, window):
    for batch in batches:
        out = []
        for lang, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = list(words_of(text))
            at = key % max(1, len(words) - window + 1)
            out.append((lang, words[at : at + window]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.string()))],
            names=["lang", "words"],
        )


def sample_windows(rows, per_language=PER_LANGUAGE, languages=LANGUAGES, window=WINDOW):
    """(language, words) of at most ``languages`` times ``per_language`` windows of rows (lang, text)."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("lang", "text").alias("key"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    keys = rows.select("lang", "key").distinct().join(F.broadcast(common.select("lang")), "lang")
    order = Window.partitionBy("lang").orderBy("key")
    least = keys.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    bounds = {r.lang: r.key for r in least.groupBy("lang").agg(F.max("key").alias("key")).collect()}
    if not bounds:
        return []
    limits = F.create_map(*[F.lit(v) for pair in sorted(bounds.items()) for v in pair])
    chosen = rows.filter(F.col("key") <= limits[F.col("lang")]).dropDuplicates(["lang", "key"])
    found = chosen.mapInArrow(lambda batches: _window(batches, window), "lang string, words array<string>").collect()
    return sorted((r.lang, list(r.words)) for r in found if r.words)


def learn(docs, training, lang_column="lang", text_column="text", **options):
    """A model from the labelled rows of ``docs`` that ``training`` (a condition) takes, or None without any."""
    rows = docs.filter(training).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    windows = sample_windows(rows, **options)
    return fit(windows) if windows else None


def predict(docs, model, id_column="doc_id", text_column="text"):
    """doc_id, n_words, lang_pred and score of every row."""
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        tagger = Tagger(sent.value) if sent.value else None

        def group(ids, texts):
            if tagger is None:
                counts = np.array([sum(1 for _ in words_of(text)) for text in texts], dtype=np.int64)
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                counts, shares = tagger.shares(texts)
                best = shares.argmax(axis=1)
                langs = [tagger.model.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), counts.tolist(), strict=True)]
                scores = np.where(counts > 0, np.clip(shares[np.arange(len(texts)), best], 0.0, 1.0), 0.0).round(9)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "lang_pred", "score"],
            )

        for batch in batches:
            ready, size, at = [], 0, 0
            for text in batch.column(1):
                ready.append(text.as_py())
                size += len(ready[-1])
                if size > GROUP_CHARACTERS:
                    yield group(batch.column(0).slice(at, len(ready)), ready)
                    at, ready, size = at + len(ready), [], 0
            if ready:
                yield group(batch.column(0).slice(at, len(ready)), ready)

    return texts.mapInArrow(task, schema)


def label_spans(docs, model, id_column="doc_id", text_column="text"):
    """doc_id, start, end, lang and score of the runs of words of one language; code points, end exclusive."""
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        tagger = Tagger(sent.value) if sent.value else None
        for batch in batches:
            for number, text in enumerate(batch.column(1)):
                spans = tagger.spans(text.as_py()) if tagger else []
                if spans:
                    columns = list(zip(*spans, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([number] * len(spans))), pa.array(columns[0], pa.int64()),
                         pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64())],
                        names=["doc_id", "start", "end", "lang", "score"],
                    )

    return texts.mapInArrow(task, f"doc_id {kind}, start long, end long, lang string, score double")
