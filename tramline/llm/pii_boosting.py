"""Personal data: base rules, and further spans chosen by boosted trees.

Base spans come from four exact rules and always stay. Around them, generators with high recall
propose overlapping candidates: addresses with written-out signs, dotted numbers, chains of digits
with any separators. Gradient-boosted trees judge a candidate by its format (lengths, separators,
checksum, ranges) and its context (neighbouring characters, cue words before it). They are trained on
the variants spelt out below, and on the distinct candidates of all documents: one that equals a base
span is a good one, one whose format rules its kind out is a bad one, and the others, which nobody has
judged, are left out. The variants weigh the same however many candidates there are. The rows stay in
blocks on the executors: each level of a tree costs one job, which adds up gradients per node, feature
and bin. Every distinct row is judged by trees grown without it, which grow in the same jobs; there the
margins become probabilities, and each kind's threshold is the lowest that keeps the wanted precision
among rows that could be added. Sums are taken in whole numbers, so the trees do not depend on the layout. Chosen candidates that touch no base span are taken by falling
probability, without overlaps, and added to the result.

Results for unusual input: null and empty texts have no spans; a null id stays null; repeated rows
are judged one by one; without any candidate in the documents the variants alone train the trees; an empty table gives no rows; very long texts are read whole, in time that grows with their
length. Columns other than the id and the text are not read.
"""

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from .storage import stored, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TABLE_WEIGHT = 1000.0  # of all variants together, and at most of all candidates together
FOLDS = 8
BLOCK_ROWS = 8192
LARGEST = 255  # lengths and counts beyond it are one value of a feature
STEPS = 1 << 24  # gradients are summed in this part of one
GRID = 1024  # margins are counted in this part of one

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TELLING = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 if value > 4 else 2 * value
        total += value
    return total % 10 == 0


def _emails(text):
    """Leftmost matches of a local part, the sign and a domain with a dot; linear in the text."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            spans.append((start, done))
        at = text.find("@", done)
    return spans


def base_spans(text):
    """(kind number, start, end) by the four rules, in the order of kinds, then starts."""
    spans = []
    if "@" in text:
        spans += [(0, a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


# Generators: the kind they propose and a pattern with bounded repeats.
GENERATORS = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[{]at[)\]}]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{1,63}){1,6}", re.I)),
    (1, re.compile(r"(?<![0-9])[0-9]{1,4}(?:[.,][0-9]{1,4}){2,4}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){11,23}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,17}(?![0-9])")),
)
# Words that announce a kind.
CUES = (
    frozenset("email mail contact write courriel correo address at".split()),
    frozenset("ip host server address node client gateway".split()),
    frozenset("card visa mastercard credit debit account karte carte tarjeta".split()),
    frozenset("phone tel telephone call fax mobile cell ring telefon telefono".split()),
)
_CUE_WORD = re.compile(r"[^\W\d_]+")
_GROUP = re.compile(r"[0-9]+")
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}([./-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
                   r"|(?:0?[1-9]|[12][0-9]|3[01])([./-])(?:0?[1-9]|[12][0-9]|3[01])\2(?:1[89]|20)[0-9]{2}")

FEATURES = (
    "kind", "characters", "digits", "groups", "longest group", "shortest group", "separators", "kinds of separators",
    "plus", "bracket", "checksum", "octets", "signs", "dots", "last label", "letter before", "letter after",
    "digit near", "cue", "repeated digit", "date", "written out",
)


def candidates(text):
    """Distinct proposals (kind, start, end), base spans among them."""
    if not _TELLING.search(text):
        return []
    found = set(base_spans(text))
    for kind, pattern in GENERATORS:
        found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(found)


def candidate_features(text, kind, start, end):
    span = text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    other = [c for c in span if not c.isalnum()]
    sizes = [len(g) for g in groups] or [0]
    before, after = text[start - 1 : start], text[end : end + 1]
    words = [w.lower() for w in _CUE_WORD.findall(text, max(0, start - 40), start)][-4:]
    tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
    date = len(sizes) == 3 and sorted(sizes) in ([1, 1, 4], [1, 2, 4], [2, 2, 4], [2, 2, 2])
    octets = len(sizes) == 4 and all(s <= 3 and int(g) <= 255 for s, g in zip(sizes, groups, strict=True))
    lengths = (len(span), len(digits), len(groups), max(sizes), min(sizes), len(other), len(set(other)))
    return [
        kind, *[min(n, LARGEST) for n in lengths],
        span.startswith("+"), "(" in span, bool(digits) and luhn(digits), octets,
        min(span.count("@"), LARGEST), min(span.count("."), LARGEST),
        min(len(tail), LARGEST) if tail.isalpha() else 0, before.isalpha() or before == "_", after.isalpha() or after == "_",
        any(c.isdigit() or c in "+.-" for c in (before, after) if c), any(w in CUES[kind] for w in words),
        round(max((digits.count(d) for d in set(digits)), default=0) / max(len(digits), 1), 3), date,
        bool(re.search(r"[(\[{](?:at|dot)[)\]}]", span, re.I)),
    ]


# The small labelled table of variants: kind, text with the span between bars, verdict.
VARIANTS = (
    (0, "write to |jo.lee (at) mail4.example.com| soon", 1), (0, "mail |ann [at] host.example.org|", 1),
    (0, "contact |k.roe[at]firm[dot]example|", 1), (0, "reach |sam (at) post (dot) example (dot) net| now", 1),
    (0, "see |figure (at) left.of| it", 0), (0, "look |there (at) once.again| and", 0),
    (1, "version |2.0.1.4000| of", 0), (1, "section |3.4.1| says", 0), (1, "about |1,204,331| rows", 0),
    (1, "visa |4111.1111.1111.1111| ok", 0), (1, "number |1000.2000.3000.4000| of", 0), (1, "code |260.1.1.999| is", 0),
    (1, "release |10.4.22| was", 0), (1, "host |300.12.4.900| is", 0), (1, "sum |12,400,21| of", 0),
    (2, "card |3782 822463 10005| paid", 1), (2, "visa |4111.1111.1111.1111| ok", 1), (2, "card |3714-496353-98431|", 1),
    (2, "credit card |378282246310005|", 1), (2, "card |5555/5555/5555/4444| used", 1), (2, "visa |4012 8888 8888 1881|", 1),
    (2, "order |123456789012345| sent", 0), (2, "number |2020 1201 0930 12| of", 0), (2, "id |9876543210123456|", 0),
    (2, "row |4012888888881882| of", 0), (2, "part |000123 456789 0| in", 0), (2, "serial |811-223-334-455-2|", 0),
    (3, "call |(555) 201-3344| today", 1), (3, "phone |0044 20 7946 0958|", 1), (3, "tel |030 901820 55| please", 1),
    (3, "fax: |212-555-0147|", 1), (3, "mobile |0170 5550123| or", 1), (3, "call |555.201.3344| now", 1),
    (3, "on |2021-10-07| it", 0), (3, "from |12/05/2019| to", 0), (3, "pages |1044 1089| of", 0), (3, "code |1234567| was", 0),
    (3, "sum |1 200 300 400| was", 0), (3, "id |4054205407814823|", 0), (3, "part |77-1203-4| fits", 0), (3, "year |1999 2004| in", 0),
)


class Covered:
    """Places that spans cover, as disjoint intervals in order."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for start, end in sorted((a, b) for _, a, b in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start, end):
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start, end):
        """An interval that touches none."""
        k = bisect_right(self.ends, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def ruled_out(text, kind, start, end, base):
    """Whether a candidate that could be added, as it touches no base span, isn't of its kind by its format."""
    if base.touches(start, end):
        return False
    span = text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9]+", span)[-1]
        return not last.isalpha() or len(last) < 2
    if kind == 1:
        return len(groups) != 4 or "," in span or any(len(g) > 3 or int(g) > 255 for g in groups)
    if kind == 2:
        return not 12 <= len(digits) <= 19 or not luhn(digits)
    return not 7 <= len(digits) <= 15 or bool(_DATE.fullmatch(span))


def variant_rows(copies=8):
    rows = []
    for kind, marked, verdict in VARIANTS:
        start, end = marked.index("|"), marked.rindex("|") - 1
        rows += [[*candidate_features(marked.replace("|", ""), kind, start, end), verdict]] * copies
    return rows


def _edges(values, weight, bins):
    """Limits between bins of about equal weight."""
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    at = np.minimum(np.searchsorted(share, np.linspace(0, 1, bins + 1)[1:-1]), len(values) - 1)
    return np.unique(values[order][at])


def boost(x, y, weight=None, rounds=60, depth=3, rate=0.2, bins=32, ridge=1.0):
    """Trees on the weighted logistic loss; each is a tuple (feature, limit, low, high) or a leaf value."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [_edges(x[:, f], weight, bins) for f in range(x.shape[1])]
    places = [np.searchsorted(limits, x[:, f], side="left") for f, limits in enumerate(edges)]
    good = (weight * y).sum()
    start = float(np.log((good + 1) / (weight.sum() - good + 1)))
    margin, trees = np.full(len(y), start), []

    def split(rows, gradient, hessian, left):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if left:
            for f, limits in enumerate(edges):
                place = places[f][rows]
                gs = np.cumsum(np.bincount(place, gradient[rows], len(limits) + 1))[:-1]
                hs = np.cumsum(np.bincount(place, hessian[rows], len(limits) + 1))[:-1]
                if not len(gs):
                    continue
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[(hs < 1e-3) | (h - hs < 1e-3)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(limits[k]))
        if best[1] is None:
            return -rate * g / (h + ridge)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], split(rows[low], gradient, hessian, left - 1), split(rows[~low], gradient, hessian, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = split(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), depth)
        trees.append(tree)
        margin += evaluate(tree, x)
    return start, trees


def evaluate(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = evaluate(tree[2], x[low]), evaluate(tree[3], x[~low])
    return out


def margins(model, x):
    start, trees = model
    return start + sum(evaluate(tree, x) for tree in trees)


def calibrate(margin, y, weight, rounds=200):
    """Slope and offset that turn margins into probabilities."""
    a, b = 1.0, 0.0
    good, bad = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = weight * (p * (1 - p) + 1e-9)
        g = np.array([(weight * (p - target) * margin).sum(), (weight * (p - target)).sum()])
        h = np.array([[(w * margin**2).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -0.1, 0.1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def threshold(probability, y, weight, precision):
    """The lowest probability, 0.5 at least, from which on the rows have the wanted precision."""
    order = np.argsort(-probability, kind="stable")
    p, good, every = probability[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    fine = (good / every >= precision) & (p >= 0.5) & np.append(p[1:] < p[:-1], True)
    return float(p[np.flatnonzero(fine)[-1]]) if fine.any() else 1.01


def train(rows, precision=PRECISION, table=()):
    """Trees, calibration and a threshold per kind from rows of features and verdict.

    With a table, its rows weigh TABLE_WEIGHT together, and thresholds leave out the other good rows,
    which are base spans and never added.
    """
    rows = np.array([*rows, *table], dtype=float)
    x, y = rows[:, :-1], rows[:, -1]
    weight, judged = np.ones(len(y)), np.ones(len(y), dtype=bool)
    if len(table):
        found = len(y) - len(table)
        weight[:found] = min(8.0, TABLE_WEIGHT / max(found, 1))
        weight[found:] = TABLE_WEIGHT / len(table)
        judged[:found] = y[:found] == 0
    fold = np.unique(x, axis=0, return_inverse=True)[1].ravel() % FOLDS
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        unseen = fold == k
        if unseen.any() and not unseen.all():
            margin[unseen] = margins(boost(x[~unseen], y[~unseen], weight[~unseen]), x[unseen])
    slope, offset = calibrate(margin, y, weight)
    p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -700, 700)))
    limits = tuple(
        threshold(p[of], y[of], weight[of], precision) if (of := judged & (x[:, 0] == k)).any() else 1.01 for k in range(len(KINDS))
    )
    return boost(x, y, weight), (slope, offset), limits


def training_rows(docs, text_column="text"):
    """Distinct rows (features and verdict) of the judged candidates of all documents."""

    def task(batches):
        for batch in batches:
            seen = set()
            for text in batch.column(0):
                text = text.as_py()
                base = set(base_spans(text))
                covered = Covered(base)
                for c in candidates(text):
                    if c in base or ruled_out(text, *c, covered):
                        seen.add((*map(float, candidate_features(text, *c)), float(c in base)))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(map(list, seen)), pa.list_(pa.float64()))], names=["row"])

    return docs.select(text_of(text_column).alias("text")).mapInArrow(task, "row array<double>").distinct()


class Block:
    """Rows of a partition: bins of their features, verdict, weight, fold, and a margin per model."""

    def __init__(self, rows, limits, weights, starts):
        x = np.array([r.row for r in rows], dtype=float)
        self.kind, self.y = x[:, 0].astype(int), x[:, -1]
        self.table = np.array([r.table for r in rows])
        self.fold = np.array([r.fold for r in rows])
        self.weight = np.where(self.table, weights[1], weights[0])
        self.bins = np.stack([np.searchsorted(of, x[:, f], side="left") for f, of in enumerate(limits)], 1)
        self.margin = np.repeat(np.array(starts)[:, None], len(x), 1)

    def node(self, splits, levels):
        """Each row's node after so many levels of a growing tree, -1 in a closed one."""
        at = np.zeros(len(self.y), dtype=int)
        for _ in range(levels):
            feature, limit = splits[np.maximum(at, 0)].T
            after = 2 * at + 1 + (self.bins[np.arange(len(at)), feature] > limit)
            at = np.where((at < 0) | (feature < 0), -1, after)
        return at

    def moved(self, grown, depth):
        """The same rows after a tree of each model."""
        for m, (splits, values) in enumerate(grown):
            at = np.zeros(len(self.y), dtype=int)
            for _ in range(depth):
                feature, limit = splits[at].T
                at = np.where(feature < 0, at, 2 * at + 1 + (self.bins[np.arange(len(at)), feature] > limit))
            self.margin[m] += values[at]
        return self

    def sums(self, splits, level, size):
        """Gradients and second derivatives by model, node of the level, feature and bin."""
        models, features = len(self.margin), self.bins.shape[1]
        out = np.zeros((2, models, 2**level, features, size), dtype=np.int64)
        for m in range(models):
            at = self.node(splits[m], level)
            rows = np.flatnonzero((at >= 0) & (self.fold != m))
            p = 1 / (1 + np.exp(-self.margin[m, rows]))
            for part, value in enumerate((p - self.y[rows], p * (1 - p))):
                value = np.rint(value * self.weight[rows] * STEPS)
                for f in range(features):
                    cell = (at[rows] - (2**level - 1)) * size + self.bins[rows, f]
                    out[part, m, :, f] += np.bincount(cell, value, 2**level * size).astype(np.int64).reshape(-1, size)
        return out

    def judged(self):
        """Rows by verdict, kind, origin and margin of the trees grown without them."""
        unseen = np.rint(self.margin[self.fold, np.arange(len(self.y))] * GRID)
        return Counter(zip(self.y, self.kind.tolist(), self.table.tolist(), unseen, strict=True))


def _added_up(blocks, of, empty):
    """The sum over all blocks, added up on the executors; nothing but sums reaches the driver."""
    return blocks.treeAggregate(empty, lambda total, block: total + of(block), lambda a, b: a + b)


def boost_blocks(blocks, limits, starts, rounds=60, depth=3, rate=0.2, ridge=1.0):
    """A model per fold, grown without its rows, and one of all rows; also the blocks with their margins.

    The trees are those of ``boost``; all models grow together, a level by a job.
    """
    size = max(map(len, limits)) + 1
    bounds = np.array([[b < len(of) for b in range(size)] for of in limits])
    forest, before = [[] for _ in starts], None
    for _ in range(rounds):
        splits = np.full((len(starts), 2 ** (depth + 1) - 1, 2), -1)
        values = np.zeros(splits.shape[:2])
        for level in range(depth):
            shape = (2, len(starts), 2**level, len(limits), size)
            found = _added_up(blocks, lambda b, s=splits, d=level: b.sums(s, d, size), np.zeros(shape, dtype=np.int64)) / STEPS
            if before is not None:
                before.unpersist()
                before = None
            for m, k in np.ndindex(shape[1:3]):
                node, (gs, hs) = 2**level - 1 + k, found[:, m, k].cumsum(2)
                if level and splits[m, (node - 1) // 2, 0] < 0:
                    continue
                g, h = gs[0, -1], hs[0, -1]
                values[m, node] = -rate * g / (h + ridge)
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[~bounds | (hs < 1e-3) | (h - hs < 1e-3)] = 0
                f, limit = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, limit] > 1e-6:
                    splits[m, node] = f, limit
                    low, high = (gs[f, limit], hs[f, limit]), (g - gs[f, limit], h - hs[f, limit])
                    values[m, 2 * node + 1], values[m, 2 * node + 2] = (-rate * a / (b + ridge) for a, b in (low, high))

        def tree(m, node, splits=splits, values=values):
            feature, limit = splits[m, node]
            if feature < 0:
                return float(values[m, node])
            return int(feature), float(limits[feature][limit]), tree(m, 2 * node + 1), tree(m, 2 * node + 2)

        for m, trees in enumerate(forest):
            trees.append(tree(m, 0))
        before, grown = blocks, list(zip(splits, values, strict=True))
        blocks = before.map(lambda b, g=grown: b.moved(g, depth)).persist(StorageLevel.MEMORY_AND_DISK)
    return list(zip(starts, forest, strict=True)), blocks


def train_on(docs, precision=PRECISION, text_column="text", bins=32):
    """``train`` on the variants and the judged candidates of all documents, in blocks on the executors."""
    spark = docs.sparkSession
    table = spark.createDataFrame([([*map(float, r)],) for r in variant_rows(1)], "row array<double>").coalesce(1)
    rows = stored(
        training_rows(docs, text_column).withColumn("table", F.lit(False)).unionByName(table.withColumn("table", F.lit(True)))
        .withColumn("fold", F.pmod(F.xxhash64(F.slice("row", 1, len(FEATURES))), F.lit(FOLDS)).cast("int"))
    )
    verdict = F.element_at("row", -1)
    counts = rows.groupBy("table", "fold", verdict.alias("y")).agg(F.count("*").alias("n")).collect()
    in_table = sum(r.n for r in counts if r.table)
    weights = (min(8.0, TABLE_WEIGHT / max(sum(r.n for r in counts if not r.table), 1)), TABLE_WEIGHT / in_table)
    starts = []
    for m in range(FOLDS + 1):
        bad, good = (sum(r.n * weights[r.table] for r in counts if r.fold != m and r.y == y) for y in (0, 1))
        starts.append(float(np.log((good + 1) / (bad + 1))))
    values = (
        rows.select("table", F.posexplode(F.slice("row", 1, len(FEATURES))).alias("feature", "value"))
        .groupBy("feature", "value", "table").agg(F.count("*").alias("n")).orderBy("feature", "value", "table").collect()
    )
    limits = []
    for f in range(len(FEATURES)):
        of = [(r.value, r.n * weights[r.table]) for r in values if r.feature == f]
        limits.append(_edges(*map(np.array, zip(*of, strict=True)), bins))

    def pack(part):
        while chunk := list(islice(part, BLOCK_ROWS)):
            yield Block(chunk, limits, weights, starts)

    # every level is a job over all partitions, so there are as many as there are full blocks
    blocks = rows.coalesce(-(-sum(r.n for r in counts) // BLOCK_ROWS)).rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
    models, blocks = boost_blocks(blocks, limits, starts)
    judged = _added_up(blocks, Block.judged, Counter())
    blocks.unpersist()
    y, kind, of_table, margin = map(np.array, zip(*sorted(judged), strict=True))
    weight = np.array([judged[key] for key in sorted(judged)]) * np.where(of_table, weights[1], weights[0])
    slope, offset = calibrate(margin / GRID, y, weight)
    p = 1 / (1 + np.exp(-np.clip(slope * margin / GRID + offset, -700, 700)))
    addable = of_table | (y == 0)
    thresholds = tuple(
        threshold(p[of], y[of], weight[of], precision) if (of := addable & (kind == k)).any() else 1.01 for k in range(len(KINDS))
    )
    return models[FOLDS], (slope, offset), thresholds


def _added(text, base, proposals, probabilities, limits):
    """Chosen proposals without overlaps, the likeliest first."""
    taken = Covered(base)
    chosen = []
    order = sorted(zip(proposals, probabilities, strict=True), key=lambda c: (-c[1], c[0]))
    for (kind, a, b), p in order:
        if p >= limits[kind] and not taken.touches(a, b):
            chosen.append((kind, a, b))
            taken.add(a, b)
    return chosen


def _joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs, model, id_column="doc_id", text_column="text"):
    """Per row: counts of base spans, their fingerprint, all spans, and how many were added."""
    trees, (slope, offset), limits = model

    def task(batches):
        for batch in batches:
            base, proposals, rows = [], [], []
            for number, text in enumerate(batch.column(1)):
                text = text.as_py()
                base.append(base_spans(text))
                known = set(base[-1])
                free = [c for c in candidates(text) if c not in known]
                proposals.append(free)
                rows += [candidate_features(text, *c) for c in free]
            p = np.zeros(0)
            if rows:
                margin = margins(trees, np.array(rows, dtype=float))
                p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -700, 700)))
            out, at = [], 0
            for spans, free in zip(base, proposals, strict=True):
                added = _added(None, spans, free, p[at : at + len(free)], limits)
                at += len(free)
                counts = [sum(k == kind for k, _, _ in spans) for kind in range(len(KINDS))]
                digest = hashlib.sha256(_joined(spans).encode()).hexdigest()
                out.append((*counts, digest, _joined([*spans, *added]), len(added)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(
        task,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )
