"""Scores of whole texts by a log-bilinear language model.

Tokens are words, with A-Z lowered, and one end per text. Counts cover every token of the training
texts. The most frequent words are classes of their own; every other word, known or not, belongs to
a class by its last two bytes. The model predicts the class of a token from the classes of the two
before it: each context word's vector goes through the matrix of its position, and the sum is
multiplied with the vector of the class and added to its bias. A word's share in its class is its
share of the class's training tokens, less a part for unknown words, which is the share of words
seen once. So the probabilities of all classes and words in every context add up to one.

Vectors are trained in numpy by noise-contrastive estimation, with noise from the frequencies of
classes. In each round every task trains a copy on its own texts, group of texts by group, and the
copies are averaged; each round reads another part of the training texts, and together the rounds read
all of them. Every position is learned from, and equally often, wherever its text lies.

Scores need no approximation: the exponentials of both contexts' tables are multiplied as matrices,
which yields the normaliser of every pair of contexts at once. A table of the counts of the most
frequent words, of bounded size, goes to every task; words beyond it are joined with their counts
by shuffle, one row per text and word.

Results for unusual input: null and empty texts are the end alone; a null id is in the held-out
part; repeated rows are scored one by one; without training texts all counts are 0 and the score is
the logarithm of equal shares; an empty table gives no rows.
"""

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .shingles import _LOWER, _SPACE, chunks, mix, words
from .storage import shared_folder, text_of

TABLE_WORDS = 1 << 19
OWN_CLASSES = 1024
ENDINGS = 128
DIMENSIONS = 32
ROUNDS = 4
BATCH = 2048
NOISE = 96
RATE = 0.1
FLUSH = 2_000_000
END = np.uint64(0x3C9D6A1F5B7E2481)
SMOOTHING = 0.1


def held_out(doc_id, folds=10):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def tokens(group):
    """Hashes, endings and number of tokens per text, the end of each text included."""
    hashes, counts = words(group)
    data = _LOWER[np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    last = np.flatnonzero(~space & np.append(space[1:], True))
    before = data[np.maximum(last - 1, 0)].astype(np.uint64)
    before[space[np.maximum(last - 1, 0)] | (last == 0)] = 0
    ending = (mix(data[last].astype(np.uint64) * np.uint64(256) + before) % np.uint64(ENDINGS)).astype(np.int32)
    ends = np.cumsum(counts)
    hashes = np.insert(hashes, ends, END)
    ending = np.insert(ending, ends, 0)
    return hashes, ending, counts + 1


def _count_task(batches):
    held, size = [], 0

    def merged():
        hashes, ending, n = (np.concatenate(c) for c in zip(*held, strict=True))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return unique, ending[first], np.bincount(inverse, n, len(unique)).astype(np.int64)

    def rows():
        unique, ending, n = merged()
        return pa.RecordBatch.from_arrays(
            [pa.array(unique.view(np.int64)), pa.array(ending), pa.array(n)], names=["hash", "ending", "n"]
        )

    for batch in batches:
        for group in chunks(batch.column(0).to_pylist()):
            hashes, ending, _ = tokens(group)
            unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
            held.append((unique, ending[first], n))
            size += len(unique)
            if size > FLUSH:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield rows()
                    held.clear()
                    size = 0
    if held:
        yield rows()


class Model(NamedTuple):
    hashes: np.ndarray  # frequent words, sorted
    counts: np.ndarray  # their counts
    classes: np.ndarray  # and classes
    total: int  # training tokens
    distinct: int  # different ones
    n_own: int
    share: np.ndarray  # per ending: log10 of what known words have of a class, per training token
    unknown: np.ndarray  # per ending: log10 of what unknown words have of a class
    frequency: np.ndarray  # per class
    vectors: dict  # r, q, b, c1, c2
    learned: int = 0  # positions the vectors have learned from


def count_words(train_texts):
    """The counts of all words of the training texts, written to the shared folder."""
    spark = train_texts.sparkSession
    folder = f"{shared_folder(spark)}/word-counts-{uuid.uuid4().hex}"
    counts = (
        train_texts.mapInArrow(_count_task, "hash long, ending int, n long")
        .groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    )
    counts.write.parquet(folder)
    return spark.read.schema("hash long, ending int, n long").parquet(folder)


def _at_least(histogram, most):
    """The lowest count such that at most so many words have it or a higher one."""
    limit, words_so_far = None, 0
    for n, size in sorted(histogram, reverse=True):
        words_so_far += size
        if words_so_far > most:
            break
        limit = n
    return limit if limit is not None else 1 << 62


def _outline(counts, table_words, own_classes):
    """The model without vectors: the table of frequent words and the shares of words in classes."""
    histogram = counts.groupBy("n").agg(F.count("*").alias("size"))
    top = histogram.orderBy(F.desc("n")).limit(table_words).collect()
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    in_table, own = (_at_least([(r["n"], r["size"]) for r in top], most) for most in (table_words, own_classes))
    table = counts.filter((F.col("n") >= in_table) | (F.col("hash") == int(END.view(np.int64)))).toPandas()
    hashes = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, n, ending = hashes[order], table["n"].to_numpy()[order], table["ending"].to_numpy()[order]
    is_own = (n >= own) | (hashes == END)
    classes = np.empty(len(n), dtype=np.int32)
    classes[is_own] = np.arange(is_own.sum())
    n_own = int(is_own.sum())
    classes[~is_own] = n_own + ending[~is_own]
    rest = counts.filter((F.col("n") < own) & (F.col("hash") != int(END.view(np.int64)))).groupBy("ending").agg(
        F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")
    ).collect()
    mass, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in rest:
        mass[row["ending"]], once[row["ending"]] = row["n"], row["once"]
    unknown = (once + 0.5) / (mass + 1.0)
    share = np.log10(1 - unknown) - np.log10(np.maximum(mass, 1))
    frequency = np.concatenate((n[is_own].astype(float), mass)) + 0.5
    return Model(hashes, n, classes, int(sums["total"] or 0), sums["distinct"], n_own, share, np.log10(unknown),
                 frequency / frequency.sum(), {})


def _start(model, dimensions, seed=7):
    random = np.random.default_rng(seed)
    n = len(model.frequency)
    small = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "r": small(n + 1, dimensions), "q": small(n, dimensions) * 0, "b": np.log(model.frequency).astype(np.float32),
        "c1": np.eye(dimensions, dtype=np.float32), "c2": np.eye(dimensions, dtype=np.float32) * 0.5,
    }


def class_ids(model, hashes, ending):
    """Class of each token, and its place in the table of frequent words or -1."""
    if not len(model.hashes):
        return ending + model.n_own, np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
    known = model.hashes[place] == hashes
    return np.where(known, model.classes[place], ending + model.n_own), np.where(known, place, -1)


def contexts(classes, counts, begin):
    """Classes of the two tokens before each one; ``begin`` where the text begins."""
    first = np.concatenate(([begin], classes[:-1]))
    second = np.concatenate(([begin, begin], classes[:-2]))[: len(classes)]
    starts = np.cumsum(counts) - counts
    first[starts] = begin
    second[starts] = begin
    longer = starts[counts > 1] + 1
    second[longer] = begin
    return first, second


def _sum_rows(index, rows, size):
    """Sums of rows by index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    return index[starts], np.add.reduceat(rows[order], starts, axis=0)


class Copy:
    """Vectors that learn from positions (target, first, second context) by noise-contrastive steps with Adagrad."""

    def __init__(self, vectors, frequency, seed, rate=RATE, batch=BATCH, noise=NOISE):
        self.v = {k: x.copy() for k, x in vectors.items()}
        self.past = {k: np.full(x.shape, 0.1, dtype=np.float32) for k, x in self.v.items()}
        self.random = np.random.default_rng(seed)
        self.edge = np.cumsum(frequency)
        self.log_noise = np.log(noise * frequency).astype(np.float32)
        self.rate, self.batch, self.noise = rate, batch, noise
        self.learned = 0

    def _move(self, name, index, gradient):
        v, past = self.v[name], self.past[name]
        if index is None:
            past += gradient * gradient
            v -= self.rate * gradient / np.sqrt(past)
        else:
            index, gradient = _sum_rows(index, gradient, len(v))
            past[index] += gradient * gradient
            v[index] -= self.rate * gradient / np.sqrt(past[index])

    def learn(self, positions):
        """Every position once, in a random order."""
        v, batch, edge, log_noise = self.v, self.batch, self.edge, self.log_noise
        positions = positions[self.random.permutation(len(positions))]
        for at in range(0, len(positions), batch):
            target, first, second = positions[at : at + batch].T
            drawn = np.minimum(np.searchsorted(edge, self.random.random(self.noise) * edge[-1]), len(edge) - 1)
            r1, r2, qt, qn = v["r"][first], v["r"][second], v["q"][target], v["q"][drawn]
            h = r1 @ v["c1"] + r2 @ v["c2"]
            true = (h * qt).sum(1) + v["b"][target] - log_noise[target]
            false = h @ qn.T + v["b"][drawn] - log_noise[drawn]
            dt = (-1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32) / batch * 64
            dn = (1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32) / batch * 64
            dh = dt[:, None] * qt + dn @ qn
            self._move("q", np.concatenate((target, drawn)), np.concatenate((dt[:, None] * h, dn.T @ h)))
            self._move("b", np.concatenate((target, drawn)), np.concatenate((dt, dn.sum(0))))
            self._move("r", np.concatenate((first, second)), np.concatenate((dh @ v["c1"].T, dh @ v["c2"].T)))
            self._move("c1", None, r1.T @ dh)
            self._move("c2", None, r2.T @ dh)
        self.learned += len(positions)


def train_copy(vectors, frequency, positions, seed, **parameters):
    """Vectors that have learned from every position once."""
    copy = Copy(vectors, frequency, seed, **parameters)
    copy.learn(positions)
    return copy.v


def _flat(vectors):
    return np.concatenate([vectors[k].ravel() for k in sorted(vectors)])


def _unflat(flat, like):
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _train_round(texts, model, number, slices=16):
    """The average of the copies that all tasks train, weighted by their positions."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def train(batches):
        model = shared.value
        begin = len(model.frequency)
        copy = Copy(model.vectors, model.frequency, 1000 * number + TaskContext.get().partitionId())
        for batch in batches:
            for group in chunks(batch.column(0).to_pylist()):
                hashes, ending, counts = tokens(group)
                classes, _ = class_ids(model, hashes, ending)
                rows = np.column_stack((classes, *contexts(classes, counts, begin))).astype(np.int32)
                copy.learn(rows)
        if copy.learned:
            flat = _flat(copy.v).astype(np.float64) * copy.learned
            for k, part in enumerate(np.array_split(flat, slices)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([float(copy.learned)]), pa.array([part.tobytes()], pa.binary())],
                    names=["slice", "weight", "sums"],
                )

    def add(batches):
        sums = {}
        for batch in batches:
            for k, w, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(part.as_py())
                old = sums.get(k)
                sums[k] = (w, part) if old is None else (old[0] + w, old[1] + part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()),
             pa.array([p.tobytes() for _, p in sums.values()], pa.binary())], names=["slice", "weight", "sums"],
        )

    schema = "slice int, weight double, sums binary"
    summed = texts.mapInArrow(train, schema).repartition(slices, "slice").mapInArrow(add, schema).collect()
    if not summed:
        return model
    flat = np.concatenate([np.frombuffer(r["sums"]) / r["weight"] for r in sorted(summed, key=lambda r: r["slice"])])
    return model._replace(vectors=_unflat(flat, model.vectors), learned=model.learned + int(summed[0]["weight"]))


def learn(docs, training, table_words=TABLE_WORDS, own_classes=OWN_CLASSES, dimensions=DIMENSIONS, rounds=ROUNDS,
          id_column="doc_id", text_column="text"):
    """(model, counts of all words) from the rows for which the condition ``training`` holds."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).filter(training)
    counts = count_words(rows.select("text"))
    model = _outline(counts, table_words, own_classes)
    model = model._replace(vectors=_start(model, dimensions))
    if model.total:
        for number in range(rounds):
            part = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == number)
            model = _train_round(part.select("text"), model, number)
    return model, counts


class Tables:
    """Log-probabilities of classes for all pairs of contexts, from matrix products."""

    def __init__(self, model):
        v = {k: x.astype(np.float64) for k, x in model.vectors.items()}
        self.one = (v["r"] @ v["c1"]) @ v["q"].T
        self.two = (v["r"] @ v["c2"]) @ v["q"].T + v["b"]
        top1, top2 = self.one.max(1), self.two.max(1)
        product = np.exp(self.one - top1[:, None]) @ np.exp(self.two - top2[:, None]).T
        self.normal = (np.log(product) + top1[:, None] + top2[None, :]).astype(np.float32)
        self.one, self.two = self.one.astype(np.float32), self.two.astype(np.float32)

    def log10(self, target, first, second):
        value = self.one[first, target] + self.two[second, target] - self.normal[first, second]
        return value.astype(np.float64) / np.log(10)


_TABLES = {}


def _tables(model):
    """The tables of a model, built once per worker process."""
    name = hashlib.sha1(_flat(model.vectors).tobytes()).digest()
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Tables(model)
    return _TABLES[name]


_SCORED = (
    "row long, hash long, kind int, times long, ending int, "
    "doc struct<doc_id: long, n_tokens: long, n_known: long, base: double, score: double>"
)


def _scan(shared):
    """Per text a row of what is known so far, and a row for each of its words beyond the table."""
    names = ["row", "hash", "kind", "times", "ending", "doc"]
    doc_type = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                          ("base", pa.float64()), ("score", pa.float64())])

    def task(batches):
        model = shared.value
        tables = _tables(model)
        begin = len(model.frequency)
        whole = model.total + SMOOTHING * (model.distinct + 1)
        log_base = np.log10((model.counts + SMOOTHING) / whole)
        own = model.classes < model.n_own
        log_share = np.where(own, 0.0, np.log10(np.maximum(model.counts, 1)) + model.share[np.where(own, 0, model.classes - model.n_own)])
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            done = 0
            for group in chunks(batch.column(1).to_pylist()):
                hashes, ending, counts = tokens(group)
                classes, place = class_ids(model, hashes, ending)
                in_table = place >= 0
                value = tables.log10(classes, *contexts(classes, counts, begin))
                base = np.zeros(len(hashes))
                if len(log_base):
                    value += np.where(in_table, log_share[place], 0.0)
                    base = np.where(in_table, log_base[place], 0.0)
                starts = np.cumsum(counts) - counts
                n = len(group)
                docs = pa.StructArray.from_arrays(
                    [ids.slice(done, n), pa.array(counts.astype(np.int64)), pa.array(np.add.reduceat(in_table.astype(np.int64), starts)),
                     pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(value, starts))], fields=list(doc_type),
                )
                row = at + np.arange(n)
                keys = mix(row.astype(np.uint64)).view(np.int64)
                zero = np.zeros(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(keys), pa.array(zero.astype(np.int32)), pa.array(zero),
                     pa.array(zero.astype(np.int32)), docs], names=names,
                )
                text = np.repeat(np.arange(n), counts)[~in_table]
                beyond, its = hashes[~in_table], ending[~in_table]
                if len(beyond):
                    order = np.lexsort((beyond, text))
                    text, beyond, its = text[order], beyond[order], its[order]
                    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (beyond[1:] != beyond[:-1]))))
                    times = np.diff(np.append(first, len(text)))
                    m = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at + text[first]), pa.array(beyond[first].view(np.int64)), pa.array(np.ones(m, dtype=np.int32)),
                         pa.array(times.astype(np.int64)), pa.array(its[first].astype(np.int32)), pa.nulls(m, doc_type)], names=names,
                    )
                done += n
                at += n

    return task


def score(docs, model, counts, id_column="doc_id", text_column="text"):
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    scanned = texts.mapInArrow(_scan(shared), _SCORED)
    known = counts.select("hash", F.lit(1).alias("kind"), F.col("n"))
    # model.total and the rest are numbers of the driver: constants of the plan
    whole = model.total + SMOOTHING * (model.distinct + 1)
    share, unknown = (F.array(*[F.lit(float(x)) for x in values]) for values in (model.share, model.unknown))
    at = F.col("ending") + 1
    n = F.coalesce("n", F.lit(0))
    beyond = F.col("kind") == 1
    terms = scanned.join(known, ["hash", "kind"], "left").select(
        "row", "doc",
        F.when(beyond, F.col("times") * F.log10((n + SMOOTHING) / F.lit(whole))).alias("base"),
        F.when(beyond, F.col("times") * F.when(n > 0, F.log10(n.cast("double")) + F.element_at(share, at))
               .otherwise(F.element_at(unknown, at))).alias("score"),
        F.when(beyond & (n > 0), F.col("times")).alias("n_known"),
    )
    added = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        terms.groupBy("row").agg(
            F.max("doc.doc_id").alias("doc_id"), F.max("doc.n_tokens").alias("n_tokens"),
            (F.max("doc.n_known") + added("n_known")).alias("n_known"),
            (F.max("doc.base") + added("base")).alias("base_score"), (F.max("doc.score") + added("score")).alias("score"),
        )
        .select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
    )
