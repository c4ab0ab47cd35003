import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import clashing, documents, edge_rows
from tramline.llm import bilinear_lm as L


def words(text):
    return (text or "").encode().lower().split() + [b"</s>"]


def base_scores(rows):
    """{position: (n_tokens, n_known, train_tokens, base score)} in plain Python."""
    counts = Counter()
    for i, t in rows:
        if i is not None and crc32(str(i).encode()) % 10:
            counts.update(words(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out.append((i, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6 if abs(base) < 1e5 else 4)))
    return sorted(out, key=repr)


def scored(docs, **parameters):
    model, counts = L.learn(docs, ~L.held_out(F.col("doc_id")), **{"rounds": 1} | parameters)
    return model, L.score(docs, model, counts).collect()


@pytest.mark.parametrize("table_words", [5, 1 << 12])
def test_base_scores(spark, table_words):
    """With few words in the table most counts come by the join, with many none."""
    rows = edge_rows() + [(100 + k, f"alpha b{k % 7} gamma d{k} Alpha") for k in range(60)]
    for docs in (documents(spark, rows), clashing(spark, rows)):
        _, found = scored(docs, table_words=table_words, own_classes=table_words)
        got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6 if abs(r.base_score) < 1e5 else 4)) for r in found]
        assert sorted(got, key=repr) == base_scores(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_empty_tables(spark):
    assert scored(documents(spark, []))[1] == []
    only_held = next(k for k in range(1000) if crc32(str(k).encode()) % 10 == 0)
    _, found = scored(documents(spark, [(only_held, "a b"), (None, None)]))
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in found} == {(3, 0, 0), (1, 0, 0)}


def test_tokens_end_every_text():
    hashes, ending, counts = L.tokens([b"A b", b"", b" a\x1cx  b\x85 "])
    assert counts.tolist() == [3, 1, 3]
    assert [int(h == L.END) for h in hashes] == [0, 0, 1, 1, 0, 0, 1]
    assert hashes[1] == L.tokens([b"B"])[0][0] and hashes[0] != hashes[4]
    assert len(ending) == 7 and (ending >= 0).all() and (ending < L.ENDINGS).all()


def test_contexts_stop_at_the_beginning():
    first, second = L.contexts(np.array([5, 6, 7, 1, 8, 2]), np.array([3, 1, 2]), 99)
    assert first.tolist() == [99, 5, 6, 99, 99, 8] and second.tolist() == [99, 99, 5, 99, 99, 99]


def test_probabilities_add_up_to_one(spark):
    rows = [(k, f"a{k % 3} b{k % 5} c{k % 40} d{k}") for k in range(200)]
    docs = documents(spark, rows)
    model, _ = L.learn(docs, ~L.held_out(F.col("doc_id")), own_classes=20, rounds=1)
    tables = L.Tables(model)
    n = len(model.frequency)
    for first, second in ((0, 1), (n, n), (n - 1, 0)):
        p = 10 ** tables.log10(np.arange(n), np.full(n, first), np.full(n, second))
        assert abs(p.sum() - 1) < 1e-4
    # within a class of rare words: known words and the unknown part
    rest = model.counts[model.classes >= model.n_own]
    classes = model.classes[model.classes >= model.n_own] - model.n_own
    for c in set(classes.tolist()):
        known = sum(10 ** (math.log10(x) + model.share[c]) for x in rest[classes == c])
        assert abs(known + 10 ** model.unknown[c] - 1) < 1e-9


def test_training_learns_what_follows():
    """Pairs of classes that always follow each other become likely; an untrained model knows frequencies only."""
    random = np.random.default_rng(0)
    first = random.integers(0, 20, 60_000)
    positions = np.column_stack(((first + 1) % 20, first, random.integers(0, 20, 60_000))).astype(np.int32)
    frequency = np.full(20, 0.05)
    model = L.Model(np.empty(0, np.uint64), np.empty(0), np.empty(0, int), 1, 1, 20, np.zeros(0), np.zeros(0), frequency, {})
    vectors = L._start(model, 16)
    trained = L.train_copy(vectors, frequency, positions, 1)
    score = lambda v: L.Tables(model._replace(vectors=v)).log10(*positions[:2000].T).mean()
    assert abs(score(vectors) - math.log10(0.05)) < 0.01
    assert score(trained) > -0.3


@pytest.mark.parametrize("partitions", [1, 5])
def test_every_position_is_learned_from(spark, partitions):
    """However the texts lie: one task has far more than 100,000 positions, in several groups of texts."""
    rows = [(k, " ".join(f"a{(k + j) % 50}" for j in range(2000))) for k in range(300)]
    model, _ = L.learn(documents(spark, rows, partitions), F.lit(True), rounds=2)
    assert model.learned == model.total == 300 * 2001


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, counts = L.learn(docs, ~L.held_out(F.col("doc_id")), rounds=2)
    found = L.score(docs, model, counts).filter(L.held_out(F.col("doc_id")))
    sums = found.agg(F.sum("score"), F.sum("base_score"), F.count("*"), F.count_if(F.col("score") > F.col("base_score"))).first()
    assert sums[0] > 0.9 * sums[1] and sums[3] > 0.95 * sums[2]
