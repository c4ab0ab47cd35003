import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import clashing, documents, edge_rows
from tramline.llm import language_crf as C

FOLDER = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ba", "da", "ga", "mu"], "bb": ["sti", "pre", "klo", "ne"], "cc": ["ño", "que", "lla", "ré"]}


def word(chance, lang):
    return "".join(chance.choice(SYLLABLES[lang]) for _ in range(chance.randint(1, 4)))


def text(chance, lang, size):
    return " ".join(word(chance, lang) + chance.choice(["", "", ",", "!", " 7"]) for _ in range(size))


@pytest.fixture(scope="module")
def model():
    chance = random.Random(1)
    windows = [(lang, list(C.words_of(text(chance, lang, 64)))) for lang in SYLLABLES for _ in range(60)]
    return C.fit(windows)


def brute_force(e, begins, a, start):
    """Distributions per word by summing over all label sequences."""
    n, size = e.shape
    out = np.zeros((n, size))
    for path in itertools.product(range(size), repeat=n):
        weight = 1.0
        for t, label in enumerate(path):
            weight *= e[t, label] * (start[label] if begins[t] else a[path[t - 1], label])
        for t, label in enumerate(path):
            out[t, label] += weight
    return out / out.sum(axis=1, keepdims=True)


def random_model(size, seed):
    chance = np.random.default_rng(seed)
    weights = chance.normal(size=(C.BUCKETS, size)).astype(np.float32)
    return C.Model(tuple("abcdef"[:size]), weights, {}, chance.normal(size=(size, size)), chance.normal(size=size))


@pytest.mark.parametrize(("size", "block"), [(2, 2), (3, 4), (3, 128), (2, 3)])
def test_messages_equal_all_sequences(monkeypatch, size, block):
    """Texts of several lengths in blocks of several lengths, in one slice and in many."""
    monkeypatch.setattr(C, "BLOCK", block)
    tagger = C.Tagger(random_model(size, block), slice_words=block)
    texts = [["x", "yy", "z"], ["q"], ["yy", "yy", "x", "w", "x"]]
    numbers = tagger.number(itertools.chain(*texts))
    first = np.array([k == 0 for words in texts for k in range(len(words))])
    found = np.concatenate([part for _, part in tagger.marginals(numbers, first)])
    e = tagger.table[numbers]
    at = 0
    for words in texts:
        n = len(words)
        wanted = brute_force(e[at : at + n], first[at : at + n], tagger.a, tagger.start)
        assert np.allclose(found[at : at + n], wanted)
        at += n


def test_training_messages_and_gradient():
    chance = np.random.default_rng(2)
    scores, a, start = chance.normal(size=(2, 4, 3)), chance.normal(size=(3, 3)), chance.normal(size=3)
    found, moves = C.chain_marginals(scores, a, start)
    begins = [True, False, False, False]
    wanted_moves = np.zeros((3, 3))
    for k in range(2):
        assert np.allclose(found[k], brute_force(np.exp(scores[k]), begins, np.exp(a), np.exp(start)))
        weights = {}
        for path in itertools.product(range(3), repeat=4):
            weights[path] = np.exp(start[path[0]] + sum(scores[k, t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in itertools.pairwise(path)))
        for path, weight in weights.items():
            for x, y in itertools.pairwise(path):
                wanted_moves[x, y] += weight / sum(weights.values())
    assert np.allclose(moves, wanted_moves)


def test_code_switched_text(model):
    chance = random.Random(9)
    parts = [("aa", text(chance, "aa", 30)), ("cc", text(chance, "cc", 25)), ("bb", text(chance, "bb", 40))]
    whole = " ".join(p for _, p in parts)
    spans = C.Tagger(model).spans(whole)
    right, at = 0, 0
    for lang, part in parts:
        for hit in re.finditer(r"[^\W\d_]+", part):
            right += any(a <= at + hit.start() and at + hit.end() <= b and said == lang for a, b, said, _ in spans)
        at += len(part) + 1
    assert right >= 0.95 * 95
    assert all(whole[a:b].strip() == whole[a:b] for a, b, _, _ in spans)
    assert model.transitions.diagonal().min() > (model.transitions - 100 * np.eye(3)).max()


def test_learned_transitions_decide_a_strange_word(model):
    tagger = C.Tagger(model)
    label = lambda words: [lang for a, b, lang, _ in tagger.spans(words) if words[a:b].find("zzz") >= 0]
    assert label("bada gamu zzz daba muga") == ["aa"] and label("stipre klone zzz neklo presti") == ["bb"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = C.learn(docs, ~C.held_out(F.col("doc_id")))
    found = C.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter(C.held_out(F.col("doc_id")))
    known = found.filter("lang IS NOT NULL AND lang_pred <> 'und'")
    assert known.filter("lang = lang_pred").count() >= 0.97 * known.count() > 100
    assert found.filter("lang_pred = 'und' AND text RLIKE '\\\\p{L}'").isEmpty()


def test_folds_hold_out_rows(spark):
    """Labels of the held-out rows change nothing."""
    chance = random.Random(4)
    rows = [(k, text(chance, lang, 30), lang) for k, lang in enumerate(list(SYLLABLES) * 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spoilt = frame.withColumn("lang", F.when(C.held_out(F.col("doc_id")), "aa").otherwise(F.col("lang")))
    results = [
        sorted(C.predict(f, C.learn(f, ~C.held_out(F.col("doc_id")))).collect()) for f in (frame, spoilt, frame.repartition(7))
    ]
    for other in results[1:]:
        assert [r[:3] for r in other] == [r[:3] for r in results[0]]
        assert np.allclose([r.score for r in other], [r.score for r in results[0]], atol=1e-8)
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in results[0]) == len(rows)


def test_unusual_rows(spark, model):
    rows = edge_rows() + [(30, "² ½ ١٢"), (31, "x²"), (32, "étude"), (33, "日本語 テスト")]
    unlettered = {i for i, t in rows if not any(map(str.isalpha, t or ""))}
    for docs in (documents(spark, rows), clashing(spark, rows)):
        found = C.predict(docs, model).collect()
        assert len(found) == len(rows)
        assert {r.doc_id for r in found if r.lang_pred == "und"} == unlettered
        assert all(0 <= r.score <= 1 and (r.score > 0) == (r.lang_pred != "und") for r in found)
    assert {r.lang_pred for r in C.predict(documents(spark, rows), None).collect()} == {"und"}
    assert C.predict(documents(spark, []), model).collect() == []
    assert C.learn(documents(spark, []), F.lit(True)) is None
    assert C.learn(documents(spark, [(1, None), (2, "12 !"), (3, "")]), F.lit(True)) is None
    single = C.learn(documents(spark, [(1, "one text"), (1, "one text")]), F.lit(True))
    assert [r.lang_pred for r in C.predict(documents(spark, [(5, "other")]), single).collect()] == ["en"]
    assert C.label_spans(documents(spark, rows), model).filter("start >= end").isEmpty()


def test_long_texts_are_whole(model):
    """A text of many slices gives the shares of its parts, and the end counts."""
    chance = random.Random(3)
    one, two = (text(chance, lang, 2000) for lang in ("aa", "bb"))
    long = " ".join([one] * 20 + [two] * 30)
    small = C.Tagger(model, slice_words=512)
    for tagger in (C.Tagger(model), small):
        counts, shares = tagger.shares([long, "", one])
        assert counts.tolist() == [len(list(C.words_of(long))), 0, len(list(C.words_of(one)))]
        assert abs(shares[0][1] - 0.6) < 0.01 and shares[2][0] > 0.97
    assert list(C.words_of("ab " * 700_000 + "c" * 1_500_000 + " end"))[-2:] == ["c" * 1_500_000, "end"]
