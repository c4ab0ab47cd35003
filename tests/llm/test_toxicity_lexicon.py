import random

import pytest
from pyspark.sql import functions as F

from tests.llm.common import clashing, documents, edge_rows
from tramline.llm import toxicity_lexicon as X

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def lexicon(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return X.learn(X.cut(X.labelled(docs, labels, X.training_fold)))


def test_held_out_accuracy(spark, lexicon):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = (
        X.score(docs, lexicon).join(labels, "doc_id").filter(X.held_out(F.col("doc_id")))
        .groupBy("toxic", (F.col("score") >= 0.5).alias("said")).count().collect()
    )
    table = {(r.toxic, r.said): r["count"] for r in found}
    assert table.get((0, True), 0) <= 0.01 * table[0, False]
    assert table[1, True] >= 0.9 * (table[1, True] + table.get((1, False), 0))


@pytest.mark.parametrize("word", ["idiot", "IDIOT!", "1d1ot", "іdіоt", "id​iot", "!d!ot", "ｉｄｉｏｔ"])
def test_disguised_words(lexicon, word):
    plain = X.score_text(X.Matcher(lexicon.weights, lexicon.exceptions), lexicon.curve, "you are a idiot and a loser here")
    found = X.score_text(X.Matcher(lexicon.weights, lexicon.exceptions), lexicon.curve, f"you are a {word} and a loser here")
    assert found == plain > 0.5


def test_hits_begin_words_and_exceptions_hold():
    matcher = X.Matcher({"trash": 2.0, "tras": 1.0}, frozenset({("trash", "can")}))
    assert [h[0] for h in matcher.hits(X.fold("trash TRASHY untrash"))] == [2.0, 2.0]
    assert matcher.hits(X.fold("a trash can")) == []
    assert X.Matcher({}).hits("anything") == []


def test_copies_are_no_evidence(spark):
    """A word that only copies of one toxic text have isn't learned; one in many texts is."""
    rows = [("zebra grommet idle " + "pad " * 5, True)] * 30
    rows += [(f"w{k} x{k} scoundrel y{k}", True) for k in range(30)] + [(f"w{k} x{k} z{k}", False) for k in range(200)]
    weights = X.learn(spark.createDataFrame(rows, "text string, toxic boolean")).weights
    assert any("scoundrei".startswith(w) for w in weights) and not any("grommet".startswith(w) for w in weights)


def test_unusual_rows(spark, lexicon):
    rows = edge_rows()
    for docs in (documents(spark, rows), clashing(spark, rows)):
        found = X.score(docs, lexicon).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        assert X.drop_toxic(docs, lexicon).columns == docs.columns
        assert X.drop_toxic(docs, lexicon).count() == sum(r.score < 0.5 for r in found)
    assert X.score(documents(spark, []), lexicon).count() == 0


def test_labels(spark):
    docs = documents(spark, [(k, f"word{k} bad{k % 3} thing") for k in range(12)] + [(None, "x")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (3, 0, 1), (99, 1, 1)], "doc_id long, toxic int, quality int")
    every = lambda c: F.lit(True)
    assert sorted(map(tuple, X.labelled(docs, labels, every).collect())) == [("word1 bad1 thing", True), ("word3 bad0 thing", False)]
    assert X.labelled(docs, labels, every, label_rows=1).count() <= 1
    none = X.learn(X.labelled(docs, labels.filter("toxic = 0"), every))
    assert {r.score for r in X.score(docs, none).collect()} == {0.0}


def naive_hits(folded, weights, exceptions):
    """Hits by trying every entry at the beginning of every word."""
    words = [m for m in X._WORD.finditer(folded)]
    out = []
    for k, m in enumerate(words):
        fitting = [w for e, w in weights.items() if m[0].startswith(e)]
        before = words[k - 1][0] if k else ""
        after = words[k + 1][0] if k + 1 < len(words) else ""
        if fitting and (before, m[0]) not in exceptions and (m[0], after) not in exceptions:
            out.append((max(fitting), before, m[0], after))
    return out


def test_hits_equal_a_naive_search():
    """Words far from each other included: neighbours are found over any gap."""
    chance = random.Random(6)
    words = ["tra", "trash", "trashy", "can", "clean", "ug", "ugly", "ugliest", "x" * 90, "e", "été"]
    weights = {"tra": 1.0, "trash": 2.5, "ug": 0.5, "ugli": 3.0, "x" * 10: 1.5}
    exceptions = frozenset({("trash", "can"), ("clean", "ugly"), ("x" * 90, "e"), ("can", "x" * 90)})
    matcher = X.Matcher(weights, exceptions)
    for _ in range(60):
        text = "".join(chance.choice(words) + chance.choice([" ", ", ", "-", " " * 300, "\n" * 70, "7"]) for _ in range(chance.randint(0, 25)))
        folded = X.fold(text)
        assert matcher.hits(folded) == naive_hits(folded, weights, exceptions)


def test_white_space_changes_no_score(lexicon):
    matcher = X.Matcher(lexicon.weights, lexicon.exceptions)
    for text in ("you are a idiot and a loser here", "nothing of that kind", "", " "):
        plain = X.score_text(matcher, lexicon.curve, text)
        assert X.score_text(matcher, lexicon.curve, text.replace(" ", " " * 200)) == plain
        assert X.score_text(matcher, lexicon.curve, text.replace(" ", "\n\t ")) == plain
