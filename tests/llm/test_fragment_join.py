import pickle
import random

import numpy as np
import pytest

from tests.llm.common import clashing, documents, edge_rows, sentence, shingles
from tramline.llm import fragment_join
from tramline.llm.shingles import shingle_sets


def connected(rows, percent=80):
    """Sets of all rows and their groups of positions, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    return sets, list(groups.values())


def smallest(rows, group):
    return min((rows[k][0] for k in group if rows[k][0] is not None), default=None)


def expected(rows, percent=80):
    sets, groups = connected(rows, percent)
    return sorted(
        ((rows[k][0], len(sets[k]), smallest(rows, g) if sets[k] else rows[k][0]) for g in groups for k in g), key=repr
    )


def near_copies(base, n, edits, seed, first):
    rows, chance = [], random.Random(seed)
    for k in range(n):
        words = base.split()
        for _ in range(chance.randint(0, edits)):
            words[chance.randrange(len(words))] = f"e{chance.randrange(10**6)}"
        rows.append((first + k, " ".join(words)))
    return rows


def found(docs, **parameters):
    return sorted(map(tuple, fragment_join.jaccard_components(docs, **parameters).collect()), key=repr)


def test_sets_hold_every_distinct_shingle():
    texts = [t or "" for _, t in edge_rows()] + ["a b c d e f a b c d e f", "x\x1cy z\x85w \xa0 q r"]
    for text, numbers in zip(texts, shingle_sets(texts), strict=True):
        assert len(numbers) == len(shingles(text))
        assert np.all(numbers[1:] > numbers[:-1])


def test_unusual_rows(spark):
    rows = edge_rows()
    assert found(documents(spark, rows)) == expected(rows)
    assert found(clashing(spark, rows)) == expected(rows)
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize(("large", "few"), [(64, 100_000), (3, -1)])
def test_groups_of_near_copies(spark, monkeypatch, large, few):
    """The same components, with all pairs at once and with rounds of stars first."""
    monkeypatch.setattr(fragment_join, "LARGE_GROUP", large)
    monkeypatch.setattr(fragment_join, "FEW_PAIRS", few)
    rows = near_copies(sentence(11, 60), 60, 3, 1, 100) + near_copies(sentence(12, 200), 30, 12, 2, 300)
    rows += near_copies(sentence(13, 25), 12, 1, 3, 500) + [(600 + k, sentence(20 + k, 30 + k)) for k in range(20)]
    passage = sentence(99, 55)
    rows += [(700 + k, f"{sentence(200 + k, 60)} {passage}") for k in range(15)]
    assert found(documents(spark, rows, 4)) == expected(rows)


def test_thresholds_and_hot_numbers(spark, monkeypatch):
    monkeypatch.setattr(fragment_join, "HOT", 3)
    rows = near_copies(sentence(31, 50), 25, 4, 5, 1)
    for percent in (50, 80, 95):
        assert found(documents(spark, rows), percent=percent) == expected(rows, percent)


def test_exact_edge_of_the_threshold(spark):
    base = sentence(41, 14)  # ten shingles; nine new words after it leave 10 / (10 + k)
    rows = [(1, base), (2, base + " x1 x2"), (3, base + " y1 y2 y3")]
    assert found(documents(spark, rows)) == expected(rows)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert sizes == {1: 10, 2: 12, 3: 13}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5000, 4000), (7, 7)]
    roots = dict(map(tuple, fragment_join.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert roots == {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(60)} | {5000: 4000, 4000: 4000}


def test_one_of_each_component_stays(spark):
    rows = edge_rows() + near_copies(sentence(51, 60), 20, 2, 9, 100)
    docs = documents(spark, rows)
    stay = fragment_join.keep_one_per_component(docs)
    assert stay.columns == docs.columns
    _, groups = connected(rows)
    assert sorted(map(repr, (r.doc_id for r in stay.collect()))) == sorted(repr(smallest(rows, g)) for g in groups)


@pytest.mark.parametrize("sizes", [(0, 3), (40, 50), (100, 130), (500, 520), (500, 60_000)])
def test_signatures_bound_the_difference(sizes):
    first, second = (np.random.default_rng(k).choice(2**20, n, replace=False).astype(np.uint64) for k, n in enumerate(sizes))
    differing = fragment_join._differing(*(fragment_join._signature(x).tobytes() for x in (first, second)))
    assert differing <= len(np.setxor1d(first, second))
    assert fragment_join._differing(*[fragment_join._signature(second).tobytes()] * 2) == 0


def own_words(name, length):
    return " ".join(f"{name}x{k}" for k in range(length))


def test_only_shared_n_grams_are_spread(spark):
    """Entries of texts without a neighbour stay in their task, and shared ones of other tasks go."""
    passage = sentence(99, 12)
    rows = [(k, own_words(k, 80)) for k in range(40)] + [(100, passage), (101, passage + " end")]
    texts = fragment_join._texts(documents(spark, rows, 6), "doc_id", "text")
    counts = np.zeros(1 << fragment_join.BUCKET_BITS, dtype=np.int64)
    for numbers in shingle_sets([t for _, t in rows]):
        np.add.at(counts, (numbers & np.uint64(len(counts) - 1)).astype(np.int64), 1)
    order = spark.sparkContext.broadcast(fragment_join._Order(counts))
    shared = spark.sparkContext.broadcast(fragment_join._shared(texts, order, 50, 5))
    assert len(pickle.dumps(shared.value)) < 1_000_000  # of 32 MB
    entries = fragment_join._prefixes(texts, order, shared, 50, 5).collect()
    own = {fragment_join._set_class(numbers) for numbers in shingle_sets([passage, passage + " end"])}
    assert {e["class"] for e in entries} == own
    assert len({e["number"] for e in entries}) < len(entries)


def test_pairs_far_from_a_link_get_no_segments(spark, monkeypatch):
    """Texts that share a third to a half, beyond the bound of 128 bits, end before their whole sets are sent."""
    passage = own_words("p", 300)
    rows = [(k, f"{passage} {own_words(k, 240 + 5 * k)}") for k in range(12)]
    rows += near_copies(sentence(97, 300), 4, 2, 7, 100)
    sent, segments = [], fragment_join._segments

    def watched(texts, wanted, *others):
        sent.append(wanted.count())
        return segments(texts, wanted, *others)

    monkeypatch.setattr(fragment_join, "_segments", watched)
    assert found(documents(spark, rows)) == expected(rows)
    assert 0 < sum(sent) <= 4
