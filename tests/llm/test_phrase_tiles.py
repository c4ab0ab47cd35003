import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.common import LOWER, clashing, documents, edge_rows
from tramline.llm import phrase_tiles as P

BREAKS = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def plain_collocations(rows, max_words=3, least=10, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        counter = counts.setdefault(lang or "und", Counter())
        for piece in BREAKS.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            totals[lang or "und"] += len(words)
            for n in range(1, max_words + 1):
                counter.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, counter in counts.items():
        able = {p: a for p, a in counter.items() if len(p) > 1 and a >= least}
        around = Counter()
        for phrase, a in able.items():
            for n in range(2, len(phrase)):
                for k in range(len(phrase) - n + 1):
                    around[phrase[k : k + n]] = max(a, around[phrase[k : k + n]])
        best = []
        for phrase, a in able.items():
            if 100 * around[phrase] >= 50 * a:
                continue
            score, _, left, right = min(
                (1_000_000 * a * a // (counter[phrase[:k]] * counter[phrase[k:]]), k, counter[phrase[:k]], counter[phrase[k:]])
                for k in range(1, len(phrase)))
            best.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def random_rows(seed, n=60):
    chance = random.Random(seed)
    words = ["the", "THE", "a", "été", "x\xa0y", "\x1c", "b-c", "Zürich"] + [f"w{k}" for k in range(25)]
    weights = [30, 5, 20, 8, 4, 3, 5, 9] + [60 / (k + 2) for k in range(25)]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]
    rows = []
    for k in range(n):
        text = "".join(w + chance.choice(marks) for w in chance.choices(words, weights, k=chance.randint(0, 120)))
        rows.append((k, text, chance.choice(["en", "fr", None, "und"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


@pytest.mark.parametrize("options", [
    {}, {"ranked": 4, "n_bits": 64}, {"ranked": 12, "slice_bytes": 40, "flush_pairs": 50}, {"ranked": 0, "n_bits": 1 << 16},
    {"max_words": 4, "ranked": 20}, {"max_words": 2}, {"least": 2, "ranked": 30, "n_bits": 256},
])
def test_equals_plain_python(spark, options):
    """With ranks for all words, for some and for none: the way of counting never shows."""
    rows = random_rows(1)
    plain = {k: v for k, v in options.items() if k in ("max_words", "least")}
    found = P.collocations(frame(spark, rows), **options).collect()
    wanted = plain_collocations([(lang, text) for _, text, lang in rows], **plain)
    assert sorted(tuple(r) for r in found) == wanted and wanted


def test_many_partitions_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "ONE_ROUND", 2)
    rows = random_rows(2)
    found = P.collocations(frame(spark, rows).repartition(11), top=15).collect()
    assert sorted(tuple(r) for r in found) == plain_collocations([(lang, text) for _, text, lang in rows], top=15)


def test_dense_and_sorted_tiles_agree():
    chance = np.random.default_rng(1)
    left, last = (chance.geometric(0.0008, 30_000) - 1 for _ in range(2))
    whole = Counter(zip(left.tolist(), last.tolist(), strict=True))
    for dense in (1, 2000, 1 << 30):
        found = Counter()
        for tile, cells, counts in P.tiles(left, last, dense):
            assert np.all(np.diff(cells) > 0)
            for cell, n in zip(cells.tolist(), counts.tolist(), strict=True):
                found[((tile >> 32) << 11) + (cell >> 11), ((tile & 0xFFFFFFFF) << 11) + (cell & 2047)] += n
        assert found == whole


def test_merging_tiles(monkeypatch):
    monkeypatch.setattr(P, "AREA", 16)
    merge, wanted, chance = P.Merge(), Counter(), random.Random(4)
    for _ in range(50):
        cells = sorted(chance.sample(range(40), chance.randint(1, 20)))
        counts = [chance.randint(1, 1 << 40) for _ in cells]
        merge.add(np.array(cells), np.array(counts))
        wanted.update(dict(zip(cells, counts, strict=True)))
    cells, counts = merge.settle()
    assert dict(zip(cells.tolist(), counts.tolist(), strict=True)) == wanted and merge.waiting <= 40


def test_scores_of_large_counts_are_exact(spark):
    """Products of counts far beyond 64 bits."""
    big = 3_000_000_000_007
    rows = [("en", "a", big, 1), ("en", "b", big - 1, 1), ("en", "a b", big - 5, 2), ("en", None, 10 * big, 1)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, f long, size int")
    row = P.score_phrases(counts).first()
    assert row.score == 1_000_000 * (big - 5) ** 2 // (big * (big - 1)) and (row.l, row.r, row.n) == (big, big - 1, 10 * big)


def test_unusual_rows(spark):
    rows = edge_rows()
    wanted = plain_collocations([("en", text) for _, text in rows])
    assert sorted(tuple(r) for r in P.collocations(documents(spark, rows)).collect()) == wanted and wanted
    found = P.collocations(clashing(spark, rows), lang_column="row").collect()
    assert sorted(tuple(r)[1:] for r in found) == [w[1:] for w in wanted]
    assert P.collocations(documents(spark, [])).collect() == []
    assert P.collocations(documents(spark, [(1, None), (2, " . ")])).collect() == []


def test_long_text_is_whole(spark):
    text = "alpha beta gamma " * 40_000 + "x" * 9_000_000 + " omega"
    found = P.collocations(documents(spark, [(1, text)])).collect()
    assert [(r.phrase, r.a, r.n) for r in found] == plain_phrases(text)


def plain_phrases(text):
    return [(r[2], r[3], r[6]) for r in plain_collocations([("en", text)])]
