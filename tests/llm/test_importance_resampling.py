import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm.common import LOWER, clashing, documents, edge_rows, sentence
from tramline.llm import importance_resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, max_n=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[k : k + n]) for n in range(1, max_n + 1) for k in range(len(words) - n + 1)]


def plain_resample(rows, target, percent, max_n, n_buckets):
    """All of it in plain Python: id -> (n_features, weight, score), and the drawn ids in order."""
    bucket = lambda f: crc32(f.encode()) % n_buckets
    raw, wanted, of = Counter(), Counter(), []
    for _, text in rows:
        of.append([bucket(f) for f in plain_features(text, max_n)[1]])
        raw.update(of[-1])
    for text in target:
        wanted.update(bucket(f) for f in plain_features(text, max_n)[1])
    s_all, t_all = raw.total(), wanted.total()
    gain = [math.floor(1000.0 * math.log(((wanted[b] + 1.0) * (s_all + n_buckets)) / ((raw[b] + 1.0) * (t_all + n_buckets))))
            for b in range(n_buckets)]
    out = []
    for (number, text), buckets in zip(rows, of, strict=True):
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"2024:{'' if number is None else number}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        out.append((number, len(buckets), weight, score, len(plain_features(text)[0])))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = able[: percent * len(able) // 100]
    ranks = Counter()
    rows_ = []
    for r in out:
        rows_.append((*r[:4], None))
    for place, r in enumerate(drawn, 1):
        rows_.remove((*r[:4], None))
        rows_.append((*r[:4], place))
    return sorted(rows_, key=repr)


@pytest.mark.parametrize(("max_n", "n_buckets", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 70_000, 100)])
def test_equals_plain_python(spark, max_n, n_buckets, percent):
    chance = random.Random(max_n)
    rows = [(k, " ".join(chance.choice(["Äpfel", "x", "yes-no", "1,5", "Oslo"]) + str(chance.randint(0, 9))
                         for _ in range(chance.randint(0, 60)))) for k in range(80)]
    rows += edge_rows()
    target = ["x1 oslo3 äpfel9 x1", None, "", "Äpfel2 Äpfel2 1,58"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    wanted = plain_resample(rows, target, percent, max_n, n_buckets)
    for docs in (documents(spark, rows), clashing(spark, rows)):
        found = R.resample(docs, bench, percent=percent, max_n=max_n, n_buckets=n_buckets).collect()
        assert sorted((tuple(r) for r in found), key=repr) == wanted
    ranks = sorted(r["rank"] for r in found if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_slices_and_long_words_change_nothing():
    chance = random.Random(3)
    texts = [" ".join("w" * chance.choice([1, 3, 90]) + str(chance.randint(0, 5)) for _ in range(300)).encode() for _ in range(5)]
    texts += [b"", b"a" * 5000, "é".encode() * 700 + b" B"]
    whole = R.word_payloads(texts)
    words = [w for t in texts for w in WORD.findall(t.decode().translate(LOWER))]
    assert whole[0].tolist() == [crc32(w.encode()) for w in words]
    assert whole[1].tolist() == [len(w.encode()) for w in words]
    for size, longest in ((7, 64), (100, 2), (1000, 10_000)):
        cut = R.word_payloads(texts, slice_bytes=size, longest=longest)
        assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_crcs_are_composed():
    parts = [b"", b"a", b"some words", "ünï".encode() * 40, bytes(1000)]
    for one in parts:
        for two in parts:
            found = R.join_crcs(np.array([crc32(one)], np.uint32), np.array([crc32(two)], np.uint32), np.array([len(two)]))
            assert int(found[0]) == crc32(one + two)


def test_empty_tables_and_draw(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert R.resample(none, bench).collect() == []
    rows = [(k, sentence(k)) for k in range(40)]
    docs = documents(spark, rows)
    found = R.resample(docs, bench.limit(0)).collect()
    assert len(found) == 40 and sum(r["rank"] is not None for r in found) == 4
    drawn = R.draw(docs, bench, percent=25)
    assert drawn.columns == docs.columns and drawn.count() == 10


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(7, sentence(1))] * 30 + [(k, sentence(k)) for k in range(100, 110)]
    bench = spark.createDataFrame([(1, sentence(1))], "item_id int, text string")
    found = R.resample(documents(spark, rows), bench, percent=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"] is not None) == list(range(1, 21))
    assert len({(r.weight, r.score) for r in found if r.doc_id == 7}) == 1 and len(found) == 40
