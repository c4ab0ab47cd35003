import random
import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import clashing, documents, edge_rows
from tramline.llm import pii_boosting as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    numbers = [int(d) for d in digits][::-1]
    return sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(numbers)) % 10 == 0


def plain(text):
    spans = [(0, *m.span()) for m in EMAIL.finditer(text)]
    spans += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and luhn(re.sub("[ -]", "", m[0]))]
    return spans + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


@given(st.text(alphabet="0123456789. -+()@ab%_é\n", max_size=80))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_plain_rules(text):
    assert P.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "4539 1488 0343 6467 x 4539148803436467", "a@b.c@d.e", "..@x.y", "1.2.3.4.5.6.7.8", "1.2.3.256 001.002.003.004",
    "+1 (555) 201-3344, +49 30 1", "x" * 50 + "@" + "y." * 20 + "z",
])
def test_base_spans_of_examples(text):
    assert P.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 100_000, "+1((" * 80_000, "1 " * 150_000, "a(at)" * 60_000])
def test_long_runs_take_little_time(text):
    began = time.process_time()
    P.candidates(text)
    P.base_spans(text)
    assert time.process_time() - began < 20


@pytest.fixture(scope="module")
def model():
    random = np.random.default_rng(3)
    rows = []
    for k in range(400):
        text = f"w{k} {random.choice(['call', 'the', 'mail'])} +1 ({random.integers(100, 999)}) 555-{random.integers(1000, 9999)} and "
        text += f"{random.integers(0, 400)}.{random.integers(0, 400)}.{random.integers(0, 400)}.{random.integers(0, 400)} or n{k}.x@h{k % 9}.example.com "
        text += "".join(map(str, random.integers(0, 10, 16))) + f" on 2021-{k % 12 + 1:02}-1{k % 10}"
        base = set(P.base_spans(text))
        rows += [[*map(float, P.candidate_features(text, *c)), float(c in base)] for c in P.candidates(text)]
    return P.train(rows + P.variant_rows()), np.array(rows)


def test_trees_tell_spans_from_others(model):
    (trees, (slope, offset), limits), rows = model
    assert all(0.5 <= limit <= 1.01 for limit in limits)
    p = 1 / (1 + np.exp(-(slope * P.margins(trees, rows[:, :-1]) + offset)))
    assert np.mean((p >= 0.5) == (rows[:, -1] > 0)) > 0.99


def spans(model, text):
    trees, (slope, offset), limits = model
    base = P.base_spans(text)
    free = [c for c in P.candidates(text) if c not in base]
    p = 1 / (1 + np.exp(-(slope * P.margins(trees, np.array([P.candidate_features(text, *c) for c in free], dtype=float)) + offset)))
    return base, P._added(text, base, free, p, limits)


def test_variants_are_added_and_others_are_not(model):
    model = model[0]
    text = "write to kim.roe (at) mail7.example.com or call (555) 203-7788 soon"
    base, added = spans(model, text)
    assert base == [] and {text[a:b] for _, a, b in added} == {"kim.roe (at) mail7.example.com", "(555) 203-7788"}
    assert spans(model, "released on 2022-11-03 as 2.0.1.4000 with 1234567 rows") == ([], [])


@pytest.mark.parametrize("count", [0, 60, 1500])
def test_further_data_in_the_documents_does_not_train_against_itself(spark, count):
    """The given documents, and others full of data beyond the base rules, which nobody has judged."""
    rows = [
        (-1 - k, f"call ({200 + k % 700}) {100 + k * 7 % 900}-{1000 + k} or write to k{k}.roe (at) post{k % 9}.example.com about card 3782 822463 10005")
        for k in range(count)
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(documents(spark, rows))
    model = P.train_on(docs)
    text = "write to kim.roe (at) mail7.example.com or call (555) 203-7788 about card 3714 496353 98431 soon"
    found = P.find(documents(spark, [(1, text)]), model).first().spans
    wanted = ("kim.roe (at) mail7.example.com", "(555) 203-7788", "3714 496353 98431")
    assert {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in found.split(",") if s)} == set(wanted)
    plain = "released on 2022-11-03 as 2.0.1.4000 with 1234567 rows"
    assert P.find(documents(spark, [(1, plain)]), model).first().n_added == 0


def test_copies_of_a_row_are_judged_unseen(monkeypatch):
    fits, judged = [], []
    boost, margins = P.boost, P.margins
    monkeypatch.setattr(P, "boost", lambda x, y, *a: fits.append({tuple(r) for r in x}) or boost(x, y, *a))
    monkeypatch.setattr(P, "margins", lambda model, x: judged.append({tuple(r) for r in x}) or margins(model, x))
    P.train(P.variant_rows())
    assert judged and all(not fit & rows for fit, rows in zip(fits, judged, strict=False))


def test_rows(spark):
    rows = edge_rows() + [(50, "ip 10.0.0.1, mail a.b@c.de; card 4539 1488 0343 6467 tel +1 (555) 201-3344"), (51, "\U0001f600 x@y.zz")]
    for docs in (documents(spark, rows), clashing(spark, rows)):
        found = {(r.doc_id, r.base_sha256): r for r in P.find(docs, P.train_on(docs)).collect()}
        for i, t in rows:
            joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in plain(t or ""))
            r = found[i, hashlib.sha256(joined.encode()).hexdigest()]
            counts = [sum(k == kind for k, _, _ in plain(t or "")) for kind in range(4)]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
            assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert P.find(docs, P.train_on(docs)).count() == len(rows)
    nothing = documents(spark, [])
    assert P.find(nothing, P.train_on(nothing)).count() == 0


def test_time_grows_with_the_length():
    """Texts full of spans: covered places are looked up, not searched through."""
    chance = random.Random(8)
    covered, plain = P.Covered(), []
    for _ in range(400):
        start = chance.randrange(3000)
        end = start + chance.randint(1, 12)
        assert covered.touches(start, end) == any(start < b and a < end for a, b in plain)
        if not covered.touches(start, end):
            covered.add(start, end)
            plain.append((start, end))
    spans = [(0, a, a + chance.randint(1, 9)) for a in chance.sample(range(2000), 300)]
    known = P.Covered(spans)
    for start in range(0, 2010, 3):
        assert known.touches(start, start + 2) == any(start < b and a < start + 2 for _, a, b in spans)

    def seconds(n):
        text = " ".join(f"a{k}@example.org (555) 201-{k % 9000 + 1000}" for k in range(n))
        began = time.perf_counter()
        base = P.base_spans(text)
        found = [c for c in P.candidates(text) if c not in set()]
        touching = P.Covered(base)
        for c in found:
            P.ruled_out(text, *c, touching)
        P._added(None, base, found, [0.9] * len(found), (0.5,) * 4)
        return time.perf_counter() - began

    assert seconds(16_000) < 6 * seconds(4_000) + 0.5


def test_every_document_is_learned_from(spark):
    """One candidate in the last of 20,500 documents, in any order of their ids, is among the rows."""
    plain = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("nothing here").alias("text"))
    last = plain.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    text = "version 2.0.1.4000 of"
    docs = plain.withColumn("text", F.when(F.col("doc_id") == last, text).otherwise(F.col("text")))
    rows = [r.row for r in P.training_rows(docs).collect()]
    assert rows == [[*map(float, P.candidate_features(text, *c)), 0.0] for c in P.candidates(text) if c[0] == 1]


def test_trees_grown_in_blocks_are_those_of_the_rows(spark):
    """The model of all rows against ``boost`` on the same rows, and the same from any layout."""
    rows = [
        (k, f"call {k} {'the mail'.split()[k % 2]} +1 ({100 + k * 7 % 900}) 555-{1000 + k * 13 % 9000} on {k % 300}.{k * 3 % 400}.{k * 7 % 400}.1 "
            f"or n{k}.x@h{k % 9}.example.com {'4539148803436467' if k % 2 else 4539148803436460 + k} 2021-{k % 12 + 1:02}-1{k % 10}")
        for k in range(300)
    ]
    (start, trees), calibration, limits = P.train_on(documents(spark, rows))
    assert P.train_on(documents(spark, rows, 1)) == ((start, trees), calibration, limits)
    found = [list(r.row) for r in P.training_rows(documents(spark, rows)).collect()]
    x = np.array([*found, *P.variant_rows(1)], dtype=float)
    weight = np.repeat([min(8.0, P.TABLE_WEIGHT / len(found)), P.TABLE_WEIGHT / len(P.VARIANTS)], [len(found), len(P.VARIANTS)])
    wanted = P.margins(P.boost(x[:, :-1], x[:, -1], weight), x[:, :-1])
    assert np.abs(P.margins((start, trees), x[:, :-1]) - wanted).max() < 0.05
    assert all(0.5 <= limit <= 1.01 for limit in limits)


def test_training_jobs_have_a_task_for_each_full_block(spark, monkeypatch):
    """A few rows are one block, however many files they come from; smaller blocks give the same model."""
    parts, grow = [], P.boost_blocks
    monkeypatch.setattr(P, "boost_blocks", lambda blocks, *a: parts.append(blocks.getNumPartitions()) or grow(blocks, *a))
    rows = [(k, f"call {k} or +1 ({100 + k * 7 % 900}) 555-{1000 + k * 13 % 9000} on {k % 300}.{k * 3 % 400}.{k}.1") for k in range(120)]
    model = P.train_on(documents(spark, rows, 12))
    monkeypatch.setattr(P, "BLOCK_ROWS", 40)
    assert P.train_on(documents(spark, rows, 12)) == model
    assert parts[0] == 1 < parts[1]
