"""The pipeline against plain Python, stage by stage, and whole."""

from zlib import crc32

import pytest

import corpus_pipeline
from tests.llm.common import documents, shingles
from tests.llm.test_fragment_join import connected, smallest
from tests.llm.test_ordered_packing import check
from tramline.llm import template_decontamination, toxicity_lexicon
from tramline.llm.token_ids import encode

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the table itself first."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER).collect()
        kept.append(rows)
        docs = spark.createDataFrame(rows, docs.schema) if "text" in rows[0].asDict() else None
    return kept


def test_names():
    assert len(corpus_pipeline.STAGES) == 5


def test_toxicity(spark, stages):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity_lexicon.learn(toxicity_lexicon.labelled(docs, labels, toxicity_lexicon.training_fold))
    matcher = toxicity_lexicon.Matcher(lexicon.weights, lexicon.exceptions)
    want = [r for r in stages[0] if toxicity_lexicon.score_text(matcher, lexicon.curve, r.text) < 0.5]
    assert sorted(stages[1]) == sorted(want)


def test_exact_dedup(stages):
    best = {}
    for r in stages[1]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(stages[2]) == sorted(r for r in stages[1] if best[r.text] == r.doc_id)


def test_near_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages[2]]
    _, groups = connected(rows)
    assert sorted(r.doc_id for r in stages[3]) == sorted(smallest(rows, g) for g in groups)


def test_decontamination(spark, stages):
    windows = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        own = next(template_decontamination.text_windows([r.text]))
        windows[r.item_id] = set(own[0][~own[2]].tolist())
    for r in stages[3]:
        found = next(template_decontamination.text_windows([r.text]))
        seen = set(found[0][~found[2]].tolist())
        share = max(len(w & seen) / len(w) for w in windows.values())
        assert (share < 0.5) == any(s.doc_id == r.doc_id for s in stages[4])


def test_packing(stages):
    check([(r.doc_id, r.text) for r in stages[4]], stages[5])


def test_run(spark, stages):
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {p.doc_id for p in pieces}
    assert ids == {r.doc_id for r in stages[4]}
    check([(r.doc_id, r.text) for r in stages[4]], pieces)


def test_planted_rows(spark):
    """Copies, near copies and leaks go; clean rows, empty ones included, stay."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean = [(k, " ".join(f"clean{k}x{j}" for j in range(60))) for k in range(10)]
    near = [(20, clean[0][1] + " end"), (21, clean[1][1].replace("clean1x59", "other"))]
    rows = [*clean, *near, (30, clean[2][1]), (31, f"{clean[3][1][:80]} {item} tail"), (40, None)]
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 30, 40]
    assert all(shingles(r.text) or r.doc_id == 40 for r in docs.collect())
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).collect()
    assert sum(p.length for p in pieces) == sum(len(encode(r.text)) + 1 for r in docs.collect())
    assert {p.ids_crc32 for p in pieces if p.doc_id == 40} == {crc32(b"\x00\x00\x00\x00")}
