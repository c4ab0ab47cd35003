import hashlib
from collections import defaultdict

import pytest

from tests.llm.common import clashing, documents, edge_rows
from tramline.llm import digest_merge


def expected(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[t] = (max if keep == "largest" else min)(known) if known else None
    return sorted(
        ((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr
    )


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_groups(spark, keep, fan_in):
    rows = edge_rows() + [(100 + k, "copy" if k % 3 else f"own {k}") for k in range(90)]
    found = digest_merge.exact_groups(documents(spark, rows, 7), keep, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected(rows, keep)
    kept = [r for r in found if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_unequal_second_hashes_do_not_meet(spark):
    rows = spark.createDataFrame(
        [(1, b"d", 3, 10, 0, 0), (2, b"d", 3, 11, 1, 1), (3, b"d", 4, 10, 2, 2)],
        "doc_id long, sha binary, n_bytes int, second long, run int, row long",
    )
    rank, best = digest_merge._better("smallest")
    leaves = rows.selectExpr("*", "1L as size").withColumn("best", rank)
    assert digest_merge.merge_rounds(leaves.select("run", *digest_merge.MATCH, "best", "size"), 3, best, 2)[-1].count() == 3


def test_rows_that_stay(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    stay = digest_merge.drop_exact_copies(docs, "largest")
    assert stay.columns == docs.columns
    texts = [r.text or "" for r in stay.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    odd = clashing(spark, rows)
    assert digest_merge.drop_exact_copies(odd, "smallest").columns == odd.columns
    assert digest_merge.drop_exact_copies(odd, "smallest").count() == len(texts)


def test_empty_table(spark):
    assert digest_merge.exact_groups(documents(spark, []), "largest").count() == 0
    assert digest_merge.drop_exact_copies(documents(spark, [])).count() == 0
