import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import clashing, documents, edge_rows, sentence
from tramline.llm import ordered_packing
from tramline.llm.token_ids import encode, encode_marked


@pytest.fixture(scope="module")
def other():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_equal_the_other_library(other):
    texts = [t or "" for _, t in edge_rows()] + ["It's  he'll\r\n\r\n 12,345.6 <|endoftext|> Ünï — ß 😀  x", "   ", "\n\n a"]
    for text in texts:
        assert encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "\u3000"])
def test_long_white_space(other, run):
    """Two million characters of white space between words, which the fast encoder can't take."""
    text = "one" + run * (2_000_000 // len(run)) + "two <|endoftext|> three"
    assert encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_rows_with_long_white_space(spark):
    rows = [(1, " " * 1_000_000), (2, "a b"), (3, "x" + "\n" * 700_000 + "<|endoftext|>y")]
    found = ordered_packing.pack(documents(spark, rows)).collect()
    assert {p.doc_id: p.doc_tokens for p in found} == {i: len(encode_marked(t)) + 1 for i, t in rows}


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y.<|endoftext|>", "<|endoftext |> no", "<|endoftext|>tail  "]


def test_pieces_have_the_ids_of_the_other_library(spark):
    """With its settings as they come: the mark for the end of a text is one id."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for number, text in enumerate(MARKED + [sentence(5, 700) + MARKED[2] + sentence(6, 700)]):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert encode_marked(text).tolist() == ids[:-1].tolist()
        for p in ordered_packing.pack(documents(spark, [(number, text)])).collect():
            assert (p.doc_tokens, p.ids_crc32) == (len(ids), crc32(ids[p.start : p.start + p.length].tobytes()))
    assert encode_marked(MARKED[0]).tolist() == [64, 220, 50256, 275]


def check(rows, pieces, length=1024):
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p.doc_id].append(p)
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[i].append(np.concatenate((encode(t), [0])).astype("<u4"))
    for i, streams in wanted.items():
        total = sum(map(len, streams))
        assert sum(p.length for p in by_row[i]) == total
        if len(streams) == 1:
            at = 0
            for p in sorted(by_row[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == total
                assert p.ids_crc32 == crc32(streams[0][at : at + p.length].tobytes())
                at += p.length
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for window in windows.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    return [sum(p.length for p in w) for w in windows.values()]


def test_every_id_is_in_one_piece(spark):
    rows = edge_rows() + [(1000 + k, sentence(k, 30 + 17 * k % 400)) for k in range(80)]
    check(rows, ordered_packing.pack(documents(spark, rows)).collect())
    check(rows, ordered_packing.pack(documents(spark, rows), block=3000).collect())
    check(rows, ordered_packing.pack(clashing(spark, rows)).collect())
    assert ordered_packing.pack(documents(spark, [])).count() == 0


def test_little_padding(spark):
    rows = [(k, ". ".join(sentence(31 * k + s, 5 + (k + s) % 9) for s in range(25)) + ".") for k in range(300)]
    sizes = check(rows, ordered_packing.pack(documents(spark, rows, 2)).collect())
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding < 0.03 * sum(sizes)


def brute(cuts, penalties, length, charge):
    positions = [0, *cuts]
    extra = [0, *penalties]
    whole = {1 << k for k in range(20) if ordered_packing.SHORTEST <= 1 << k < length}
    cost = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            size = positions[j] - positions[i]
            if size <= length:
                cost[j] = min(cost[j], cost[i] + charge + extra[j] + (0 if size in whole else length - size))
    return cost[-1]


@pytest.mark.parametrize("seed", range(12))
def test_dynamic_programme_is_optimal(seed):
    chance = random.Random(seed)
    cuts = np.cumsum([chance.choice([1, 3, 9, 30, 128, 200]) for _ in range(60)])
    penalties = np.array([chance.choice([0, 0, 16]) for _ in cuts], dtype=float)
    chosen = ordered_packing.best_cuts(cuts, penalties, length=512)
    extra = dict(zip(cuts.tolist(), penalties.tolist(), strict=True))
    total, before = 0.0, 0
    for end in chosen:
        size = end - before
        total += ordered_packing.WINDOW_CHARGE + extra[end] + (0 if size in (128, 256) else 512 - size)
        before = end
    assert before == cuts[-1]
    assert total == brute(cuts.tolist(), penalties.tolist(), 512, ordered_packing.WINDOW_CHARGE)
