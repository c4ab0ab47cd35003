"""Collocations: phrases of consecutive words that occur together more than their parts explain.

A-Z are lowered; a text falls into pieces at ``. , ; : ! ?`` and line breaks, a piece into words at
blanks and tabs. Everything is counted per language. A phrase of m words is a phrase of m - 1 words,
its left part, and one more word. Words are ranked by how often they occur, and so are the phrases of
every size before they become left parts: a pair (rank of the left part, rank of the word) addresses a
cell of a square tile. Pairs are counted tile by tile, in a dense array with ``bincount`` where a tile
is well filled and as sorted coordinates elsewhere, and tasks exchange whole tiles: a tile has a fixed
number of cells, so merging needs bounded memory however many tasks take part in it. Tiles of many
tasks are merged in two rounds, first among a share of the tasks, so a tile that all tasks fill is not
left to one of them.

Ranks are given to the ``ranked`` most frequent words and phrases of each size, which bounds what is
sent to tasks. All others that are frequent enough are known to tasks by a bitmap of fixed size; what
holds one of them is counted as text, in lists by a hash of the phrase that travel and are merged like
tiles; there are more lists the more tasks there are, so one of them stays small. A bitmap may let rare
phrases through; they are counted exactly as well and dropped then. So counts are exact whatever the
bounds are.

Results for unusual input: a null text is empty and gives nothing; a null language is ``und``; repeated
rows count each time; long texts are read in slices, with the last words of a slice carried on; ties in
every order are broken by the phrase; an empty table gives no rows. Extra columns are not read.
"""

from collections import Counter
from itertools import repeat
from math import isqrt
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shingles import chunks, mix
from .storage import cut, text_of

MAX_WORDS = 3
LEAST = 10
TOP = 2_000
SHARE = 50  # per cent of a phrase that must not lie in one longer candidate
SCALE = 1_000_000

RANKED = 1 << 18
BITS = 1 << 25
SIDE_BITS = 11  # a tile has 2^11 by 2^11 cells
AREA = 1 << (2 * SIDE_BITS)
DENSE = AREA // 16
FLUSH_PAIRS = 1 << 22
FLUSH_TEXTS = 300_000
SLICE_BYTES = 1 << 22
ONE_ROUND = 64
LISTS_A_TASK = 8

BREAK = b"\xff"  # no byte of a text
_PLAIN = bytes(
    255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def token_slices(texts, carried, slice_bytes=SLICE_BYTES):
    """Lists of words and breaks of consecutive texts; each list begins with the last ``carried`` of the one before."""
    tail = []
    for group in chunks(texts):
        data = (BREAK.join(group) + BREAK).translate(_PLAIN)
        at = 0
        while at < len(data):
            end = min(at + slice_bytes, len(data))
            if end < len(data):
                end = max(data.rfind(b" ", at, end), data.rfind(BREAK, at, end)) + 1
                if not end:
                    later = [k for k in (data.find(b" ", at), data.find(BREAK, at)) if k >= 0]
                    end = min(later) + 1
            tokens = data[at:end].replace(BREAK, b" \xff ").split()
            if tokens:
                tokens = tail + tokens
                yield tokens
                tail = tokens[-carried:] if carried else []
            at = end


def _by_language(batch):
    """(language, texts) of a batch (lang, text)."""
    langs = batch.column(0).to_pylist()
    rows = {}
    for number, lang in enumerate(langs):
        rows.setdefault(lang, []).append(number)
    for lang, numbers in rows.items():
        yield lang, (batch.column(1)[k].as_py() for k in numbers)


def _text_rows(counts):
    """Rows (lang, phrase, f) of a dict language -> Counter of phrases as bytes."""
    langs, phrases, f = [], [], []
    for lang, counter in counts.items():
        langs += [lang] * len(counter)
        phrases += counter.keys()
        f += counter.values()
        counter.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())],
        names=["lang", "phrase", "f"],
    )


def _count_words(batches):
    """Words of each language, and in rows without a phrase how many there are in all."""
    counts, totals = {}, Counter()
    for batch in batches:
        for lang, texts in _by_language(batch):
            counter = counts.setdefault(lang, Counter())
            for tokens in token_slices(texts, 0):
                counter.update(tokens)
                totals[lang] += len(tokens) - counter.pop(BREAK, 0)
            if sum(map(len, counts.values())) > FLUSH_TEXTS:
                yield _text_rows(counts)
    yield _text_rows(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
        names=["lang", "phrase", "f"],
    )


class Ranks(NamedTuple):
    """What tasks know of the phrases of one size."""

    keys: dict  # language -> sorted left rank << 32 | word rank; for single words, words by rank
    ranks: dict  # language -> rank of each key
    others: np.ndarray  # bitmap of the phrases without a rank


class Reader:
    """Ranks, and which phrases may be frequent, along the words of a slice."""

    def __init__(self, levels):
        self.levels = levels
        self.words, self.hashes = {}, {}

    def _language(self, lang):
        if lang not in self.words:
            known = self.levels[0].keys.get(lang, [])
            self.words[lang] = {word: rank for rank, word in enumerate(known)}
            self.hashes[lang] = np.array([word_hash(lang, word) for word in known] + [0], dtype=np.uint64)
        return self.words[lang], self.hashes[lang]

    def pairs(self, lang, tokens):
        """Per place: left rank, rank of the last word (-1 without one), and whether it must be counted."""
        known, hashes = self._language(lang)
        words = np.fromiter(map(known.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        h = hashes[words]
        strange = np.flatnonzero(words < 0)
        own = [tokens[k] for k in strange.tolist()]
        named = {word: word_hash(lang, word) for word in set(own)}
        h[strange] = np.fromiter(map(named.get, own), dtype=np.uint64, count=len(own))
        frequent = words >= 0
        frequent[strange] = _in_bitmap(self.levels[0].others, h[strange])
        broken = np.fromiter((word == BREAK for word in own), dtype=bool, count=len(own))
        frequent[strange[broken]] = False
        ranks, size, run = words, 1, h
        while True:
            size += 1
            count = max(0, len(tokens) - size + 1)
            wanted = frequent[:count] & frequent[1 : count + 1]
            left, last = ranks[:count], words[size - 1 : size - 1 + count]
            if size > len(self.levels):
                return left, last, wanted
            level = self.levels[size - 1]
            run = _longer(run[:count], h[size - 1 : size - 1 + count])
            ranks = np.full(count, -1, dtype=np.int64)
            keys = level.keys.get(lang)
            frequent = wanted.copy()
            if keys is not None and len(keys):
                at = np.flatnonzero(wanted & (left >= 0) & (last >= 0))
                key = (left[at] << 32) | last[at]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                ranks[at[hit]] = level.ranks[lang][place[hit]]
            rest = np.flatnonzero(wanted & (ranks < 0))
            frequent[rest] = _in_bitmap(level.others, run[rest])


def word_hash(lang, word):
    import xxhash

    return xxhash.xxh3_64_intdigest(word, crc32(lang.encode()))


def _longer(run, word):
    return mix(run * _STEP + word)


def _in_bitmap(bitmap, hashes):
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(phrases, n_bits):
    """Bitmap of the phrases (lang, phrase), all of one size; at most ``n_bits`` / 64 rows come to the driver."""

    def places(batches):
        for batch in batches:
            words = [phrase.encode().split(b" ") for phrase in batch.column(1).to_pylist()]
            langs = batch.column(0).to_pylist()
            run = None
            for k in range(len(words[0]) if words else 0):
                h = np.array([word_hash(lang, w[k]) for lang, w in zip(langs, words, strict=True)], dtype=np.uint64)
                run = h if run is None else _longer(run, h)
            at = np.zeros(0, dtype=np.int64) if run is None else (run & np.uint64(n_bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

    blocks = (
        phrases.select("lang", "phrase").mapInArrow(places, "at long")
        .groupBy(F.shiftright("at", 6).alias("block"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    ).toArrow()
    words = np.zeros(n_bits // 64, dtype=np.int64)
    words[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy()
    return words.astype("<i8").view(np.uint8)


def _threshold(counted, limit):
    """The least count so that at most ``limit`` phrases have as much or more, by a histogram of fixed size."""
    band = F.floor(F.log2("f") * 32).cast("int")
    seen = 0
    least = None
    for row in sorted(counted.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("f").alias("f")).collect(), reverse=True):
        seen += row.n
        if seen > limit:
            break
        least = row.f
    return least


def _ranks(counted, size, ranked, n_bits):
    """The ranks of the most frequent phrases of one size and the bitmap of all others."""
    counted = counted.filter("phrase IS NOT NULL")
    can = counted if size == 1 else counted.filter("key IS NOT NULL")
    least = _threshold(can, ranked)
    has_rank = F.lit(False) if least is None else F.col("f") >= least
    if size > 1:
        has_rank = has_rank & F.col("key").isNotNull()
    name = "phrase" if size == 1 else "key"
    rows = counted.filter(has_rank).select("lang", "f", name).toArrow().to_pandas()
    keys, ranks = {}, {}
    for lang, group in rows.groupby("lang"):
        group = group.sort_values(["f", name], ascending=[False, True])
        if size == 1:
            keys[lang] = [word.encode() for word in group[name]]
        else:
            values = group[name].to_numpy(dtype=np.int64)
            order = np.argsort(values)
            keys[lang], ranks[lang] = values[order], order.astype(np.int64)
    return Ranks(keys, ranks, _bitmap(counted.filter(~has_rank), n_bits))


_BLOBS = "lang string, tile long, part int, cells binary, counts binary"


def _blob_rows(blobs):
    """Blobs (lang, tile, part, cells, counts) as rows; the cells of a list, whose tile is negative, are phrases."""
    lang, tile, part, cells, counts = zip(*blobs, strict=True) if blobs else ((),) * 5
    packed = [
        BREAK.join(c) if t < 0 else np.diff(c, prepend=0).astype("<u4").tobytes() for t, c in zip(tile, cells, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(tile, pa.int64()), pa.array(part, pa.int32()), pa.array(packed, pa.binary()),
         pa.array([np.asarray(c).astype("<i8").tobytes() for c in counts], pa.binary())],
        names=["lang", "tile", "part", "cells", "counts"],
    )


def _lists(counter, n_lists):
    """(tile, phrases, counts) of a Counter of phrases, by a hash of the phrase."""
    parts = {}
    for phrase, n in counter.items():
        phrases, counts = parts.setdefault(crc32(phrase) % n_lists, ([], []))
        phrases.append(phrase)
        counts.append(n)
    for number, (phrases, counts) in parts.items():
        yield -1 - number, phrases, counts


def tiles(left, last, dense=DENSE):
    """(tile, cells, counts) of pairs of ranks: dense tiles by bincount, the others by sorting."""
    side = (1 << SIDE_BITS) - 1
    across = int(last.max() >> SIDE_BITS) + 1 if len(last) else 1
    tile = (left >> SIDE_BITS) * across + (last >> SIDE_BITS)
    cell = (left & side) << SIDE_BITS | (last & side)
    filled = np.bincount(tile)
    number = ((np.arange(len(filled)) // across) << 32) | (np.arange(len(filled)) % across)
    for t in np.flatnonzero(filled >= dense).tolist():
        here = tile == t
        counted = np.bincount(cell[here], minlength=AREA)
        tile, cell = tile[~here], cell[~here]
        cells = np.flatnonzero(counted)
        yield int(number[t]), cells, counted[cells]
    codes = np.sort(tile << (2 * SIDE_BITS) | cell)
    if not len(codes):
        return
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(starts, append=len(codes))
    codes = codes[starts]
    of_tile = codes >> (2 * SIDE_BITS)
    edges = [0, *(np.flatnonzero(np.diff(of_tile)) + 1).tolist(), len(codes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(number[of_tile[a]]), codes[a:b] & (AREA - 1), counts[a:b]


class Merge:
    """The sum of blobs of one tile; holds at most two tiles' worth of cells."""

    def __init__(self):
        self.cells, self.counts, self.waiting = [], [], 0

    def add(self, cells, counts):
        self.cells.append(cells)
        self.counts.append(counts)
        self.waiting += len(cells)
        if self.waiting > 2 * AREA:
            self.settle()

    def settle(self):
        cells, counts = np.concatenate(self.cells), np.concatenate(self.counts)
        if len(self.cells) > 1:
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            cells, counts = cells[starts], np.add.reduceat(counts, starts)
        self.cells, self.counts, self.waiting = [cells], [counts], len(cells)
        return cells, counts


class MergeLists(Counter):
    """The sum of lists of phrases."""

    def add(self, phrases, counts):
        for phrase, n in zip(phrases, counts.tolist(), strict=True):
            self[phrase] += n

    def settle(self):
        return list(self), np.array(list(self.values()), dtype=np.int64)


def _merged(batches):
    """(lang, tile, part, cells, counts) of rows that come sorted, one per tile and part."""
    key, merge = None, None
    for batch in batches:
        columns = [batch.column(k) for k in range(3)]
        for number, found in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if found != key:
                if key is not None:
                    yield (*key, *merge.settle())
                key, merge = found, MergeLists() if found[1] < 0 else Merge()
            if found[1] < 0:
                cells = batch.column(3)[number].as_py().split(BREAK)
            else:
                cells = np.cumsum(np.frombuffer(batch.column(3)[number].as_buffer(), "<u4"), dtype=np.int64)
            merge.add(cells, np.frombuffer(batch.column(4)[number].as_buffer(), "<i8"))
    if key is not None:
        yield (*key, *merge.settle())


def _merge_blobs(batches):
    ready, size = [], 0
    for blob in _merged(batches):
        ready.append(blob)
        size += len(blob[3])
        if size > AREA or len(ready) >= 10_000:
            yield _blob_rows(ready)
            ready, size = [], 0
    yield _blob_rows(ready)


def _together(blobs, *keys):
    return blobs.repartition(*keys).sortWithinPartitions(*keys)


def count_longer(texts, levels, least=LEAST, slice_bytes=SLICE_BYTES, flush_pairs=FLUSH_PAIRS):
    """(lang, phrase, f, key) of the phrases one word longer than those of the last level, found ``least`` times."""
    spark = texts.sparkSession
    size = len(levels) + 1
    sent = spark.sparkContext.broadcast(levels)
    n_parts = texts.rdd.getNumPartitions()
    n_lists = LISTS_A_TASK * n_parts

    def count(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        reader = Reader(sent.value)
        pairs, others, waiting = {}, {}, 0

        def blobs():
            made = []
            for lang, (left, last) in pairs.items():
                made += [(lang, t, part, cells, counts) for t, cells, counts in tiles(np.concatenate(left), np.concatenate(last))]
            for lang, counter in others.items():
                made += [(lang, t, part, phrases, counts) for t, phrases, counts in _lists(counter, n_lists)]
            pairs.clear()
            others.clear()
            return _blob_rows(made)

        for batch in batches:
            for lang, texts_ in _by_language(batch):
                for tokens in token_slices(texts_, size - 1, slice_bytes):
                    left, last, wanted = reader.pairs(lang, tokens)
                    addressed = wanted & (left >= 0) & (last >= 0)
                    mine = pairs.setdefault(lang, ([], []))
                    mine[0].append(left[addressed])
                    mine[1].append(last[addressed])
                    waiting += int(addressed.sum())
                    rest = np.flatnonzero(wanted & ~addressed).tolist()
                    others.setdefault(lang, Counter()).update(b" ".join(tokens[k : k + size]) for k in rest)
                    if waiting > flush_pairs or sum(map(len, others.values())) > FLUSH_TEXTS:
                        yield blobs()
                        waiting = 0
        yield blobs()

    blobs = texts.mapInArrow(count, _BLOBS)
    if n_parts > ONE_ROUND:
        blobs = blobs.withColumn("part", F.col("part") % isqrt(n_parts))
        blobs = _together(blobs, "lang", "tile", "part").mapInArrow(_merge_blobs, _BLOBS)
    blobs = _together(blobs.withColumn("part", F.lit(0)), "lang", "tile")

    def frequent(batches):
        names = Names(sent.value)
        for lang, tile, _, cells, counts in _merged(batches):
            kept = np.flatnonzero(counts >= least)
            if not len(kept):
                continue
            counts = counts[kept]
            if tile < 0:
                phrases, keys = [cells[k] for k in kept.tolist()], pa.nulls(len(kept), pa.int64())
            else:
                left = ((tile >> 32) << SIDE_BITS) + (cells[kept] >> SIDE_BITS)
                last = ((tile & 0xFFFFFFFF) << SIDE_BITS) + (cells[kept] & ((1 << SIDE_BITS) - 1))
                phrases = [names.phrase(lang, size, a, b) for a, b in zip(left.tolist(), last.tolist(), strict=True)]
                keys = pa.array(left << 32 | last, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(kept), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                 pa.array(counts, pa.int64()), keys],
                names=["lang", "phrase", "f", "key"],
            )

    return cut(blobs.mapInArrow(frequent, "lang string, phrase string, f long, key long"))


class Names:
    """Phrases back from ranks."""

    def __init__(self, levels):
        self.levels, self.by_rank = levels, {}

    def phrase(self, lang, size, left, last):
        return self._ranked(lang, size - 1, left) + b" " + self.levels[0].keys[lang][last]

    def _ranked(self, lang, size, rank):
        level = self.levels[size - 1]
        if size == 1:
            return level.keys[lang][rank]
        if (lang, size) not in self.by_rank:
            keys = np.empty(len(level.keys[lang]), dtype=np.int64)
            keys[level.ranks[lang]] = level.keys[lang]
            self.by_rank[lang, size] = keys
        key = int(self.by_rank[lang, size][rank])
        return self.phrase(lang, size, key >> 32, key & 0xFFFFFFFF)


def phrase_counts(
    docs, max_words=MAX_WORDS, least=LEAST, ranked=RANKED, n_bits=BITS, lang_column="lang", text_column="text", **limits,
):
    """(lang, phrase, f, size) of all phrases found ``least`` times; rows without a phrase hold the words in all."""
    texts = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), text_of(text_column).alias("text"))
    words = cut(
        texts.mapInArrow(_count_words, "lang string, phrase string, f long").groupBy("lang", "phrase")
        .agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull())
    )
    found, levels = [words.withColumn("size", F.lit(1))], []
    counted = words
    for size in range(2, max_words + 1):
        levels = [*levels, _ranks(counted, size - 1, ranked, n_bits)]
        counted = count_longer(texts, levels, least, **limits)
        found.append(counted.drop("key").withColumn("size", F.lit(size)))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _part(first, size):
    """Words ``first``, counted from 1, and the ``size`` - 1 after it, of a phrase."""
    return F.array_join(F.slice("words", first, size), " ")


def score_phrases(counts, top=TOP, share=SHARE, scale=SCALE):
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    All of it works on the frequent phrases alone, and sums are exact: products are decimals.
    """
    totals = counts.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    known = counts.filter("phrase IS NOT NULL").select("lang", "phrase", "f")
    longer = counts.filter("size > 1").select(
        "lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words")
    )
    cuts = longer.select(
        "lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size")).alias("rest"))
    sides = cuts.join(
        known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]
    ).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    a, left, right = (F.col(name).cast("decimal(19,0)") for name in "alr")
    scored = sides.withColumn("num", a * a * F.lit(scale).cast("decimal(10,0)")).withColumn("den", left * right)
    scored = scored.withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " ")),
    ))
    inside = longer.filter("size > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("around")
    )
    free = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("around").isNull()
        | (F.col("around").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def collocations(docs, top=TOP, share=SHARE, **options):
    return score_phrases(phrase_counts(docs, **options), top, share)
