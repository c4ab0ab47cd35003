"""Order-preserving packing of token streams into windows by dynamic programming.

Each task lays the ids of its documents end to end, in the order it reads them, and cuts the
stream into windows of at most ``length`` ids. Cuts may lie at the end of a document, at the end
of a sentence, or, at a penalty, inside a long sentence. The cost of a cutting is its padding, a
fixed charge per window and the penalties; a window whose length is a power of two isn't padded.

For a cut at j the best earlier cut i has the smallest cost(i) + i among those within ``length``
ids, which a monotone queue yields in constant time; the few lengths without padding are looked
up directly. A stream is handled in blocks, and the last window of a block is carried into the
next one, so memory is bounded by a block and one document.

No shuffle takes place. A retried task reads its partition again and yields the same windows.

Results for unusual input: a null or empty text is one piece that holds the end id alone; rows
with the same id are packed one by one; very long texts are encoded and cut whole; an empty table gives
no rows. Columns other than the id and the text are not read.
"""

from collections import deque

import numpy as np
import pyarrow as pa
from zlib import crc32

from pyspark import TaskContext

from .storage import text_of
from .token_ids import encode_marked, sentence_ends

LENGTH = 1024
END_ID = 0
WINDOW_CHARGE = 8
INSIDE_PENALTY = 16
INSIDE_STEP = 16
THIN = 16  # of the sentence ends in a stretch of so many ids the last is a candidate
SHORTEST = 128  # windows without padding are looked for from this length on
BLOCK_IDS = 1 << 18

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def candidate_cuts(ids, document_ends, ends_sentence, step=INSIDE_STEP, penalty=INSIDE_PENALTY):
    """Sorted cut positions in 1..len(ids) and the penalty of each."""
    sentences = np.flatnonzero(ends_sentence[ids]) + 1
    last_in_bucket = np.append(sentences[1:] // THIN != sentences[:-1] // THIN, True)[: len(sentences)]
    natural = np.union1d(sentences[last_in_bucket], document_ends)
    before = np.concatenate(([0], natural[:-1]))
    long = np.flatnonzero(natural - before > 2 * step)
    inside = [np.arange(before[k] + step, natural[k] - step // 2, step) for k in long]
    inside = np.concatenate(inside) if inside else np.empty(0, dtype=np.int64)
    cuts = np.concatenate((natural, inside))
    penalties = np.concatenate((np.zeros(len(natural)), np.full(len(inside), float(penalty))))
    order = np.argsort(cuts, kind="stable")
    return cuts[order].astype(np.int64), penalties[order]


def best_cuts(cuts, penalties, length=LENGTH, charge=WINDOW_CHARGE):
    """Positions at which an optimal cutting ends its windows, the last position included.

    Consecutive candidates must be at most ``length`` apart.
    """
    positions = [0, *cuts.tolist()]
    extra = [0.0, *penalties.tolist()]
    whole = [1 << k for k in range(length.bit_length()) if SHORTEST <= 1 << k < length]
    place = {0: 0}
    cost = [0.0] * len(positions)
    origin = [0] * len(positions)
    queue = deque([(0.0, 0)])
    for k in range(1, len(positions)):
        j = positions[k]
        while positions[queue[0][1]] < j - length:
            queue.popleft()
        best, source = queue[0]
        best += length - j
        for size in whole:
            i = place.get(j - size)
            if i is not None and cost[i] < best:
                best, source = cost[i], i
        total = best + charge + extra[k]
        cost[k], origin[k], place[j] = total, source, k
        key = total + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, k))
    chosen, k = [], len(positions) - 1
    while k:
        chosen.append(positions[k])
        k = origin[k]
    return chosen[::-1]


def _pieces(ids, documents, window_ends, first_sequence):
    """Piece rows of a block: ``documents`` has (doc_id, first position, start in document, total)."""
    rows = []
    windows = [0, *window_ends]
    w = 0
    stop = windows[-1]
    for doc_id, at, skipped, count, total in documents:
        end = min(at + count, stop)
        while at < end:
            while windows[w + 1] <= at:
                w += 1
            to = min(end, windows[w + 1])
            crc = crc32(ids[at:to].astype("<u4").tobytes())
            rows.append((doc_id, skipped, to - at, crc, total, first_sequence + w, at - windows[w]))
            skipped += to - at
            at = to
    return rows


class _Stream:
    """The documents of one task, cut block by block."""

    def __init__(self, first_sequence, length, block, ends_sentence):
        self.sequence, self.length, self.block, self.ends = first_sequence, length, block, ends_sentence
        self.parts, self.documents, self.size = [], [], 0

    def add(self, doc_id, ids):
        self.documents.append((doc_id, self.size, 0, len(ids), len(ids)))
        self.parts.append(ids)
        self.size += len(ids)
        return self.flush(last=False) if self.size >= self.block else []

    def flush(self, last):
        if not self.size:
            return []
        ids = np.concatenate(self.parts)
        stops = np.array([at + count for _, at, _, count, _ in self.documents], dtype=np.int64)
        cuts, penalties = candidate_cuts(ids, stops, self.ends)
        ends = best_cuts(cuts, penalties, self.length)
        if not last:
            ends = ends[:-1]  # the last window goes on in the next block
        stop = ends[-1] if ends else 0
        rows = _pieces(ids, self.documents, [*ends, len(ids)] if not ends else ends, self.sequence) if ends else []
        self.sequence += len(ends)
        self.parts, self.size = [ids[stop:]], len(ids) - stop
        self.documents = [
            (doc_id, max(at - stop, 0), skipped + max(stop - at, 0), count - max(stop - at, 0), total)
            for doc_id, at, skipped, count, total in self.documents
            if at + count > stop
        ]
        return rows


def _batch(rows):
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=pa.int64()) for c in columns],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def pack(docs, id_column="doc_id", text_column="text", length=LENGTH, end_id=END_ID, block=BLOCK_IDS, vocabulary=None):
    """One row per piece; sequence ids are unique, the upper bits are the number of the task."""

    def task(batches):
        stream = _Stream(TaskContext.get().partitionId() << 33, length, block, sentence_ends(vocabulary))
        tail = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = stream.add(doc_id, np.concatenate((encode_marked(text.as_py(), vocabulary), tail)))
                if rows:
                    yield _batch(rows)
        if rows := stream.flush(last=True):
            yield _batch(rows)

    return docs.select(id_column, text_of(text_column).alias("text")).mapInArrow(task, SCHEMA)
