"""Training order: every sequence gets a global slot, and shards are written in slot order.

A sequence is the ids of one document, with the end id. Sequences are numbered by task and row, and
the number goes through a keyed Feistel permutation of the numbers below a power of four, walked on
until it falls below the number of sequences. So slots are 0, 1, 2, ... without gaps, any slot can be
computed from a number without looking at the others, and the inverse finds the number of a slot.

Shard k holds the slots from k * stride on, in order. Rows are sent straight to the partition of
their shard, sorted there and written as Parquet, one folder per shard. A reader goes through shards
in order, and resumes at slot s with row s % stride of shard s // stride. A manifest beside the shards
keeps sequences, stride, key and end id for readers in other processes. Without a given stride it grows
in powers of two from ``STRIDE`` on, so that there are at most ``MAX_SHARDS`` folders.

The numbers depend on how Spark cuts the input into tasks, which the reading of files does alike
each time; the count of written slots is held against the count of rows.

Results for unusual input: a null or empty text is a sequence of the end id alone; rows with the
same id are sequences of their own; a null id stays null; an empty table writes nothing; very long texts
are encoded whole. Columns other than the id and the text are not read.
"""

import json
import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .shingles import mix
from .storage import shared_folder, text_of
from .token_ids import encode_marked

KEY = 20_240_229
ROUNDS = 6
STRIDE = 4096
MAX_SHARDS = 50_000
END_ID = 0
MANIFEST = "_manifest"  # readers of the shards pass over names like this


def _round_keys(key, rounds):
    return mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permute(numbers, size, key=KEY, rounds=ROUNDS, inverse=False):
    """The permutation of 0 .. size - 1 that the key names, applied to an array."""
    numbers = np.asarray(numbers, dtype=np.uint64).copy()
    half = np.uint64(max(1, -(-max(size - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key, rounds)
    todo = np.arange(len(numbers))
    while len(todo):
        left, right = numbers[todo] >> half, numbers[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        numbers[todo] = (left << half) | right
        todo = todo[numbers[todo] >= size]
    return numbers.astype(np.int64)


def shard_stride(size, stride=None):
    """Sequences per shard; by default grown in powers of two until there are few enough shards."""
    if stride:
        return stride
    stride = STRIDE
    while size > stride * MAX_SHARDS:
        stride *= 2
    return stride


def _first_numbers(rows):
    """The number of rows of all tasks, and the number of each task's first row."""

    def count(batches):
        yield pa.RecordBatch.from_pydict(
            {"task": [TaskContext.get().partitionId()], "n": [sum(b.num_rows for b in batches)]}
        )

    counts = {r["task"]: r["n"] for r in rows.mapInArrow(count, "task long, n long").collect()}
    firsts, total = {}, 0
    for task in sorted(counts):
        firsts[task] = total
        total += counts[task]
    return firsts, total


def materialise(docs, folder, key=KEY, stride=None, id_column="doc_id", text_column="text", end_id=END_ID, vocabulary=None):
    """Write all sequences in training order under ``folder``; returns (sequences, stride)."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    firsts, size = _first_numbers(rows)
    stride = shard_stride(size, stride)
    if not size:
        return 0, stride
    starts = docs.sparkSession.sparkContext.broadcast(firsts)

    def task(batches):
        at = starts.value[TaskContext.get().partitionId()]
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                slots = permute(np.arange(at, at + piece.num_rows), size, key)
                at += piece.num_rows
                ids = [np.concatenate((encode_marked(t.as_py(), vocabulary).astype("<u4"), tail)) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slots // stride).astype(np.int32)), pa.array(slots), piece.column(0),
                     pa.array([len(i) for i in ids], pa.int32()), pa.array([_packed(i) for i in ids], pa.binary())],
                    names=["shard", "slot", "doc_id", "n_tokens", "ids"],
                )

    sequences = rows.mapInArrow(task, "shard int, slot long, doc_id long, n_tokens int, ids binary")
    shards = sequences.repartitionById(-(-size // stride), F.col("shard"))
    shards.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    about = {"sequences": size, "stride": stride, "key": key, "rounds": ROUNDS, "end_id": end_id}
    text = docs.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string")
    text.coalesce(1).write.text(f"{folder}/{MANIFEST}")
    return size, stride


def manifest(spark, folder):
    """What a reader needs to know of written shards: sequences, stride, key, rounds and end id."""
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()["value"])


def _packed(ids):
    """Two bytes an id while all fit, four otherwise; the length tells which."""
    return (ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids).tobytes()


def unpack(data, n_tokens):
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n_tokens else "<u4").astype("<u4")


def read_from(spark, folder, slot, stride=None):
    """The sequences from ``slot`` on, for a reader that resumes there; order by slot to go through them.

    Another process needs the folder alone: the stride stands in the manifest beside the shards.
    """
    stride = stride or manifest(spark, folder)["stride"]
    return spark.read.parquet(folder).filter((F.col("shard") >= slot // stride) & (F.col("slot") >= slot))


def training_order(docs, folder=None, key=KEY, stride=None, **parameters):
    """Writes the shards and reads back, per sequence: doc_id, slot, shard, place, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    size, stride = materialise(docs, folder, key, stride, **parameters)
    columns = "doc_id long, slot long, shard int, place int, n_tokens int, ids_crc32 long"
    if not size:
        return spark.createDataFrame([], columns)
    written = spark.read.schema("slot long, doc_id long, n_tokens int, ids binary, shard int").parquet(folder)
    if (n := written.agg(F.countDistinct("slot")).first()[0]) != size:
        raise RuntimeError(f"{n} slots written for {size} sequences: the input gave other rows when read again")

    def digest(batches):
        for batch in batches:
            slots = batch.column(0).to_numpy()
            sums = [crc32(unpack(d.as_py(), n).tobytes()) for d, n in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), batch.column(4), pa.array((slots % stride).astype(np.int32)),
                 batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "slot", "shard", "place", "n_tokens", "ids_crc32"],
            )

    return written.select("slot", "doc_id", "n_tokens", "ids", "shard").mapInArrow(digest, columns)
