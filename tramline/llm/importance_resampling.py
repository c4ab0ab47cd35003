"""Resampling of documents towards a target, by importance weights over hashed word n-grams.

A-Z are lowered; a word is a run of digits, small letters and characters beyond ASCII. The features
of a text are all runs of 1 to ``max_n`` consecutive words joined by one space, repeats counted; a
feature's bucket is the CRC-32 of its bytes modulo ``n_buckets``.

Texts are read slice by slice. The distinct words of a slice, with the delimiter before and after
them, make up an Aho-Corasick dictionary; the payload of an entry is its CRC and its length. One scan
of the automaton emits the payloads in the order of the words, and the CRC of a longer run is composed
from the payloads of neighbours without looking at the text again. Slices end at delimiters, so the
dictionary has a bounded size however long a text is; words of more than ``LONGEST`` bytes stay out of
it and get their payload directly.

Buckets are written once, two or four bytes a feature. Counting and scoring start from there. A
bucket's gain compares its smoothed share in the target with that in the documents, a document's
weight is the sum of its gains, and Gumbel noise drawn from a hash of the id turns weights into scores
whose highest values are a sample without replacement. Ranks come from range partitions: a row's place
in its partition plus the rows of the partitions before it.

Results for unusual input: a null, empty or wordless text has no features and weight 0; a null id
counts as the empty text in the noise and comes last in ties; repeated rows are rows of their own and
get neighbouring ranks; very long texts are read whole; an empty table gives no rows, an empty target
gives gains from the smoothing alone. Extra columns are not read, whatever their names.
"""

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shingles import chunks
from .storage import cut, stored, text_of

N_BUCKETS = 10_000
MAX_N = 1
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
GROUP_BYTES = 1 << 22
SLICE_BYTES = 1 << 22
LONGEST = 64
POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest bit first
ONE = np.uint32(1 << 31)  # the polynomial 1 in this order of bits

_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _slices(data, size):
    """Bounds of consecutive slices of about ``size`` bytes that end with a delimiter."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            end = (data.rfind(b" ", at, end) + 1) or (data.find(b" ", end) + 1)
        yield at, end
        at = end


def _scan(data, longest):
    """(crc, length) of the words of a slice, by the automaton of its distinct words."""
    import ahocorasick

    space = np.frombuffer(data, dtype=np.uint8) == 32
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    lengths = (ends - begins).astype(np.int64)
    crcs = np.zeros(len(lengths), dtype=np.uint32)
    text = " " + data.decode("latin-1")  # one character a byte
    automaton, payloads = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
    for word in set(text.split(" ")):
        if 0 < len(word) <= longest:
            automaton.add_word(f" {word} ", len(payloads))
            payloads.append((crc32(word.encode("latin-1")), len(word)))
    short = lengths <= longest
    if payloads:
        automaton.make_automaton()
        hits = np.fromiter((k for _, k in automaton.iter(text)), dtype=np.int64, count=int(short.sum()))
        found = np.array(payloads, dtype=np.int64)[hits]
        crcs[short], lengths[short] = found[:, 0].astype(np.uint32), found[:, 1]
    for k in np.flatnonzero(~short).tolist():
        crcs[k] = crc32(data[begins[k] : ends[k]])
    return crcs, lengths, begins


def word_payloads(group, slice_bytes=SLICE_BYTES, longest=LONGEST):
    """CRC and length of all words of a group of texts, and the number of words of each text."""
    data = b" ".join([*group, b""]).translate(_PLAIN)
    crcs, lengths, begins = [], [], []
    for at, end in _slices(data, slice_bytes):
        c, n, b = _scan(data[at:end], longest)
        crcs.append(c)
        lengths.append(n)
        begins.append(b + at)
    if not crcs:
        crcs, lengths, begins = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = np.cumsum([len(t) + 1 for t in group])
    counts = np.diff(np.searchsorted(np.concatenate(begins), bounds), prepend=0)
    return np.concatenate(crcs), np.concatenate(lengths), counts


def times(a, b):
    """Products of polynomials modulo that of the CRC, element by element."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=np.uint32), np.asarray(b, dtype=np.uint32))
    b, product = b.copy(), np.zeros(a.shape, dtype=np.uint32)
    for bit in range(31, -1, -1):
        product ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return product


def shifts(lengths):
    """For each length the factor that moves a CRC by so many bytes."""
    distinct, back = np.unique(lengths, return_inverse=True)
    factor, power, left = np.full(len(distinct), ONE, dtype=np.uint32), np.uint32(1 << 23), distinct.copy()
    while left.any():
        factor = np.where(left & 1, times(factor, power), factor)
        power = times(power, power)
        left >>= 1
    return factor[back]


def join_crcs(first, second, second_length):
    """CRC of two byte strings put together, from those of its parts."""
    return times(first, shifts(second_length)) ^ second


def features(group, max_n=MAX_N, n_buckets=N_BUCKETS, **limits):
    """(buckets, number of features by text, number of words by text); buckets in the order of texts."""
    crcs, lengths, counts = word_payloads(group, **limits)
    last = np.repeat(np.cumsum(counts), counts)  # end of the text each word belongs to
    owner = np.repeat(np.arange(len(counts)), counts)
    found, owners, run = [crcs % np.uint32(n_buckets)], [owner], crcs
    if max_n > 1:
        spaced = join_crcs(np.uint32(crc32(b" ")), crcs, lengths)
        for n in range(2, max_n + 1):
            inside = np.arange(len(crcs) - n + 1) + n <= last[: max(0, len(crcs) - n + 1)]
            tail = slice(n - 1, None)
            run = join_crcs(run[: len(crcs) - n + 1], spaced[tail], lengths[tail] + 1) if len(crcs) >= n else run[:0]
            found.append((run % np.uint32(n_buckets))[inside])
            owners.append(owner[: len(inside)][inside])
    by_text = np.concatenate(owners)
    order = np.argsort(by_text, kind="stable") if max_n > 1 else slice(None)
    return np.concatenate(found)[order], np.bincount(by_text, minlength=len(counts)), counts


def _width(n_buckets):
    return np.dtype("<u2" if n_buckets <= 1 << 16 else "<u4")


def featured(texts, max_n=MAX_N, n_buckets=N_BUCKETS, **limits):
    """(doc_id, n_words, n_features, buckets as little-endian numbers) of a frame (doc_id, text)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for group in chunks((t.as_py() for t in batch.column(1)), GROUP_BYTES):
                found, sizes, words = features(group, max_n, n_buckets, **limits)
                data, ends = found.astype(_width(n_buckets)).tobytes(), np.cumsum(sizes) * _width(n_buckets).itemsize
                parts = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(group)), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(parts, pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"],
                )
                at += len(group)

    return texts.mapInArrow(task, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(rows, n_buckets=N_BUCKETS):
    """(bucket, n) over all features of rows made by ``featured``; at most one row a bucket."""

    def task(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), dtype=_width(n_buckets)), minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark, raw_counts, target_counts, n_buckets=N_BUCKETS):
    """(bucket, gain) of every bucket: thousands of natural logs of target share over raw share, floored."""
    raw, target = (c.select("bucket", F.col("n").alias(name)) for c, name in ((raw_counts, "s"), (target_counts, "t")))
    both = spark.range(n_buckets).withColumnRenamed("id", "bucket").join(raw, "bucket", "left").join(target, "bucket", "left")
    s, t = (F.coalesce(F.col(name), F.lit(0)).cast("double") for name in ("s", "t"))
    sums = both.agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("double").alias(name) for name in ("s", "t")]).first()
    ratio = ((t + 1.0) * F.lit(sums.s + n_buckets)) / ((s + 1.0) * F.lit(sums.t + n_buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighted(rows, gain, n_buckets=N_BUCKETS):
    """The rows made by ``featured`` with ``weight``, the sum of ``gain`` (an array) over their features."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(data.as_buffer(), dtype=_width(n_buckets))].sum()) for data in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(
        task, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id, seed=SEED):
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    share = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked(scored, percent=PERCENT, least_words=LEAST_WORDS):
    """``scored`` with ``rank``: 1, 2, 3... over the drawn share of the rows with enough words, else null.

    Rows are dealt to range partitions in the order of the draw, those that can't be drawn last, and
    written; the few numbers needed from all rows are one count a partition and one in all.
    """
    enough = (F.col("n_words") >= least_words).alias("enough")
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"]
    placed = cut(
        scored.select("*", enough).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .select("*", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"), F.count_if("enough").alias("eligible"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    drawn = sizes.agg(F.floor(F.coalesce(F.sum("eligible"), F.lit(0)) * percent / 100)).first()[0]
    rank = F.col("earlier") + F.col("at") + 1
    return placed.join(offsets, "part").select(
        *scored.columns, F.when(F.col("enough") & (rank <= drawn), rank).alias("rank")
    )


def resample(
    docs, target, percent=PERCENT, least_words=LEAST_WORDS, max_n=MAX_N, n_buckets=N_BUCKETS, seed=SEED,
    id_column="doc_id", text_column="text", target_column="text",
):
    """doc_id, n_features, weight, score and rank of every row; ranks number the drawn rows."""
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    rows = stored(featured(texts, max_n, n_buckets))
    wanted = featured(
        target.select(F.lit(0).alias("doc_id"), text_of(target_column).alias("text")), max_n, n_buckets
    )
    table = gains(docs.sparkSession, bucket_counts(rows, n_buckets), bucket_counts(wanted, n_buckets), n_buckets)
    gain = np.zeros(n_buckets, dtype=np.int64)
    for bucket, value in table.collect():  # one number a bucket
        gain[bucket] = value
    scored = weighted(rows, gain, n_buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs, target, id_column="doc_id", **options):
    """The drawn documents with all their columns; ids must be unique here."""
    picked = resample(docs, target, id_column=id_column, **options).filter("rank IS NOT NULL")
    names = picked.select(F.col("doc_id").alias(id_column))
    return docs.join(names, id_column, "left_semi").select(*docs.columns)
