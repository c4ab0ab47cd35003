"""N-gram Jaccard join with vertical partitioning.

All n-grams stand in one global order, the rare ones first: counts of 262,144 hash buckets over every
text rank the buckets, and the number of an n-gram is its bucket's rank followed by its hash. The
order is cut into fragments; a text's set falls into one segment per fragment.

* Texts with the same set form a class, and the join works on classes.
* The first segment of a set is its prefix, so long that two sets with the wanted similarity must
  share an n-gram within both prefixes. Sorted lists of 36-bit hashes of the prefixes tell first which
  n-grams may be in two of them; they are kept as a bitmap of 2^28 bits. Only these are spread by
  n-gram, and those without a second class of fitting size there are dropped.
* Every set has a signature, the parities of the counts of its n-grams by a hash. Bits in which two
  signatures differ stand for n-grams of one set only, so their number bounds the overlap:
  2 * overlap <= n + m - differing bits. Folded to 128 bits it does so before a pair is made.
* Of a candidate pair the overlap within the prefixes is counted first, and the whole signatures, of
  at least a bit for each n-gram, are compared. Both bound the whole overlap, and most pairs end here.
* For the others the overlap is counted in each fragment on its own, and the partial counts are
  summed per pair.

Only components are wanted, so classes already connected needn't be compared. Where many classes share
n-grams, rounds of stars go first: every class is compared with a few pivots of each of its n-grams,
those with the largest shared part and then by hash, and the components are updated. What is left,
every pair that shares a prefix n-gram and lies in different components, is then compared without
exception, so no link is lost; the rounds only decide how many pairs are left.

Wrong counts take a collision of hashes: of two n-grams of a compared pair at 63 bits, of two sets that
are taken for one class at 64 bits (sum, exclusive or and size of their hashes), or of two segments'
names at 64 bits.

Results for unusual input: null and empty texts, and texts without words, have an empty set and are
linked with nothing; a null id is ignored as the smallest of a component unless it has no other;
rows that agree in id and text are in one class; an empty table gives no rows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shingles import mix, shingle_sets
from .storage import cut, keep_rows, row_key, text_of

BUCKET_BITS = 18
SLICES = 16
FRAGMENTS = 8
CELL_BITS = 36  # of an n-gram's hash in the lists of prefixes
MAP_BITS = 28
MAP_SLICES = 256
LIST_ENTRIES = 1 << 20  # of a task's lists before they are sent
SIGNATURE_WORDS = 2  # of 64 bits
SIGNATURE = [f"s{k}" for k in range(SIGNATURE_WORDS)]
HOT = 20_000  # n-grams of a bucket beyond four times the mean; for each so many its entries get a further part
BAND = 1.5
PIVOTS = 4
MAX_ROUNDS = 8
LARGE_GROUP = 64  # classes that share an n-gram in their prefixes, from which on stars go first
FEW_PAIRS = 20  # for each entry: with no more pairs left in large groups than this, no further round of stars
BROADCAST_IDS = 100_000  # rows of at most 100 bytes


def _set_class(numbers):
    """The class of a set: a hash of its sum, its exclusive or and its size."""
    if not len(numbers):
        return 0
    spread = mix(numbers + np.uint64(0x5851F42D4C957F2D))
    parts = np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(spread), len(numbers)], dtype=np.uint64)
    return int(mix(mix(mix(parts[:1]) + parts[1:2]) + parts[2:]).view(np.int64)[0])


def _signature(numbers):
    """Parities of the numbers of n-grams by a hash: a power of two of bits, at least one for each n-gram."""
    bits = max(64 * SIGNATURE_WORDS, 1 << (len(numbers) - 1).bit_length() if len(numbers) else 0)
    at = (mix(numbers ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def _folded(signature, size):
    """The signature of the same set with so many bytes, which are a power of two and not more."""
    return np.bitwise_xor.reduce(signature.reshape(-1, size), axis=0)


def _differing(first, second):
    """In how many bits two signatures differ, the longer one folded."""
    first, second = np.frombuffer(first, dtype=np.uint8), np.frombuffer(second, dtype=np.uint8)
    size = min(len(first), len(second))
    return int(np.bitwise_count(_folded(first, size) ^ _folded(second, size)).sum())


def _texts(docs, id_column, text_column):
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        row_key(id_column, text_column).alias("row"),
        text_of(text_column).alias("text"),
    )


def _summary(texts, size):
    """Rows (doc_id, row, class, n, signatures) of texts, and per task the bucket counts in slices."""

    def task(batches):
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        names = ["doc_id", "row", "class", "n", "slice", "counts", "bits", *SIGNATURE]
        for batch in batches:
            classes, sizes, signatures = [], [], []
            for numbers in shingle_sets(batch.column(2).to_pylist(), size):
                classes.append(_set_class(numbers))
                sizes.append(len(numbers))
                signatures.append(_signature(numbers))
                counts += np.bincount((numbers & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(classes), pa.int32()), pa.nulls(len(classes), pa.binary())
            bits = np.array([_folded(b, 8 * SIGNATURE_WORDS) for b in signatures], dtype=np.uint8).reshape(len(classes), 8 * SIGNATURE_WORDS).view("<i8")
            whole = pa.array([b.tobytes() for b in signatures], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), *none, whole,
                 *[pa.array(bits[:, k]) for k in range(SIGNATURE_WORDS)]], names=names
            )
        if counts.any():
            parts = [zlib.compress(part.astype("<i8").tobytes(), 1) for part in np.split(counts, SLICES)]
            none = [pa.nulls(SLICES, kind) for kind in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), pa.nulls(SLICES, pa.binary()),
                 *[pa.nulls(SLICES, pa.int64())] * SIGNATURE_WORDS], names=names
            )

    words = ", ".join(f"{name} long" for name in SIGNATURE)
    return texts.mapInArrow(task, f"doc_id long, row string, class long, n long, slice int, counts binary, bits binary, {words}")


def _bucket_counts(summary):
    """Sum of the bucket counts of all tasks."""

    def add(batches):
        sums = {}
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(part.as_py()), dtype="<i8")
                sums[number] = sums[number] + part if number in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())],
            names=["slice", "counts"],
        )

    parts = summary.filter("slice IS NOT NULL").select("slice", "counts")
    schema = "slice int, counts binary"
    summed = parts.mapInArrow(add, schema).repartition(SLICES, "slice").mapInArrow(add, schema)
    out = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES), dtype=np.int64)
    for row in summed.collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype="<i8")
    return out.ravel()


class _Order:
    """The global order: numbers of n-grams, cuts of the fragments, and shares of hot n-grams."""

    def __init__(self, counts, fragments=FRAGMENTS):
        by_count = np.lexsort((np.arange(len(counts)), counts))
        self.rank = np.empty(len(counts), dtype=np.uint64)
        self.rank[by_count] = np.arange(len(counts), dtype=np.uint64)
        mass = np.cumsum(counts[by_count])
        steps = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)
        self.cuts = steps.astype(np.int64) << (63 - BUCKET_BITS)
        self.shares = (np.maximum(counts[by_count] - 4 * counts.mean(), 0) // HOT + 1).astype(np.int64)

    def numbers(self, hashes):
        bucket = (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)
        low = hashes >> np.uint64(BUCKET_BITS + 1)
        return np.sort((self.rank[bucket] << np.uint64(63 - BUCKET_BITS)) | low).astype(np.int64)


def _class_prefixes(batches, table, percent, size):
    """For each batch (prefix, class, size) of the sets in it that are new to the task."""
    seen = set()
    for batch in batches:
        parts = []
        for numbers in shingle_sets(batch.column(0).to_pylist(), size):
            name = _set_class(numbers)
            n = len(numbers)
            if not n or name in seen:
                continue
            seen.add(name)
            parts.append((table.numbers(numbers)[: n - -(-percent * n // 100) + 1], name, n))
        yield parts


def _cells(number):
    return mix(number.view(np.uint64)) >> np.uint64(64 - CELL_BITS)


class _Bitmap:
    """A bit for each of 2^28 ranges of cells, sent to the tasks as compressed slices."""

    def __init__(self, slices):
        self.slices = slices
        self.bits = np.zeros((MAP_SLICES, (1 << MAP_BITS) // MAP_SLICES // 8), dtype=np.uint8)
        for k, part in slices.items():
            self.bits[k] = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
        self.bits = self.bits.ravel()

    def __reduce__(self):
        return _Bitmap, (self.slices,)

    def has(self, number):
        bit = (_cells(number) >> np.uint64(CELL_BITS - MAP_BITS)).astype(np.int64)
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _shared(texts, order, percent, size):
    """A bitmap with the n-grams that are in the prefixes of two sets, and by chance some others.

    Tasks send their cells in sorted lists of distances, by the cells' first bits. A class that two
    tasks have counts twice; its n-grams stay until they are spread by n-gram.
    """
    low = CELL_BITS - MAP_SLICES.bit_length() + 1

    def lists(cells):
        cells = np.sort(np.concatenate(cells))
        bounds = np.searchsorted(cells, np.arange(1, MAP_SLICES, dtype=np.uint64) << np.uint64(low))
        parts = [(k, part) for k, part in enumerate(np.split(cells, bounds)) if len(part)]
        steps = [np.diff(part, prepend=np.uint64(k << low)).astype("<u4") for k, part in parts]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in steps], pa.binary())],
            names=["slice", "cells"],
        )

    def task(batches):
        held, count = [], 0
        for parts in _class_prefixes(batches, order.value, percent, size):
            for prefix, _, _ in parts:
                held.append(_cells(prefix))
                count += len(prefix)
                if count >= LIST_ENTRIES:
                    yield lists(held)
                    held, count = [], 0
        if held:
            yield lists(held)

    def mark(batches):
        found = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(k, []).append(part)
        for k, parts in found.items():
            cells = np.sort(np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(p), dtype="<u4"), dtype=np.uint64) for p in parts]))
            bits = np.zeros((1 << MAP_BITS) // MAP_SLICES, dtype=np.uint8)
            bits[(cells[1:][cells[1:] == cells[:-1]] >> np.uint64(CELL_BITS - MAP_BITS)).astype(np.int64)] = 1
            bits = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits], pa.binary())], names=["slice", "cells"])

    schema = "slice int, cells binary"
    spread = texts.select("text").mapInArrow(task, schema).repartition(min(MAP_SLICES, _parts(texts)), "slice")
    return _Bitmap({row["slice"]: row["cells"] for row in spread.mapInArrow(mark, schema).collect()})


def _prefixes(texts, order, shared, percent, size):
    """Rows (number, share, class, n, place) of the n-grams in prefixes that may be shared, once per task and class."""

    def task(batches):
        table, bitmap = order.value, shared.value
        for parts in _class_prefixes(batches, table, percent, size):
            if parts:
                number = np.concatenate([p for p, _, _ in parts])
                lengths = [len(p) for p, _, _ in parts]
                name = np.repeat(np.array([c for _, c, _ in parts], dtype=np.int64), lengths)
                n = np.repeat(np.array([n for _, _, n in parts], dtype=np.int32), lengths)
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                kept = bitmap.has(number)
                number, name, n, place = number[kept], name[kept], n[kept], place[kept]
                share = (mix((number ^ name).view(np.uint64)) >> np.uint64(1)).view(np.int64) % table.shares[number >> (63 - BUCKET_BITS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(share.astype(np.int32)), pa.array(name), pa.array(n), pa.array(place)],
                    names=["number", "share", "class", "n", "place"],
                )

    return texts.select("text").mapInArrow(task, "number long, share int, class long, n int, place int")


def _with_partner(order, percent):
    """Drops repeated classes and entries without a neighbour of fitting size; rows come sorted."""

    def task(batches):
        table = order.value
        held = None  # the last entry, whose next neighbour isn't known yet, and its verdict so far
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if not len(columns[0]):
                continue
            had = np.zeros(len(columns[0]), dtype=bool)
            if held is not None:
                columns = [np.concatenate((h, c)) for h, c in zip(held[0], columns, strict=True)]
                had = np.concatenate(([held[1]], had))
            number, share, name, n, _ = columns
            new = np.ones(len(number), dtype=bool)
            new[1:] = (number[1:] != number[:-1]) | (name[1:] != name[:-1])
            columns, had = [c[new] for c in columns], had[new]
            number, share, name, n, _ = columns
            fits = np.zeros(len(number), dtype=bool)
            near = (number[1:] == number[:-1]) & (share[1:] == share[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            fits[1:] |= near
            fits[:-1] |= near
            fits |= had | (table.shares[number >> (63 - BUCKET_BITS)] > 1)
            held = [c[-1:] for c in columns], bool(fits[-1])
            if fits[:-1].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[k][:-1][fits[:-1]]) for k in (0, 2, 3, 4)], names=["number", "class", "n", "place"]
                )
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0][k]) for k in (0, 2, 3, 4)], names=["number", "class", "n", "place"])

    return task


def _parts(frame):
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _segments(texts, rows, order, size):
    """Rows (segment, numbers) of the texts in ``rows`` (row, class)."""

    def task(batches):
        table = order.value
        for batch in batches:
            out = []
            for name, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), size), strict=True):
                numbers = table.numbers(hashes)
                fragment = np.searchsorted(table.cuts, numbers, side="right")
                bounds = np.flatnonzero(np.diff(fragment)) + 1
                for part, f in zip(np.split(numbers, bounds), fragment[np.concatenate(([0], bounds))], strict=True):
                    out.append((name, int(f), part))
            for at in range(0, len(out), 4096):
                part = out[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _, _ in part], pa.int64()), pa.array([f for _, f, _ in part], pa.int32()),
                     pa.array([v for _, _, v in part], pa.list_(pa.int64()))],
                    names=["class", "fragment", "numbers"],
                )

    small = rows.count() <= BROADCAST_IDS
    wanted = texts.select("row", "text").join(F.broadcast(rows) if small else rows, "row")
    found = wanted.select("class", "text").mapInArrow(task, "class long, fragment int, numbers array<long>")
    return found.select(F.xxhash64("class", "fragment").alias("segment"), "numbers")


def _alike(batches):
    """Of pairs (a, b, sizes, allowed, signatures) those whose signatures differ in the allowed bits at most."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (3, 4, 5)]
        kept = pa.array([_differing(x, y) <= allowed for allowed, x, y in zip(*columns, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in range(3)], names=["a", "b", "sizes"])


def _stars(percent):
    """Pairs of each class with pivots of its n-grams, and how many pairs would be left to compare.

    Rows come sorted by n-gram, share, band and rank, so the first rows of a group are its pivots.
    Output (a, b, left): pairs in different components that may be links, and a row per task with the
    sum over groups of the pairs that have a class outside the component of the first pivot.
    """

    def task(batches):
        group, pivots, left = None, [], 0
        total = strong_total = rest = strong_rest = 0
        for batch in batches:
            pairs = set()
            columns = (batch.column(k).to_pylist() for k in range(9))
            signatures = np.column_stack([batch.column(9 + k).to_numpy() for k in range(SIGNATURE_WORDS)])
            signatures = [int.from_bytes(row.tobytes(), "little") for row in signatures]
            for number, share, band, name, n, root, k, behind, strong, bits in zip(*columns, signatures, strict=True):
                if group != (number, share, band):
                    left += total * strong_rest + strong_total * rest
                    group, pivots = (number, share, band), []
                    total = strong_total = rest = strong_rest = 0
                total += 1
                strong_total += strong
                if pivots and root != pivots[0][2]:
                    rest += 1
                    strong_rest += strong
                for other, m, its, k2, behind2, strong2, bits2 in pivots:
                    if its != root and (strong if (n, name) < (m, other) else strong2) and 100 * min(n, m) >= percent * max(n, m):
                        needed = -(-percent * (n + m) // (100 + percent))
                        if min(k, k2) + 1 + min(behind, behind2) >= needed and (bits ^ bits2).bit_count() <= n + m - 2 * needed:
                            pairs.add((name, other) if name < other else (other, name))
                if len(pivots) < PIVOTS and all(name != p[0] for p in pivots):
                    pivots.append((name, n, root, k, behind, strong, bits))
            if pairs:
                first, second = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.nulls(len(first), pa.int64())], names=["a", "b", "left"]
                )
        left += total * strong_rest + strong_total * rest
        if left:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([left], pa.int64())], names=["a", "b", "left"])

    return task


def components(edges):
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node in reach.

    Large and small stars in turn (every edge is moved to the smallest neighbour of its end) until
    the edges stay the same. Smallest neighbours are aggregated before they are joined, so a node
    with many neighbours isn't gathered anywhere.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


class _Join:
    """State of one join: prefixes by class, pairs checked so far and components."""

    def __init__(self, texts, classes, entries, order, percent, size):
        self.texts, self.order, self.percent, self.size = texts, order, percent, size
        self.prefixes = cut(
            entries.repartition(_parts(entries), "class").groupBy("class").agg(
                F.first("n").alias("n"), F.sort_array(F.collect_list("number")).alias("numbers"),
                F.sort_array(F.collect_list("place")).alias("places"),
            ).join(classes, "class")
        )
        numbers = self.prefixes.select(F.explode("numbers").alias("number"))
        self.large = cut(numbers.groupBy("number").count().filter(F.col("count") > LARGE_GROUP).select("number"))
        self.any_large = not self.large.isEmpty()
        self.few_pairs = FEW_PAIRS * self.prefixes.agg(F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()[0]
        self.roots = self.checked = None

    def needed(self, n, m):
        """The overlap two sets of these sizes need: overlap / (n + m - overlap) >= percent / 100."""
        whole = 100 + self.percent
        return F.call_function("div", (n.cast("long") + m) * self.percent + (whole - 1), F.lit(whole))

    def entries(self, round_number=0):
        """Prefix entries with the component of their class and their rank as a pivot.

        ``k`` is the place among the class's entries and ``behind`` the number of its n-grams after
        this one. Of the last n-gram two prefixes share, the smaller ``k`` + 1 bounds what they share up
        to it, and the smaller ``behind`` what they may share after it. An entry is strong if that
        allows a link with a set that isn't smaller; of a pair the smaller set must have one.
        """
        entries = self.prefixes
        if self.roots is None:
            entries = entries.withColumn("root", F.col("class"))
        else:
            roots = self.roots.select(F.col("node").alias("class"), "root")
            entries = entries.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        central = F.round(F.size("numbers") / F.col("n"), 1 if round_number else 3)
        return (
            entries.select("class", "n", "root", *SIGNATURE, (-central).alias("rank"), F.posexplode(F.arrays_zip("numbers", "places")).alias("k", "entry"))
            .select("class", "n", "root", *SIGNATURE, "rank", "k", F.col("entry.numbers").alias("number"), (F.col("n") - F.col("entry.places") - 1).alias("behind"))
            .withColumn("strong", F.col("k") + 1 + F.col("behind") >= self.needed(F.col("n"), F.col("n")))
        )

    def in_large_groups(self, entries, wanted=True):
        """The entries of n-grams that many classes share, or the others."""
        return entries.join(self.large, "number", "left_semi" if wanted else "left_anti") if self.any_large else entries

    def star_pairs(self, number):
        """Pairs with pivots, and the number of pairs left; bands of sizes are moved in every other round."""
        band = F.floor(F.log(BAND, F.col("n").cast("double")) + (0.5 if number % 2 else 0.0)).cast("int")
        shares = self.order.value.shares
        hot = np.flatnonzero(shares > 1)
        share = F.lit(0)
        if len(hot):  # hot buckets are the last ones of the order
            limit = int(hot[0]) << (63 - BUCKET_BITS)
            share = F.when(F.col("number") >= limit, F.pmod(F.xxhash64("class", "number", F.lit(number)), F.lit(int(shares[hot].max()))).cast("int")).otherwise(0)
        spread = self.in_large_groups(self.entries(number)).select("number", share.alias("share"), band.alias("band"), "class", "n", "root", "k", "behind", "strong", *SIGNATURE, "rank")
        ordered = spread.repartition("number", "share").sortWithinPartitions(
            "number", "share", "band", "rank", F.xxhash64("class", F.lit(number)), "class"
        )
        return cut(
            ordered.drop("rank").mapInArrow(_stars(self.percent), "a long, b long, left long")
            .groupBy("a", "b").agg(F.sum("left").alias("left"))
        )

    def meeting(self, large, small, keys):
        """Pairs of a class and a smaller or equal one, from entries that meet, as far as they may be links."""
        needed = self.needed(F.col("n"), F.col("m"))
        differing = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(f"small_{s}"))) for s in SIGNATURE)
        may_link = (
            (F.col("root") != F.col("r"))
            & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("x") < F.col("class"))))
            & (F.col("m") * 100 >= F.col("n") * self.percent)
            & (F.least("k", "k2") + 1 + F.least("behind", "behind2") >= needed)
            & (differing.cast("long") <= F.col("n").cast("long") + F.col("m") - 2 * needed)
        )
        met = large.join(small, keys).filter(may_link)
        return met.select(F.least("class", "x").alias("a"), F.greatest("class", "x").alias("b"))

    def smaller(self, entries, *others):
        return entries.filter("strong").select(
            "number", *others, F.col("class").alias("x"), F.col("n").alias("m"), F.col("root").alias("r"), F.col("k").alias("k2"),
            F.col("behind").alias("behind2"), *[F.col(s).alias(f"small_{s}") for s in SIGNATURE],
        )

    def all_pairs(self):
        """Every pair in different components that shares a prefix n-gram and may be a link there.

        In large groups both sides meet by band of sizes too, and of each n-gram one component is left
        out against itself: a pair in different components has a class outside of it.
        """
        columns = ["number", "class", "n", "root", "k", "behind", "strong", *SIGNATURE]
        others = self.in_large_groups(self.entries().select(*columns), False)
        pairs = self.meeting(others.drop("strong"), self.smaller(others), ["number"])
        if not self.any_large:
            return pairs.distinct()
        entries = self.in_large_groups(self.entries())
        tops = entries.groupBy("number").agg(
            F.min(F.struct("rank", F.xxhash64("class").alias("s"), "root")).alias("top"), F.min("root").alias("low"), F.max("root").alias("high")
        ).filter("low <> high").select("number", F.col("top.root").alias("top"))
        ratio = 100.0 / self.percent
        # sizes within the ratio lie in one band or in neighbours; equal quotients are rounded alike
        band = F.floor(F.log(ratio, F.col("n").cast("double")) + 1e-9).cast("int") if ratio > 1 else F.lit(0)
        entries = cut(entries.join(tops, "number").select(*columns, "top", band.alias("band")))
        near = F.explode(F.array("band", F.col("band") + 1)).alias("band")
        small_rest = self.smaller(entries.filter("root <> top"), near)
        small_top = self.smaller(entries.filter("root = top"), near)
        return (
            pairs.unionByName(self.meeting(entries, small_rest, ["number", "band"]))
            .unionByName(self.meeting(entries.filter("root <> top"), small_top, ["number", "band"])).distinct()
        )

    def verify(self, pairs):
        """The pairs that are links, by counts of prefixes and signatures first and of fragments then; pairs are distinct."""
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        side = lambda c: self.prefixes.select(
            F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("numbers").alias(f"numbers_{c}"), F.col("places").alias(f"places_{c}"),
            F.col("bits").alias(f"bits_{c}"),
        )
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.array_intersect("numbers_a", "numbers_b"))
        last = F.array_max("common")
        left_over = lambda c: F.col(f"n_{c}") - 1 - F.element_at(
            f"places_{c}", F.array_position(f"numbers_{c}", last).cast("int")
        )
        needed = self.needed(F.col("n_a").cast("long"), F.col("n_b").cast("long"))
        likely = cut(
            both.filter(F.size("common") + F.least(left_over("a"), left_over("b")) >= needed)
            .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), (F.col("n_a").cast("long") + F.col("n_b") - 2 * needed).alias("allowed"), "bits_a", "bits_b")
            .mapInArrow(_alike, "a long, b long, sizes int")
        )
        segments = self.segments(likely)
        fragments = F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment")
        keys = likely.select("a", "b", "sizes", fragments).select(
            "a", "b", "sizes", "fragment", F.xxhash64("a", "fragment").alias("segment_a"), F.xxhash64("b", "fragment").alias("segment_b")
        )
        part = lambda c: segments.select(F.col("segment").alias(f"segment_{c}"), F.col("numbers").alias(f"numbers_{c}"))
        partial = keys.join(part("a"), "segment_a").join(part("b"), "segment_b")
        counted = partial.groupBy("a", "b", "sizes", "fragment").agg(  # a text that is there twice has its segments twice
            F.max(F.size(F.array_intersect("numbers_a", "numbers_b"))).alias("part")
        )
        overlap = counted.groupBy("a", "b", "sizes").agg(F.sum("part").alias("overlap"))
        found = overlap.filter(F.col("overlap") * 100 >= (F.col("sizes") - F.col("overlap")) * self.percent)
        done = likely.select("a", "b")
        self.checked = done if self.checked is None else self.checked.unionByName(done)
        return cut(found.select("a", "b"))

    def segments(self, pairs):
        """Segments of the classes of the pairs; both joins read them from one shuffle."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        rows = cut(self.prefixes.select("row", "class").join(wanted, "class", "left_semi").select("row", "class"))
        return _segments(self.texts, rows, self.order, self.size)

    def connect(self, links):
        if self.roots is not None:
            links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = components(links)

    def run(self):
        before = None
        for number in range(MAX_ROUNDS if self.any_large else 0):
            stars = self.star_pairs(number)
            left = stars.agg(F.sum("left")).first()[0] or 0
            # another round of stars pays while there is much to compare and the last one more than halved it;
            # the first one connects the copies, what is left after it are mostly pairs the bounds rule out
            if before is not None and (left <= self.few_pairs or 2 * left > before):
                break
            before = left
            self.connect(self.verify(stars.filter("a IS NOT NULL").select("a", "b")))
        self.connect(self.verify(self.all_pairs()))
        return self.roots


def _joined(docs, percent, size, id_column, text_column):
    """Rows (doc_id, row, class, n) and the roots of classes with links."""
    spark = docs.sparkSession
    texts = _texts(docs, id_column, text_column)
    summary = cut(_summary(texts, size))
    rows = summary.filter("slice IS NULL").select("doc_id", "row", "class", "n")
    counts = _bucket_counts(summary)
    if not counts.any():
        return rows, spark.createDataFrame([], "node long, root long")
    order = spark.sparkContext.broadcast(_Order(counts))
    shared = spark.sparkContext.broadcast(_shared(texts, order, percent, size))
    spread = _prefixes(texts, order, shared, percent, size).repartition("number", "share")
    entries = spread.sortWithinPartitions("number", "share", "n", "class").mapInArrow(
        _with_partner(order, percent), "number long, class long, n int, place int"
    )
    signed = summary.filter("slice IS NULL AND n > 0")
    classes = signed.groupBy("class").agg(F.min("row").alias("row"), F.min("bits").alias("bits"), *[F.min(s).alias(s) for s in SIGNATURE])
    return rows, _Join(texts, classes, entries, order, percent, size).run()


def _class_components(rows, roots):
    """Per class with words: the smallest id of its component, and the row that has it."""
    named = (
        rows.filter("n > 0").groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("smallest"))
    return named.join(smallest, "root").select("class", F.col("smallest.doc_id").alias("component_id"), F.col("smallest.row").alias("_key"))


def jaccard_components(docs, percent=80, size=5, id_column="doc_id", text_column="text"):
    """One row per input row: doc_id, n_shingles, component_id."""
    rows, roots = _joined(docs, percent, size, id_column, text_column)
    named = _class_components(rows, roots).select("class", "component_id")
    return rows.join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one_per_component(docs, percent=80, size=5, id_column="doc_id", text_column="text"):
    """The rows with the smallest id of their component, and those without words; all columns stay."""
    rows, roots = _joined(docs, percent, size, id_column, text_column)
    keys = _class_components(rows, roots).select("_key").distinct()
    empty = rows.filter("n = 0").select(F.col("row").alias("_key")).distinct()
    return keep_rows(docs, keys.unionByName(empty), id_column, text_column)
