"""Benchmark decontamination by template windows.

Texts are read as tokens: runs of letters and digits, numbers with their points and commas, single
characters of scripts that are written without spaces between words. In the
template of a text, numbers, units after numbers and names (capitalised words that don't begin a
sentence) are typed placeholders. Windows of ``width`` tokens are hashed in three forms: as written
in lower case, and, where a window has a slot and enough literal words, as template; where it has a
capitalised word that begins a sentence, also as a template in which that word is a name. An item with
fewer tokens is one window as written, and documents have windows of that length too.

The windows of the benchmark are a table. Windows of documents that can't be in it are dropped in
the scan by a bitmap of fixed size; the rest are joined with it on the hash. Template windows count
only as far as their slots are consistent: along one alignment of a document with an item, every
value of the item must always become the same value, or the disagreeing windows are left out; words
that begin sentences have to agree with the other slots, but don't speak against them. A
document leaks an item when its windows cover the wanted share of the item's windows, or as many of
them as a passage of ``passage`` tokens has.

Results for unusual input: null and empty texts have no windows; rows that agree in id and text are judged together, and a null id is
reported as null; equal items are all reported; very long texts are searched whole; an empty table on either side
gives no rows. Columns other than the ids and the texts are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .shingles import chunks, mix
from .storage import cut, row_key, text_of

WIDTH = 8
COVERAGE = 0.5
PASSAGE = 25
LITERALS = 4
BITMAP_BITS = 24

# Units of measure and money that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres "
    "gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees kmh mph kw kwh mb gb tb"
).split()

_NUMBER, _UNIT, _NAME = (np.uint64(k) for k in (0xA5A5A5A501, 0xA5A5A5A502, 0xA5A5A5A503))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, dtype=np.uint8)  # 1 digit, 2 lower, 4 upper, 8 part of a longer character, 16 point or comma
_KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[128:] = 1, 2, 4, 8
_KIND[[44, 46]] = 16
# Lead bytes and second bytes of the three-byte characters of scripts without spaces, and of their signs.
_SINGLE, _SIGN = np.zeros((256, 256), dtype=bool), np.zeros((256, 256), dtype=bool)
_SINGLE[0xE4:0xEA, 0x80:] = True  # Chinese characters
_SINGLE[0xE3, 0x81:0x84] = True  # Japanese syllables
_SINGLE[0xE3, 0x87] = _SINGLE[0xE3, 0x90:] = True  # more of both
_SINGLE[0xEF, 0xA4:0xAC] = _SINGLE[0xEF, 0xBD:0xBF] = True  # and of their other widths
_SINGLE[0xE0, 0xB8:0xBC] = True  # Thai, Lao
_SINGLE[0xE1, 0x80:0x83] = _SINGLE[0xE1, 0x9E:0xA0] = True  # Burmese, Khmer
_SIGN[0xE3, 0x80] = _SIGN[0xEF, 0xBC] = True  # their signs, less what is told apart by the third byte
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True


class Tokens:
    """Token arrays of a group of texts."""

    def __init__(self, group):
        data = np.frombuffer(b"\n".join(group) + b"\n\n", dtype=np.uint8)
        kind = _KIND[data]
        after = np.append(data[1:], np.uint8(0))
        before = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
        accented = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        lower = data + np.where((kind == 4) | accented, 32, 0).astype(np.uint8)
        upper = (kind == 4) | ((data == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
        sign = ((data == 0xE2) & (after == 0x80)) | ((data == 0xC2) & (after >= 0x80) & (after <= 0xBF))
        sign[1:] |= sign[:-1]
        long = (data == 0xE2) & (after == 0x80)
        sign[2:] |= long[:-2]
        third = np.append(after[1:], np.uint8(0))
        single = _SINGLE[data, after] | ((data == 0xE3) & (after == 0x80) & (third >= 0x85) & (third <= 0x87))
        lead = _SIGN[data, after] & ~single & ~((data == 0xEF) & ((third >= 0x90) & (third <= 0x99) | (third >= 0xA1) & (third <= 0xBA)))
        lead |= (data == 0xEF) & (after == 0xBD) & (third >= 0x9B) & (third <= 0xA5)
        wide = (data == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
        single &= ~lead
        for k in range(3):
            sign[k:] |= lead[: len(lead) - k]
        edge = single | wide
        edge[3:] |= single[:-3]
        edge[4:] |= wide[:-4]
        digit = kind == 1
        inner = (kind == 16) & np.concatenate(([False], digit[:-1])) & np.append(digit[1:], False)
        word = (((kind & 15) > 0) & ~sign) | inner
        self.begins = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge))
        self.ends = np.flatnonzero((~word | edge) & np.concatenate(([False], word[:-1])))
        n = len(self.begins)

        up = np.full(len(data), _BASE)
        up[0] = 1
        up = np.cumprod(up)
        inverse = np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        length = self.ends - self.begins
        self.literal = mix((sums[self.ends] - sums[self.begins]) * inverse[self.begins] + length.astype(np.uint64))

        def count(mask):
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[self.ends] - total[self.begins]

        number = (count(digit | inner) == length) & (length > 0)
        stops = np.concatenate(([0], np.cumsum(_STOP[data] & ~word)))
        first = np.ones(n, dtype=bool)
        if n > 1:
            first[1:] = stops[self.begins[1:]] > stops[self.ends[:-1]]
        bounds = np.cumsum([len(t) + 1 for t in group])
        self.counts = np.diff(np.searchsorted(self.begins, bounds), prepend=0)
        starts = np.cumsum(self.counts) - self.counts
        first[starts[self.counts > 0]] = True
        capital = upper[self.begins] & (count(kind == 2) > 0) & ~number if n else np.zeros(0, dtype=bool)
        name = capital & ~first
        unit = np.zeros(n, dtype=bool)
        if n > 1:
            unit[1:] = number[:-1] & ~first[1:] & np.isin(self.literal[1:], _units())
        self.slot = number | name | unit
        self.template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, self.literal)))
        self.opening = capital & first
        self.wide = np.where(self.opening, _NAME, self.template)


_UNIT_HASHES = []


def _units():
    if not _UNIT_HASHES:
        _UNIT_HASHES.append(None)
        _UNIT_HASHES[0] = np.unique(Tokens([" ".join(UNITS).encode()]).literal)
    found = _UNIT_HASHES[0]
    return np.empty(0, dtype=np.uint64) if found is None else found


def _rolled(values, width):
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += values[k : k + n] * (mix(np.array([k + 1], dtype=np.uint64) * _BASE)[0] | np.uint64(1))
    return mix(out)


def text_windows(texts, width=WIDTH, literals=LITERALS, short=()):
    """(hashes, places, template?, forms, tokens, first token, their number) of the windows of each text.

    Forms: 0 as written, 1 template, 2 template in which words that begin sentences are names too, -k as
    written with k tokens: of the lengths in ``short``, or, if it is None, a whole text shorter than ``width``.
    """
    for group in chunks(texts):
        tokens = Tokens(group)
        plain = _rolled(tokens.literal, width)
        template = _rolled(tokens.template, width) ^ np.uint64(0x5555555555555555)
        wide = _rolled(tokens.wide, width) ^ np.uint64(0x3333333333333333)
        rolled = {k: _rolled(tokens.literal, k) for k in short or ()}
        slots = np.concatenate(([0], np.cumsum(tokens.slot)))
        openings = np.concatenate(([0], np.cumsum(tokens.opening)))
        at = 0
        for count in tokens.counts.tolist():
            n = max(0, count - width + 1)
            places = np.arange(n)
            used = slots[at + width : at + width + n] - slots[at : at + n]
            opened = openings[at + width : at + width + n] - openings[at : at + n]
            typed = np.flatnonzero((used > 0) & (width - used >= literals))
            named = np.flatnonzero((opened > 0) & (width - used - opened >= literals))
            hashes = np.concatenate((plain[at : at + n], template[at : at + n][typed], wide[at : at + n][named]))
            places = np.concatenate((places, typed, named))
            forms = np.repeat([0, 1, 2], [n, len(typed), len(named)])
            if short is None and 0 < count < width:
                hashes, places, forms = _rolled(tokens.literal[at : at + count], count), np.zeros(1, int), np.array([-count])
            for k in rolled:
                # One of equal windows is enough, since the item has no other.
                here, first = np.unique(rolled[k][at : at + max(0, count - k + 1)], return_index=True)
                hashes, places = np.concatenate((hashes, here)), np.concatenate((places, first))
                forms = np.concatenate((forms, np.full(len(here), -k)))
            yield hashes, places, forms > 0, forms, tokens, at, count
            at += count


def _window_rows(batches, width, literals, short=None, bitmap=None):
    """Rows (key columns ..., tokens, hash, place, form, slots), only hashes in the bitmap if given."""
    for batch in batches:
        picked = []
        for row, (hashes, places, _, forms, tokens, at, count) in enumerate(text_windows(batch.column(2).to_pylist(), width, literals, short)):
            if bitmap is not None:
                low = (hashes & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                here = np.flatnonzero((bitmap[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1))
                hashes, places, forms = hashes[here], places[here], forms[here]
            for h, p, form in zip(hashes.view(np.int64).tolist(), places.tolist(), forms.tolist(), strict=True):
                values = None
                if form > 0:
                    of = slice(at + p, at + p + width)
                    slot = tokens.slot[of] | tokens.opening[of] if form == 2 else tokens.slot[of]
                    values = tokens.literal[of][slot].view(np.int64).tolist()
                picked.append((row, count, h, p, form, values))
        for part in range(0, len(picked), 8192):
            rows = picked[part : part + 8192]
            index = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()),
                 pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.list_(pa.int64()))],
                names=["id", "key", "tokens", "hash", "place", "form", "slots"],
            )


_ROWS = "id long, key string, tokens int, hash long, place int, form int, slots array<long>"


def _bitmap(windows):
    low = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = windows.select(
        F.shiftright(low, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & 63L as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    found = words.toPandas()  # at most 2^18 rows
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def leaks(docs, benchmark, width=WIDTH, coverage=COVERAGE, passage=PASSAGE, literals=LITERALS,
          id_column="doc_id", text_column="text"):
    """Rows (doc_id, row, item_id, windows, item_windows, copied): a document that leaks an item.

    ``windows`` is how many of the item's windows are found, ``copied`` how many of them as written.
    """
    spark = docs.sparkSession
    item_rows = benchmark.select(
        F.col("item_id").cast("long").alias("id"), F.lit("").alias("key"), text_of().alias("text")
    )
    items = cut(item_rows.mapInArrow(lambda batches: _window_rows(batches, width, literals), _ROWS))
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    short = sorted(-r["form"] for r in items.filter("form < 0").select("form").distinct().collect())  # fewer than width

    def scan(batches):
        yield from _window_rows(batches, width, literals, short, bitmap.value)

    texts = docs.select(
        F.col(id_column).cast("long").alias("id"), row_key(id_column, text_column).alias("key"), text_of(text_column).alias("text")
    )
    found = texts.mapInArrow(scan, _ROWS)
    wanted = items.select(
        "hash", "form", F.col("id").alias("item_id"), F.col("tokens").alias("item_tokens"), F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"),
    )
    hits = cut(
        found.drop("tokens").join(wanted, ["hash", "form"])
        .filter((F.col("form") <= 0) | (F.size("slots") == F.size("item_slots")))
        .withColumn("shift", F.col("place") - F.col("item_place"))
    )
    # The value of the document for each value of the item along one alignment, where it isn't the only one.
    # Values of templates also speak for the form in which words that begin sentences are names.
    values = (
        hits.filter("form > 0")
        .select("key", "item_id", "shift", F.explode(F.sequence("form", F.lit(2))).alias("form"), "item_slots", "slots")
        .select("key", "item_id", "shift", "form", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
        .groupBy("key", "item_id", "shift", "form", F.col("s.item_slots").alias("value"))
        .agg(F.min("s.slots").alias("least"), F.max("s.slots").alias("most"))
        .filter("least <> most")
        .groupBy("key", "item_id", "shift", "form").agg(F.collect_set("value").alias("torn"))
    )
    sound = (
        hits.join(values, ["key", "item_id", "shift", "form"], "left")
        .filter((F.col("form") <= 0) | F.col("torn").isNull() | ~F.arrays_overlap("item_slots", "torn"))
    )
    matched = sound.groupBy("id", "key", "item_id", "item_tokens", "item_place").agg(
        F.max((F.col("form") <= 0).cast("int")).alias("as_written")
    )
    total = F.greatest(F.col("item_tokens") - (width - 1), F.lit(1))
    return (
        matched.groupBy("id", "key", "item_id", "item_tokens")
        .agg(F.count("*").alias("windows"), F.sum("as_written").alias("copied"))
        .filter((F.col("windows") >= coverage * total) | (F.col("windows") >= passage - (width - 1)))
        .select(F.col("id").alias("doc_id"), F.col("key").alias("row"), "item_id", "windows",
                total.cast("long").alias("item_windows"), "copied")
    )


def drop_leaks(docs, benchmark, id_column="doc_id", text_column="text", **parameters):
    """The rows that leak no item, with all their columns."""
    found = leaks(docs, benchmark, id_column=id_column, text_column=text_column, **parameters)
    bad = cut(found.select(F.col("row").alias("_key")).distinct())
    names = [F.col(f"`{n}`") for n in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), row_key(id_column, text_column).alias("_key"))
    return rows.join(bad, "_key", "left_anti").select("_row.*")
