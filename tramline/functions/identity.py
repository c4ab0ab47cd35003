"""Identities and content hashes."""

import hashlib
import json

from pyspark.sql import functions as F

# Versions of the typed model and of the KPI rules; they are part of the identities.
MODEL_VERSION = "silver-v1"
METRICS_VERSION = "gold-v1"


def dataset_id(source_sha256, model_version=MODEL_VERSION):
    """Identity of a snapshot: its bytes and the typing rules, never the run."""
    text = f"{model_version}\0{source_sha256}"
    return "gtfs_" + hashlib.sha256(text.encode()).hexdigest()


def dataset_id_column(source_sha256, model_version=MODEL_VERSION):
    """The same identity for a column of source hashes."""
    text = F.concat(F.lit(model_version + "\0"), source_sha256)
    return F.concat(F.lit("gtfs_"), F.sha2(text, 256))


def analysis_id(dataset, start, end, version=METRICS_VERSION):
    text = json.dumps([dataset, start.isoformat(), end.isoformat(), version], separators=(",", ":"))
    return "analysis_" + hashlib.sha256(text.encode()).hexdigest()


def analysis_id_column(dataset, start, end, version=METRICS_VERSION):
    """The same identity for a column of dataset ids, which hold no characters JSON escapes."""
    tail = f'","{start.isoformat()}","{end.isoformat()}","{version}"]'
    return F.concat(
        F.lit("analysis_"), F.sha2(F.concat(F.lit('["'), dataset, F.lit(tail)), 256)
    )


def row_text(columns):
    """One text per row that differs whenever any value differs, NULL included.

    All pieces go into one text at once; a NULL value leaves its sign alone.
    """
    pieces = []
    for name in columns:
        text = F.col(f"`{name}`").cast("string")
        size = F.concat(F.lit("="), F.length(text).cast("string"), F.lit(":"))
        pieces += [F.coalesce(size, F.lit("-")), F.coalesce(text, F.lit(""))]
    return F.concat(*pieces)


# Two 60-bit lanes of a row's hash, and the bits of a lane that are summed together.
LANES = {"low": 1, "high": 16}
LANE_BITS = 60
PART_BITS = 20


def _part(name, shift):
    return f"_{name}_{shift}"


def with_lanes(frame, columns=None):
    """Add the lanes of each row's hash, in parts of whole numbers."""
    digest = F.sha2(row_text(columns or frame.columns), 256)
    lanes = {f"_{name}": F.conv(F.substring("_digest", start, 15), 16, 10).cast("long") for name, start in LANES.items()}
    mask = F.lit((1 << PART_BITS) - 1).cast("long")
    parts = {
        _part(name, shift): F.shiftright(f"_{name}", shift).bitwiseAND(mask)
        for name in LANES for shift in range(0, LANE_BITS, PART_BITS)
    }
    return frame.withColumn("_digest", digest).withColumns(lanes).withColumns(parts).drop("_digest", *lanes)


def content_fingerprint(frame, columns=None):
    """Row count and content hash of a table, independent of row order; one row.

    Two 60-bit lanes of each row's hash are summed, so any split into tasks gives the same
    result and a repeated row changes it.
    """
    sums = with_lanes(frame, columns).agg(*fingerprint_parts())
    return sums.select(
        "row_count", F.sha2(F.concat_ws(":", "row_count", "low", "high"), 256).alias("content_hash")
    )


def _lane_sum(name):
    """Exact sum of a lane: its parts are summed as 64-bit numbers, which hold 2^43 rows."""
    total = F.lit(0).cast("decimal(38,0)")
    for shift in range(0, LANE_BITS, PART_BITS):
        part = F.coalesce(F.sum(_part(name, shift)), F.lit(0)).cast("decimal(20,0)")
        total = (total + part * F.lit(1 << shift).cast("decimal(14,0)")).cast("decimal(38,0)")
    return total.cast("string").alias(name)


def fingerprint_parts():
    """The aggregates over ``with_lanes`` a fingerprint is made of, which an Observation can take during a write."""
    return [F.count(F.lit(1)).alias("row_count"), *map(_lane_sum, LANES)]


def observed_fingerprint(parts):
    """(row count, content hash) from observed aggregates."""
    text = f"{parts['row_count']}:{parts['low']}:{parts['high']}"
    return parts["row_count"], hashlib.sha256(text.encode()).hexdigest()


def document_hash(document):
    """Hash of a small JSON document, whatever the order of its keys."""
    text = json.dumps(document, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()
