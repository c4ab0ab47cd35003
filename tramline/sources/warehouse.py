"""Writing feeds and analyses: tables in a folder of the run, one marker per commit.

Plain files have no transaction over several tables. Tables are written to a folder of the run, and
become the published ones with a small marker that names the run; a run that fails leaves what was
published before as it was. The marker of an identity is created only where none is: of two runs that
load or analyse the same at the same time, one publishes and the other finds what that one published.
"""

import json
import time
import uuid
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import (
    METRICS_VERSION,
    MODEL_VERSION,
    analysis_id,
    content_fingerprint,
    dataset_id,
    document_hash,
    fingerprint_parts,
    observed_fingerprint,
    with_lanes,
)
from ..operators import quality, silver
from ..operators.events import estimate_guard
from ..operators.gold import coverage_summary, source_context
from ..operators.service_calendar import calendar_envelope, services_catalog
from ..feed import Feed
from ..plans.analysis import OUTPUTS, Analysis
from ..session import scratch_folder
from .feed_csv import feed_capabilities, read_shapes


class Rejected(ValueError):
    """A dataset or analysis that must not be published."""


class QualityFailed(Rejected):
    """A feed with errors; ``checks`` and ``examples`` hold its small report."""

    def __init__(self, report):
        super().__init__(f"{report['error_count']} quality errors")
        self.report = report


def write_parquet(frame, path):
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(frame, path, form=lambda table: table):
    """Write a table as zstd Parquet; count and fingerprint are taken of the rows as they are written.

    ``form`` shapes what is written; the entry describes the table as it was given.
    """
    seen = Observation()
    rows = with_lanes(frame).observe(seen, *fingerprint_parts()).select(*[F.col(f"`{n}`") for n in frame.columns])
    write_parquet(form(rows), path)
    row_count, content_hash = observed_fingerprint(seen.get)
    return {
        "row_count": row_count,
        "content_hash": content_hash,
        "columns": _columns(frame),
    }


def write_document(spark, path, document):
    """Write a small JSON document as one text row."""
    text = json.dumps(document, ensure_ascii=False, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark, path):
    """A document written by ``write_document`` or ``publish_once``, or None if there is none yet."""
    try:
        rows = spark.read.text(path, wholetext=True).filter("value <> ''").limit(1).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return json.loads(rows[0].value) if rows else None


def _file_system(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish_once(spark, path, document):
    """Write a small JSON document unless there is one; of several writers one gets True."""
    files, target = _file_system(spark, path)
    text = json.dumps(document, ensure_ascii=False, default=str, sort_keys=True)
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.toString():
            raise
        return False
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def published_document(spark, path, seconds=30):
    """The document another writer has just created; waits while it is being written."""
    for _ in range(2 * seconds):
        document = read_document(spark, path)
        if document is not None:
            return document
        time.sleep(0.5)
    raise Rejected(f"{path} was begun and never finished: remove it")


def replace_document(spark, path, document):
    """Put a new document in the place of a published one by a rename; readers see either."""
    jvm = spark._jvm
    files, target = _file_system(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}"
    publish_once(spark, fresh, document)
    renames = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(renames, 1)
    options[0] = renames.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(jvm.org.apache.hadoop.fs.Path(fresh)), files.makeQualified(target), options)


def discard(spark, paths):
    """Remove folders this run has written and will not publish."""
    for name in paths:
        files, path = _file_system(spark, name)
        files.delete(path, True)


def write_bronze(tables, folder):
    """Write raw text tables; returns the manifest of the tables written."""
    return {name: write_table(frame, f"{folder}/{name}") for name, frame in tables.items()}


def manifest_rows(spark, tables):
    """The manifest of written tables as a relation: counts, columns and hashes taken by the writes."""
    rows = [
        (name, table["row_count"], ",".join(f"{column}:{kind}" for column, kind in table["columns"]), table["content_hash"])
        for name, table in tables.items()
    ]
    return spark.createDataFrame(rows, "table_name string, row_count bigint, columns string, content_hash string")


def quality_report(raw, frequencies=None, typed=None, present=None, row_counts=None):
    """The bounded report of a feed as one small document.

    The findings are written to the scratch folder once; counts and examples are read from there.
    """
    spark = raw["trips"].sparkSession
    typed = typed or silver.silver_tables({name: raw[name] for name in silver.TABLES})
    path = f"{scratch_folder(spark)}/findings"
    write_parquet(quality.all_findings(raw, frequencies, typed), path)
    found = spark.read.parquet(path)
    capabilities = feed_capabilities(raw, present or dict.fromkeys(silver.TABLES, True), frequencies)
    if row_counts is None:
        row_counts = {name: frame.count() for name, frame in typed.items()}
    checks = quality.summarize(found).orderBy(*quality.CHECK_KEYS).collect()
    totals = {"error": 0, "warning": 0}
    for row in checks:
        totals[row.severity] += row.findings
    return {
        "status": "failed" if totals["error"] else "passed",
        "error_count": totals["error"],
        "warning_count": totals["warning"],
        "checks": [row.asDict() for row in checks],
        "examples": [row.asDict() for row in quality.examples(found).collect()] if checks else [],
        "example_limit": quality.EXAMPLES_TOTAL,
        "time_coverage": quality.time_coverage(typed["stop_times"]).first().asDict(),
        "service_date_range": quality.service_date_range(typed).first().asDict(),
        "unknown_directions": quality.unknown_directions(typed["trips"]).first()[0],
        "capabilities": capabilities.first().asDict(recursive=True),
        "row_counts": row_counts,
    }


def silver_gate(raw, folder, source_sha256, frequencies=None, present=None, data_kind="unknown"):
    """Write typed tables to a folder of this run, check them, and publish them only without errors.

    Typing runs once; the checks across rows read the written columns they need. A feed with errors
    gets no manifest, so what the folder published before stays; the report of the last run is
    written either way. ``raw`` should come from bronze files, since it is read twice.
    """
    spark = raw["trips"].sparkSession
    run = f"runs/{uuid.uuid4().hex}"
    typed = silver.silver_tables({name: raw[name] for name in silver.TABLES})
    written = {name: write_table(frame, f"{folder}/{run}/{name}") for name, frame in typed.items()}
    row_counts = {name: table["row_count"] for name, table in written.items()}
    report = quality_report(raw, frequencies, _typed_tables(spark, f"{folder}/{run}"), present, row_counts)
    for place in (f"{folder}/{run}/quality", f"{folder}/quality"):
        write_document(spark, place, report)
    if report["error_count"]:
        raise QualityFailed(report)
    manifest = {
        "dataset_id": dataset_id(source_sha256),
        "source_sha256": source_sha256,
        "model_version": MODEL_VERSION,
        "status": "passed",
        "run": run,
        "data_kind": data_kind,
        "warning_count": report["warning_count"],
        "time_coverage": report["time_coverage"],
        "capabilities": report["capabilities"],
        "tables": written,
    }
    replace_document(spark, f"{folder}/manifest", manifest)
    return manifest


def _typed_tables(spark, folder):
    return {name: spark.read.parquet(f"{folder}/{name}") for name in silver.TABLES}


def _table_or_none(spark, path):
    files, target = _file_system(spark, path)
    return spark.read.parquet(path) if files.exists(target) else None


def published(spark, folder):
    """The manifest of a folder's published tables."""
    manifest = read_document(spark, f"{folder}/manifest")
    if manifest is None or manifest["status"] != "passed":
        raise Rejected(f"{folder} holds no published tables")
    return manifest


def read_silver(spark, folder):
    """Typed tables a folder has published."""
    return _typed_tables(spark, f"{folder}/{published(spark, folder)['run']}")


def verify_table(frame, declared):
    """Compare a table with its manifest entry; one row with a flag per property, all false without a table."""
    if frame is None:
        names = ("schema_matches", "count_matches", "content_matches")
        return SparkSession.active().range(1).select(*[F.lit(False).alias(name) for name in names])
    return content_fingerprint(frame).select(
        F.lit(_has_schema(frame, declared)).alias("schema_matches"),
        (F.col("row_count") == declared["row_count"]).alias("count_matches"),
        (F.col("content_hash") == declared["content_hash"]).alias("content_matches"),
    )


def reported(spark, folder):
    """The manifest of a folder's published tables, whose quality report belongs to it."""
    manifest = published(spark, folder)
    report = read_document(spark, f"{folder}/{manifest['run']}/quality")
    warnings = sum(c["findings"] for c in report["checks"] if c["severity"] == "warning")
    if report["status"] != "passed" or warnings != manifest["warning_count"]:
        raise Rejected(f"{folder}: the quality report does not belong to the manifest")
    return manifest


def verify_silver(spark, folder):
    """Check a published folder against its manifest and report; one row per table."""
    manifest = reported(spark, folder)
    run = f"{folder}/{manifest['run']}"
    return silver.union_all(
        verify_table(_table_or_none(spark, f"{run}/{name}"), declared).withColumn("table_name", F.lit(name))
        for name, declared in manifest["tables"].items()
    )


def logical_fingerprint(manifest):
    """One hash for the schemas and contents of all tables of a manifest."""
    return document_hash(
        {n: [t["columns"], t["row_count"], t["content_hash"]] for n, t in manifest["tables"].items()}
    )


def load_silver(spark, folder, warehouse):
    """Add a published dataset to the warehouse once.

    Returns LOADED or ALREADY_LOADED; the same identity with other content is a conflict. Tables are
    held against their manifest as they are written; those that differ are removed and nothing is published.
    """
    manifest = reported(spark, folder)
    identity = manifest["dataset_id"]
    entry = {
        "dataset_id": identity,
        "source_sha256": manifest["source_sha256"],
        "model_version": manifest["model_version"],
        "fingerprint": logical_fingerprint(manifest),
        "status": "complete",
        "data_kind": manifest["data_kind"],
        "capabilities": manifest["capabilities"],
        "time_coverage": manifest["time_coverage"],
        "row_counts": {name: table["row_count"] for name, table in manifest["tables"].items()},
    }
    marker = f"{warehouse}/meta/datasets/dataset_id={identity}"
    existing = read_document(spark, marker)
    tables = {name: _table_or_none(spark, f"{folder}/{manifest['run']}/{name}") for name in manifest["tables"]}
    if existing is not None or not all(map(_has_schema, tables.values(), manifest["tables"].values())):
        _refuse_changes(spark, folder)
        return _already_loaded(existing, entry)
    entry["run"] = f"runs/{uuid.uuid4().hex}"
    paths = [f"{warehouse}/silver/{name}/dataset_id={identity}/{entry['run']}" for name in (*tables, "services")]
    wrong = []
    for path, (name, frame) in zip(paths, tables.items(), strict=False):
        if write_table(frame, path, partial(silver.with_extra_fields, name)) != manifest["tables"][name]:
            wrong.append(name)
    if wrong:
        discard(spark, paths)
        raise Rejected(f"tables differ from their manifest: {wrong}")
    write_parquet(services_catalog(tables["calendar"], tables["calendar_dates"]), paths[-1])
    if not publish_once(spark, marker, entry):
        discard(spark, paths)
        return _already_loaded(published_document(spark, marker), entry)
    return "LOADED", entry


def _columns(frame):
    return [[field.name, field.dataType.simpleString()] for field in frame.schema]


def _has_schema(frame, declared):
    return frame is not None and _columns(frame) == [list(pair) for pair in declared["columns"]]


def _refuse_changes(spark, folder):
    """Refuse a folder with tables that differ from their manifest."""
    bad = verify_silver(spark, folder).filter(
        ~(F.col("schema_matches") & F.col("count_matches") & F.col("content_matches"))
    )
    wrong = [row.table_name for row in bad.collect()]
    if wrong:
        raise Rejected(f"tables differ from their manifest: {wrong}")


def _already_loaded(existing, entry):
    if any(existing[key] != entry[key] for key in ("source_sha256", "model_version", "fingerprint", "status")):
        raise Rejected("CONFLICT: the dataset is loaded with other content")
    return "ALREADY_LOADED", existing


def loaded_feed(spark, warehouse, identity):
    """The feed of a loaded dataset; only its own run is read."""
    entry = read_document(spark, f"{warehouse}/meta/datasets/dataset_id={identity}")
    if entry is None:
        raise Rejected("DATASET_NOT_FOUND")
    tables = {
        name: spark.read.parquet(f"{warehouse}/silver/{name}/dataset_id={identity}/{entry['run']}")
        for name in silver.TABLES
    }
    geometry = read_document(spark, f"{warehouse}/meta/geometry/dataset_id={identity}")
    if geometry and geometry["status"] == "complete":
        tables["shapes"] = spark.read.parquet(f"{warehouse}/shapes/dataset_id={identity}/{geometry['run']}")
    return Feed(**tables)


def write_gold(analysis, folder, name):
    """Write the eight KPI tables of an analysis; returns their row counts."""
    counts = {}
    for output, frame in analysis.tables().items():
        seen = Observation()
        frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option(
            "compression", "zstd"
        ).parquet(f"{folder}/{output}/analysis_id={name}")
        counts[output] = seen.get["rows"]
    return counts


def gold_tables(spark, folder, name):
    return {o: spark.read.parquet(f"{folder}/{o}/analysis_id={name}") for o in OUTPUTS}


def publish_gold(spark, warehouse, identity, start, end, scratch, replace=False, **limits):
    """Compute and publish all KPI tables of a loaded dataset over a range.

    ``scratch`` is a shared folder for the departure profile the group tables start from. The tables
    are written to a folder of the run, and one marker publishes all of them. Returns ANALYZED or
    ALREADY_ANALYZED with the published marker; with ``replace`` a published analysis is computed
    anew, and read as it was until the new marker takes the place of the old one.
    """
    dataset = read_document(spark, f"{warehouse}/meta/datasets/dataset_id={identity}")
    if dataset is None:
        raise Rejected("DATASET_NOT_FOUND")
    if not dataset["capabilities"]["quantitative_gold_supported"]:
        raise Rejected("UNSUPPORTED_FREQUENCIES: frequency templates are not expanded")
    feed = loaded_feed(spark, warehouse, identity)
    analysis = Analysis(feed, start, end)
    name = analysis_id(identity, analysis.start, analysis.end)
    marker = f"{warehouse}/meta/analyses/analysis_id={name}"
    existing = read_document(spark, marker)
    if existing is not None and not replace:
        return _already_analyzed(existing, dataset)
    estimate_guard(feed, analysis.start, analysis.end, **limits)
    run = uuid.uuid4().hex
    folder = f"{warehouse}/gold/runs/{run}"
    counts = write_gold(analysis.share_profile(f"{scratch}/{name}-{run}"), folder, name)
    envelope = calendar_envelope(feed.calendar, feed.calendar_dates)
    coverage = gold_tables(spark, folder, name)["coverage_daily"].withColumns(
        {bound: envelope.select(bound).scalar() for bound in ("source_start", "source_end")}
    )
    context = source_context(
        feed,
        json.dumps(dataset["capabilities"]),
        "static table types, keys, relations and known service times",
        json.dumps(dataset["time_coverage"]),
    )
    entry = {
        "analysis_id": name,
        "dataset_id": identity,
        "metrics_version": METRICS_VERSION,
        "start_date": analysis.start.isoformat(),
        "end_date": analysis.end.isoformat(),
        "input_fingerprint": dataset["fingerprint"],
        "status": "complete",
        "run": run,
        "row_counts": counts,
        "coverage": json.loads(coverage_summary(coverage).first()[0]),
        "source_context": context.first().asDict(),
    }
    if replace and existing is not None:
        replace_document(spark, marker, entry)
    elif not publish_once(spark, marker, entry):
        discard(spark, [folder])
        return _already_analyzed(published_document(spark, marker), dataset)
    return "ANALYZED", entry


def _already_analyzed(existing, dataset):
    if existing["input_fingerprint"] != dataset["fingerprint"]:
        raise Rejected("CONFLICT: the analysis was made from other content")
    return "ALREADY_ANALYZED", existing


def read_gold(spark, warehouse, name):
    """KPI tables of a published analysis and its marker."""
    entry = read_document(spark, f"{warehouse}/meta/analyses/analysis_id={name}")
    if entry is None:
        raise Rejected("the analysis is not published")
    return gold_tables(spark, f"{warehouse}/gold/runs/{entry['run']}", name), entry


def import_geometry(spark, warehouse, identity, source_sha256, path=None):
    """Add the shapes of a loaded dataset once, from exactly its snapshot."""
    dataset = read_document(spark, f"{warehouse}/meta/datasets/dataset_id={identity}")
    if dataset is None or dataset["source_sha256"] != source_sha256:
        raise Rejected("load the typed tables of exactly this snapshot first")
    marker = f"{warehouse}/meta/geometry/dataset_id={identity}"
    existing = read_document(spark, marker)
    if existing is not None:
        return _already_imported(existing, source_sha256)
    run = f"runs/{uuid.uuid4().hex}"
    folder = f"{warehouse}/shapes/dataset_id={identity}/{run}"
    points = 0
    if path is not None:
        written = write_table(read_shapes(spark, path).withColumn("source_sha256", F.lit(source_sha256)), folder)
        points = written["row_count"]
    entry = {
        "dataset_id": identity,
        "source_sha256": source_sha256,
        "status": "absent" if path is None else "complete",
        "run": run,
        "point_count": points,
    }
    if not publish_once(spark, marker, entry):
        discard(spark, [folder])
        return _already_imported(published_document(spark, marker), source_sha256)
    return "IMPORTED", entry


def _already_imported(existing, source_sha256):
    if existing["source_sha256"] != source_sha256:
        raise Rejected("CONFLICT: geometry was imported from another snapshot")
    return "ALREADY_IMPORTED", existing


def dataset_metadata(feed, identity, entry=None):
    """Calendar bounds of a dataset with its registry fields; one row."""
    bounds = quality.service_date_range(
        {"calendar": feed.calendar, "calendar_dates": feed.calendar_dates}
    )
    known = entry or {}
    return bounds.select(
        F.lit(identity).alias("dataset_id"),
        *[F.lit(known.get(key)).cast("string").alias(key) for key in ("data_kind", "source_sha256")],
        "start_date",
        "end_date",
    )
