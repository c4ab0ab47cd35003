"""Vehicle observations from a JSON export and its metadata document."""

from pyspark.sql import functions as F

# Field names of the export and its metadata, and the confirmed licence.
RECORDS = "dane"
FIELDS = {
    "vehicle_id": "Nr_Boczny",
    "line": "Nazwa_Linii",
    "latitude": "Ostatnia_Pozycja_Szerokosc",
    "longitude": "Ostatnia_Pozycja_Dlugosc",
    "measured_at": "Data_Aktualizacji",
}
TITLE = "tytul"
LICENCE = "licencja"
CONFIRMED_LICENCE = "CC0 1.0"

RECORD_SCHEMA = ", ".join(f"`{field}` string" for field in FIELDS.values())


def read_positions(spark, path):
    """One row per record: its 0-based place and its fields as text.

    A record that is no JSON object keeps its place with all fields NULL and no coordinates,
    so it is counted as received and skipped; ``is_object`` tells it apart. An export is one
    document; a history in one line per record is read by ``read_position_lines``, in splits.
    """
    export = spark.read.schema(f"{RECORDS} array<string>").json(path, multiLine=True)
    records = export.select(F.posexplode(RECORDS).alias("place", "text"))
    return _records(records.select(F.col("place").cast("string").alias("observation_id"), "text"))


def read_position_lines(spark, path):
    """The same rows from files with one record per line; ids are unique but not consecutive."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return _records(
        lines.select(F.monotonically_increasing_id().cast("string").alias("observation_id"), F.col("value").alias("text"))
    )


def _records(records, *about):
    kind = F.schema_of_variant(F.try_parse_json("text"))
    return records.withColumn("record", F.from_json("text", RECORD_SCHEMA)).select(
        *(about or ("observation_id",)),
        *[F.col(f"record.`{field}`").alias(name) for name, field in FIELDS.items()],
        F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"),
    )


def read_position_documents(spark, export_path, metadata_path, multi_line=True):
    """One row per record of every export document, with what its metadata say.

    Exports hold their records and a title; metadata documents hold a title and a licence. An export
    is consistent when there are metadata with its title, and its terms are confirmed when all of
    those name the confirmed licence. An export without a list of records is unavailable and gives
    one row without a place. ``multi_line`` false reads one document per line, in splits.
    """
    exports = spark.read.schema(f"{RECORDS} array<string>, meta struct<{TITLE}: string>").json(export_path, multiLine=multi_line)
    metadata = spark.read.schema(f"{TITLE} string, {LICENCE} string").json(metadata_path, multiLine=multi_line)
    confirmed = F.coalesce(F.col(LICENCE) == CONFIRMED_LICENCE, F.lit(False))
    terms = metadata.groupBy(F.col(TITLE).alias("known")).agg(F.bool_and(confirmed).alias("confirmed"))
    documents = exports.select(F.col(f"meta.{TITLE}").alias("title"), F.col(RECORDS).alias("records"))
    described = documents.join(terms, F.col("title").eqNullSafe(F.col("known")), "left")
    status = F.when(F.col("records").isNull(), "unavailable").otherwise("available")
    available = F.col("records").isNotNull() & F.col("confirmed").isNotNull()
    records = described.select(
        "title", status.alias("status"), available.alias("metadata_consistent"),
        (available & F.coalesce("confirmed", F.lit(False))).alias("terms_confirmed"),
        F.posexplode_outer("records").alias("place", "text"),
    )
    return _records(records, "title", "place", "status", "metadata_consistent", "terms_confirmed")


def source_terms(spark, export_path, metadata_path):
    """Whether export and metadata agree and the licence is the confirmed one; one row."""
    titles = spark.read.schema(f"meta struct<{TITLE}: string>").json(export_path, multiLine=True)
    metadata = spark.read.schema(f"{TITLE} string, {LICENCE} string").json(
        metadata_path, multiLine=True
    )
    title = metadata.select(TITLE).scalar()
    licence = metadata.select(LICENCE).scalar()
    return titles.select(
        F.col(f"meta.{TITLE}").eqNullSafe(title).alias("metadata_consistent")
    ).withColumn(
        "terms_confirmed",
        F.col("metadata_consistent") & F.coalesce(licence == CONFIRMED_LICENCE, F.lit(False)),
    )
