"""Feed tables as all-text DataFrames read from CSV files.

A file in which every line is a whole record is read as lines, in splits. A file with a line that is
none, which is one with a line break inside a quoted field or a broken one, is read whole by one task
and cut into records there. Which of the two a file is follows from one scan of its lines, which also
finds text that is not UTF-8 and counts the lines of every split, so that records get their numbers.
The fields of a record are read by Spark's CSV parser.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators.silver import GENERATED, OPTIONAL_TABLES, RECORD, RULES, TABLES, to_silver, union_all
from ..session import scratch_folder

# Columns each file must have, and names reserved for typed columns.
REQUIRED_COLUMNS = {
    "agency": ("agency_name", "agency_url", "agency_timezone"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes": ("route_id", "route_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "calendar": (
        "service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
        "start_date", "end_date",
    ),
    "calendar_dates": ("service_id", "date", "exception_type"),
}
SHAPE_COLUMNS = ("shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon")
RESERVED = {name for names in GENERATED.values() for name in names} | {RECORD}
ROUTE_NAMES = ("route_short_name", "route_long_name")
# A text no feed holds: an empty field stays an empty text and "NA" or "NULL" stay ids.
NO_NULL = "\x00\x00"

ISSUES = "code string, file string, detail string"


class FeedError(ValueError):
    """A file or table that cannot be accepted."""


# A quoted field may hold anything, its quotes doubled; any other field runs to the next comma and may
# not begin with a quote. Repeats are possessive, so long texts need no deep stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_PLAIN = r'[^",\n][^,\n]*+|'
_RECORD = rf"(?:{_QUOTED}|{_PLAIN})(?:,(?:{_QUOTED}|{_PLAIN}))*+"
WHOLE_LINE = rf"^{_RECORD}\r?\z"
RECORDS = rf"{_RECORD}(?:\r?\n|\r?\z)"
BLANK_RECORD = rf'^(?:"{parsing.BLANKS}*+"|{parsing.BLANKS}*+)(?:,(?:"{parsing.BLANKS}*+"|{parsing.BLANKS}*+))*+\z'
# A file that one task must read whole has at most so many bytes.
WHOLE_BYTES = 1 << 30

PARSER = {
    "mode": "FAILFAST", "quote": '"', "escape": '"', "nullValue": NO_NULL, "emptyValue": "", "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1",
}


def _reader(spark):
    return spark.read.options(encoding="UTF-8", **PARSER)


def _without_mark(text, at_start):
    return F.when(at_start, F.ltrim(text, F.lit("\ufeff"))).otherwise(text)


def read_lines(spark, path):
    """Every line with its file, split and place, and whether it is a whole record."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value",
    )
    plain = ~F.contains(F.col("value"), F.lit('"'))
    return lines.withColumn("complete", plain | _without_mark(F.col("value"), F.col("block") == 0).rlike(WHOLE_LINE))


def _stored(frame, name):
    """A small table that several steps start from, written once; its size is then known to the planner."""
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/{name}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _whole_files(spark, path, names):
    """(file, records) of the files named, each read by one task; a record keeps its line break."""
    text = _without_mark(F.col("value"), F.lit(True))
    files = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_path").isin(names))
    found = F.filter(F.regexp_extract_all(text, F.lit(RECORDS), 0), lambda record: record != "")
    return files.select(
        F.col("_metadata.file_path").alias("file"), found.alias("records"),
        (F.length(F.array_join(found, "")) == F.length(text)).alias("complete"),
    )


def read_records(spark, path, table):
    """(number, text) of the records of a file or folder, blank ones included, headers left out.

    Numbers count in the order of file names and lines. Text that is not UTF-8, a quoted field that
    is never closed and text after a closing quote are refused.
    """
    lines = read_lines(spark, path)
    splits = _stored(
        lines.groupBy("file", "size", "block").agg(
            F.min("place").alias("low"), F.count("*").alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("undecodable"),
            F.count_if(~F.col("complete")).alias("broken"),
        ), "splits",
    )
    if not splits.filter("undecodable > 0").isEmpty():
        raise FeedError(f"{table}: not valid UTF-8")
    sizes = {row.file: row.size for row in splits.filter("broken > 0").select("file", "size").distinct().collect()}
    if any(size > WHOLE_BYTES for size in sizes.values()):
        raise FeedError(f"{table}: a quoted line break or a broken quoted field in a file of more than {WHOLE_BYTES} bytes")
    names = sorted(sizes)
    counts = splits.filter(~F.col("file").isin(names)).groupBy("file").agg(F.sum("n").alias("n"))
    if names:
        whole = _stored(_whole_files(spark, path, names).select("file", "complete", F.size("records").cast("long").alias("n")), "whole")
        if not whole.filter("NOT complete").isEmpty():
            raise FeedError(f"{table}: a quoted field is not closed, or text follows its closing quote")
        counts = counts.unionByName(whole.select("file", "n"))
    # One row per file; records of a file come after those of all files before it.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.select("file", F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.filter(~F.col("file").isin(names)).withColumn("begun", F.coalesce(F.sum("n").over(within), F.lit(0)))
    known = _stored(known.join(files, "file").select("file", "block", "low", "begun", "earlier"), "known")
    number = F.col("place") - F.col("low") + F.col("begun")
    records = lines.join(known, ["file", "block"]).select("earlier", number.alias("at"), F.col("value").alias("text"))
    if names:
        cut = _whole_files(spark, path, names).join(files, "file").select("earlier", F.posexplode("records").alias("at", "text"))
        records = records.unionByName(cut.withColumn("at", F.col("at").cast("long")))
    line_break = F.regexp_replace("text", r"\r?\n?\z", "")
    return records.filter("at > 0").select((F.col("earlier") + F.col("at")).alias("number"), line_break.alias("text"))


def read_header(spark, path):
    """Column names of a file as they are written, repeated ones included."""
    first = _reader(spark).csv(path, header=False).first()
    names = [] if first is None else ["" if value is None else value for value in first]
    if names:
        names[0] = names[0].removeprefix("\ufeff")
    return names


def check_header(names, table):
    if not names or any(not name.strip() for name in names) or len(set(names)) != len(names):
        raise FeedError(f"{table}: empty or repeated column name")
    if RESERVED & set(names):
        raise FeedError(f"{table}: reserved column name")
    return names


def skip_blank_records(frame, columns):
    """Drop records whose fields are all blank."""
    return frame.filter(~parsing.is_blank(F.concat_ws("", *[F.col(f"`{c}`") for c in columns])))


def read_feed_csv(spark, path, table):
    """A feed file as text columns plus the record number; blank records keep their number and go.

    Short or long records fail the read.
    """
    names = check_header(read_header(spark, path), table)
    schema = ", ".join(f"`{name}` string" for name in names)
    records = read_records(spark, path, table).filter(~F.col("text").rlike(BLANK_RECORD))
    rows = records.select(F.from_csv("text", schema, PARSER).alias("r"), F.col("number").alias(RECORD))
    return rows.select(*[F.coalesce(F.col(f"r.`{n}`"), F.lit("")).alias(n) for n in names], RECORD)


def read_feed(spark, paths):
    """Raw tables of a feed from a dict table -> path; absent optional calendars get no rows.

    Returns the tables and, per table, whether its file was there.
    """
    present = {table: paths.get(table) is not None for table in (*TABLES, "frequencies")}
    tables = {}
    for table in TABLES:
        if present[table]:
            tables[table] = read_feed_csv(spark, paths[table], table)
        elif table in OPTIONAL_TABLES:
            tables[table] = empty_raw(spark, table)
        else:
            raise FeedError(f"missing {table}")
    if present["frequencies"]:
        tables["frequencies"] = read_feed_csv(spark, paths["frequencies"], "frequencies")
    return tables, present


def empty_raw(spark, table):
    """An absent optional table: the model columns as text and no rows."""
    text = ", ".join(f"`{name}` string" for name in RULES[table])
    return spark.createDataFrame([], f"{text}, {RECORD} bigint")


def structure_issues(files):
    """Issues of a feed from (file, names, has_rows), one row per file or part of one, in one plan.

    A table may come in several parts; its issues are those of any part, and it has rows if one has.
    """
    known = files.filter(F.col("file").isin(list(REQUIRED_COLUMNS)))
    required = F.create_map(*[
        part for table, names in REQUIRED_COLUMNS.items() for part in (F.lit(table), F.array(*[F.lit(n) for n in names]))
    ])
    absent = F.array_sort(F.array_except(required[F.col("file")], "names"))
    blank = F.exists("names", parsing.is_blank)
    route_names = F.array(*[F.lit(name) for name in ROUTE_NAMES])

    def issue(condition, code, file, detail=""):
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.when(condition, F.struct(F.lit(code).alias("code"), file.alias("file"), detail.alias("detail")))

    file = F.col("file")
    of_parts = known.select(F.explode(F.array(
        issue(blank, "empty_column", file),
        issue(F.size(F.array_distinct("names")) < F.size("names"), "duplicate_column", file),
        issue(F.size(absent) > 0, "missing_columns", file, F.array_join(absent, ",")),
        issue((file == "routes") & ~F.arrays_overlap("names", route_names), "missing_route_name", file),
    )).alias("issue")).filter("issue IS NOT NULL").distinct()
    tables = known.groupBy("file").agg(F.max("has_rows").alias("has_rows"))
    of_tables = tables.select(
        issue(~F.col("has_rows") & ~file.isin(list(OPTIONAL_TABLES)), "empty_table", file).alias("issue")
    )
    needed = F.array(*[F.lit(t) for t in REQUIRED_COLUMNS if t not in OPTIONAL_TABLES])
    optional = file.isin(list(OPTIONAL_TABLES))
    none = F.lit(None).cast("string")
    of_feed = tables.agg(
        F.collect_set("file").alias("present"), F.count_if(optional).alias("calendars"),
        F.count_if(optional & F.col("has_rows")).alias("filled"),
    ).select(F.explode(F.concat(
        F.transform(F.array_except(needed, "present"), lambda t: issue(F.lit(True), "missing_file", t)),
        F.array(
            issue(F.col("calendars") == 0, "missing_calendar", none),
            issue((F.col("calendars") > 0) & (F.col("filled") == 0), "empty_calendar", none),
        ),
    )).alias("issue"))
    return union_all([of_parts, of_tables, of_feed]).filter("issue IS NOT NULL").select("issue.*")


def _header_names(header):
    """Column names of the first line of a file; none for an empty line."""
    fields = F.regexp_extract_all(header, F.lit(rf"(?:^|,)({_QUOTED}|[^,]*)"), 1)
    names = F.transform(fields, lambda f: F.when(
        f.startswith('"') & f.endswith('"') & (F.length(f) > 1),
        F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(f))
    return F.when(header == "", F.array().cast("array<string>")).otherwise(names)


def feed_structure_check(spark, path):
    """Issues of the files of a folder, ``<table>.txt`` each, or folders of that name with the parts of one.

    One scan counts the lines of every file with anything in them and finds the place of the first, a
    second one reads that line. A record that is blank over several lines counts as a row.
    """
    text = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(path)
    named = lambda name: F.regexp_replace(name, "^([a-z0-9]+):/+", "$1:/").alias("path")
    listed = spark.createDataFrame([(name,) for name in text.inputFiles()], "name string").select(
        named(F.col("name")), F.regexp_extract("name", r"/([^/]+)\.txt(?:/[^/]*)?$", 1).alias("file")
    )  # empty files have no lines
    lines = text.select(
        named(F.col("_metadata.file_path")), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", r"\r\z", "").alias("line"),
    )
    found = lines.groupBy("path").agg(
        F.min(F.when(F.col("block") == 0, F.col("place"))).alias("place"),
        F.count_if(~F.col("line").rlike(BLANK_RECORD)).alias("filled"),
    )  # numbers only, so that no task sorts its lines
    headers = lines.filter("block = 0").join(F.broadcast(found.select("place")), "place", "left_semi").select(
        "path", _without_mark(F.col("line"), F.lit(True)).alias("header")
    )
    headed = found.drop("place").join(headers, "path", "left")
    header = F.coalesce("header", F.lit(""))
    has_rows = F.coalesce("filled", F.lit(0)) > F.when(header.rlike(BLANK_RECORD), 0).otherwise(1)
    return structure_issues(
        listed.join(headed, "path", "left").select("file", _header_names(header).alias("names"), has_rows.alias("has_rows"))
    )


def table_structure_check(tables):
    """The same checks for raw tables that are DataFrames already."""
    rows = []
    for name, frame in tables.items():
        columns = [c for c in frame.columns if c != RECORD]
        filled = skip_blank_records(frame, columns).agg((F.count("*") > 0).alias("has_rows"))
        names = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
        rows.append(filled.select(F.lit(name).alias("file"), names.alias("names"), "has_rows"))
    return structure_issues(union_all(rows))


def tables_present(tables, present):
    """One row per table of a feed: whether its file was there, rows, and the typed columns of an absent one.

    An absent calendar counts as a typed table without rows.
    """
    agency = tables["agency"]
    rows = []
    for name in TABLES:
        typed = to_silver(name, tables[name], agency)
        absent = not present[name]
        if absent and name not in OPTIONAL_TABLES:
            raise FeedError(f"missing {name}")
        kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in typed.schema) if absent else None
        rows.append(typed.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(not absent).alias("source_present"),
            F.lit(absent).alias("normalized_empty"), "row_count", F.lit(kinds).cast("string").alias("absent_columns"),
        ))
    return union_all(rows)


def frequencies_capability(frequencies):
    """Number of frequency templates; KPI tables are supported only without any. One row."""
    return frequencies.agg(F.count("*").alias("row_count")).withColumn(
        "quantitative_gold_supported", F.col("row_count") == 0
    )


def feed_capabilities(tables, present, frequencies=None, other_files=()):
    """What of a feed is processed and what is only kept; one row."""
    spark = tables["trips"].sparkSession
    if frequencies is None:
        frequencies = spark.createDataFrame([], "trip_id string")
    extras = {
        table: [c for c in tables[table].columns if c != RECORD and c not in RULES[table]]
        for table in TABLES
    }
    return frequencies_capability(frequencies).select(
        F.struct(
            F.lit(bool(present.get("frequencies"))).alias("present"),
            F.col("row_count"),
            F.lit("textual_bronze_only").alias("handling"),
        ).alias("frequencies"),
        "quantitative_gold_supported",
        F.lit(False).alias("flexible_service_supported"),
        F.array(*[F.lit(name) for name in other_files]).cast("array<string>").alias(
            "unprocessed_files"
        ),
        F.struct(
            *[F.lit(bool(present.get(t))).alias(t) for t in OPTIONAL_TABLES]
        ).alias("calendar_sources"),
        F.struct(
            *[
                F.array(*[F.lit(c) for c in names]).cast("array<string>").alias(table)
                for table, names in extras.items()
            ]
        ).alias("untyped_extra_columns"),
        F.lit("base_codes_only; other codes retained").alias("route_type_descriptions"),
    )


def typed_shapes(raw):
    """Shape points as typed columns with ``valid``, which says whether a row can be used."""
    missing = sorted(set(SHAPE_COLUMNS) - set(raw.columns))
    if missing:
        raise FeedError(f"shapes: missing columns {missing}")
    points = raw.select(
        "shape_id",
        parsing.parse_whole_number(F.col("shape_pt_sequence")).alias("shape_pt_sequence"),
        parsing.parse_number(F.col("shape_pt_lat")).alias("latitude"),
        parsing.parse_number(F.col("shape_pt_lon")).alias("longitude"),
    )
    valid = (
        (F.col("shape_id") != "")
        & (F.col("shape_pt_sequence") >= 0)
        & F.col("latitude").between(-parsing.MAX_LATITUDE, parsing.MAX_LATITUDE)
        & F.col("longitude").between(-parsing.MAX_LONGITUDE, parsing.MAX_LONGITUDE)
    )
    return points.withColumn("valid", F.coalesce(valid, F.lit(False)))


def read_shapes(spark, path):
    """Shape points of a file; any invalid row rejects the file."""
    points = typed_shapes(read_feed_csv(spark, path, "shapes"))
    if not points.filter(~F.col("valid")).isEmpty():
        raise FeedError("shapes: invalid id, sequence or coordinates")
    return points.drop("valid")


