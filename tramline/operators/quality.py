"""Data-quality checks of a raw feed.

Every check yields findings (severity, code, table_name, column_name, record, value,
occurrences). Row checks of a table share one scan. Checks across rows are written so that a
key shared by a large part of the rows costs one partial-aggregate row per task: keys are
counted before they are joined, and long trips are walked in blocks of the sequence axis.
"""

from functools import reduce
from operator import or_
from zoneinfo import available_timezones

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.labels import whole_div
from . import silver
from .explorer import BLOCK
from .service_calendar import calendar_envelope
from .silver import RECORD, RULES, union_all

# Usual size of a report's examples, unique keys, references and unsupported columns.
EXAMPLES_PER_CHECK = 5
EXAMPLES_TOTAL = 50
VALUE_LENGTH = 100
UNIQUE_KEYS = {
    "agency": ("_agency_key",),
    "stops": ("stop_id",),
    "routes": ("route_id",),
    "trips": ("trip_id",),
    "stop_times": ("trip_id", "stop_sequence"),
    "calendar": ("service_id",),
    "calendar_dates": ("service_id", "date"),
}
REFERENCES = (
    ("routes", "_agency_key", "agency", "_agency_key"),
    ("trips", "route_id", "routes", "route_id"),
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("stop_times", "stop_id", "stops", "stop_id"),
    ("stops", "parent_station", "stops", "stop_id"),
)
FLEXIBLE_COLUMNS = (
    "location_group_id",
    "location_id",
    "start_pickup_drop_off_window",
    "end_pickup_drop_off_window",
)
BOUNDARY_TYPES = (0, 1, 2)
CHECK_KEYS = ["severity", "code", "table_name", "column_name"]


def zone_exists(name):
    """Whether a text is the name of a zone in the IANA list (about 600 names)."""
    return name.isin(*sorted(available_timezones()))


def row_checks(table, raw, agency=None):
    """(code, column, bad) for every check that looks at a single raw row."""
    checks = []

    def add(code, column, bad):
        checks.append((code, column, bad))

    for name, rule in RULES[table].items():
        text = F.col(name)
        if rule.kind == "id":
            add("id_whitespace", name, parsing.has_outer_blank(text))
            if rule.required:
                add("required_id", name, text == "")
        elif rule.kind == "integer":
            # the checks of a table are one generated method, which has to stay small to be compiled
            known = text.rlike(rf"^0*({'|'.join(map(str, rule.choices))})\z") if rule.choices else silver.typed(rule).isNotNull()
            bad = (text != "") & ~known
            if rule.required:
                bad |= text == ""
            add("invalid_integer_or_enum", name, bad)
        elif rule.kind == "date":
            add("invalid_date", name, silver.typed(rule).isNull())
        elif rule.kind == "float":
            bound = parsing.MAX_LATITUDE if name == "stop_lat" else parsing.MAX_LONGITUDE
            inside = F.coalesce(silver.typed(rule).between(-bound, bound), F.lit(False))
            add("invalid_coordinate", name, (text != "") & ~inside)
        elif rule.required:
            add("required_text", name, parsing.is_blank(text))
    for name in silver.extra_columns(table, raw):
        if name.endswith("_id"):
            add("id_whitespace", name, parsing.has_outer_blank(F.col(name)))

    if table == "agency":
        add("invalid_timezone", "agency_timezone", ~zone_exists(F.col("agency_timezone")))
    elif table == "routes":
        if agency is not None:
            no_key = (F.col("agency_id") == "") & silver.only_agency_key(agency).isNull()
            add("ambiguous_agency", "agency_id", no_key)
        both_blank = parsing.is_blank(F.col("route_short_name")) & parsing.is_blank(
            F.col("route_long_name")
        )
        add("missing_route_name", "route_short_name", both_blank)
    elif table == "stops":
        place = silver.typed(RULES["stops"]["location_type"]).isin(*BOUNDARY_TYPES)
        needs = F.coalesce(place, F.lit(False))
        add("required_stop_name", "stop_name", needs & parsing.is_blank(F.col("stop_name")))
        for name in ("stop_lat", "stop_lon"):
            add("required_coordinate", name, needs & silver.typed(RULES["stops"][name]).isNull())
    elif table == "stop_times":
        for name in ("arrival_time", "departure_time"):
            unread = parsing.parse_seconds(F.col(name)).isNull()
            add("invalid_gtfs_time", name, (F.col(name) != "") & unread)
        for name in FLEXIBLE_COLUMNS:
            if name in raw.columns:
                add("unsupported_flexible_service", name, F.col(name) != "")
    return checks


def findings(frame, code, table, column, record=None, value=None, occurrences=None, severity="error"):
    """Shape a frame of offending rows or keys as findings."""
    return frame.select(
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        F.lit(table).alias("table_name"),
        F.lit(column).cast("string").alias("column_name"),
        (F.lit(None) if record is None else F.col(record)).cast("long").alias("record"),
        (F.lit(None) if value is None else F.col(value)).cast("string").alias("value"),
        (F.lit(1) if occurrences is None else F.col(occurrences)).cast("long").alias("occurrences"),
    )


def row_findings(table, raw, agency=None, codes=None):
    """Findings of all single-row checks of a table in one scan; ``codes`` picks some.

    Only rows with a finding get an array of marks to spread.
    """
    checks = [c for c in row_checks(table, raw, agency) if codes is None or c[0] in codes]
    if not checks:
        return None
    marks = [
        F.when(
            bad,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(column).alias("column_name"),
                F.col(column).alias("value"),
            ),
        )
        for code, column, bad in checks
    ]
    return (
        silver.conform_columns(table, raw)
        .filter(reduce(or_, (bad for _, _, bad in checks)))
        .select(F.col(RECORD).alias("record"), F.explode(F.array(*marks)).alias("f"))
        .filter(F.col("f").isNotNull())
        .select(
            F.lit("error").alias("severity"),
            "f.code",
            F.lit(table).alias("table_name"),
            "f.column_name",
            "record",
            "f.value",
            F.lit(1).cast("long").alias("occurrences"),
        )
    )


def duplicate_keys(tables, names=tuple(UNIQUE_KEYS)):
    """Keys that occur more than once; each key is one finding."""
    found = []
    for name in names:
        keys = UNIQUE_KEYS[name]
        repeated = (
            tables[name]
            .dropna(subset=list(keys))
            .groupBy(*keys)
            .agg(F.count("*").alias("rows"), F.min(RECORD).alias("record"))
            .filter(F.col("rows") > 1)
        )
        found.append(findings(repeated, "duplicate_key", name, ",".join(keys), "record", keys[0]))
    return union_all(found)


def counted_keys(frame, column):
    """Rows and first record per non-NULL key."""
    return (
        frame.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count("*").alias("rows"), F.min(RECORD).alias("record"))
    )


def orphan_references(tables, references=REFERENCES):
    """Keys without a row in the table they refer to, with the number of rows that use them."""
    found = []
    for table, column, target, key in references:
        missing = counted_keys(tables[table], column).join(
            tables[target].select(F.col(key).alias("key")).distinct(), "key", "left_anti"
        )
        found.append(
            findings(missing, "orphan_reference", table, column, "record", "key", "rows")
        )
    return union_all(found)


def unknown_services(tables):
    known = (
        tables["calendar"].select(F.col("service_id").alias("key"))
        .union(tables["calendar_dates"].select("service_id"))
        .distinct()
    )
    missing = counted_keys(tables["trips"], "service_id").join(known, "key", "left_anti")
    return findings(missing, "unknown_service", "trips", "service_id", "record", "key", "rows")


def calendar_ranges(tables):
    wrong = tables["calendar"].filter(F.col("start_date") > F.col("end_date"))
    return findings(wrong, "calendar_range", "calendar", "start_date,end_date", RECORD, "service_id")


def required_parents(tables):
    wrong = tables["stops"].filter(
        F.col("location_type").isin(2, 3, 4) & F.col("parent_station").isNull()
    )
    return findings(wrong, "required_parent", "stops", "parent_station", RECORD, "stop_id")


def invalid_parent_types(tables):
    """Parents of the wrong kind, found between counted children and counted parents."""
    stops = tables["stops"]
    children = stops.groupBy(F.col("parent_station").alias("key"), "location_type").agg(
        F.count("*").alias("rows"), F.min(F.struct(RECORD, "stop_id")).alias("first")
    )
    parents = stops.filter(F.col("stop_id").isNotNull()).groupBy(F.col("stop_id").alias("key")).agg(
        F.count("*").alias("all"),
        F.count_if(F.col("location_type") != 1).alias("not_station"),
        F.count_if(F.col("location_type") != 0).alias("not_platform"),
    )
    kind = F.col("location_type")
    times = (
        F.when((kind == 1) & F.col("key").isNotNull(), F.coalesce("all", F.lit(1)))
        .when(kind.isin(0, 2, 3), F.col("not_station"))
        .when(kind == 4, F.col("not_platform"))
    )
    wrong = (
        children.join(parents, "key", "left")
        .withColumn("times", F.col("rows") * times)
        .filter(F.col("times") > 0)
        .select("first.*", "times")
    )
    return findings(
        wrong, "invalid_parent_type", "stops", "parent_station", RECORD, "stop_id", "times"
    )


def invalid_event_locations(tables):
    """Visits at stops that are not platforms."""
    places = tables["stops"].filter(F.col("location_type") != 0).groupBy(
        F.col("stop_id").alias("key")
    ).agg(F.count("*").alias("places"))
    wrong = (
        counted_keys(tables["stop_times"], "stop_id")
        .join(places, "key")
        .withColumn("times", F.col("rows") * F.col("places"))
    )
    return findings(
        wrong, "invalid_event_location", "stop_times", "stop_id", "record", "key", "times"
    )


def missing_exact_times(tables):
    wrong = tables["stop_times"].filter(
        (F.col("timepoint") == 1)
        & (F.col("arrival_seconds").isNull() | F.col("departure_seconds").isNull())
    )
    return findings(
        wrong, "missing_exact_time", "stop_times", "arrival_time,departure_time", RECORD, "trip_id"
    )


def missing_endpoint_arrivals(tables):
    """Trips whose first or last sequence lacks an arrival, with the number of such rows."""
    known = tables["stop_times"].filter(F.col("trip_id").isNotNull() & F.col("stop_sequence").isNotNull())
    sequence = F.col("stop_sequence")
    missing = F.when(F.col("arrival_seconds").isNull(), sequence)
    ends = known.groupBy("trip_id").agg(
        F.min(sequence).alias("first"), F.max(sequence).alias("last"),
        F.min(missing).alias("first_missing"), F.max(missing).alias("last_missing"),
    )
    # few trips lack one: rows are counted at the ends that do
    lacking = [F.when(F.col(f"{end}_missing") == F.col(end), F.col(end)) for end in ("first", "last")]
    places = ends.select(
        "trip_id", F.explode(F.array_distinct(F.array_compact(F.array(*lacking)))).alias("stop_sequence")
    )
    wrong = (
        known.filter(F.col("arrival_seconds").isNull())
        .groupBy("trip_id", "stop_sequence")
        .agg(F.count("*").alias("rows"), F.min(RECORD).alias("record"))
        .join(places, ["trip_id", "stop_sequence"])
        .groupBy("trip_id")
        .agg(F.sum("rows").alias("rows"), F.min("record").alias("record"))
    )
    return findings(
        wrong, "missing_endpoint_arrival", "stop_times", "arrival_time", "record", "trip_id", "rows"
    )


def _step(edge, low, block_end, record):
    return F.struct(
        F.lit(edge).alias("edge"), low.alias("low"), block_end.alias("block_end"), record.alias("record")
    )


def time_decreases(tables):
    """Known times that run backwards along a trip.

    Times are ordered by sequence, arrival before departure, then by value, so only the step
    between neighbouring (sequence, arrival/departure) points can fall: the lowest time of a
    point against the highest of the point before. Neighbours are compared within blocks of
    the sequence axis, and the last point of a block with the first of the next one.
    """
    seconds = {"first": "arrival_seconds", "second": "departure_seconds"}
    known = tables["stop_times"].filter(
        F.col("stop_sequence").isNotNull() & F.coalesce(*seconds.values()).isNotNull()
    )
    visits = known.groupBy("trip_id", "stop_sequence").agg(
        *[
            part
            for point, name in seconds.items()
            for part in (
                F.min(name).alias(f"{point}_low"),
                F.max(name).alias(f"{point}_high"),
                F.min(F.when(F.col(name).isNotNull(), F.col(RECORD))).alias(f"{point}_record"),
            )
        ]
    )
    entry = F.when(F.col("first_low").isNotNull(), F.col("first_record")).otherwise(F.col("second_record"))
    steps = visits.select(
        "trip_id",
        whole_div(F.col("stop_sequence"), BLOCK).alias("block"),
        "stop_sequence",
        F.coalesce("first_low", "second_low").alias("low"),
        F.coalesce("second_high", "first_high").alias("high"),
        entry.alias("record"),
        (F.col("second_low") < F.col("first_high")).alias("falls_inside"),
        F.when(F.col("second_low") < F.col("first_high"), F.col("second_record")).alias("inside"),
    )
    along = Window.partitionBy("trip_id", "block").orderBy("stop_sequence")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = steps.select(
        "trip_id",
        "block",
        "low",
        "record",
        "falls_inside",
        "inside",
        F.lag("high").over(along).alias("before"),
        F.row_number().over(along).alias("place"),
        F.last("high").over(whole).alias("block_end"),
    )
    # falls within blocks, and the first point of each block, whose step is decided between blocks
    nothing = F.lit(None).cast("long")
    found = walked.select(
        "trip_id",
        "block",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("low") < F.col("before"), _step(False, nothing, nothing, F.col("record"))),
                    F.when(F.col("falls_inside"), _step(False, nothing, nothing, F.col("inside"))),
                    F.when(F.col("place") == 1, _step(True, F.col("low"), F.col("block_end"), F.col("record"))),
                )
            )
        ).alias("step"),
    ).select("trip_id", "block", "step.*")
    between = Window.partitionBy("edge", "trip_id", F.when(~F.col("edge"), F.col("block"))).orderBy("block")
    wrong = found.withColumn("before", F.lag("block_end").over(between)).filter(
        ~F.col("edge") | (F.col("low") < F.col("before"))
    )
    return findings(
        wrong, "time_decreases", "stop_times", "arrival_time,departure_time", "record", "trip_id"
    )


def agency_consistency(tables):
    """Several agencies need ids, and all agencies share one zone."""
    totals = tables["agency"].agg(
        F.count("*").alias("agencies"),
        F.count_if(F.col("agency_id").isNull()).alias("without_id"),
        F.count_distinct("agency_timezone").alias("zones"),
    )
    return findings(
        totals.filter((F.col("agencies") > 1) & (F.col("without_id") > 0)),
        "multi_agency_missing_id", "agency", "agency_id", occurrences="without_id",
    ).unionByName(
        findings(
            totals.filter(F.col("zones") > 1),
            "multiple_agency_timezones", "agency", "agency_timezone", occurrences="zones",
        )
    )


def unknown_times(tables):
    """Warnings: visits without a known departure or arrival."""
    totals = tables["stop_times"].agg(
        F.count_if(F.col("departure_seconds").isNull()).alias("departures"),
        F.count_if(F.col("arrival_seconds").isNull()).alias("arrivals"),
    )
    return union_all(
        findings(
            totals.filter(F.col(f"{part}s") > 0), f"unknown_{part}", "stop_times", f"{part}_time",
            occurrences=f"{part}s", severity="warning",
        )
        for part in ("departure", "arrival")
    )


def unsupported_frequencies(frequencies):
    """Warning: frequency templates are kept as text and not expanded."""
    total = frequencies.agg(F.count("*").alias("rows")).filter(F.col("rows") > 0)
    return findings(
        total, "unsupported_frequencies", "frequencies", None, occurrences="rows", severity="warning"
    )


GLOBAL_CHECKS = (
    duplicate_keys,
    orphan_references,
    unknown_services,
    calendar_ranges,
    required_parents,
    invalid_parent_types,
    invalid_event_locations,
    missing_exact_times,
    missing_endpoint_arrivals,
    time_decreases,
    agency_consistency,
    unknown_times,
)


def all_findings(raw, frequencies=None, typed=None):
    """Findings of every check on a feed given as a dict of raw tables.

    ``typed`` holds the typed tables where they are written already; each check then reads
    only the columns it needs.
    """
    tables = typed or silver.silver_tables(raw)
    found = [row_findings(table, raw[table], raw["agency"]) for table in RULES]
    found += [check(tables) for check in GLOBAL_CHECKS]
    if frequencies is not None:
        found.append(unsupported_frequencies(frequencies))
    return union_all(found)


def summarize(found):
    """Exact number of findings per check and the first record of each."""
    return found.groupBy(*CHECK_KEYS).agg(
        F.sum("occurrences").alias("findings"), F.min("record").alias("first_record")
    )


def examples(found, per_check=EXAMPLES_PER_CHECK, total=EXAMPLES_TOTAL, length=VALUE_LENGTH):
    """The first findings of each check by record, so many in all, with the beginnings of their values."""
    order = Window.partitionBy(*CHECK_KEYS).orderBy("record", "value")
    return (
        found.filter(F.col("record").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= per_check)
        .orderBy("severity", "code", "table_name", "column_name", "rank")
        .limit(total)
        .select(*CHECK_KEYS, "record", F.left("value", F.lit(length)).alias("value"))
    )


def report_status(checks):
    """Passed or failed with the number of errors and warnings; one row."""
    def total(severity):
        return F.coalesce(
            F.sum(F.when(F.col("severity") == severity, F.col("findings"))), F.lit(0)
        )

    return checks.agg(
        total("error").alias("error_count"), total("warning").alias("warning_count")
    ).select(
        F.when(F.col("error_count") > 0, F.lit("failed")).otherwise(F.lit("passed")).alias("status"),
        "error_count",
        "warning_count",
    )


def time_coverage(stop_times):
    """How complete the static times are; one row."""
    regular = F.col("pickup_type") == 0
    known = F.col("departure_seconds").isNotNull()
    return stop_times.agg(
        F.count("*").alias("stop_time_records"),
        F.count("arrival_seconds").alias("known_arrivals"),
        F.count("departure_seconds").alias("known_departures"),
        F.count_if(regular).alias("regular_pickup_records"),
        F.count_if(regular & known).alias("known_regular_departures"),
        F.count_if(F.col("pickup_type") == 1).alias("no_pickup_records"),
        F.count_if(F.col("pickup_type").isin(2, 3)).alias("on_request_pickup_records"),
        F.count_if(F.col("timepoint") == 0).alias("approximate_timepoint_records"),
    ).withColumn(
        "departure_ratio",
        F.col("known_departures") / F.nullif(F.col("stop_time_records"), F.lit(0)),
    )


def service_date_range(tables):
    return calendar_envelope(tables["calendar"], tables["calendar_dates"]).select(
        F.col("source_start").alias("start_date"), F.col("source_end").alias("end_date")
    )


def unknown_directions(trips):
    return trips.agg(F.count_if(F.col("direction_id").isNull()).alias("unknown_directions"))
