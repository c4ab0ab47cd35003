"""Registry of queries over the derived feed: name -> callable(spark, folder)."""

from collections.abc import Mapping

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, labels, parsing
from ..operators import (
    constraints,
    events,
    explorer,
    gold,
    positions,
    quality,
    reports,
    service_calendar,
    silver,
)
from ..session import scratch_folder
from ..sources import feed_csv, positions_json, warehouse
from ..sources.derived_feed import clean_feed, raw_tables, view
from .analysis import OUTPUTS, Analysis
from .params import DAY, END, NOW, REPORT_END, REPORT_START, START

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def on_feed(name):
    """Register a function of the clean feed."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(clean_feed(spark, sf_dir))
        return function

    return register


def on_analysis(name):
    """Register a function of the analysis of the clean feed over the query range."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(Analysis(clean_feed(spark, sf_dir), START, END))
        return function

    return register


def rounded(frame, *names):
    return frame.withColumns({name: F.round(name, 6) for name in names})


# Calendar, events and KPI tables -----------------------------------------------------------
on_feed("calendar_envelope")(
    lambda f: service_calendar.calendar_envelope(f.calendar, f.calendar_dates)
)
on_feed("analysis_days_domain")(lambda f: service_calendar.analysis_days(f, START, END))
on_feed("active_services")(lambda f: service_calendar.active_services(f, START, END))
on_feed("services_catalog")(
    lambda f: service_calendar.services_catalog(f.calendar, f.calendar_dates)
)
on_feed("trip_instances")(lambda f: events.trip_instances(f, START, END))
on_feed("estimate_guard")(
    lambda f: events.estimate_guard(f, START, END)
)
on_feed("stop_events")(lambda f: events.stop_events(f, START, END))
on_feed("regular_departures")(lambda f: events.regular_departures(f, START, END))
on_analysis("headway_lag")(lambda a: events.headway_intervals(a.profile))
on_analysis("gold_analysis_days")(lambda a: a.analysis_days)
on_analysis("gold_route_daily")(lambda a: a.route_daily)
on_analysis("gold_stop_daily")(lambda a: a.stop_daily)
on_analysis("gold_route_stop_hourly")(lambda a: a.route_stop_hourly)
on_analysis("gold_route_stop_headways")(
    lambda a: rounded(a.route_stop_headways, "avg_seconds", "median_seconds", "p90_seconds")
)
on_analysis("gold_service_span")(lambda a: rounded(a.service_span, "known_regular_ratio"))
on_analysis("coverage_daily")(
    lambda a: rounded(
        a.coverage_daily,
        "known_arrival_ratio",
        "known_departure_ratio",
        "known_regular_departure_ratio",
    )
)
on_analysis("coverage_summary")(
    lambda a: rounded(
        gold.coverage_totals(a.coverage), "known_departure_ratio", "known_regular_departure_ratio"
    )
)
on_feed("source_context")(
    lambda f: gold.source_context(f).select(
        F.array_join("agency_timezones", ",").alias("agency_timezones")
    )
)
on_feed("route_catalog")(gold.route_catalog)
on_feed("stop_catalog")(gold.stop_catalog)
# four of the tables start from the profile; counts need the groups, not their totals
on_analysis("gold_row_counts")(
    lambda a: gold.row_counts(a.share_profile(scratch_folder(a.feed.spark), totals=False).tables())
)


# Reports over the KPI tables ---------------------------------------------------------------
def on_reports(name):
    """Register a function of the analysis and the report range."""

    def register(function):
        def run(spark, sf_dir):
            analysis = Analysis(clean_feed(spark, sf_dir), START, END)
            first, last = reports.check_range(analysis, REPORT_START, REPORT_END)
            return function(analysis, first, last)

        QUERIES[name] = run
        return function

    return register


on_reports("overview_kpi")(
    lambda a, s, e: reports.overview(
        a.analysis_days, a.coverage_daily, a.route_daily, a.service_span, a.feed.stops, s, e
    )
)
on_reports("top_routes")(lambda a, s, e: reports.top_routes(a.route_daily, a.feed.routes, s, e))
on_reports("top_stops")(lambda a, s, e: reports.top_stops(a.stop_daily, a.feed.stops, s, e))
on_reports("hourly_profile")(lambda a, s, e: reports.hourly_profile(a.route_stop_hourly, s, e))
on_reports("hourly_top200")(
    lambda a, s, e: reports.busiest_hours(reports.hourly_profile(a.route_stop_hourly, s, e))
)
on_reports("coverage_view")(
    lambda a, s, e: rounded(
        reports.coverage_view(a.coverage_daily, s, e), "known_regular_departure_ratio"
    )
)
on_reports("filter_routes")(lambda a, s, e: reports.filter_routes(gold.route_catalog(a.feed)))
on_reports("filter_stops")(
    lambda a, s, e: reports.filter_stops(a.service_span, a.feed.stops, s, e)
)
on_reports("filter_directions")(lambda a, s, e: reports.filter_directions(a.service_span, s, e))
on_reports("direction_predicate")(
    lambda a, s, e: reports.direction_totals(reports.in_range(a.service_span, s, e))
)
on_reports("group_daily")(
    lambda a, s, e: reports.group_daily(a.analysis_days, a.service_span, s, e)
)
on_reports("group_hourly")(lambda a, s, e: reports.group_hourly(a.route_stop_hourly, s, e))
on_reports("group_headways")(
    lambda a, s, e: rounded(
        reports.group_headways(a.route_stop_headways, s, e),
        "avg_seconds", "median_seconds", "p90_seconds",
    )
)
on_reports("bounded_fetch")(
    lambda a, s, e: reports.bounded_fetch(reports.hourly_profile(a.route_stop_hourly, s, e), 20_000)
)
on_analysis("span_headway_join")(
    lambda a: rounded(a.span_headways, "median_seconds", "p90_seconds")
)
on_reports("period_event_totals")(
    lambda a, s, e: reports.period_event_totals(a.coverage_daily, s, e)
)
on_feed("shape_counts")(lambda f: reports.shape_counts(f.shapes))

# Trip explorer -----------------------------------------------------------------------------
on_feed("explorer_views_routes")(explorer.routes_view)
on_feed("explorer_views_stops")(explorer.stops_view)
on_feed("explorer_views_calendar")(explorer.calendar_view)
on_feed("explorer_views_calendar_dates")(explorer.calendar_dates_view)
on_feed("explorer_views_stop_times")(explorer.stop_times_view)
on_feed("extra_field_get")(
    lambda f: f.trips.withColumn("extras", F.from_json("extra_fields", explorer.EXTRAS)).select(
        "trip_id",
        F.nullif("extras.shape_id", F.lit("")).alias("shape_id"),
        F.nullif("extras.variant_id", F.lit("")).alias("source_variant_id"),
        F.col("extras.vehicle_id").alias("vehicle_id"),
        F.col("extras.brigade_id").alias("brigade_id"),
    )
)
on_feed("trip_patterns")(explorer.trip_patterns)
on_feed("active_services_on_day")(lambda f: events.running_services_on(f, DAY))
on_feed("day_in_envelope")(lambda f: service_calendar.day_in_envelope(f, START, END))
on_feed("explorer_routes")(explorer.list_routes)
on_feed("route_label")(lambda f: explorer.with_route_label(explorer.routes_view(f)))
on_feed("route_search")(
    lambda f: explorer.route_search(explorer.routes_view(f), labels.BUS, "R#00000012")
    .unionByName(explorer.route_search(explorer.routes_view(f), labels.TRAM, "TRAM"))
)
on_feed("active_routes")(lambda f: explorer.active_routes(f, DAY))
on_feed("variants")(lambda f: explorer.variants(f, DAY))
on_feed("variant_trips")(lambda f: explorer.variant_trips(f, DAY))
on_feed("trip_visits")(lambda f: explorer.trip_visits(f, DAY))
on_feed("trip_geometry")(lambda f: explorer.trip_geometry(f, DAY))
on_feed("stop_departures")(lambda f: explorer.stop_departures(f, DAY))
on_feed("first_known_departure")(lambda f: explorer.first_known_departure(f, DAY))
on_feed("timetable_view")(lambda f: explorer.timetable_view(explorer.trip_visits(f, DAY)))
on_feed("stop_markers")(
    lambda f: explorer.stop_markers(explorer.trip_visits(f, DAY), "0000000005")
)
on_feed("trip_summary")(lambda f: explorer.trip_summary(explorer.trip_visits(f, DAY)))

# Labels ------------------------------------------------------------------------------------
on_feed("service_hour")(
    lambda f: f.stop_times.filter(F.col("departure_seconds").isNotNull()).select(
        "trip_id", "stop_sequence", gold.service_hour("departure_seconds").alias("service_hour")
    )
)
on_feed("format_service_time")(
    lambda f: f.stop_times.select(
        "trip_id", "stop_sequence",
        labels.service_time(F.col("arrival_seconds")).alias("arrival"),
        labels.service_time(F.col("departure_seconds") * 1000).alias("long_time"),
    )
)
on_analysis("format_percent")(
    lambda a: a.service_span.select(
        *events.GROUP,
        labels.percent(F.col("observation_count"), F.col("regular_event_count")).alias("known"),
    )
)
on_feed("transport_mode")(
    lambda f: f.routes.select(
        "route_id", labels.transport_mode(F.col("route_type")).alias("transport")
    )
)
on_feed("boarding_timepoint_label")(
    lambda f: f.stop_times.select(
        "trip_id", "stop_sequence",
        labels.boarding_label(F.col("pickup_type")).alias("boarding"),
        labels.timepoint_label(F.col("timepoint")).alias("time_kind"),
    )
)
on_feed("iso_weekday_flag")(
    lambda f: f.calendar.select(
        "service_id",
        F.explode(F.sequence("start_date", "end_date")).alias("service_date"),
        *service_calendar.DAYS,
    ).select(
        "service_id", "service_date",
        service_calendar.weekday_flag(F.col("service_date")).alias("flag"),
    )
)


# Vehicle observations ----------------------------------------------------------------------
def on_positions(name):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(
            view(spark, sf_dir, "r_positions"), spark, sf_dir
        )
        return function

    return register


def _observations(records):
    return positions.normalize_positions(records, NOW, terms_confirmed=True)


on_positions("normalize_positions")(
    lambda p, spark, sf_dir: rounded(
        _observations(p).drop("label"), "latitude", "longitude", "age_seconds"
    )
)
on_positions("position_freshness")(
    lambda p, spark, sf_dir: _observations(p).groupBy("state").agg(
        F.count("*").alias("observations"),
        F.round(F.min("age_seconds"), 6).alias("youngest"),
        F.round(F.max("age_seconds"), 6).alias("oldest"),
    )
)
on_positions("position_labels")(
    lambda p, spark, sf_dir: _observations(p).select("observation_id", "label")
)
on_positions("duplicate_vehicle_ids")(
    lambda p, spark, sf_dir: positions.duplicate_vehicle_ids(p)
)
on_positions("position_summary")(
    lambda p, spark, sf_dir: positions.position_summary(p, NOW)
)
on_positions("positions_for_line")(
    lambda p, spark, sf_dir: positions.positions_for_line(
        _observations(p), view(spark, sf_dir, "g_routes")
    ).select("observation_id", "line", "vehicle_id")
)


# Typing and quality of the raw feed --------------------------------------------------------
def on_raw(name):
    """Register a function of the dict of raw tables."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(raw_tables(spark, sf_dir))
        return function

    return register


for _table in silver.TABLES:
    on_raw(f"silver_{_table}")(
        lambda raw, table=_table: silver.to_silver(table, raw[table], raw["agency"])
    )
on_raw("conform_columns")(lambda raw: silver.conform_columns("stop_times", raw["stop_times"]))
on_raw("normalize_id")(
    lambda raw: silver.to_silver("stops", raw["stops"]).select(
        "_source_record", "stop_id", "parent_station"
    )
)
on_raw("parse_int_enum")(
    lambda raw: raw["stop_times"].select(
        "_source_record",
        F.col("stop_sequence").alias("sequence_text"),
        parsing.parse_int(F.col("stop_sequence")).alias("stop_sequence"),
        F.col("pickup_type").alias("pickup_text"),
        parsing.parse_int(F.col("pickup_type"), "0").alias("pickup_type"),
    )
)
on_raw("parse_date_strict")(
    lambda raw: raw["calendar"].select(
        "_source_record",
        F.col("start_date").alias("date_text"),
        parsing.parse_date(F.col("start_date")).alias("start_date"),
    )
)
on_raw("parse_coordinate")(
    lambda raw: raw["stops"].select(
        "_source_record",
        F.col("stop_lat").alias("lat_text"),
        F.round(parsing.parse_number(F.col("stop_lat")), 6).alias("stop_lat"),
        F.round(parsing.parse_number(F.col("stop_lon")), 6).alias("stop_lon"),
    )
)
on_raw("parse_gtfs_seconds")(
    lambda raw: raw["stop_times"].select(
        "_source_record",
        "arrival_time",
        parsing.parse_seconds(F.col("arrival_time")).alias("arrival_seconds"),
        parsing.parse_seconds(F.col("departure_time")).alias("departure_seconds"),
    )
)
on_raw("agency_key")(
    lambda raw: silver.to_silver("routes", raw["routes"], raw["agency"]).select(
        "_source_record", "_agency_key"
    )
)
on_raw("route_type_description")(
    lambda raw: silver.to_silver("routes", raw["routes"], raw["agency"]).select(
        "_source_record", "route_type", "route_type_description"
    )
)
on_raw("timezone_valid")(
    lambda raw: raw["agency"].select(
        "_source_record", quality.zone_exists(F.col("agency_timezone")).alias("zone_valid")
    )
)
on_raw("extra_fields_json")(
    lambda raw: silver.with_extra_fields(
        "trips", silver.to_silver("trips", raw["trips"])
    ).select("_source_record", "extra_fields")
)

# The checks run as in a real import: raw text is first written as bronze files, typed once,
# and the checks read the columns they need from those files.
_STAGED = {}


def _listing(spark, folder):
    """Names, sizes and times of the files of a folder, so that a changed input is staged anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def _written_tables(spark, folder):
    return {name: spark.read.parquet(f"{folder}/{name}") for name in silver.TABLES}


class _Staged(Mapping):
    """Tables of one kind by name; each is written when it is first asked for, and then read from its files."""

    def __init__(self, spark, folder, write):
        self._spark, self._folder, self._write, self._written = spark, folder, write, {}

    def __getitem__(self, name):
        if name not in silver.TABLES:
            raise KeyError(name)
        if name not in self._written:
            path = f"{self._folder}/{name}"
            warehouse.write_parquet(self._write(name), path)
            self._written[name] = self._spark.read.parquet(path)
        return self._written[name]

    def __iter__(self):
        return iter(silver.TABLES)

    def __len__(self):
        return len(silver.TABLES)


def staged_feed(spark, sf_dir):
    """Bronze and typed tables of the raw feed, each written once per session and state of the input.

    A check stages the tables it reads, whole; the report of all checks stages all of them.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _listing(spark, sf_dir))
    if key not in _STAGED:
        folder = scratch_folder(spark)
        raw = _Staged(spark, f"{folder}/bronze", raw_tables(spark, sf_dir).__getitem__)
        typed = _Staged(
            spark, f"{folder}/silver",
            lambda name: silver.to_silver(name, raw[name], raw["agency"] if name == "routes" else None),
        )
        _STAGED[key] = raw, typed
    return _STAGED[key]


def on_staged(name):
    """Register a function of the written raw and typed tables."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(*staged_feed(spark, sf_dir))
        return function

    return register


# Codes of the checks that look at one raw row, and the tables they concern.
ROW_CODES = {
    "id_whitespace": silver.TABLES,
    "required_id": ("stops", "routes", "trips", "stop_times", "calendar", "calendar_dates"),
    "invalid_integer_or_enum": (
        "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates",
    ),
    "invalid_date": ("calendar", "calendar_dates"),
    "invalid_coordinate": ("stops",),
    "required_text": ("agency",),
    "invalid_timezone": ("agency",),
    "ambiguous_agency": ("routes",),
    "missing_route_name": ("routes",),
    "required_stop_name": ("stops",),
    "required_coordinate": ("stops",),
    "invalid_gtfs_time": ("stop_times",),
    "unsupported_flexible_service": ("stop_times",),
}
for _code, _concerned in ROW_CODES.items():
    on_staged(f"dq_{_code}")(
        lambda raw, typed, code=_code, concerned=_concerned: quality.summarize(
            silver.union_all(
                [quality.row_findings(t, raw[t], raw["agency"], {code}) for t in concerned]
            )
        )
    )
for _code, _check in (
    ("duplicate_key", quality.duplicate_keys),
    ("orphan_reference", quality.orphan_references),
    ("unknown_service", quality.unknown_services),
    ("calendar_range", quality.calendar_ranges),
    ("required_parent", quality.required_parents),
    ("invalid_parent_type", quality.invalid_parent_types),
    ("invalid_event_location", quality.invalid_event_locations),
    ("missing_exact_time", quality.missing_exact_times),
    ("missing_endpoint_arrival", quality.missing_endpoint_arrivals),
    ("time_decreases", quality.time_decreases),
    ("multi_agency_missing_id", quality.agency_consistency),
    ("multiple_agency_timezones", quality.agency_consistency),
    ("unknown_departure", quality.unknown_times),
    ("unknown_arrival", quality.unknown_times),
):
    on_staged(f"dq_{_code}")(
        lambda raw, typed, code=_code, check=_check: quality.summarize(
            check(typed).filter(F.col("code") == code)
        )
    )
QUERIES["dq_unsupported_frequencies"] = lambda spark, sf_dir: quality.summarize(
    quality.unsupported_frequencies(view(spark, sf_dir, "r_frequencies"))
)


def _all_findings(spark, sf_dir):
    raw, typed = staged_feed(spark, sf_dir)
    return quality.all_findings(raw, view(spark, sf_dir, "r_frequencies"), typed)


QUERIES["dq_report"] = lambda spark, sf_dir: quality.summarize(_all_findings(spark, sf_dir))
QUERIES["dq_report_examples"] = lambda spark, sf_dir: quality.examples(_all_findings(spark, sf_dir))
QUERIES["silver_gate_status"] = lambda spark, sf_dir: quality.report_status(
    quality.summarize(_all_findings(spark, sf_dir))
)
on_staged("dq_time_coverage")(
    lambda raw, typed: rounded(quality.time_coverage(typed["stop_times"]), "departure_ratio")
)
on_staged("dq_service_date_range")(lambda raw, typed: quality.service_date_range(typed))
on_staged("dq_unknown_directions")(lambda raw, typed: quality.unknown_directions(typed["trips"]))
on_staged("dq_row_counts")(lambda raw, typed: gold.row_counts(typed))


# Constraints, identities, sources and sinks ------------------------------------------------
on_staged("check_constraints_silver")(
    lambda raw, typed: constraints.check_constraints(
        {
            **typed,
            "services": service_calendar.services_catalog(
                typed["calendar"], typed["calendar_dates"]
            ),
        }
    )
)


def _published(spark, sf_dir):
    """KPI tables of the clean feed written with a shared profile and read back."""
    folder = scratch_folder(spark)
    analysis = Analysis(clean_feed(spark, sf_dir), START, END)
    warehouse.write_gold(analysis.share_profile(f"{folder}/profile"), f"{folder}/gold", "run")
    return analysis, warehouse.gold_tables(spark, f"{folder}/gold", "run")


@query
def check_constraints_gold(spark, sf_dir):
    analysis, tables = _published(spark, sf_dir)
    feed = analysis.feed
    services = service_calendar.services_catalog(feed.calendar, feed.calendar_dates)
    found = constraints.check_constraints(
        {**tables, "routes": feed.routes, "stops": feed.stops, "services": services}
    )
    return found.filter(F.col("table_name").isin(*OUTPUTS))


@query
def publish_gold(spark, sf_dir):
    """Row counts of the KPI tables that the publishing of a loaded dataset wrote."""
    store, identity_ = _loaded(spark, sf_dir)
    _, entry = warehouse.publish_gold(spark, store, identity_, START, END, scratch_folder(spark))
    return gold.row_counts(warehouse.read_gold(spark, store, entry["analysis_id"])[0])


@query
def publish_gold_headways(spark, sf_dir):
    return rounded(
        _published(spark, sf_dir)[1]["route_stop_headways"],
        "avg_seconds", "median_seconds", "p90_seconds",
    )


def _source_hash():
    return F.sha2(F.col("agency_id"), 256)


on_feed("dataset_id")(
    lambda f: f.agency.select("agency_id", identity.dataset_id_column(_source_hash()).alias("dataset_id"))
)
on_feed("analysis_id")(
    lambda f: f.agency.select(
        "agency_id",
        identity.analysis_id_column(
            identity.dataset_id_column(_source_hash()), START, END
        ).alias("analysis_id"),
    )
)
on_feed("content_fingerprint")(
    lambda f: identity.content_fingerprint(
        f.stop_times, ["trip_id", "stop_sequence", "stop_id", "arrival_seconds", "departure_seconds"]
    )
)
on_feed("dataset_metadata")(lambda f: warehouse.dataset_metadata(f, "gtfs_derived"))


def _with_end_times(visits):
    """Visits with an arrival at the first and the last stop of every trip, which the gate asks for.

    A missing one becomes the earliest, or the latest, time the trip has, and 5:00 without any.
    """
    trip = Window.partitionBy("trip_id")
    times = ("arrival_seconds", "departure_seconds")
    end = F.when(F.col("stop_sequence") == F.min("stop_sequence").over(trip), F.min(F.least(*times)).over(trip)).when(
        F.col("stop_sequence") == F.max("stop_sequence").over(trip), F.max(F.greatest(*times)).over(trip)
    )
    at_end = F.col("stop_sequence").isin(F.min("stop_sequence").over(trip), F.max("stop_sequence").over(trip))
    arrival = F.coalesce("arrival_seconds", F.when(at_end, F.coalesce(end, F.lit(18000))))
    return visits.filter(F.col("trip_id").isNotNull()).withColumn("arrival_seconds", arrival)


def _clean_raw(spark, sf_dir):
    """The clean feed as raw text, in the form an import starts from, with all its visits.

    What the gate must refuse is mended: the ends of a trip get an arrival, and stations become
    platforms, since trips visit them, with the coordinates they must have.
    """
    feed = clean_feed(spark, sf_dir)
    raw = {}
    for name in silver.TABLES:
        frame, columns = getattr(feed, name), []
        if name == "stop_times":
            frame = _with_end_times(frame)
        for column in silver.RULES[name]:
            if column in ("arrival_time", "departure_time"):
                columns.append(
                    F.when(F.col(column.replace("time", "seconds")).isNull(), "")
                    .otherwise(labels.service_time(F.col(column.replace("time", "seconds")))).alias(column)
                )
                continue
            value = F.col(column)
            if column in ("stop_lat", "stop_lon"):
                value = F.coalesce(column, F.lit(17.5))
            elif column == "location_type":
                value = F.lit(0)
            if dict(frame.dtypes)[column] == "date":
                value = F.date_format(value, "yyyyMMdd")
            columns.append(F.coalesce(value.cast("string"), F.lit("")).alias(column))
        raw[name] = frame.select(*columns, F.monotonically_increasing_id().alias("_source_record"))
    return raw


def _imported(spark, sf_dir):
    """A folder with typed tables published through the gate, and its manifest.

    The raw text is written as bronze files first, since the gate reads it twice.
    """
    folder = scratch_folder(spark)
    for name, frame in _clean_raw(spark, sf_dir).items():
        warehouse.write_parquet(frame, f"{folder}/bronze/{name}")
    raw = _written_tables(spark, f"{folder}/bronze")
    return folder, warehouse.silver_gate(raw, folder, "0" * 64, data_kind="gtfs_derived")


def _damaged(spark, folder, manifest):
    """Rewrite four tables of a published run: a value, a column, a type and a row are not as declared."""
    run = f"{folder}/{manifest['run']}"
    changes = {
        "stops": lambda f: f.withColumn("stop_name", F.concat("stop_name", F.lit("!"))),
        "routes": lambda f: f.drop("route_long_name"),
        "trips": lambda f: f.withColumn("direction_id", F.col("direction_id").cast("string")),
        "calendar": lambda f: f.filter("service_id <> 'SV1'"),
    }
    for name, change in changes.items():
        kept = f"{folder}/changed/{name}"
        warehouse.write_parquet(change(spark.read.parquet(f"{run}/{name}")), kept)
        warehouse.write_parquet(spark.read.parquet(kept), f"{run}/{name}")
    warehouse.discard(spark, [f"{run}/calendar_dates"])


@query
def verify_silver(spark, sf_dir):
    """A published folder against its manifest, as written and after some of its tables were changed."""
    folder, manifest = _imported(spark, sf_dir)
    whole = scratch_folder(spark)
    warehouse.write_parquet(warehouse.verify_silver(spark, folder), whole)
    _damaged(spark, folder, manifest)
    return spark.read.parquet(whole).withColumn("state", F.lit("published")).unionByName(
        warehouse.verify_silver(spark, folder).withColumn("state", F.lit("damaged"))
    )


@query
def silver_gate(spark, sf_dir):
    """The stop times that went through gate and report."""
    folder, _ = _imported(spark, sf_dir)
    return warehouse.read_silver(spark, folder)["stop_times"].select(
        "trip_id", "stop_id", "stop_sequence", "arrival_seconds", "departure_seconds", "pickup_type", "timepoint"
    )


REPORT_SCHEMA = """
    status string, error_count bigint, warning_count bigint, example_limit bigint, unknown_directions bigint,
    checks array<struct<severity: string, code: string, table_name: string, column_name: string, findings: bigint,
                        first_record: bigint>>,
    examples array<struct<severity: string, code: string, table_name: string, column_name: string, record: bigint,
                          value: string>>,
    time_coverage map<string, string>, service_date_range map<string, string>, row_counts map<string, bigint>,
    capabilities struct<quantitative_gold_supported: boolean, flexible_service_supported: boolean,
                        frequencies: struct<present: boolean, row_count: bigint, handling: string>,
                        calendar_sources: map<string, boolean>, untyped_extra_columns: map<string, array<string>>>
"""


@query
def write_quality_report(spark, sf_dir):
    """All of the report document of the faulty feed, written and parsed again: (section, name, value)."""
    raw, typed = staged_feed(spark, sf_dir)
    path = f"{scratch_folder(spark)}/quality"
    frequencies = view(spark, sf_dir, "r_frequencies")
    present = dict.fromkeys((*silver.TABLES, "frequencies"), True)
    counts = {row.table_name: row.row_count for row in gold.row_counts(typed).collect()}
    warehouse.write_document(spark, path, warehouse.quality_report(raw, frequencies, typed, present, counts))
    text = spark.read.text(path, wholetext=True)
    report = text.select(F.from_json("value", REPORT_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    def rows(section, items, name, value):
        return report.select(F.explode(items).alias("i")).select(
            F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value")
        )

    def entries(section, of):
        return rows(section, F.map_entries(of), F.col("i.key"), F.col("i.value"))

    about = F.concat_ws("|", "i.severity", "i.code", "i.table_name", F.coalesce("i.column_name", F.lit("-")))
    single = F.create_map(*[
        part for name in ("status", "error_count", "warning_count", "example_limit", "unknown_directions")
        for part in (F.lit(name), F.col(name).cast("string"))
    ])
    able = F.create_map(
        F.lit("quantitative"), F.col("capabilities.quantitative_gold_supported").cast("string"),
        F.lit("flexible"), F.col("capabilities.flexible_service_supported").cast("string"),
        F.lit("frequencies"), F.concat_ws(" ", *[F.col(f"capabilities.frequencies.{n}").cast("string") for n in ("present", "row_count", "handling")]),
        F.lit("calendar"), F.col("capabilities.calendar_sources")["calendar"].cast("string"),
        F.lit("extra of trips"), F.array_join(F.col("capabilities.untyped_extra_columns")["trips"], ","),
    )
    whole = F.filter(F.map_entries("time_coverage"), lambda e: e["key"] != "departure_ratio")
    return silver.union_all([
        entries("report", single),
        rows("check", F.col("checks"), about, F.concat_ws(" ", F.col("i.findings"), F.coalesce("i.first_record", F.lit(-1)))),
        rows("example", F.col("examples"), F.concat_ws("|", about, F.col("i.record")), F.coalesce("i.value", F.lit(""))),
        rows("time_coverage", whole, F.col("i.key"), F.col("i.value")),
        rows("time_coverage", F.array(F.col("time_coverage")["departure_ratio"]), F.lit("departure_ratio"),
             F.round(F.col("i").cast("double"), 6)),
        entries("service_date_range", F.col("service_date_range")),
        entries("row_count", F.col("row_counts")),
        entries("capability", able),
    ])


def _loaded(spark, sf_dir):
    folder, manifest = _imported(spark, sf_dir)
    store = f"{folder}/store"
    warehouse.load_silver(spark, folder, store)
    return store, manifest["dataset_id"]


@query
def load_silver(spark, sf_dir):
    """The trips of the feed of a loaded dataset."""
    store, identity_ = _loaded(spark, sf_dir)
    return warehouse.loaded_feed(spark, store, identity_).trips.select(
        "trip_id", "route_id", "service_id", "direction_id", "trip_headsign"
    )


def _rewritten(frame, name):
    """A table written as zstd Parquet and scanned again with its declared schema."""
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/{name}"
    warehouse.write_parquet(frame, path)
    return spark.read.schema(frame.schema).parquet(path)


on_raw("write_scan_bronze")(lambda raw: _rewritten(raw["stop_times"], "stop_times"))
on_raw("write_scan_silver")(
    lambda raw: _rewritten(silver.to_silver("stop_times", raw["stop_times"]), "stop_times")
)


def _scanned(spark, folder, names):
    """Counts and content hashes of written tables, taken from the files alone."""
    return silver.union_all(
        identity.content_fingerprint(spark.read.parquet(f"{folder}/{name}")).select(
            F.lit(name).alias("table_name"), "row_count", "content_hash"
        )
        for name in names
    )


def _written(spark, tables):
    folder = scratch_folder(spark)
    return folder, warehouse.manifest_rows(spark, warehouse.write_bronze(tables, folder))


@query
def write_bronze(spark, sf_dir):
    """What the writes of all raw tables observed."""
    return _written(spark, raw_tables(spark, sf_dir))[1]


@query
def write_silver(spark, sf_dir):
    """What the writes of all typed tables observed."""
    return _written(spark, silver.silver_tables(raw_tables(spark, sf_dir)))[1]


@query
def scan_bronze(spark, sf_dir):
    return _scanned(spark, _written(spark, raw_tables(spark, sf_dir))[0], silver.TABLES)


@query
def scan_silver(spark, sf_dir):
    return _scanned(spark, _written(spark, silver.silver_tables(raw_tables(spark, sf_dir)))[0], silver.TABLES)


def _as_csv(frame, name, folder=None):
    path = f"{folder or scratch_folder(frame.sparkSession)}/{name}.txt"
    frame.write.options(
        header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


on_raw("read_feed_csv")(
    lambda raw: feed_csv.read_feed_csv(
        raw["stop_times"].sparkSession,
        _as_csv(raw["stop_times"].drop("_source_record"), "stop_times"),
        "stop_times",
    ).drop("_source_record")
)
def _numbered(raw):
    """Trips written in the order of their ids with their numbers as read.

    Some notes have quotes and line breaks, some are quotes or commas alone, and some records are blank.
    """
    trips = raw["trips"].filter(F.col("trip_id") != "").groupBy("trip_id").agg(F.min("trip_headsign").alias("headsign"))
    long_note = F.concat(F.lit('a "'), "headsign", F.lit('",\nb'))
    digit = F.right("trip_id", F.lit(1))
    note = (
        F.when(digit.isin("1", "4", "7"), long_note).when(digit == "2", '"   ').when(digit == "3", ',",')
        .when(digit == "5", "   ").otherwise('5" x')
    )
    shown = F.when(digit == "5", "").otherwise(F.col("trip_id"))
    rows = (
        trips.select("trip_id", note.alias("note"), shown.alias("shown")).repartitionByRange(4, "trip_id")
        .sortWithinPartitions("trip_id").select(F.col("shown").alias("trip_id"), "note")
    )
    return feed_csv.read_feed_csv(raw["trips"].sparkSession, _as_csv(rows, "trips"), "trips")


on_raw("source_record_number")(_numbered)
on_raw("skip_blank_records")(
    lambda raw: feed_csv.skip_blank_records(
        raw["stop_times"].select("_source_record", "location_group_id", "timepoint"),
        ["location_group_id", "timepoint"],
    )
)
def _structure(raw):
    """A folder of files without a route type, a calendar without rows and no exceptions, read by one job."""
    spark = raw["trips"].sparkSession
    folder = scratch_folder(spark)
    tables = {
        **{t: f for t, f in raw.items() if t != "calendar_dates"},
        "routes": raw["routes"].drop("route_short_name", "route_long_name", "route_type"),
        "calendar": raw["calendar"].filter(F.col("service_id") == ""),
        "stops": raw["stops"].withColumn(" ", F.lit("x")),
    }
    for name, frame in tables.items():
        _as_csv(frame.drop("_source_record"), name, folder)
    return feed_csv.feed_structure_check(spark, folder)


on_raw("feed_structure_check")(_structure)
on_raw("table_structure_check")(
    lambda raw: feed_csv.table_structure_check(
        {
            **{t: f for t, f in raw.items() if not t.startswith("calendar")},
            "routes": raw["routes"].drop("route_short_name", "route_long_name", "route_type"),
            "calendar": raw["calendar"].filter(F.col("service_id") == ""),
        }
    )
)


def _without_calendar(raw):
    """A feed whose services are all exceptions: the weekly calendar's file is not there."""
    tables = {**raw, "calendar": feed_csv.empty_raw(raw["trips"].sparkSession, "calendar")}
    return feed_csv.tables_present(tables, {name: name != "calendar" for name in silver.TABLES})


on_raw("feed_tables_present")(_without_calendar)
QUERIES["frequencies_capability"] = lambda spark, sf_dir: feed_csv.frequencies_capability(
    view(spark, sf_dir, "r_frequencies")
)
QUERIES["feed_capabilities"] = lambda spark, sf_dir: feed_csv.feed_capabilities(
    raw_tables(spark, sf_dir),
    dict.fromkeys((*silver.TABLES, "frequencies"), True),
    view(spark, sf_dir, "r_frequencies"),
).select(
    "frequencies.row_count",
    "frequencies.handling",
    "quantitative_gold_supported",
    "flexible_service_supported",
    "calendar_sources.calendar",
    F.array_join("untyped_extra_columns.trips", ",").alias("trips_extra"),
    F.array_join("untyped_extra_columns.stop_times", ",").alias("stop_times_extra"),
)


@query
def read_shapes(spark, sf_dir):
    raw = view(spark, sf_dir, "g_shapes").select(
        "shape_id",
        F.col("shape_pt_sequence").cast("string").alias("shape_pt_sequence"),
        F.col("latitude").cast("string").alias("shape_pt_lat"),
        F.col("longitude").cast("string").alias("shape_pt_lon"),
    )
    return rounded(feed_csv.read_shapes(spark, _as_csv(raw, "shapes")), "latitude", "longitude")


@query
def import_geometry(spark, sf_dir):
    """Counts of the shapes that were imported for a loaded dataset from a file."""
    points = view(spark, sf_dir, "g_shapes").select(
        "shape_id", "shape_pt_sequence",
        F.col("latitude").alias("shape_pt_lat"), F.col("longitude").alias("shape_pt_lon"),
    ).select(*[F.col(c).cast("string").alias(c) for c in feed_csv.SHAPE_COLUMNS])
    store, identity_ = _loaded(spark, sf_dir)
    warehouse.import_geometry(spark, store, identity_, "0" * 64, _as_csv(points, "shapes"))
    return reports.shape_counts(warehouse.loaded_feed(spark, store, identity_).shapes)


@query
def read_position_lines(spark, sf_dir):
    """Observations written as a history of one record per line and read again."""
    positions_ = view(spark, sf_dir, "r_positions")
    records = positions_.select(F.to_json(F.struct(
        *[F.col(name).alias(field) for name, field in positions_json.FIELDS.items()]
    )).alias("value"))
    path = f"{scratch_folder(spark)}/positions"
    records.write.text(path)
    return positions_json.read_position_lines(spark, path).drop("observation_id", "is_object")


@query
def read_positions_json(spark, sf_dir):
    """Observations written as export documents of up to 200 records, and read with their metadata.

    Some documents have no metadata of their title, and some metadata another licence.
    """
    folder = scratch_folder(spark)
    record = F.struct(*[F.col(name).alias(field) for name, field in positions_json.FIELDS.items()])
    exports = (
        view(spark, sf_dir, "r_positions").withColumn("number", F.floor(F.col("observation_id") / 200))
        .groupBy("number").agg(F.sort_array(F.collect_list(F.struct("observation_id", record.alias("record")))).alias("found"))
        .withColumn("title", F.concat(F.lit("Positions "), "number"))
    )
    exports.select(F.to_json(F.struct(
        F.struct(F.col("title").alias(positions_json.TITLE)).alias("meta"),
        F.transform("found", lambda f: f["record"]).alias(positions_json.RECORDS),
    )).alias("value")).write.text(f"{folder}/exports")
    licence = F.when(F.col("number") % 7 == 2, "other").otherwise(positions_json.CONFIRMED_LICENCE)
    exports.filter("number % 5 <> 3").select(F.to_json(F.struct(
        F.col("title").alias(positions_json.TITLE), licence.alias(positions_json.LICENCE)
    )).alias("value")).write.text(f"{folder}/metadata")
    return positions_json.read_position_documents(spark, f"{folder}/exports", f"{folder}/metadata", multi_line=False)
