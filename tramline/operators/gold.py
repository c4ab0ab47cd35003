"""The eight KPI tables of an analysis, each a DataFrame at its own grain.

Counts are zero inside the calendar envelope and NULL outside it. Direction NULL is a group
of its own. Tables that do not need single visits are counted per service first and spread
over dates afterwards; the group tables sum the measures of ``events.with_measures``, either
straight from events or from the smaller departure profile.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .events import (
    GROUP,
    NO_PICKUP,
    ON_REQUEST,
    REGULAR,
    headway_gaps,
    is_regular_departure,
    per_date,
    service_visits,
)
from .service_calendar import (
    OUTSIDE,
    WITHIN,
    analysis_days,
    calendar_envelope,
    covered_by_envelope,
    dates_between,
    service_dates,
)


def covered_or_null(name):
    """Zero-filled inside the envelope, NULL outside."""
    return F.when(F.col("calendar_covered"), F.coalesce(F.col(name), F.lit(0))).alias(name)


def ratio(part, whole):
    """Share as a double; NULL when the whole is zero or NULL."""
    return F.col(part).cast("double") / F.nullif(F.col(whole), F.lit(0))


def gold_days(feed, start, end):
    trips = feed.trips.groupBy("service_id").agg(F.count("*").alias("trips"))
    per_day = (
        service_dates(feed, start, end)
        .join(trips, "service_id", "left")
        .select(F.explode("service_dates").alias("service_date"), "trips")
        .groupBy("service_date")
        .agg(
            F.count("*").alias("active_services"),
            F.coalesce(F.sum("trips"), F.lit(0)).alias("trip_instances"),
        )
    )
    return (
        analysis_days(feed, start, end)
        .join(per_day, "service_date", "left")
        .select(
            "service_date",
            "calendar_covered",
            F.when(F.col("calendar_covered"), F.lit(WITHIN))
            .otherwise(F.lit(OUTSIDE))
            .alias("coverage_state"),
            covered_or_null("active_services"),
            covered_or_null("trip_instances"),
        )
    )


def daily_grid(entities, feed, start, end):
    """Each row of ``entities`` for every requested date, marked covered or not."""
    envelope = calendar_envelope(feed.calendar, feed.calendar_dates)
    return entities.withColumn("service_date", F.explode(dates_between(start, end))).withColumn(
        "calendar_covered", covered_by_envelope(F.col("service_date"), envelope)
    )


def gold_routes(feed, start, end):
    counts = feed.trips.groupBy("service_id", "route_id").agg(F.count("*").alias("trips"))
    daily = (
        per_date(counts, feed, start, end)
        .groupBy("service_date", "route_id")
        .agg(F.sum("trips").alias("trip_count"))
    )
    return (
        daily_grid(feed.routes.select("route_id"), feed, start, end)
        .join(daily, ["service_date", "route_id"], "left")
        .select("service_date", "route_id", "calendar_covered", covered_or_null("trip_count"))
    )


def gold_stops(measures, feed, start, end):
    """Platforms by day. Routes are counted from (date, stop, route) partial sums."""
    daily = (
        measures.filter(F.col("departure").isNotNull())
        .groupBy("service_date", "stop_id", "route_id")
        .agg(F.sum("departures").alias("departures"))
        .groupBy("service_date", "stop_id")
        .agg(
            F.sum("departures").alias("regular_known_departures"),
            F.count("*").alias("distinct_routes"),
        )
    )
    platforms = feed.stops.filter(F.col("location_type") == 0).select("stop_id")
    return (
        daily_grid(platforms, feed, start, end)
        .join(daily, ["service_date", "stop_id"], "left")
        .select(
            "service_date",
            "stop_id",
            "calendar_covered",
            covered_or_null("regular_known_departures"),
            covered_or_null("distinct_routes"),
        )
    )


def service_hour(name):
    """Hour of the service day of a column of seconds; hour 25 stays 25."""
    return F.expr(f"{name} div 3600")


def gold_hourly(measures):
    return (
        measures.filter(F.col("departure").isNotNull())
        .withColumn("service_hour", service_hour("departure"))
        .groupBy(*GROUP, "service_hour")
        .agg(
            F.sum("departures").alias("departure_count"),
            F.sum("approximate").alias("approximate_departures"),
        )
    )


def _headway_entries(profile):
    """Profile rows with their gap; departures of the same second add a row of zero gaps without counts."""
    profile = profile.withColumn("_key", F.xxhash64(*GROUP))  # sorts compare whole numbers before texts
    again = F.col("again") == 1  # what is zero in the second row of a second stays a column of its own, so counts need no gaps
    rows = (
        headway_gaps(profile, "_key")
        .withColumn("again", F.explode(F.when(F.col("departures") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "_key",
            *GROUP,
            "departure",
            F.when(again, F.lit(0).cast("long")).otherwise(F.col("gap")).alias("gap"),
            F.when(again, F.col("departures") - 1).otherwise(F.lit(1).cast("long")).alias("times"),
            *[F.when(again, F.lit(0).cast("long")).otherwise(F.col(m)).alias(m) for m in ("regular", "departures", "approximate")],
        )
    )
    known = F.sum(F.when(F.col("gap").isNotNull(), F.col("times")))
    group = Window.partitionBy("_key", *GROUP).orderBy(F.col("gap").asc_nulls_first())
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"upto": known.over(upto), "intervals": known.over(whole)})


def _percentile(share):
    """Exact interpolated percentile of the group's gaps, each counted as often as it occurs.

    The same as ``F.percentile`` with frequencies, from places in the sorted group instead of a map per group.
    """
    position = (F.col("intervals") - 1) * F.lit(share)
    low, high = (F.min(F.when(F.col("upto") > whole, F.col("gap"))) for whole in (F.floor(position), F.ceil(position)))
    place = F.max(position)
    below, above = F.ceil(place) - place, place - F.floor(place)
    return F.when(low == high, low.cast("double")).otherwise(below * low + above * high)


def _headway_columns():
    intervals = F.coalesce(F.sum(F.when(F.col("gap").isNotNull(), F.col("times"))), F.lit(0))
    return [
        F.sum("departures").alias("departure_count"),
        intervals.alias("interval_count"),
        (F.sum(F.col("gap") * F.col("times")) / F.nullif(intervals, F.lit(0))).alias("avg_seconds"),
        _percentile(0.5).alias("median_seconds"),
        _percentile(0.9).alias("p90_seconds"),
    ]


def _span_columns():
    return [
        F.min("departure").alias("first_departure_seconds"),
        F.max("departure").alias("last_departure_seconds"),
        F.sum("departures").alias("observation_count"),
        F.sum("regular").alias("regular_event_count"),
        F.sum(F.col("regular") - F.col("departures")).alias("missing_regular_departures"),
        F.sum("approximate").alias("approximate_departures"),
    ]


HEADWAY_COLUMNS = ("departure_count", "interval_count", "avg_seconds", "median_seconds", "p90_seconds")


def group_totals(profile):
    """All columns of the headway and span tables of each group, from one aggregate."""
    return (
        _headway_entries(profile).groupBy("_key", *GROUP).agg(*_headway_columns(), *_span_columns()).drop("_key")
        .withColumn("known_regular_ratio", ratio("observation_count", "regular_event_count"))
    )


def gold_headways(profile):
    """Departures, intervals and their mean, exact median and 90th percentile per group.

    Needs the departure profile: after it a group has at most a row per second. Groups
    visited without any regular departure stay, with counts of zero.
    """
    return _headway_entries(profile).groupBy("_key", *GROUP).agg(*_headway_columns()).drop("_key")


def gold_span(measures):
    """First and last regular departure and how complete the regular times are."""
    return (
        measures.groupBy(*GROUP)
        .agg(*_span_columns())
        .withColumn("known_regular_ratio", ratio("observation_count", "regular_event_count"))
    )


def span_and_headways(profile):
    """Span and headways of each group, an unknown direction included, from one aggregate."""
    return (
        _headway_entries(profile).groupBy("_key", *GROUP).agg(*_span_columns(), *_headway_columns())
        .drop("_key", "departure_count", "avg_seconds", "approximate_departures")
    )


def _visit_counts():
    regular = F.col("pickup_type") == REGULAR
    conditions = {
        "total_events": F.lit(True),
        "known_arrivals": F.col("arrival_seconds").isNotNull(),
        "known_departures": F.col("departure_seconds").isNotNull(),
        "regular_events": regular,
        "regular_known_departures": is_regular_departure(),
        "no_pickup_events": F.col("pickup_type") == NO_PICKUP,
        "on_request_events": F.col("pickup_type").isin(*ON_REQUEST),
        "pickup_type_2_events": F.col("pickup_type") == ON_REQUEST[0],
        "pickup_type_3_events": F.col("pickup_type") == ON_REQUEST[1],
        "exact_timepoint_events": F.col("timepoint") == 1,
        "approximate_timepoint_events": F.col("timepoint") == 0,
        "approximate_regular_departures": is_regular_departure() & (F.col("timepoint") == 0),
    }
    return {name: F.count_if(condition).alias(name) for name, condition in conditions.items()}


def gold_coverage(feed, start, end):
    """Visit counts per date, counted per service before dates are attached."""
    counts = _visit_counts()
    daily = (
        per_date(
            service_visits(feed).groupBy("service_id").agg(*counts.values()), feed, start, end
        )
        .groupBy("service_date")
        .agg(*[F.sum(name).alias(name) for name in counts])
    )
    measured = (
        analysis_days(feed, start, end)
        .join(daily, "service_date", "left")
        .select(
            "service_date",
            "source_start",
            "source_end",
            "calendar_covered",
            *[covered_or_null(name) for name in counts],
        )
    )
    return measured.select(
        "*",
        (F.col("total_events") - F.col("known_arrivals")).alias("missing_arrivals"),
        (F.col("total_events") - F.col("known_departures")).alias("missing_departures"),
        (F.col("regular_events") - F.col("regular_known_departures")).alias(
            "regular_missing_departures"
        ),
        ratio("known_arrivals", "total_events").alias("known_arrival_ratio"),
        ratio("known_departures", "total_events").alias("known_departure_ratio"),
        ratio("regular_known_departures", "regular_events").alias("known_regular_departure_ratio"),
    )


# The summed counts and the notes of the coverage summary.
SUMMED = (
    "total_events",
    "known_arrivals",
    "missing_arrivals",
    "known_departures",
    "missing_departures",
    "regular_events",
    "regular_known_departures",
    "regular_missing_departures",
    "no_pickup_events",
    "on_request_events",
    "approximate_timepoint_events",
)
COVERAGE_METHOD = (
    "min/max of calendar bounds and calendar_dates; not proof of complete feed validity"
)
TIME_AXIS = "service_date plus GTFS seconds; no UTC or DST wall-clock conversion"


def coverage_totals(coverage):
    """Range totals as one row; all-NULL totals when no day is covered."""
    return (
        coverage.agg(
            F.min("source_start").alias("start_date"),
            F.max("source_end").alias("end_date"),
            F.count("*").alias("requested_days"),
            F.count_if("calendar_covered").alias("covered_days"),
            F.count_if(~F.col("calendar_covered")).alias("outside_calendar_days"),
            *[F.sum(name).alias(name) for name in SUMMED],
        )
        .withColumn("known_departure_ratio", ratio("known_departures", "total_events"))
        .withColumn(
            "known_regular_departure_ratio", ratio("regular_known_departures", "regular_events")
        )
    )


def coverage_summary(coverage):
    """The range totals as one JSON document."""
    fields = [
        F.struct("start_date", "end_date").alias("calendar_envelope"),
        F.lit(COVERAGE_METHOD).alias("calendar_coverage_method"),
        "requested_days",
        "covered_days",
        "outside_calendar_days",
        *SUMMED,
        "known_departure_ratio",
        "known_regular_departure_ratio",
        F.lit(TIME_AXIS).alias("time_axis"),
    ]
    return coverage_totals(coverage).select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("coverage")
    )


def route_catalog(feed):
    """Routes with the name and zone of their agency."""
    agency = feed.agency.select("_agency_key", "agency_name", "agency_timezone")
    return feed.routes.join(agency, "_agency_key")


def stop_catalog(feed):
    return feed.stops


def source_context(feed, capabilities=None, quality_scope=None, time_coverage=None):
    """Agency zones and static facts an analysis records about its source; one row."""
    return feed.agency.agg(
        F.array_sort(F.collect_set("agency_timezone")).alias("agency_timezones")
    ).select(
        "agency_timezones",
        F.lit(quality_scope).cast("string").alias("static_silver_quality_scope"),
        F.lit(time_coverage).cast("string").alias("static_silver_time_coverage"),
        F.lit(capabilities).cast("string").alias("capabilities"),
    )


def row_counts(tables):
    """Rows per named table as one frame."""
    counted = [
        frame.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, frame in tables.items()
    ]
    result = counted[0]
    for frame in counted[1:]:
        result = result.unionByName(frame)
    return result
