"""Report queries over the KPI tables, each over a closed date range within the analysis.

Where a screen would ask for one route and stop, the functions here answer for all of them at
once and take the ids as optional filters.
"""

from pyspark.sql import functions as F

from ..feed import service_range
from .gold import covered_or_null
from .service_calendar import dates_between

# Choices of the direction filter, usual lengths of top lists and of the hour profile.
DIRECTIONS = ("ALL", "NULL", "0", "1")
TOP = 20
BUSIEST_HOURS = 200


class TooManyRows(ValueError):
    """A view holds more rows than it may show."""


def direction_predicate(choice):
    """Direction filter; NULL is a direction of its own and ALL keeps every row."""
    if choice not in DIRECTIONS:
        raise ValueError(f"unknown direction {choice}")
    if choice == "ALL":
        return F.lit(True)
    if choice == "NULL":
        return F.col("direction_id").isNull()
    return F.col("direction_id") == int(choice)


def in_range(table, start, end):
    first, last = service_range(start, end)
    return table.filter(F.col("service_date").between(F.lit(first), F.lit(last)))


def check_range(analysis, start, end):
    """A report range must lie inside its analysis."""
    first, last = service_range(start, end)
    if first < analysis.start or last > analysis.end:
        raise ValueError("the date filter must lie inside the analysis")
    return first, last


def group_filter(table, route=None, stop=None, direction="ALL"):
    """Narrow a group table to a route, a stop and a direction where given."""
    if route is not None:
        table = table.filter(F.col("route_id") == route)
    if stop is not None:
        table = table.filter(F.col("stop_id") == stop)
    return table.filter(direction_predicate(direction))


def bounded_fetch(frame, limit):
    """The frame itself if it has at most ``limit`` rows, an error otherwise; never cut.

    The caller names the limit. One row more than it is looked for, not all of them.
    """
    if len(frame.limit(limit + 1).select(F.lit(1)).collect()) > limit:
        raise TooManyRows(f"more than {limit} rows; narrow the dates or filters")
    return frame


# Measures of the overview and the coverage columns they sum.
OVERVIEW_SUMS = {
    "departures": "regular_known_departures",
    "regular_events": "regular_events",
    "total_events": "total_events",
    "missing_departures": "missing_departures",
    "no_pickup_events": "no_pickup_events",
    "on_request_events": "on_request_events",
    "approximate_departures": "approximate_regular_departures",
}


def overview(days, coverage, route_daily, span, stops, start, end):
    """Headline numbers; routes and stops are counted distinct over the whole period."""
    period = in_range(days, start, end).agg(
        F.sum("trip_instances").alias("trips"),
        F.count_if("calendar_covered").alias("covered_days"),
        F.count("*").alias("requested_days"),
        F.max("calendar_covered").alias("any_covered"),
    )
    sums = in_range(coverage, start, end).agg(
        F.struct(*[F.sum(column).alias(name) for name, column in OVERVIEW_SUMS.items()])
    )
    routes = in_range(route_daily, start, end).filter(F.col("trip_count") > 0)
    active_routes = routes.agg(F.count_distinct("route_id")).scalar()
    served_stops = in_range(span, start, end).agg(F.count_distinct("stop_id")).scalar()
    return period.withColumn("sums", sums.scalar()).select(
        "trips",
        "sums.*",
        "covered_days",
        "requested_days",
        F.when(F.col("any_covered"), active_routes).alias("active_routes"),
        F.when(F.col("any_covered"), served_stops).alias("served_stops"),
        stops.agg(F.count("*")).scalar().alias("catalog_stops"),
    )


def _top(daily, catalog, key, label, measure, alias, start, end, top):
    """Sum per key first, so only one row per key meets the catalog."""
    totals = in_range(daily, start, end).groupBy(key).agg(F.sum(measure).alias(alias))
    return (
        totals.join(catalog.select(key, label), key)
        .orderBy(F.desc_nulls_last(alias), key)
        .limit(top)
        .select(key, label, alias)
    )


def top_routes(route_daily, routes, start, end, top=TOP):
    return _top(route_daily, routes, "route_id", "route_short_name", "trip_count", "trips", start, end, top)


def top_stops(stop_daily, stops, start, end, top=TOP):
    return _top(
        stop_daily, stops, "stop_id", "stop_name", "regular_known_departures", "departures", start, end, top
    )


def hourly_profile(hourly, start, end):
    """Departures per service hour of the whole network."""
    return (
        in_range(hourly, start, end)
        .groupBy("service_hour")
        .agg(F.sum("departure_count").alias("departures"))
        .orderBy("service_hour")
    )


def busiest_hours(profile, limit=BUSIEST_HOURS):
    """The hours with most departures, shown in hour order."""
    return (
        profile.orderBy(F.desc("departures"), "service_hour").limit(limit).orderBy("service_hour")
    )


# The columns the coverage view shows.
COVERAGE_VIEW = (
    "service_date",
    "calendar_covered",
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
    "approximate_regular_departures",
    "known_regular_departure_ratio",
)


def coverage_view(coverage, start, end):
    return in_range(coverage, start, end).select(*COVERAGE_VIEW).orderBy("service_date")


def filter_routes(routes):
    """Routes a report can be narrowed to."""
    return routes.select("route_id", "route_short_name", "route_long_name").orderBy(
        "route_short_name", "route_id"
    )


def filter_stops(span, stops, start, end, route=None):
    """Stops served by each route (or one) in the range."""
    served = group_filter(in_range(span, start, end), route).select("route_id", "stop_id").distinct()
    return served.join(stops.select("stop_id", "stop_name"), "stop_id")


def filter_directions(span, start, end, route=None, stop=None):
    """Directions seen per route and stop, the unknown one first."""
    return (
        group_filter(in_range(span, start, end), route, stop)
        .select("route_id", "stop_id", "direction_id")
        .distinct()
        .orderBy("route_id", "stop_id", F.asc_nulls_first("direction_id"))
    )


def group_daily(days, span, start, end, route=None, stop=None, direction="ALL"):
    """Every date for each route and stop: sums, first and last departure.

    With both ids given the group is shown even if it was never served. Dates are attached to
    a group by the range itself; the covered marks, one row per date of the range and so never
    more than its days, are broadcast.
    """
    first, last = service_range(start, end)
    spans = group_filter(in_range(span, first, last), route, stop, direction)
    if route is not None and stop is not None:
        groups = span.sparkSession.createDataFrame(
            [(route, stop)], "route_id string, stop_id string"
        )
    else:
        groups = group_filter(in_range(span, first, last), route, stop).select(
            "route_id", "stop_id"
        ).distinct()
    sums = spans.groupBy("service_date", "route_id", "stop_id").agg(
        F.sum("observation_count").alias("departures"),
        F.sum("regular_event_count").alias("regular_events"),
        F.sum("missing_regular_departures").alias("missing"),
        F.sum("approximate_departures").alias("approximate"),
        F.min("first_departure_seconds").alias("first_seconds"),
        F.max("last_departure_seconds").alias("last_seconds"),
    )
    marks = F.broadcast(in_range(days, first, last).select("service_date", "calendar_covered"))
    return (
        groups.withColumn("service_date", F.explode(dates_between(first, last)))
        .join(sums, ["service_date", "route_id", "stop_id"], "left")
        .join(marks, "service_date")
        .select(
            "service_date",
            "route_id",
            "stop_id",
            "calendar_covered",
            *[covered_or_null(n) for n in ("departures", "regular_events", "missing", "approximate")],
            "first_seconds",
            "last_seconds",
        )
    )


def group_hourly(hourly, start, end, route=None, stop=None, direction="ALL"):
    """Departures per service hour within each route and stop."""
    return (
        group_filter(in_range(hourly, start, end), route, stop, direction)
        .groupBy("route_id", "stop_id", "service_hour")
        .agg(F.sum("departure_count").alias("departures"))
    )


def group_headways(headways, start, end, route=None, stop=None, direction="ALL"):
    """Headway rows of each route and stop by date, unknown direction first."""
    return (
        group_filter(in_range(headways, start, end), route, stop, direction)
        .select(
            "service_date", "route_id", "stop_id", "direction_id", "departure_count",
            "interval_count", "avg_seconds", "median_seconds", "p90_seconds",
        )
        .orderBy("route_id", "stop_id", "service_date", F.asc_nulls_first("direction_id"))
    )


def direction_totals(span):
    """Groups and departures each choice of the direction filter selects."""
    marked = span.withColumn(
        "choice",
        F.explode(
            F.array_compact(
                F.array(*[F.when(direction_predicate(c), F.lit(c)) for c in DIRECTIONS])
            )
        ),
    )
    return marked.groupBy("choice").agg(
        F.count("*").alias("group_rows"), F.sum("observation_count").alias("departures")
    )


def period_event_totals(coverage, start, end):
    return in_range(coverage, start, end).agg(
        F.sum("total_events").alias("visits"),
        F.sum("regular_known_departures").alias("regular_departures"),
        F.sum("no_pickup_events").alias("no_pickup"),
        F.sum("on_request_events").alias("on_request"),
        F.sum("missing_departures").alias("missing_departures"),
    )


def shape_counts(shapes):
    """Points and distinct shapes; points are summed per shape before counting."""
    return shapes.groupBy("shape_id").agg(F.count("*").alias("points")).agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.count("*").alias("shapes")
    )
