"""Trip instances, stop events and regular departures.

A trip carries the array of its dates through the join with ``stop_times``; the array is
expanded only afterwards, so the big join handles each visit once however long the range is.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .service_calendar import active_services, service_dates

# Pickup codes of the timetable format.
REGULAR = 0
NO_PICKUP = 1
ON_REQUEST = (2, 3)

GROUP = ["service_date", "route_id", "stop_id", "direction_id"]


class LimitExceeded(ValueError):
    """The estimated work lies over a limit the caller set."""


def dated_trips(feed, start, end):
    """Running trips, one row each, with the array of their dates."""
    trips = feed.trips.select("trip_id", "route_id", "service_id", "direction_id")
    return trips.join(service_dates(feed, start, end), "service_id")


def trip_instances(feed, start, end):
    """One row per date and running trip."""
    return dated_trips(feed, start, end).select(
        F.explode("service_dates").alias("service_date"),
        "trip_id",
        "route_id",
        "service_id",
        "direction_id",
    )


def stop_events(feed, start, end):
    """One row per date and visit of a running trip."""
    visits = feed.stop_times.select(
        "trip_id", "stop_id", "stop_sequence", "arrival_seconds", "departure_seconds",
        "pickup_type", "timepoint",
    )
    return (
        visits.join(dated_trips(feed, start, end), "trip_id")
        .withColumn("service_date", F.explode("service_dates"))
        .drop("service_dates", "service_id")
    )


def is_regular_departure():
    """Regular pickup with a known departure; missing times are never filled in."""
    return (F.col("pickup_type") == REGULAR) & F.col("departure_seconds").isNotNull()


def service_visits(feed):
    """Visits with the service of their trip, before any date is attached."""
    return feed.stop_times.join(feed.trips.select("trip_id", "service_id"), "trip_id")


def per_date(counts, feed, start, end):
    """Spread counts kept per service over the dates the service runs."""
    return counts.join(service_dates(feed, start, end), "service_id").withColumn(
        "service_date", F.explode("service_dates")
    ).drop("service_dates")


def estimate(feed, start, end):
    """Events, instances and grid rows an analysis would make, without making them."""
    dates = service_dates(feed, start, end)
    visits = service_visits(feed).groupBy("service_id").agg(F.count("*").alias("visits"))
    trips = feed.trips.groupBy("service_id").agg(F.count("*").alias("trips"))
    days = F.size(F.col("service_dates")).cast("long")
    totals = (
        trips.join(dates, "service_id")
        .join(visits, "service_id", "left")
        .agg(
            F.coalesce(F.sum(F.coalesce("visits", F.lit(0)) * days), F.lit(0)).alias("events"),
            F.coalesce(F.sum(F.col("trips") * days), F.lit(0)).alias("instances"),
        )
    )
    routes = feed.routes.agg(F.count("*")).scalar()
    platforms = feed.stops.agg(F.count_if(F.col("location_type") == 0)).scalar()
    requested = (end - start).days + 1
    return totals.withColumn("grid_rows", F.lit(requested).cast("long") * (routes + platforms))


def over(value, limit):
    return limit is not None and value > limit


def estimate_guard(feed, start, end, max_days=None, max_events=None, max_grid_rows=None):
    """Refuse an analysis over the limits the caller sets; returns the estimate as a one-row frame."""
    if max_days is not None and (end - start).days + 1 > max_days:
        raise LimitExceeded(f"the range has more than {max_days} days")
    found = estimate(feed, start, end)
    if max_events is None and max_grid_rows is None:
        return found
    row = found.first()
    if over(max(row.events, row.instances), max_events) or over(row.grid_rows, max_grid_rows):
        raise LimitExceeded(
            f"events={row.events}, instances={row.instances}, grid_rows={row.grid_rows}"
        )
    return found


def regular_departures(feed, start, end):
    """Events with a regular, known departure."""
    return stop_events(feed, start, end).filter(is_regular_departure())


def with_measures(events):
    """Events as additive measures per departure second.

    ``departure`` is the second of a regular known departure and NULL for every other visit,
    so a group of (``GROUP``, departure) can be summed up in any order and any number of steps.
    """
    return events.select(
        *GROUP,
        F.when(F.col("pickup_type") == REGULAR, F.col("departure_seconds")).alias("departure"),
        (F.col("pickup_type") == REGULAR).cast("long").alias("regular"),
        is_regular_departure().cast("long").alias("departures"),
        (is_regular_departure() & (F.col("timepoint") == 0)).cast("long").alias("approximate"),
    )


def departure_profile(feed, start, end):
    """Measures summed per (``GROUP``, departure second).

    However many visits a busy group has, it holds at most one row per second of its service
    day (and one for visits without a departure) after this step, which map-side aggregation
    reaches before the shuffle.
    """
    return (
        with_measures(stop_events(feed, start, end))
        .groupBy(*GROUP, "departure")
        .agg(*[F.sum(name).alias(name) for name in ("regular", "departures", "approximate")])
    )


def headway_gaps(profile, *before):
    """Add the gap to the previous departure second of the group (NULL for the first).

    ``before`` are columns that follow from the group's own; groups are told apart by them first.
    """
    order = Window.partitionBy(*before, *GROUP).orderBy(F.col("departure").asc_nulls_first())
    return profile.withColumn("gap", F.col("departure") - F.lag("departure").over(order))


def headway_intervals(profile):
    """Multiset of headways per group: (gap, how often).

    n departures in the same second make n-1 zero gaps besides the gap to the second before.
    """
    gaps = headway_gaps(profile.filter(F.col("departure").isNotNull()))
    pair = F.struct(F.col("gap").alias("gap"), F.lit(1).cast("long").alias("times"))
    zeros = F.struct(F.lit(0).cast("long").alias("gap"), (F.col("departures") - 1).alias("times"))
    return (
        gaps.select(
            *GROUP,
            F.explode(
                F.filter(F.array(pair, zeros), lambda x: x.gap.isNotNull() & (x.times > 0))
            ).alias("interval"),
        )
        .select(*GROUP, "interval.gap", "interval.times")
        .groupBy(*GROUP, "gap")
        .agg(F.sum("times").alias("times"))
        .withColumnRenamed("gap", "headway_seconds")
    )


def running_services_on(feed, day):
    """Services of a single date: the same rule over a one-day range."""
    return active_services(feed, day, day).select("service_id")
