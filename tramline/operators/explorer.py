"""Trips of one service day: routes, variants, visits, geometry and departures.

Every function answers for the whole day; ids narrow the result where given. The output is
ordered only when it is narrowed to one trip, variant or stop, as a screen would show it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from .events import running_services_on
from .service_calendar import DAYS

# Visits are numbered within blocks of this many sequence numbers, so a very long trip is
# spread over many tasks.
BLOCK = 4096

EXTRAS = "shape_id string, variant_id string, vehicle_id string, brigade_id string"

VISIT_COLUMNS = (
    "trip_id", "stop_id", "stop_sequence", "arrival_seconds", "departure_seconds", "pickup_type",
    "drop_off_type", "timepoint",
)


def routes_view(feed):
    agency = feed.agency.select("_agency_key", "agency_name")
    return feed.routes.join(agency, "_agency_key").select(
        "route_id", "agency_id", "agency_name", "route_short_name", "route_long_name", "route_type"
    )


def stops_view(feed):
    return feed.stops.select("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type")


def calendar_view(feed):
    return feed.calendar.select("service_id", *DAYS, "start_date", "end_date")


def calendar_dates_view(feed):
    return feed.calendar_dates.select("service_id", "date", "exception_type")


def stop_times_view(feed):
    return feed.stop_times.select(*VISIT_COLUMNS)


def positioned_visits(visits):
    """Add ``position``, the 1-based place of a visit in its trip.

    Visits are numbered within blocks of the sequence axis; a block starts after the visits of
    the earlier blocks of its trip, which are counted by a grouped count.
    """
    blocks = visits.withColumn("_block", labels.whole_div(F.col("stop_sequence"), BLOCK))
    earlier = (
        Window.partitionBy("trip_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocks.groupBy("trip_id", "_block")
        .agg(F.count("*").alias("_visits"))
        .select("trip_id", "_block", F.sum("_visits").over(earlier).alias("_before"))
        .filter(F.col("_before").isNotNull())
    )
    within = Window.partitionBy("trip_id", "_block").orderBy("stop_sequence")
    return (
        blocks.join(offsets, ["trip_id", "_block"], "left")
        .withColumn(
            "position", F.row_number().over(within) + F.coalesce("_before", F.lit(0).cast("long"))
        )
        .drop("_block", "_before")
    )


def _hash_lane(digest, start):
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def stop_patterns(stop_times):
    """Per trip: first and last known time and a fingerprint of its ordered stops.

    The fingerprint combines hashes of (position, stop) with XOR. Positions do not repeat in a
    trip, so equal fingerprints mean equal stop lists, and no list has to be gathered.
    """
    visits = stop_times.select(
        "trip_id", "stop_id", "stop_sequence", "arrival_seconds", "departure_seconds"
    )
    digest = F.md5(F.concat_ws(":", F.col("position").cast("string"), F.col("stop_id")))
    hashed = positioned_visits(visits).withColumn("_digest", digest)
    return (
        hashed.groupBy("trip_id")
        .agg(
            F.min_by(F.coalesce("departure_seconds", "arrival_seconds"), "stop_sequence").alias(
                "start_seconds"
            ),
            F.max_by(F.coalesce("arrival_seconds", "departure_seconds"), "stop_sequence").alias(
                "end_seconds"
            ),
            F.count("*").alias("visit_count"),
            F.bit_xor(_hash_lane(F.col("_digest"), 1)).alias("_low"),
            F.bit_xor(_hash_lane(F.col("_digest"), 16)).alias("_high"),
        )
        .withColumn("stop_pattern", F.concat_ws(":", "visit_count", "_low", "_high"))
        .drop("_low", "_high", "visit_count")
    )


def marked(value):
    """Text in which NULL and the empty string differ."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def trip_patterns(feed, trips=None):
    """Trips with their source extras, first and last time and the key of their variant.

    ``trips`` narrows the work to some trips of the feed. A trip without visits stays, with
    NULL times.
    """
    stop_times = feed.stop_times
    if trips is None:
        trips = feed.trips
    else:
        stop_times = stop_times.join(trips.select("trip_id"), "trip_id", "left_semi")
    extras = F.from_json("extra_fields", EXTRAS)
    parts = [
        F.col("direction_id"), F.col("trip_headsign"), F.col("_extras.shape_id"),
        F.col("_extras.variant_id"), F.col("stop_pattern"),
    ]
    return (
        trips.withColumn("_extras", extras)
        .join(stop_patterns(stop_times), "trip_id", "left")
        .select(
            "trip_id",
            "route_id",
            "service_id",
            "direction_id",
            "trip_headsign",
            F.nullif("_extras.shape_id", F.lit("")).alias("shape_id"),
            F.nullif("_extras.variant_id", F.lit("")).alias("source_variant_id"),
            F.col("_extras.vehicle_id").alias("scheduled_vehicle_type_id"),
            F.col("_extras.brigade_id").alias("scheduled_brigade_id"),
            "start_seconds",
            "end_seconds",
            F.md5(F.concat_ws("|", *[marked(part) for part in parts])).alias("variant_key"),
        )
    )


def active_trips(feed, day, route=None, trip=None):
    """Trips running on a day."""
    trips = feed.trips
    if route is not None:
        trips = trips.filter(F.col("route_id") == route)
    if trip is not None:
        trips = trips.filter(F.col("trip_id") == trip)
    return trips.join(running_services_on(feed, day), "service_id", "left_semi")


def list_routes(feed):
    return routes_view(feed).orderBy("route_short_name", "agency_id", "route_id")


def with_route_label(routes):
    """Routes with the label shown for them; routes that share a name also show their ids."""
    named = routes.withColumn("_name", labels.route_main_name())
    shared = named.groupBy("_name").agg(F.count("*").alias("_routes"))
    return named.join(shared, "_name").select(
        *routes.columns, labels.route_label(F.col("_routes") > 1).alias("route_label")
    )


def route_search(routes, mode=labels.ALL_MODES, text=""):
    """Routes of a mode whose label or long name contains the text in any case."""
    labelled = with_route_label(routes)
    haystack = labels.fold_case(F.concat("route_label", F.lit(" "), "route_long_name"))
    found = labelled.filter(F.contains(haystack, labels.fold_case(F.lit(text))))
    if mode != labels.ALL_MODES:
        found = found.filter(labels.transport_mode(F.col("route_type")) == mode)
    return found


def active_routes(feed, day):
    """Routes with at least one trip on a day."""
    return active_trips(feed, day).select("route_id").distinct()


def variants(feed, day, route=None):
    """Variants of each route (or one) on a day, with their trips and first start."""
    grouped = (
        trip_patterns(feed, active_trips(feed, day, route))
        .groupBy(
            "route_id", "variant_key", "trip_headsign", "direction_id", "shape_id",
            "source_variant_id",
        )
        .agg(F.count("*").alias("trip_count"), F.min("start_seconds").alias("first_seconds"))
    )
    if route is None:
        return grouped
    return grouped.orderBy(
        F.asc_nulls_first("direction_id"), F.asc_nulls_last("first_seconds"), "variant_key"
    )


def variant_trips(feed, day, route=None, variant=None):
    """Trips of each variant (or one) on a day."""
    trips = trip_patterns(feed, active_trips(feed, day, route))
    if variant is None:
        return trips
    return trips.filter(F.col("variant_key") == variant).orderBy(
        F.asc_nulls_last("start_seconds"), "trip_id"
    )


def trip_visits(feed, day, route=None, trip=None):
    """Visits of trips running on a day with their stops; repeated visits are kept."""
    trips = active_trips(feed, day, route, trip).select("trip_id")
    visits = feed.stop_times.select(*VISIT_COLUMNS).join(trips, "trip_id", "left_semi")
    shown = visits.join(stops_view(feed), "stop_id")
    return shown if trip is None else shown.orderBy("stop_sequence")


def trip_geometry(feed, day, route=None, trip=None):
    """Points of the shapes that trips running on a day follow, once per shape."""
    extras = F.from_json("extra_fields", "shape_id string")
    used = (
        active_trips(feed, day, route, trip)
        .select(F.nullif(extras["shape_id"], F.lit("")).alias("shape_id"))
        .filter(F.col("shape_id").isNotNull())
        .distinct()
    )
    points = feed.shapes.select("shape_id", "shape_pt_sequence", "latitude", "longitude")
    found = points.join(used, "shape_id", "left_semi")
    return found if trip is None else found.orderBy("shape_pt_sequence")


def stop_departures(feed, day, route=None, stop=None):
    """All visits by route and stop on a day with their trip."""
    trips = trip_patterns(feed, active_trips(feed, day, route)).select(
        "trip_id", "route_id", "trip_headsign", "direction_id", "variant_key"
    )
    visits = feed.stop_times.select(
        "trip_id", "stop_id", "stop_sequence", "arrival_seconds", "departure_seconds",
        "pickup_type", "timepoint",
    )
    if stop is not None:
        visits = visits.filter(F.col("stop_id") == stop)
    shown = visits.join(trips, "trip_id")
    if stop is None:
        return shown
    return shown.orderBy(F.asc_nulls_last("departure_seconds"), "trip_id", "stop_sequence")


def first_known_departure(feed, day):
    """Departures and the first known one by route and stop."""
    trips = active_trips(feed, day).select("trip_id", "route_id")
    return (
        feed.stop_times.select("trip_id", "stop_id", "departure_seconds")
        .join(trips, "trip_id")
        .groupBy("route_id", "stop_id")
        .agg(F.count("*").alias("visits"), F.min("departure_seconds").alias("first_seconds"))
        .withColumn("first_time", labels.service_time(F.col("first_seconds")))
    )


def timetable_view(visits):
    """Visits with times and codes written out."""
    return visits.select(
        "trip_id",
        "stop_sequence",
        "stop_name",
        "stop_id",
        labels.service_time(F.col("arrival_seconds")).alias("arrival"),
        labels.service_time(F.col("departure_seconds")).alias("departure"),
        labels.boarding_label(F.col("pickup_type")).alias("boarding"),
        labels.timepoint_label(F.col("timepoint")).alias("time_kind"),
    )


def stop_markers(visits, selected=None):
    """One marker per trip and stop with usable coordinates; the last visit wins."""
    usable = F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull()
    for name in ("stop_lat", "stop_lon"):
        usable &= ~F.isnan(name) & (F.abs(F.col(name)) != F.lit(float("inf")))
    last = F.max_by(F.struct("stop_lat", "stop_lon", "stop_name"), "stop_sequence")
    return (
        visits.filter(usable)
        .groupBy("trip_id", "stop_id")
        .agg(last.alias("_last"))
        .select(
            "trip_id",
            "stop_id",
            F.col("_last.stop_lat").alias("latitude"),
            F.col("_last.stop_lon").alias("longitude"),
            F.concat("_last.stop_name", F.lit("\nstop_id="), "stop_id").alias("label"),
            F.coalesce(F.col("stop_id") == F.lit(selected).cast("string"), F.lit(False)).alias(
                "selected"
            ),
        )
    )


def trip_summary(visits):
    """First and last stop of each trip and how many visits it makes."""
    return visits.groupBy("trip_id").agg(
        F.min_by("stop_name", "stop_sequence").alias("first_stop"),
        F.max_by("stop_name", "stop_sequence").alias("last_stop"),
        F.count("*").alias("visits"),
    )
