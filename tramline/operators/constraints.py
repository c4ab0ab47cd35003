"""Rules a database would enforce, as assertions that count violations.

Spark tables do not enforce keys, references or checks, so they are counted on demand. Checks
of a table share one scan; keys and references are counted per key before any join.
"""

from pyspark.sql import functions as F

from .silver import union_all

GROUP_KEY = ("service_date", "route_id", "stop_id", "direction_id")

# Conditions every row must meet. A condition that is NULL counts as met.
CHECKS = {
    "agency": {
        "key known": "_agency_key IS NOT NULL",
        "texts known": "agency_name IS NOT NULL AND agency_url IS NOT NULL AND agency_timezone IS NOT NULL",
    },
    "stops": {
        "key known": "stop_id IS NOT NULL",
        "latitude": "stop_lat BETWEEN -90 AND 90",
        "longitude": "stop_lon BETWEEN -180 AND 180",
        "location type": "location_type IS NOT NULL AND location_type BETWEEN 0 AND 4",
    },
    "routes": {
        "key known": "route_id IS NOT NULL AND _agency_key IS NOT NULL",
        "route type": "route_type IS NOT NULL AND route_type >= 0",
    },
    "trips": {
        "key known": "trip_id IS NOT NULL AND route_id IS NOT NULL AND service_id IS NOT NULL",
        "direction": "direction_id IN (0, 1)",
    },
    "stop_times": {
        "key known": "trip_id IS NOT NULL AND stop_id IS NOT NULL",
        "sequence": "stop_sequence IS NOT NULL AND stop_sequence >= 0",
        "arrival": "arrival_seconds >= 0",
        "departure": "departure_seconds >= 0",
        "pickup": "pickup_type IS NOT NULL AND pickup_type BETWEEN 0 AND 3",
        "drop off": "drop_off_type IS NOT NULL AND drop_off_type BETWEEN 0 AND 3",
        "timepoint": "timepoint IS NOT NULL AND timepoint IN (0, 1)",
    },
    "calendar": {
        "flags": "monday IN (0, 1) AND tuesday IN (0, 1) AND wednesday IN (0, 1) AND thursday IN (0, 1)"
        " AND friday IN (0, 1) AND saturday IN (0, 1) AND sunday IN (0, 1)",
        "range": "start_date IS NOT NULL AND end_date IS NOT NULL AND start_date <= end_date",
    },
    "calendar_dates": {
        "exception": "date IS NOT NULL AND exception_type IS NOT NULL AND exception_type IN (1, 2)",
    },
    "analysis_days": {
        "state": "coverage_state IN ('within-calendar-envelope', 'outside-calendar-envelope')",
    },
    "route_daily": {
        "count": "trip_count >= 0",
        "zero or unknown": "calendar_covered = (trip_count IS NOT NULL)",
    },
    "stop_daily": {
        "count": "regular_known_departures >= 0 AND distinct_routes >= 0",
        "zero or unknown": "calendar_covered = (regular_known_departures IS NOT NULL)"
        " AND calendar_covered = (distinct_routes IS NOT NULL)",
    },
    "route_stop_hourly": {
        "direction": "direction_id IN (0, 1)",
        "hour": "service_hour >= 0",
        "count": "departure_count > 0 AND approximate_departures IS NOT NULL",
    },
    "route_stop_headways": {
        "direction": "direction_id IN (0, 1)",
        "count": "departure_count IS NOT NULL AND interval_count IS NOT NULL",
    },
    "service_span": {
        "direction": "direction_id IN (0, 1)",
        "count": "observation_count IS NOT NULL AND regular_event_count IS NOT NULL"
        " AND missing_regular_departures IS NOT NULL AND approximate_departures IS NOT NULL",
    },
}
# Columns that are unique together; NULL equals NULL.
UNIQUE = {
    "agency": ("_agency_key",),
    "stops": ("stop_id",),
    "routes": ("route_id",),
    "trips": ("trip_id",),
    "stop_times": ("trip_id", "stop_sequence"),
    "calendar": ("service_id",),
    "calendar_dates": ("service_id", "date"),
    "analysis_days": ("service_date",),
    "active_services": ("service_date", "service_id"),
    "route_daily": ("service_date", "route_id"),
    "stop_daily": ("service_date", "stop_id"),
    "route_stop_hourly": (*GROUP_KEY, "service_hour"),
    "route_stop_headways": GROUP_KEY,
    "service_span": GROUP_KEY,
    "coverage_daily": ("service_date",),
}
# Table, column, target table, target column.
FOREIGN = (
    ("stops", "parent_station", "stops", "stop_id"),
    ("routes", "_agency_key", "agency", "_agency_key"),
    ("trips", "route_id", "routes", "route_id"),
    ("trips", "service_id", "services", "service_id"),
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("stop_times", "stop_id", "stops", "stop_id"),
    ("active_services", "service_date", "analysis_days", "service_date"),
    ("active_services", "service_id", "services", "service_id"),
    ("route_daily", "service_date", "analysis_days", "service_date"),
    ("route_daily", "route_id", "routes", "route_id"),
    ("stop_daily", "service_date", "analysis_days", "service_date"),
    ("stop_daily", "stop_id", "stops", "stop_id"),
    ("route_stop_hourly", "route_id", "routes", "route_id"),
    ("route_stop_hourly", "stop_id", "stops", "stop_id"),
    ("route_stop_headways", "route_id", "routes", "route_id"),
    ("route_stop_headways", "stop_id", "stops", "stop_id"),
    ("service_span", "route_id", "routes", "route_id"),
    ("service_span", "stop_id", "stops", "stop_id"),
    ("coverage_daily", "service_date", "analysis_days", "service_date"),
)


def _row(frame, table, rule):
    return frame.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("violations")
    )


def check_violations(table, frame):
    """Rows that break a check, all checks of the table in one scan."""
    rules = CHECKS[table]
    counts = frame.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f"check: {rule}").alias("rule"),
                    F.count_if(F.expr(f"NOT ({text})")).alias("violations"),
                )
                for rule, text in rules.items()
            ]
        ).alias("results")
    )
    return counts.select(F.explode("results").alias("r")).select(
        F.lit(table).alias("table_name"), "r.rule", "r.violations"
    )


def unique_violations(table, frame):
    """Keys that occur more than once."""
    repeated = frame.groupBy(*UNIQUE[table]).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return _row(repeated.agg(F.count("*").alias("violations")), table, "unique")


def foreign_violations(table, column, frame, target, key):
    """Rows whose key is absent from the target, counted per key."""
    used = frame.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(
        F.count("*").alias("n")
    )
    missing = used.join(target.select(F.col(key).alias("key")).distinct(), "key", "left_anti")
    total = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return _row(total, table, f"references: {column}")


def check_constraints(tables):
    """Violations of every rule that applies to the given tables: (table, rule, violations)."""
    found = [check_violations(t, f) for t, f in tables.items() if t in CHECKS]
    found += [unique_violations(t, f) for t, f in tables.items() if t in UNIQUE]
    found += [
        foreign_violations(table, column, tables[table], tables[target], key)
        for table, column, target, key in FOREIGN
        if table in tables and target in tables
    ]
    return union_all(found)
