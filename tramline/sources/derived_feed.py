"""A timetable feed derived from the given tables; the input of every registered query.

The statements read the same in Spark SQL and DuckDB, so the SQL twins of the queries start
from the identical feed. ``g_`` views are typed and clean; ``r_`` views are raw text with
faults put into a share of the rows by CASE, never by dropping rows.
"""

from ..feed import Feed

BASE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def _stop(column):
    return f"lpad(CAST({column} AS STRING), 10, '0')"


def _clock(seconds):
    """H:MM:SS text of an integer expression, hours unbounded."""
    return (
        f"concat(CAST(CAST(floor(({seconds}) / 3600) AS BIGINT) AS STRING), ':', "
        f"lpad(CAST(CAST(floor(({seconds}) / 60) AS BIGINT) % 60 AS STRING), 2, '0'), ':', "
        f"lpad(CAST(({seconds}) % 60 AS STRING), 2, '0'))"
    )


def _compact_date(expression):
    return f"replace(CAST({expression} AS STRING), '-', '')"


_BASE = "18000 + (l_orderkey * 97) % 72000"
_CALENDAR_START = "DATE '2024-01-01' + CAST(c_custkey % 5 AS INT)"
_CALENDAR_END = "DATE '2024-01-11' + CAST(c_custkey % 20 AS INT)"
_EXCEPTION_DATE = "DATE '2024-01-01' + CAST(7 * (o_orderkey % 4) + o_orderkey % 3 AS INT)"
_FLAGS = {  # Thursday is never served: a covered day with zero service
    "monday": "c_custkey % 2",
    "tuesday": "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END",
    "wednesday": "1",
    "thursday": "0",
    "friday": "CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END",
    "saturday": "CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END",
    "sunday": "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END",
}
_SERVICE = (
    "CASE WHEN o_orderkey % 10 = 9 THEN concat('SX', o_custkey) ELSE concat('SV', o_custkey) END"
)

VIEWS = {
    "g_agency": """
        SELECT concat('A', s_suppkey) AS _agency_key, concat('A', s_suppkey) AS agency_id,
               s_name AS agency_name, 'https://agency.example/' AS agency_url,
               'Europe/Warsaw' AS agency_timezone, s_suppkey + 1 AS _source_record
        FROM {supplier}""",
    "g_routes": """
        SELECT concat('R', c_custkey) AS route_id, concat('A', c_nationkey % 5) AS agency_id,
               concat('A', c_nationkey % 5) AS _agency_key,
               CAST(c_nationkey AS STRING) AS route_short_name, c_name AS route_long_name,
               CAST(CASE WHEN c_custkey % 4 = 1 THEN 700 + c_custkey % 20
                         WHEN c_custkey % 4 = 2 THEN 900 + c_custkey % 10
                         WHEN c_custkey % 100 = 3 THEN 800
                         ELSE c_custkey % 13 END AS BIGINT) AS route_type,
               c_custkey + 1 AS _source_record
        FROM {customer}""",
    "g_stops": f"""
        SELECT {_stop("s_suppkey")} AS stop_id, s_name AS stop_name,
               CASE WHEN s_suppkey % 10 = 9 THEN NULL
                    ELSE CAST(51 AS DOUBLE) + (s_suppkey % 200) / CAST(1000 AS DOUBLE) END AS stop_lat,
               CASE WHEN s_suppkey % 10 = 9 THEN NULL
                    ELSE CAST(17 AS DOUBLE) + (s_suppkey % 300) / CAST(1000 AS DOUBLE) END AS stop_lon,
               CAST(CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS BIGINT) AS location_type,
               CAST(NULL AS STRING) AS parent_station, s_suppkey + 1 AS _source_record
        FROM {{supplier}}""",
    "g_trips": f"""
        SELECT concat('T', o_orderkey) AS trip_id, concat('R', o_custkey % 25) AS route_id,
               {_SERVICE} AS service_id,
               CAST(CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 3 END AS BIGINT)
                   AS direction_id,
               o_orderpriority AS trip_headsign,
               concat('{{{{"shape_id":"SH', o_orderkey % 50, '","variant_id":"',
                      CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('V', o_orderkey % 4) END,
                      '","vehicle_id":"', o_orderkey % 7, '","brigade_id":"', o_orderkey % 11,
                      '"}}}}') AS extra_fields,
               o_orderkey + 1 AS _source_record
        FROM {{orders}}""",
    "g_stop_times": f"""
        SELECT trip_id, stop_sequence, stop_id,
               CASE WHEN l_partkey % 11 = 0 THEN NULL
                    ELSE base + stop_sequence * 120 END AS arrival_seconds,
               CASE WHEN l_partkey % 11 IN (0, 5) THEN NULL
                    ELSE base + stop_sequence * 120 + 30 END AS departure_seconds,
               CAST(CASE l_partkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END
                   AS BIGINT) AS pickup_type,
               CAST(l_suppkey % 4 AS BIGINT) AS drop_off_type,
               CAST(CASE WHEN l_partkey % 11 IN (0, 5) OR l_linestatus = 'F' THEN 0 ELSE 1 END
                   AS BIGINT) AS timepoint
        FROM (SELECT trip_id, stop_id, l_partkey, l_suppkey, l_linestatus, base,
                     CAST(row_number() OVER (PARTITION BY trip_id
                         ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)
                         AS BIGINT) AS stop_sequence
              FROM (SELECT concat('T', l_orderkey) AS trip_id, {_stop("l_suppkey")} AS stop_id,
                           l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
                           l_linestatus, {_BASE} AS base
                    FROM {{lineitem}}) visits) numbered""",
    "g_calendar": f"""
        SELECT concat('SV', c_custkey) AS service_id,
               {", ".join(f"CAST({flag} AS BIGINT) AS {day}" for day, flag in _FLAGS.items())},
               {_CALENDAR_START} AS start_date, {_CALENDAR_END} AS end_date
        FROM {{customer}}""",
    "g_calendar_dates": f"""
        SELECT service_id, date, CAST(min(kind) AS BIGINT) AS exception_type
        FROM (SELECT {_SERVICE} AS service_id, {_EXCEPTION_DATE} AS date,
                     CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 10 = 9 THEN 1 ELSE 2 END AS kind
              FROM {{orders}}) exceptions
        GROUP BY service_id, date""",
    "g_shapes": """
        SELECT concat('SH', CAST(floor(p_partkey / 40) AS BIGINT)) AS shape_id,
               CAST(p_partkey % 40 AS BIGINT) AS shape_pt_sequence,
               CAST(51 AS DOUBLE) + p_size / CAST(1000 AS DOUBLE) AS latitude,
               CAST(17 AS DOUBLE) + p_partkey / CAST(100000000 AS DOUBLE) AS longitude
        FROM {part}""",
    "r_agency": """
        SELECT s_suppkey + 1 AS _source_record,
               CASE s_suppkey % 97 WHEN 3 THEN '' WHEN 4 THEN ' A4' WHEN 5 THEN 'A1'
                    ELSE concat('A', s_suppkey) END AS agency_id,
               CASE WHEN s_suppkey % 97 = 6 THEN '  ' ELSE s_name END AS agency_name,
               'https://agency.example/' AS agency_url,
               CASE s_suppkey % 97 WHEN 7 THEN 'Europe/Atlantis' WHEN 8 THEN 'Europe/Berlin'
                    ELSE 'Europe/Warsaw' END AS agency_timezone
        FROM {supplier}""",
    "r_stops": f"""
        SELECT s_suppkey + 1 AS _source_record,
               CASE s_suppkey % 97 WHEN 10 THEN '' WHEN 11 THEN concat(' ', s_suppkey)
                    WHEN 12 THEN {_stop(1)} ELSE {_stop("s_suppkey")} END AS stop_id,
               CASE WHEN s_suppkey % 97 IN (13, 20) THEN ' ' ELSE s_name END AS stop_name,
               CASE s_suppkey % 97 WHEN 14 THEN '91' WHEN 15 THEN 'NaN' WHEN 16 THEN ''
                    WHEN 17 THEN '5.1e1' WHEN 18 THEN '51d'
                    ELSE concat('51.', s_suppkey % 1000) END AS stop_lat,
               CASE s_suppkey % 97 WHEN 16 THEN '' WHEN 23 THEN '-180.5' WHEN 24 THEN 'Infinity'
                    ELSE concat('17.', s_suppkey % 1000) END AS stop_lon,
               CASE WHEN s_suppkey % 97 = 25 THEN '9' WHEN s_suppkey % 97 = 26 THEN '2'
                    WHEN s_suppkey % 97 IN (20, 27) THEN '4' WHEN s_suppkey % 10 = 9 THEN '1'
                    WHEN s_suppkey % 3 = 0 THEN '' ELSE '0' END AS location_type,
               CASE WHEN s_suppkey % 97 = 21 THEN 'ABSENT'
                    WHEN s_suppkey % 97 IN (22, 27, 29) THEN {_stop(9)}
                    WHEN s_suppkey % 97 IN (28, 30) THEN {_stop(2)}
                    ELSE '' END AS parent_station
        FROM {{supplier}}""",
    "r_routes": """
        SELECT c_custkey + 1 AS _source_record,
               CASE c_custkey % 97 WHEN 30 THEN '' WHEN 31 THEN 'R1'
                    ELSE concat('R', c_custkey) END AS route_id,
               CASE c_custkey % 97 WHEN 32 THEN '' WHEN 33 THEN 'ABSENT'
                    ELSE concat('A', c_nationkey % 5) END AS agency_id,
               CASE WHEN c_custkey % 97 IN (34, 35) THEN ''
                    ELSE CAST(c_nationkey AS STRING) END AS route_short_name,
               CASE WHEN c_custkey % 97 = 34 THEN ' ' ELSE c_name END AS route_long_name,
               CASE c_custkey % 97 WHEN 36 THEN 'x' WHEN 37 THEN '' WHEN 38 THEN '0003'
                    WHEN 39 THEN '9223372036854775808' WHEN 40 THEN ' 3' WHEN 41 THEN '-1'
                    ELSE CAST(c_custkey % 13 AS STRING) END AS route_type
        FROM {customer}""",
    "r_trips": f"""
        SELECT o_orderkey + 1 AS _source_record,
               CASE o_orderkey % 97 WHEN 40 THEN concat(' T', o_orderkey) WHEN 41 THEN 'T1'
                    ELSE concat('T', o_orderkey) END AS trip_id,
               CASE o_orderkey % 97 WHEN 42 THEN 'ABSENT' WHEN 43 THEN ''
                    ELSE concat('R', o_custkey % 25) END AS route_id,
               CASE WHEN o_orderkey % 97 = 44 THEN 'SV-ABSENT' ELSE {_SERVICE} END AS service_id,
               CASE WHEN o_orderkey % 97 = 45 THEN '3' WHEN o_orderkey % 3 = 2 THEN ''
                    ELSE CAST(o_orderkey % 3 AS STRING) END AS direction_id,
               o_orderpriority AS trip_headsign,
               concat('SH', o_orderkey % 50) AS shape_id,
               CASE o_orderkey % 97 WHEN 46 THEN ' V1' WHEN 47 THEN ''
                    ELSE concat('V', o_orderkey % 7) END AS vehicle_id,
               CAST(o_orderkey % 11 AS STRING) AS brigade_note
        FROM {{orders}}""",
    "r_stop_times": f"""
        SELECT _source_record,
               CASE WHEN fault = 4 THEN 'T-ABSENT' ELSE concat('T', l_orderkey) END AS trip_id,
               CASE WHEN fault = 1 THEN concat(' ', l_suppkey) WHEN fault = 9 THEN 'S-ABSENT'
                    ELSE {_stop("l_suppkey")} END AS stop_id,
               CASE WHEN fault = 2 THEN '1.0'
                    ELSE CAST(l_linenumber AS STRING) END AS stop_sequence,
               CASE WHEN fault = 0 THEN '8:60:00' WHEN l_partkey % 11 = 0 THEN ''
                    ELSE {_clock("base + l_linenumber * 120")} END AS arrival_time,
               CASE WHEN l_partkey % 11 IN (0, 5) THEN '' WHEN fault = 5 THEN {_clock("base")}
                    ELSE {_clock("base + l_linenumber * 120 + 30")} END AS departure_time,
               CASE WHEN fault = 3 THEN '4' WHEN fault = 6 THEN ''
                    ELSE CAST(l_partkey % 4 AS STRING) END AS pickup_type,
               CASE WHEN fault = 7 THEN '4' ELSE CAST(l_suppkey % 4 AS STRING) END AS drop_off_type,
               CASE WHEN fault = 8 THEN '3' WHEN l_partkey % 11 = 0 THEN '0'
                    WHEN l_partkey % 11 = 5 THEN '1' ELSE '' END AS timepoint,
               CASE WHEN fault = 10 THEN 'G1' ELSE '' END AS location_group_id,
               CASE WHEN fault = 11 THEN '08:00:00' ELSE '' END AS start_pickup_drop_off_window
        FROM (SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS _source_record,
                     l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 97 AS fault,
                     {_BASE} AS base
              FROM {{lineitem}}) visits""",
    "r_calendar": f"""
        SELECT c_custkey + 1 AS _source_record,
               CASE WHEN c_custkey % 97 = 50 THEN 'SV1' ELSE concat('SV', c_custkey) END AS service_id,
               {", ".join(
                   f"CASE WHEN c_custkey % 97 = {51 + i} THEN '2' ELSE CAST({flag} AS STRING) END AS {day}"
                   for i, (day, flag) in enumerate(_FLAGS.items())
               )},
               CASE c_custkey % 97 WHEN 60 THEN '20260230' WHEN 61 THEN '2024-01-01'
                    ELSE {_compact_date(_CALENDAR_START)} END AS start_date,
               CASE WHEN c_custkey % 97 = 62 THEN '20230930'
                    ELSE {_compact_date(_CALENDAR_END)} END AS end_date
        FROM {{customer}}""",
    "r_calendar_dates": f"""
        SELECT o_orderkey + 1 AS _source_record, {_SERVICE} AS service_id,
               CASE WHEN o_orderkey % 97 = 70 THEN '2024' ELSE {_compact_date(_EXCEPTION_DATE)}
               END AS date,
               CASE WHEN o_orderkey % 97 = 71 THEN '3' WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2'
               END AS exception_type
        FROM {{orders}}""",
    "r_frequencies": """
        SELECT event_id + 1 AS _source_record, concat('T', user_id) AS trip_id,
               '08:00:00' AS start_time, '09:00:00' AS end_time,
               CAST(event_id % 600 + 60 AS STRING) AS headway_secs
        FROM {events}""",
    "r_positions": """
        SELECT event_id AS observation_id,
               CASE WHEN user_id % 50 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS vehicle_id,
               CASE WHEN event_id % 40 = 7 THEN '' ELSE CAST(user_id % 25 AS STRING) END AS line,
               CASE event_type WHEN 'error' THEN '0' WHEN 'view' THEN concat('51,', event_id % 100)
                    WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'NaN' ELSE '900' END
                    ELSE concat('51.', event_id % 100) END AS latitude,
               CASE WHEN event_type = 'error' THEN '0'
                    ELSE concat('17.', event_id % 100) END AS longitude,
               concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'),
                      CASE WHEN event_type = 'purchase' THEN '' WHEN event_id % 2 = 0 THEN '+00:00'
                           ELSE '+02:00' END) AS measured_at
        FROM {events}""",
}


def view(spark, sf_dir, name):
    """One derived table as a DataFrame over the parquet files in ``sf_dir``."""
    text = VIEWS[name]
    tables = {
        base: spark.read.parquet(f"{sf_dir}/{base}.parquet")
        for base in BASE_TABLES
        if "{" + base + "}" in text
    }
    return spark.sql(text, **tables)


def clean_feed(spark, sf_dir):
    names = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates")
    return Feed(
        **{name: view(spark, sf_dir, f"g_{name}") for name in names},
        shapes=view(spark, sf_dir, "g_shapes"),
    )


def raw_tables(spark, sf_dir):
    names = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates")
    return {name: view(spark, sf_dir, f"r_{name}") for name in names}
