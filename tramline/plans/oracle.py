"""DuckDB twins of the registered queries, written as plain row-level SQL."""

from .oracle_quality import quality_twins
from .params import END, NOW, START
from .sql_parts import CTES, REPORT_RANGE, compose, cte

SELECTS = {}


def twin(name, select):
    SELECTS[name] = select


def rounded(*names):
    return ", ".join(f"round({name}, 6) AS {name}" for name in names)


# Calendar, events and KPI tables -----------------------------------------------------------
twin("calendar_envelope", "SELECT * FROM q_envelope")
twin("analysis_days_domain", "SELECT * FROM q_days")
twin("active_services", "SELECT * FROM q_services")
twin("services_catalog", """
    SELECT service_id FROM g_calendar UNION SELECT service_id FROM g_calendar_dates""")
twin("trip_instances", "SELECT * FROM q_instances")
twin("estimate_guard", """
    SELECT CAST((SELECT coalesce(sum(c.n), 0) FROM q_instances i
                 JOIN (SELECT trip_id, count(*) AS n FROM g_stop_times GROUP BY 1) c
                   ON c.trip_id = i.trip_id) AS BIGINT) AS events,
           (SELECT count(*) FROM q_instances) AS instances,
           (SELECT count(*) FROM q_days) * ((SELECT count(*) FROM g_routes)
             + (SELECT count(*) FROM g_stops WHERE location_type = 0)) AS grid_rows""")
twin("stop_events", "SELECT * FROM q_events")
twin("regular_departures", "SELECT * FROM q_departures")
twin("headway_lag", """
    SELECT service_date, route_id, stop_id, direction_id, headway_seconds, count(*) AS times
    FROM q_gap GROUP BY ALL""")
twin("gold_analysis_days", "SELECT * FROM q_gold_days")
twin("gold_route_daily", "SELECT * FROM q_gold_routes")
twin("gold_stop_daily", "SELECT * FROM q_gold_stops")
twin("gold_route_stop_hourly", "SELECT * FROM q_gold_hourly")
twin("gold_route_stop_headways", f"""
    SELECT * EXCLUDE (avg_seconds, median_seconds, p90_seconds),
           {rounded("avg_seconds", "median_seconds", "p90_seconds")} FROM q_gold_headways""")
twin("gold_service_span", f"""
    SELECT * EXCLUDE (known_regular_ratio), {rounded("known_regular_ratio")} FROM q_gold_span""")
_RATIOS = ("known_arrival_ratio", "known_departure_ratio", "known_regular_departure_ratio")
twin("coverage_daily", f"""
    SELECT * EXCLUDE (source_start, source_end, {", ".join(_RATIOS)}), {rounded(*_RATIOS)}
    FROM q_coverage""")
_SUMMED = (
    "total_events", "known_arrivals", "missing_arrivals", "known_departures", "missing_departures",
    "regular_events", "regular_known_departures", "regular_missing_departures", "no_pickup_events",
    "on_request_events", "approximate_timepoint_events",
)
twin("coverage_summary", f"""
    SELECT min(source_start) AS start_date, max(source_end) AS end_date,
           count(*) AS requested_days, count(*) FILTER (WHERE calendar_covered) AS covered_days,
           count(*) FILTER (WHERE NOT calendar_covered) AS outside_calendar_days,
           {", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in _SUMMED)},
           round(sum(known_departures) / nullif(sum(total_events), 0), 6) AS known_departure_ratio,
           round(sum(regular_known_departures) / nullif(sum(regular_events), 0), 6)
               AS known_regular_departure_ratio
    FROM q_coverage""")
twin("source_context", """
    SELECT string_agg(agency_timezone, ',' ORDER BY agency_timezone) AS agency_timezones
    FROM (SELECT DISTINCT agency_timezone FROM g_agency) zones""")
twin("route_catalog", """
    SELECT r.*, a.agency_name, a.agency_timezone FROM g_routes r
    JOIN g_agency a ON a._agency_key = r._agency_key""")
twin("stop_catalog", "SELECT * FROM g_stops")
twin("gold_row_counts", """
    SELECT 'analysis_days' AS table_name, count(*) AS row_count FROM q_gold_days
    UNION ALL SELECT 'active_services', count(*) FROM q_services
    UNION ALL SELECT 'route_daily', count(*) FROM q_gold_routes
    UNION ALL SELECT 'stop_daily', count(*) FROM q_gold_stops
    UNION ALL SELECT 'route_stop_hourly', count(*) FROM q_gold_hourly
    UNION ALL SELECT 'route_stop_headways', count(*) FROM q_gold_headways
    UNION ALL SELECT 'service_span', count(*) FROM q_gold_span
    UNION ALL SELECT 'coverage_daily', count(*) FROM q_coverage""")


# Reports over the KPI tables ---------------------------------------------------------------
_TOTALS = {
    "departures": "regular_known_departures", "regular_events": "regular_events", "total_events": "total_events",
    "missing_departures": "missing_departures", "no_pickup_events": "no_pickup_events",
    "on_request_events": "on_request_events", "approximate_departures": "approximate_regular_departures",
}
cte("q_period", f"SELECT * FROM q_coverage JOIN q_gold_days USING (service_date, calendar_covered) WHERE {REPORT_RANGE}")
cte("q_period_totals", "SELECT CAST(sum(trip_instances) AS BIGINT) AS trips, " + ", ".join(
    f"CAST(sum({column}) AS BIGINT) AS {name}" for name, column in _TOTALS.items()
) + ", CAST(count_if(calendar_covered) AS BIGINT) AS covered_days, count(*) AS requested_days FROM q_period")
cte("q_ran", f"SELECT DISTINCT route_id FROM q_instances WHERE {REPORT_RANGE}")
cte("q_served", f"SELECT DISTINCT stop_id FROM q_events WHERE {REPORT_RANGE}")
twin("overview_kpi", """
    SELECT *, if(covered_days > 0, (SELECT count(*) FROM q_ran), NULL) AS active_routes,
           if(covered_days > 0, (SELECT count(*) FROM q_served), NULL) AS served_stops,
           (SELECT count(*) FROM g_stops) AS catalog_stops
    FROM q_period_totals""")
twin("top_routes", f"""
    SELECT r.route_id, c.route_short_name, CAST(sum(r.trip_count) AS BIGINT) AS trips
    FROM q_gold_routes r JOIN g_routes c ON c.route_id = r.route_id WHERE {REPORT_RANGE}
    GROUP BY 1, 2 ORDER BY trips DESC NULLS LAST, r.route_id LIMIT 20""")
twin("top_stops", f"""
    SELECT r.stop_id, c.stop_name, CAST(sum(r.regular_known_departures) AS BIGINT) AS departures
    FROM q_gold_stops r JOIN g_stops c ON c.stop_id = r.stop_id WHERE {REPORT_RANGE}
    GROUP BY 1, 2 ORDER BY departures DESC NULLS LAST, r.stop_id LIMIT 20""")
_HOURS = f"""
    SELECT service_hour, CAST(sum(departure_count) AS BIGINT) AS departures
    FROM q_gold_hourly WHERE {REPORT_RANGE} GROUP BY 1"""
twin("hourly_profile", _HOURS)
twin("hourly_top200", f"SELECT * FROM ({_HOURS}) h ORDER BY departures DESC, service_hour LIMIT 200")
twin("bounded_fetch", _HOURS)
twin("coverage_view", f"""
    SELECT service_date, calendar_covered, total_events, known_arrivals, missing_arrivals,
           known_departures, missing_departures, regular_events, regular_known_departures,
           regular_missing_departures, no_pickup_events, on_request_events,
           approximate_regular_departures, {rounded("known_regular_departure_ratio")}
    FROM q_coverage WHERE {REPORT_RANGE}""")
twin("filter_routes", "SELECT route_id, route_short_name, route_long_name FROM g_routes")
twin("filter_stops", f"""
    SELECT DISTINCT s.route_id, s.stop_id, c.stop_name FROM q_gold_span s
    JOIN g_stops c ON c.stop_id = s.stop_id WHERE {REPORT_RANGE}""")
twin("filter_directions", f"""
    SELECT DISTINCT route_id, stop_id, direction_id FROM q_gold_span WHERE {REPORT_RANGE}""")
twin("direction_predicate", " UNION ALL ".join(f"""
    SELECT '{choice}' AS choice, count(*) AS group_rows,
           CAST(sum(observation_count) AS BIGINT) AS departures
    FROM q_gold_span WHERE {REPORT_RANGE} AND {rule}""" for choice, rule in (
        ("ALL", "true"), ("NULL", "direction_id IS NULL"), ("0", "direction_id = 0"),
        ("1", "direction_id = 1"))))
twin("group_daily", f"""
    SELECT d.service_date, g.route_id, g.stop_id, d.calendar_covered,
           CASE WHEN d.calendar_covered THEN CAST(coalesce(sum(observation_count), 0) AS BIGINT) END
               AS departures,
           CASE WHEN d.calendar_covered THEN CAST(coalesce(sum(regular_event_count), 0) AS BIGINT) END
               AS regular_events,
           CASE WHEN d.calendar_covered
                THEN CAST(coalesce(sum(missing_regular_departures), 0) AS BIGINT) END AS missing,
           CASE WHEN d.calendar_covered
                THEN CAST(coalesce(sum(approximate_departures), 0) AS BIGINT) END AS approximate,
           min(first_departure_seconds) AS first_seconds, max(last_departure_seconds) AS last_seconds
    FROM (SELECT DISTINCT route_id, stop_id FROM q_gold_span WHERE {REPORT_RANGE}) g
    CROSS JOIN (SELECT * FROM q_days WHERE {REPORT_RANGE}) d
    LEFT JOIN q_gold_span s ON s.service_date = d.service_date AND s.route_id = g.route_id
        AND s.stop_id = g.stop_id
    GROUP BY 1, 2, 3, 4""")
twin("group_hourly", f"""
    SELECT route_id, stop_id, service_hour, CAST(sum(departure_count) AS BIGINT) AS departures
    FROM q_gold_hourly WHERE {REPORT_RANGE} GROUP BY 1, 2, 3""")
twin("group_headways", f"""
    SELECT service_date, route_id, stop_id, direction_id, departure_count, interval_count,
           {rounded("avg_seconds", "median_seconds", "p90_seconds")}
    FROM q_gold_headways WHERE {REPORT_RANGE}""")
twin("span_headway_join", f"""
    SELECT s.service_date, s.route_id, s.stop_id, s.direction_id, first_departure_seconds,
           last_departure_seconds, observation_count, regular_event_count,
           missing_regular_departures, interval_count, {rounded("median_seconds", "p90_seconds")}
    FROM q_gold_span s JOIN q_gold_headways h ON h.service_date = s.service_date
        AND h.route_id = s.route_id AND h.stop_id = s.stop_id
        AND h.direction_id IS NOT DISTINCT FROM s.direction_id""")
twin("period_event_totals", f"""
    SELECT CAST(sum(total_events) AS BIGINT) AS visits,
           CAST(sum(regular_known_departures) AS BIGINT) AS regular_departures,
           CAST(sum(no_pickup_events) AS BIGINT) AS no_pickup,
           CAST(sum(on_request_events) AS BIGINT) AS on_request,
           CAST(sum(missing_departures) AS BIGINT) AS missing_departures
    FROM q_coverage WHERE {REPORT_RANGE}""")
twin("shape_counts", "SELECT count(*) AS points, count(DISTINCT shape_id) AS shapes FROM g_shapes")

# Trip explorer -----------------------------------------------------------------------------
cte("q_explorer_routes", """
    SELECT r.route_id, r.agency_id, a.agency_name, r.route_short_name, r.route_long_name, r.route_type
    FROM g_routes r JOIN g_agency a ON a._agency_key = r._agency_key""")
cte("q_positions_of_visits", """
    SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS position
    FROM g_stop_times""")
cte("q_patterns", """
    SELECT trip_id, count(*) AS visits,
           (array_agg(coalesce(departure_seconds, arrival_seconds) ORDER BY stop_sequence))[1]
               AS start_seconds,
           (array_agg(coalesce(arrival_seconds, departure_seconds) ORDER BY stop_sequence DESC))[1]
               AS end_seconds,
           bit_xor(CAST(concat('0x', substr(md5(concat(position, ':', stop_id)), 1, 15)) AS BIGINT))
               AS low,
           bit_xor(CAST(concat('0x', substr(md5(concat(position, ':', stop_id)), 16, 15)) AS BIGINT))
               AS high
    FROM q_positions_of_visits GROUP BY 1""")


def _marked(value):
    return f"coalesce('=' || CAST({value} AS VARCHAR), '-')"


_PARTS = ("t.direction_id", "t.trip_headsign", "x.shape_id", "x.variant_id",
          "(p.visits || ':' || p.low || ':' || p.high)")
cte("q_extras", """
    SELECT trip_id, extra_fields->>'shape_id' AS shape_id, extra_fields->>'variant_id' AS variant_id,
           extra_fields->>'vehicle_id' AS vehicle_id, extra_fields->>'brigade_id' AS brigade_id
    FROM g_trips""")
cte("q_trips", f"""
    SELECT t.trip_id, t.route_id, t.service_id, t.direction_id, t.trip_headsign,
           nullif(x.shape_id, '') AS shape_id, nullif(x.variant_id, '') AS source_variant_id,
           x.vehicle_id AS scheduled_vehicle_type_id, x.brigade_id AS scheduled_brigade_id,
           p.start_seconds, p.end_seconds,
           md5({" || '|' || ".join(_marked(part) for part in _PARTS)}) AS variant_key
    FROM g_trips t JOIN q_extras x ON x.trip_id = t.trip_id
    LEFT JOIN q_patterns p ON p.trip_id = t.trip_id""")
cte("q_active", """
    SELECT * FROM q_trips WHERE service_id IN (SELECT service_id FROM q_services_day)""")
cte("q_visits", """
    SELECT s.*, c.stop_name, c.stop_lat, c.stop_lon, c.location_type
    FROM g_stop_times s JOIN g_stops c ON c.stop_id = s.stop_id
    WHERE EXISTS (SELECT 1 FROM g_trips t WHERE t.trip_id = s.trip_id
                  AND t.service_id IN (SELECT service_id FROM q_services_day))""")

twin("explorer_views_routes", "SELECT * FROM q_explorer_routes")
twin("explorer_views_stops", """
    SELECT stop_id, stop_name, stop_lat, stop_lon, location_type FROM g_stops""")
twin("explorer_views_calendar", "SELECT * FROM g_calendar")
twin("explorer_views_calendar_dates", "SELECT * FROM g_calendar_dates")
twin("explorer_views_stop_times", "SELECT * FROM g_stop_times")
twin("extra_field_get", """
    SELECT trip_id, nullif(shape_id, '') AS shape_id, nullif(variant_id, '') AS source_variant_id,
           vehicle_id, brigade_id FROM q_extras""")
twin("trip_patterns", "SELECT * FROM q_trips")
twin("active_services_on_day", "SELECT service_id FROM q_services_day")
twin("day_in_envelope", """
    SELECT d.service_date, CASE WHEN NOT calendar_covered THEN 'outside-calendar-envelope'
           WHEN d.service_date NOT IN (SELECT service_date FROM q_services) THEN 'no-service'
           ELSE 'within-calendar-envelope' END AS day_state FROM q_days d""")
twin("explorer_routes", "SELECT * FROM q_explorer_routes")


def _clock(seconds):
    return (
        f"CASE WHEN {seconds} IS NULL THEN 'Brak czasu' ELSE printf('%02d:%02d:%02d', "
        f"{seconds} // 3600, ({seconds} // 60) % 60, {seconds} % 60) END"
    )


_MODE = """CASE WHEN route_type IN (0, 900, 901, 902, 903, 904, 905, 906, 907) THEN 'Tramwaj'
    WHEN route_type IN (3, 800) OR route_type BETWEEN 700 AND 716 THEN 'Autobus'
    ELSE 'Inny transport' END"""
_BOARDING = """CASE pickup_type WHEN 0 THEN 'Regularne' WHEN 1 THEN 'Bez wsiadania'
    WHEN 2 THEN 'Na żądanie telefoniczne' WHEN 3 THEN 'Na żądanie' END"""
_TIME_KIND = "CASE WHEN timepoint <> 0 THEN 'Dokładny' ELSE 'Przybliżony' END"
cte("q_named", f"""
    SELECT *, coalesce(nullif(route_short_name, ''), nullif(route_long_name, ''), 'Bez oznaczenia')
               AS main_name, {_MODE} AS transport
    FROM q_explorer_routes""")
cte("q_labelled", """
    SELECT * EXCLUDE (main_name), main_name || ' · ' || transport ||
           CASE WHEN count(*) OVER (PARTITION BY main_name) > 1
                THEN ' · ' || agency_name || ' · agency_id=' || coalesce(agency_id, 'None')
                     || ' · route_id=' || route_id ELSE '' END AS route_label
    FROM q_named""")
twin("route_label", "SELECT * EXCLUDE (transport) FROM q_labelled")
twin("route_search", """
    SELECT * EXCLUDE (transport) FROM q_labelled WHERE transport = 'Autobus'
        AND contains(lower(route_label || ' ' || route_long_name), lower('R#00000012'))
    UNION ALL
    SELECT * EXCLUDE (transport) FROM q_labelled WHERE transport = 'Tramwaj'
        AND contains(lower(route_label || ' ' || route_long_name), lower('TRAM'))""")
twin("active_routes", "SELECT DISTINCT route_id FROM q_active")
twin("variants", """
    SELECT route_id, variant_key, trip_headsign, direction_id, shape_id, source_variant_id,
           count(*) AS trip_count, min(start_seconds) AS first_seconds
    FROM q_active GROUP BY 1, 2, 3, 4, 5, 6""")
twin("variant_trips", "SELECT * FROM q_active")
twin("trip_visits", "SELECT * FROM q_visits")
twin("trip_geometry", """
    SELECT * FROM g_shapes WHERE shape_id IN (SELECT shape_id FROM q_active)""")
twin("stop_departures", """
    SELECT s.trip_id, s.stop_id, s.stop_sequence, s.arrival_seconds, s.departure_seconds,
           s.pickup_type, s.timepoint, t.route_id, t.trip_headsign, t.direction_id, t.variant_key
    FROM g_stop_times s JOIN q_active t ON t.trip_id = s.trip_id""")
twin("first_known_departure", f"""
    SELECT *, {_clock("first_seconds")} AS first_time FROM (
        SELECT t.route_id, s.stop_id, count(*) AS visits, min(s.departure_seconds) AS first_seconds
        FROM g_stop_times s JOIN q_active t ON t.trip_id = s.trip_id GROUP BY 1, 2) firsts""")
twin("timetable_view", f"""
    SELECT trip_id, stop_sequence, stop_name, stop_id, {_clock("arrival_seconds")} AS arrival,
           {_clock("departure_seconds")} AS departure, {_BOARDING} AS boarding,
           {_TIME_KIND} AS time_kind FROM q_visits""")
twin("stop_markers", """
    SELECT trip_id, stop_id, stop_lat AS latitude, stop_lon AS longitude,
           stop_name || chr(10) || 'stop_id=' || stop_id AS label,
           stop_id = '0000000005' AS selected
    FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY stop_sequence DESC) AS n
          FROM q_visits WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL) ranked WHERE n = 1""")
twin("trip_summary", """
    SELECT trip_id, (array_agg(stop_name ORDER BY stop_sequence))[1] AS first_stop,
           (array_agg(stop_name ORDER BY stop_sequence DESC))[1] AS last_stop, count(*) AS visits
    FROM q_visits GROUP BY 1""")

# Labels ------------------------------------------------------------------------------------
twin("service_hour", """
    SELECT trip_id, stop_sequence, departure_seconds // 3600 AS service_hour FROM g_stop_times
    WHERE departure_seconds IS NOT NULL""")
twin("format_service_time", f"""
    SELECT trip_id, stop_sequence, {_clock("arrival_seconds")} AS arrival,
           {_clock("(departure_seconds * 1000)")} AS long_time FROM g_stop_times""")
twin("format_percent", """
    SELECT service_date, route_id, stop_id, direction_id,
           CASE WHEN regular_event_count = 0 THEN 'Nieokreślone' ELSE
               printf('%.1f%%', 100 * CAST(observation_count AS DOUBLE) / regular_event_count) END
               AS known FROM q_gold_span""")
twin("transport_mode", f"SELECT route_id, {_MODE} AS transport FROM g_routes")
twin("boarding_timepoint_label", f"""
    SELECT trip_id, stop_sequence, {_BOARDING} AS boarding, {_TIME_KIND} AS time_kind
    FROM g_stop_times""")
twin("iso_weekday_flag", """
    SELECT service_id, service_date, CASE extract(isodow FROM service_date) WHEN 1 THEN monday
           WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday
           WHEN 6 THEN saturday ELSE sunday END AS flag
    FROM (SELECT *, CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP),
                    CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS service_date
          FROM g_calendar) days""")

# Vehicle observations ----------------------------------------------------------------------
cte("q_numbers", """
    SELECT *, CASE WHEN isfinite(lat) THEN lat END AS lat_ok, CASE WHEN isfinite(lon) THEN lon END AS lon_ok
    FROM (SELECT *, TRY_CAST(replace(latitude, ',', '.') AS DOUBLE) AS lat,
                 TRY_CAST(replace(longitude, ',', '.') AS DOUBLE) AS lon FROM r_positions) n""")
cte("q_checked", f"""
    SELECT *, coalesce(lat_ok BETWEEN -90 AND 90 AND lon_ok BETWEEN -180 AND 180
                       AND NOT (lat_ok = 0 AND lon_ok = 0), false) AS usable,
           CASE WHEN measured_at LIKE '%+00:00' OR measured_at LIKE '%+02:00' THEN
               epoch(TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}')
               - epoch(CAST(replace(substr(measured_at, 1, 19), 'T', ' ') AS TIMESTAMP))
               + CASE WHEN measured_at LIKE '%+02:00' THEN 7200 ELSE 0 END END AS age
    FROM q_numbers""")
cte("q_duplicates", """
    SELECT coalesce(vehicle_id, 'None') AS vehicle_id, count(*) AS observations
    FROM r_positions GROUP BY 1 HAVING count(*) > 1""")
cte("q_observed_vehicles", """
    SELECT observation_id, CASE WHEN line = '' THEN 'Niepodana' ELSE line END AS line,
           coalesce(vehicle_id, 'Niepodany') AS vehicle_id, lat_ok AS latitude, lon_ok AS longitude,
           measured_at, CAST(age AS DOUBLE) AS age_seconds,
           CASE WHEN age IS NULL THEN 'Niepotwierdzony czas / strefa'
                WHEN age < -60 THEN 'Czas w przyszłości' WHEN age > 600 THEN 'Stara obserwacja'
                ELSE 'Niedawna obserwacja' END AS state,
           coalesce(vehicle_id, 'Niepodany') IN (SELECT d.vehicle_id FROM q_duplicates d) AS duplicate_id
    FROM q_checked WHERE usable""")
twin("normalize_positions", f"""
    SELECT * EXCLUDE (latitude, longitude, age_seconds),
           {rounded("latitude", "longitude", "age_seconds")} FROM q_observed_vehicles""")
twin("position_freshness", """
    SELECT state, count(*) AS observations, round(min(age_seconds), 6) AS youngest,
           round(max(age_seconds), 6) AS oldest FROM q_observed_vehicles GROUP BY 1""")
twin("position_labels", """
    SELECT observation_id, 'Linia ' || line || ' · pojazd ' || vehicle_id || chr(10) || measured_at
           || chr(10) || state AS label FROM q_observed_vehicles""")
twin("duplicate_vehicle_ids", "SELECT * FROM q_duplicates")
twin("position_summary", """
    SELECT count(*) AS received, count(*) FILTER (WHERE NOT usable) AS skipped,
           count(*) FILTER (WHERE usable AND age IS NULL) AS unconfirmed_time FROM q_checked""")
twin("positions_for_line", """
    SELECT observation_id, line, vehicle_id FROM q_observed_vehicles
    WHERE line IN (SELECT route_short_name FROM g_routes)""")


# Constraints, identities, sources and sinks ------------------------------------------------
cte("s_services", """
    SELECT service_id FROM s_calendar UNION SELECT service_id FROM s_calendar_dates""")
cte("g_services", """
    SELECT service_id FROM g_calendar UNION SELECT service_id FROM g_calendar_dates""")
_SILVER = {t: f"s_{t}" for t in (
    "agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates", "services")}
_GOLD = {
    "analysis_days": "q_gold_days", "active_services": "q_services", "route_daily": "q_gold_routes",
    "stop_daily": "q_gold_stops", "route_stop_hourly": "q_gold_hourly",
    "route_stop_headways": "q_gold_headways", "service_span": "q_gold_span",
    "coverage_daily": "q_coverage",
}


# Rows that break a rule, table by table, in words of their own: what must not be found.
_KEY = ("service_date", "route_id", "stop_id", "direction_id")
_BROKEN = {
    "agency": {"key known": "_agency_key IS NULL",
               "texts known": "agency_name IS NULL OR agency_url IS NULL OR agency_timezone IS NULL"},
    "stops": {"key known": "stop_id IS NULL", "latitude": "abs(stop_lat) > 90", "longitude": "abs(stop_lon) > 180",
              "location type": "location_type IS NULL OR location_type NOT IN (0, 1, 2, 3, 4)"},
    "routes": {"key known": "route_id IS NULL OR _agency_key IS NULL", "route type": "ifnull(route_type, -1) < 0"},
    "trips": {"key known": "trip_id IS NULL OR route_id IS NULL OR service_id IS NULL",
              "direction": "direction_id <> 0 AND direction_id <> 1"},
    "stop_times": {"key known": "trip_id IS NULL OR stop_id IS NULL", "sequence": "ifnull(stop_sequence, -1) < 0",
                   "arrival": "arrival_seconds < 0", "departure": "departure_seconds < 0",
                   "pickup": "ifnull(pickup_type, -1) NOT IN (0, 1, 2, 3)",
                   "drop off": "ifnull(drop_off_type, -1) NOT IN (0, 1, 2, 3)",
                   "timepoint": "ifnull(timepoint, -1) NOT IN (0, 1)"},
    "calendar": {"flags": "list_max([monday, tuesday, wednesday, thursday, friday, saturday, sunday]) > 1 OR "
                          "list_min([monday, tuesday, wednesday, thursday, friday, saturday, sunday]) < 0",
                 "range": "start_date IS NULL OR end_date IS NULL OR end_date < start_date"},
    "calendar_dates": {"exception": "date IS NULL OR ifnull(exception_type, 0) NOT IN (1, 2)"},
    "analysis_days": {"state": "NOT regexp_full_match(coverage_state, '(within|outside)-calendar-envelope')"},
    "route_daily": {"count": "trip_count < 0", "zero or unknown": "(trip_count IS NULL) = calendar_covered"},
    "stop_daily": {"count": "regular_known_departures < 0 OR distinct_routes < 0",
                   "zero or unknown": "(regular_known_departures IS NULL) = calendar_covered "
                                      "OR (distinct_routes IS NULL) = calendar_covered"},
    "route_stop_hourly": {"direction": "direction_id <> 0 AND direction_id <> 1", "hour": "service_hour < 0",
                          "count": "departure_count < 1 OR approximate_departures IS NULL"},
    "route_stop_headways": {"direction": "direction_id <> 0 AND direction_id <> 1",
                            "count": "departure_count IS NULL OR interval_count IS NULL"},
    "service_span": {"direction": "direction_id <> 0 AND direction_id <> 1",
                     "count": "observation_count IS NULL OR regular_event_count IS NULL OR "
                              "missing_regular_departures IS NULL OR approximate_departures IS NULL"},
}
_ONE_ROW = {
    "agency": ("_agency_key",), "stops": ("stop_id",), "routes": ("route_id",), "trips": ("trip_id",),
    "stop_times": ("trip_id", "stop_sequence"), "calendar": ("service_id",), "calendar_dates": ("service_id", "date"),
    "analysis_days": ("service_date",), "active_services": ("service_date", "service_id"),
    "route_daily": ("service_date", "route_id"), "stop_daily": ("service_date", "stop_id"),
    "route_stop_hourly": (*_KEY, "service_hour"), "route_stop_headways": _KEY, "service_span": _KEY,
    "coverage_daily": ("service_date",),
}
_KNOWN_ELSEWHERE = {  # target and its key: the columns that must be found there
    ("stops", "stop_id"): (("stops", "parent_station"), ("stop_times", "stop_id"), ("stop_daily", "stop_id"),
                           ("route_stop_hourly", "stop_id"), ("route_stop_headways", "stop_id"), ("service_span", "stop_id")),
    ("agency", "_agency_key"): (("routes", "_agency_key"),),
    ("routes", "route_id"): (("trips", "route_id"), ("route_daily", "route_id"), ("route_stop_hourly", "route_id"),
                             ("route_stop_headways", "route_id"), ("service_span", "route_id")),
    ("services", "service_id"): (("trips", "service_id"), ("active_services", "service_id")),
    ("trips", "trip_id"): (("stop_times", "trip_id"),),
    ("analysis_days", "service_date"): (("active_services", "service_date"), ("route_daily", "service_date"),
                                        ("stop_daily", "service_date"), ("coverage_daily", "service_date")),
}


def violations(tables, shown):
    """Counts of broken rules by plain SQL over ``tables``, for the tables in ``shown``."""
    parts = []
    for table in shown:
        found = tables[table]
        parts += [f"SELECT '{table}' AS table_name, 'check: {rule}' AS rule, CAST(count_if({broken}) AS BIGINT) AS violations FROM {found}"
                  for rule, broken in _BROKEN.get(table, {}).items()]
        if table in _ONE_ROW:
            keys = ", ".join(_ONE_ROW[table])
            parts.append(f"SELECT '{table}', 'unique', CAST(count_if(rows_there > 1) AS BIGINT) "
                         f"FROM (SELECT count(*) AS rows_there FROM {found} GROUP BY {keys}) keys")
    for (target, key), users in _KNOWN_ELSEWHERE.items():
        parts += [f"SELECT '{table}', 'references: {column}', "
                  f"(SELECT count({column}) FROM {tables[table]} ANTI JOIN (SELECT DISTINCT {key} AS {column} "
                  f"FROM {tables[target]}) known USING ({column}))"
                  for table, column in users if table in shown and target in tables]
    return " UNION ALL ".join(parts)


twin("check_constraints_silver", violations(_SILVER, [t for t in _SILVER if t != "services"]))
twin("check_constraints_gold", violations(
    {**_GOLD, "routes": "g_routes", "stops": "g_stops", "services": "g_services"}, list(_GOLD)))
twin("publish_gold", SELECTS["gold_row_counts"])
twin("publish_gold_headways", SELECTS["gold_route_stop_headways"])
_DATASET = "'gtfs_' || sha256('silver-v1' || chr(0) || sha256(agency_id))"
twin("dataset_id", f"SELECT agency_id, {_DATASET} AS dataset_id FROM g_agency")
twin("analysis_id", f"""
    SELECT agency_id, 'analysis_' || sha256('["' || {_DATASET} ||
           '","{START}","{END}","gold-v1"]') AS analysis_id FROM g_agency""")
_TEXT = " || ".join(
    f"coalesce('=' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("trip_id", "stop_sequence", "stop_id", "arrival_seconds", "departure_seconds"))
twin("content_fingerprint", f"""
    SELECT n AS row_count, sha256(n || ':' || low || ':' || high) AS content_hash
    FROM (SELECT count(*) AS n,
                 sum(CAST(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT) AS HUGEINT)) AS low,
                 sum(CAST(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT) AS HUGEINT)) AS high
          FROM (SELECT sha256({_TEXT}) AS h FROM g_stop_times) hashed) sums""")
twin("dataset_metadata", """
    SELECT 'gtfs_derived' AS dataset_id, CAST(NULL AS VARCHAR) AS data_kind,
           CAST(NULL AS VARCHAR) AS source_sha256, source_start AS start_date, source_end AS end_date
    FROM q_envelope""")
_CHANGED = {  # table: its flags for schema, count and content after it was changed
    "stops": "true, true, count(*) = 0", "routes": "false, true, count(*) = 0", "trips": "false, true, count(*) >= 0",
    "calendar": "true, count(*) FILTER (WHERE service_id = 'SV1') = 0, count(*) FILTER (WHERE service_id = 'SV1') = 0",
    "calendar_dates": "false, false, count(*) < 0",
}
twin("verify_silver", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, state, schema_matches, count_matches, content_matches FROM ("
    f"SELECT 'published' AS state, count(*) >= 0 AS schema_matches, true AS count_matches, true AS content_matches FROM g_{t} "
    f"UNION ALL SELECT 'damaged', {_CHANGED.get(t, 'true, true, count(*) >= 0')} FROM g_{t}) both_states"
    for t in _SILVER if t != "services"))
# What goes through the import: the ends of a trip with an arrival, and every stop as a platform.
_IMPORTED = {
    "g_stop_times": f"""
        SELECT * REPLACE (CASE
            WHEN arrival_seconds IS NOT NULL THEN arrival_seconds
            WHEN stop_sequence = min(stop_sequence) OVER trip
                THEN coalesce(least(min(arrival_seconds) OVER trip, min(departure_seconds) OVER trip), 18000)
            WHEN stop_sequence = max(stop_sequence) OVER trip
                THEN coalesce(greatest(max(arrival_seconds) OVER trip, max(departure_seconds) OVER trip), 18000)
            END AS arrival_seconds)
        FROM ({CTES['g_stop_times']}) visits WINDOW trip AS (PARTITION BY trip_id)""",
    "g_stops": f"SELECT * REPLACE (CAST(0 AS BIGINT) AS location_type) FROM ({CTES['g_stops']}) stops",
}
_AFTER_IMPORT = ("silver_gate", "load_silver", "publish_gold", "import_geometry")
twin("silver_gate", """
    SELECT trip_id, stop_id, stop_sequence, arrival_seconds, departure_seconds, pickup_type, timepoint
    FROM g_stop_times""")
_ABOUT = "severity || '|' || code || '|' || table_name || '|' || coalesce(column_name, '-')"
_COVERED = ("stop_time_records", "known_arrivals", "known_departures", "regular_pickup_records", "known_regular_departures",
            "no_pickup_records", "on_request_pickup_records", "approximate_timepoint_records", "departure_ratio")


def report_twin(twins):
    """The report in rows, from the statements of its parts."""
    for name in ("silver_gate_status", "dq_report_examples", "dq_time_coverage", "dq_service_date_range",
                 "dq_unknown_directions", "dq_row_counts"):
        cte(f"p_{name}", twins[name])
    parts = [f"SELECT 'report', '{name}', CAST({name} AS VARCHAR) FROM p_silver_gate_status"
             for name in ("status", "error_count", "warning_count")]
    parts += ["SELECT 'report', 'example_limit', '50' FROM p_silver_gate_status",
              "SELECT 'report', 'unknown_directions', CAST(unknown_directions AS VARCHAR) FROM p_dq_unknown_directions",
              f"SELECT 'check', {_ABOUT}, findings || ' ' || coalesce(first_record, -1) FROM q_checks",
              f"SELECT 'example', {_ABOUT} || '|' || record, coalesce(value, '') FROM p_dq_report_examples",
              "SELECT 'row_count', table_name, CAST(row_count AS VARCHAR) FROM p_dq_row_counts"]
    parts += [f"SELECT 'time_coverage', '{name}', CAST({name} AS VARCHAR) FROM p_dq_time_coverage" for name in _COVERED]
    parts += [f"SELECT 'service_date_range', '{name}', CAST({name} AS VARCHAR) FROM p_dq_service_date_range"
              for name in ("start_date", "end_date")]
    parts += ["SELECT 'capability', 'quantitative', CASE WHEN count(*) = 0 THEN 'true' ELSE 'false' END FROM r_frequencies",
              "SELECT 'capability', 'flexible', 'false' FROM p_silver_gate_status",
              "SELECT 'capability', 'frequencies', 'true ' || count(*) || ' textual_bronze_only' FROM r_frequencies",
              "SELECT 'capability', 'calendar', 'true' FROM p_silver_gate_status",
              "SELECT 'capability', 'extra of trips', 'shape_id,vehicle_id,brigade_note' FROM p_silver_gate_status"]
    return "SELECT section, name, value FROM (" + " UNION ALL ".join(parts) + ") AS report(section, name, value)"


twin("load_silver", "SELECT trip_id, route_id, service_id, direction_id, trip_headsign FROM g_trips")
twin("read_position_lines", "SELECT vehicle_id, line, latitude, longitude, measured_at FROM r_positions")
twin("read_positions_json", """
    SELECT 'Positions ' || number AS title,
           CAST(row_number() OVER (PARTITION BY number ORDER BY observation_id) - 1 AS INTEGER) AS place,
           'available' AS status, number % 5 <> 3 AS metadata_consistent,
           number % 5 <> 3 AND number % 7 <> 2 AS terms_confirmed,
           vehicle_id, line, latitude, longitude, measured_at, true AS is_object
    FROM (SELECT *, CAST(floor(observation_id / 200) AS BIGINT) AS number FROM r_positions) numbered""")
twin("write_scan_bronze", "SELECT * FROM r_stop_times")
twin("write_scan_silver", "SELECT * FROM s_stop_times")
twin("read_feed_csv", "SELECT * EXCLUDE (_source_record) FROM r_stop_times")
cte("q_headsigns", """
    SELECT trip_id, min(trip_headsign) AS headsign, right(trip_id, 1) AS digit
    FROM r_trips WHERE trip_id <> '' GROUP BY trip_id""")
twin("source_record_number", """
    SELECT trip_id, CASE WHEN digit IN ('1', '4', '7') THEN 'a "' || headsign || '",' || chr(10) || 'b'
                         WHEN digit = '2' THEN '"   ' WHEN digit = '3' THEN ',",' ELSE '5" x' END AS note, _source_record
    FROM (SELECT *, rank() OVER (ORDER BY trip_id) AS _source_record FROM q_headsigns) numbered
    WHERE digit <> '5'""")
twin("skip_blank_records", """
    SELECT _source_record, location_group_id, timepoint FROM r_stop_times
    WHERE trim(location_group_id || timepoint) <> ''""")
twin("table_structure_check", """
    SELECT 'missing_columns' AS code, 'routes' AS file, 'route_type' AS detail
    FROM (SELECT count(*) FROM r_routes) all_routes
    UNION ALL SELECT 'missing_route_name', 'routes', ''
    UNION ALL SELECT 'empty_calendar', NULL, '' FROM (SELECT count(*) AS n FROM r_calendar
        WHERE service_id = '') none WHERE n = 0""")
twin("feed_structure_check", f"{SELECTS['table_structure_check']} UNION ALL SELECT 'empty_column', 'stops', ''")
_WEEK = ",".join(f"{day}:bigint" for day in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
twin("feed_tables_present", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS source_present, false AS normalized_empty, count(*) AS row_count, "
    f"CAST(NULL AS VARCHAR) AS absent_columns FROM r_{t}" for t in _SILVER if t not in ("services", "calendar"))
    + f" UNION ALL SELECT 'calendar', false, true, count(*), 'service_id:string,{_WEEK},"
      "start_date:date,end_date:date,_source_record:bigint' FROM r_calendar WHERE 1 = 0")
# Columns of the raw tables in their order; typing puts the record number after them, then what it adds.
_RAW_COLUMNS = {
    "agency": "_source_record agency_id agency_name agency_url agency_timezone",
    "stops": "_source_record stop_id stop_name stop_lat stop_lon location_type parent_station",
    "routes": "_source_record route_id agency_id route_short_name route_long_name route_type",
    "trips": "_source_record trip_id route_id service_id direction_id trip_headsign shape_id vehicle_id brigade_note",
    "stop_times": "_source_record trip_id stop_id stop_sequence arrival_time departure_time pickup_type drop_off_type timepoint "
                  "location_group_id start_pickup_drop_off_window",
    "calendar": "_source_record service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "_source_record service_id date exception_type",
}
_ADDED = {"agency": "_agency_key", "routes": "_agency_key route_type_description", "stop_times": "arrival_seconds departure_seconds"}
_BIGINT = set("_source_record location_type route_type direction_id stop_sequence pickup_type drop_off_type timepoint exception_type "
              "arrival_seconds departure_seconds monday tuesday wednesday thursday friday saturday sunday".split())
_KIND = {"stop_lat": "double", "stop_lon": "double", "start_date": "date", "end_date": "date", "date": "date",
         **dict.fromkeys(_BIGINT, "bigint")}


def manifest_twin(source, columns, kinds):
    """Count and content hash of a table, its rows hashed as text column by column."""
    text = " || ".join(
        f"coalesce('=' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    listed = ",".join(f"{c}:{kinds(c)}" for c in columns)
    return f"""
    SELECT '{source[2:]}' AS table_name, n AS row_count, '{listed}' AS columns,
           sha256(n || ':' || coalesce(low, 0) || ':' || coalesce(high, 0)) AS content_hash
    FROM (SELECT count(*) AS n, sum(CAST(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT) AS HUGEINT)) AS low,
                 sum(CAST(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT) AS HUGEINT)) AS high
          FROM (SELECT sha256({text}) AS h FROM {source}) hashed) sums"""


twin("write_bronze", " UNION ALL ".join(
    manifest_twin(f"r_{t}", names.split(), lambda c: "bigint" if c == "_source_record" else "string")
    for t, names in _RAW_COLUMNS.items()))
twin("write_silver", " UNION ALL ".join(
    manifest_twin(f"s_{t}", [*names.split()[1:], "_source_record", *_ADDED.get(t, "").split()], lambda c: _KIND.get(c, "string"))
    for t, names in _RAW_COLUMNS.items()))
for _layer in ("bronze", "silver"):
    twin(f"scan_{_layer}", f"SELECT * EXCLUDE (columns) FROM ({SELECTS[f'write_{_layer}']}) written")
twin("frequencies_capability", """
    SELECT count(*) AS row_count, count(*) = 0 AS quantitative_gold_supported FROM r_frequencies""")
twin("feed_capabilities", """
    SELECT count(*) AS row_count, 'textual_bronze_only' AS handling,
           count(*) = 0 AS quantitative_gold_supported, false AS flexible_service_supported,
           true AS calendar, 'shape_id,vehicle_id,brigade_note' AS trips_extra,
           'location_group_id,start_pickup_drop_off_window' AS stop_times_extra
    FROM r_frequencies""")
twin("read_shapes", f"""
    SELECT shape_id, shape_pt_sequence, {rounded("latitude", "longitude")} FROM g_shapes""")
twin("import_geometry", SELECTS["shape_counts"])

SELECTS.update(quality_twins())
twin("write_quality_report", report_twin(SELECTS))


def oracle_sql():
    return {name: compose(select, _IMPORTED if name in _AFTER_IMPORT else None) for name, select in SELECTS.items()}
