"""Shared CTE texts of the DuckDB twins and their composition into one statement."""

import re

from ..sources.derived_feed import BASE_TABLES, VIEWS
from .params import DAY, END, REPORT_END, REPORT_START, START

CTES = {name: text.format(**{table: table for table in BASE_TABLES}) for name, text in VIEWS.items()}


def cte(name, text):
    CTES[name] = text


def compose(select, instead=None):
    """Put the CTEs a statement needs, and those they need, in front of it; some may be replaced."""
    texts = {**CTES, **(instead or {})}
    needed, order = set(), []

    def visit(text):
        for word in re.findall(r"\b[a-z_][a-z_0-9]*\b", text):
            if word in texts and word not in needed:
                needed.add(word)
                visit(texts[word])
                order.append(word)

    visit(select)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({texts[name]})" for name in order) + "\n" + select


# The twins follow the rules of the results with other means than the operators: dates are unnested
# per service, gaps come from sorted lists, grids from keys that are counted with zeros beside them.
def spread(first, last):
    """All dates from one SQL date to another, as an expression that unnests."""
    return f"unnest(range(CAST({first} AS TIMESTAMP), CAST({last} AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY))"


def running(first, last):
    """Distinct (date, service) pairs of a closed range, removed dates taken out."""
    return f"""
    SELECT DISTINCT marked.on_date AS service_date, marked.service_id FROM (
        SELECT service_id, on_date FROM (
            SELECT service_id, week, CAST({spread(f"greatest(start_date, DATE '{first}')", f"least(end_date, DATE '{last}')")}
                   AS DATE) AS on_date
            FROM (SELECT *, [monday, tuesday, wednesday, thursday, friday, saturday, sunday] AS week FROM g_calendar) c
        ) dated WHERE week[isodow(on_date)] = 1
        UNION ALL
        SELECT service_id, date FROM g_calendar_dates
        WHERE exception_type = 1 AND date >= DATE '{first}' AND date <= DATE '{last}'
    ) marked ANTI JOIN (SELECT service_id, date FROM g_calendar_dates WHERE exception_type = 2) gone
        ON gone.service_id = marked.service_id AND gone.date = marked.on_date"""


cte("q_mentioned", """
    SELECT unnest([start_date, end_date]) AS on_date FROM g_calendar
    UNION ALL SELECT date FROM g_calendar_dates""")
cte("q_envelope", """
    SELECT arg_min(on_date, on_date) AS source_start, arg_max(on_date, on_date) AS source_end
    FROM q_mentioned""")
cte("q_days", f"""
    SELECT service_date, source_start, source_end,
           ifnull(source_start <= service_date AND service_date <= source_end, false) AS calendar_covered
    FROM (SELECT *, CAST({spread(f"DATE '{START}'", f"DATE '{END}'")} AS DATE) AS service_date FROM q_envelope) all_days""")
cte("q_services", running(START, END))
cte("q_services_day", running(DAY, DAY))
cte("q_instances", """
    SELECT service_date, trip_id, route_id, service_id, direction_id
    FROM g_trips JOIN q_services USING (service_id)""")
cte("q_events", """
    SELECT service_date, route_id, direction_id, trip_id, stop_id, stop_sequence, arrival_seconds,
           departure_seconds, pickup_type, timepoint
    FROM g_stop_times JOIN q_instances USING (trip_id)""")
cte("q_departures", "SELECT * FROM q_events WHERE pickup_type = 0 AND departure_seconds >= 0")
cte("q_groups", """
    SELECT service_date, route_id, stop_id, direction_id,
           list_sort(list(departure_seconds) FILTER (pickup_type = 0 AND departure_seconds IS NOT NULL)) AS times,
           CAST(count_if(pickup_type = 0) AS BIGINT) AS regular,
           CAST(count_if(pickup_type = 0 AND departure_seconds IS NOT NULL AND timepoint = 0) AS BIGINT) AS approximate
    FROM q_events GROUP BY ALL""")
cte("q_gaps", """
    SELECT *, list_transform(range(1, greatest(len(times), 1)), lambda i: times[i + 1] - times[i]) AS gaps
    FROM (SELECT * REPLACE (ifnull(times, []) AS times) FROM q_groups) filled""")
cte("q_gap", "SELECT service_date, route_id, stop_id, direction_id, unnest(gaps) AS headway_seconds FROM q_gaps")
cte("q_gold_days", """
    SELECT service_date, calendar_covered,
           if(calendar_covered, 'within', 'outside') || '-calendar-envelope' AS coverage_state,
           if(calendar_covered, (SELECT count(*) FROM q_services s WHERE s.service_date = d.service_date), NULL)
               AS active_services,
           if(calendar_covered, (SELECT count(*) FROM q_instances i WHERE i.service_date = d.service_date), NULL)
               AS trip_instances
    FROM q_days d""")
cte("q_gold_routes", """
    SELECT service_date, route_id, calendar_covered,
           if(calendar_covered, CAST(sum(here) AS BIGINT), NULL) AS trip_count
    FROM (SELECT service_date, route_id, 0 AS here FROM g_routes, q_days
          UNION ALL SELECT service_date, route_id, 1 FROM q_instances SEMI JOIN g_routes USING (route_id)) counted
    JOIN q_days USING (service_date) GROUP BY service_date, route_id, calendar_covered""")
cte("q_gold_stops", """
    SELECT service_date, stop_id, calendar_covered,
           if(calendar_covered, count(route_id), NULL) AS regular_known_departures,
           if(calendar_covered, count(DISTINCT route_id), NULL) AS distinct_routes
    FROM (SELECT service_date, stop_id, NULL AS route_id FROM g_stops, q_days
          UNION ALL SELECT service_date, stop_id, route_id FROM q_departures) counted
    JOIN q_days USING (service_date)
    WHERE stop_id IN (SELECT stop_id FROM g_stops WHERE location_type = 0)
    GROUP BY service_date, stop_id, calendar_covered""")
cte("q_gold_hourly", """
    SELECT service_date, route_id, stop_id, direction_id,
           (departure_seconds - departure_seconds % 3600) // 3600 AS service_hour, count(*) AS departure_count,
           CAST(count_if(timepoint = 0) AS BIGINT) AS approximate_departures
    FROM q_departures GROUP BY ALL""")
cte("q_gold_headways", """
    SELECT service_date, route_id, stop_id, direction_id, len(times) AS departure_count,
           len(gaps) AS interval_count, list_avg(gaps) AS avg_seconds,
           list_aggregate(CAST(gaps AS DOUBLE[]), 'quantile_cont', 0.5) AS median_seconds,
           list_aggregate(CAST(gaps AS DOUBLE[]), 'quantile_cont', 0.9) AS p90_seconds
    FROM q_gaps""")
cte("q_gold_span", """
    SELECT service_date, route_id, stop_id, direction_id, times[1] AS first_departure_seconds,
           times[len(times)] AS last_departure_seconds, len(times) AS observation_count,
           regular AS regular_event_count, regular - len(times) AS missing_regular_departures,
           approximate AS approximate_departures,
           if(regular > 0, len(times) / regular, NULL) AS known_regular_ratio
    FROM q_gaps""")

_ARRIVAL, _DEPARTURE = "arrival_seconds IS NOT NULL", "departure_seconds IS NOT NULL"
_MEASURES = {
    "total_events": "trip_id IS NOT NULL",
    "known_arrivals": _ARRIVAL,
    "missing_arrivals": "trip_id IS NOT NULL AND arrival_seconds IS NULL",
    "known_departures": _DEPARTURE,
    "missing_departures": "trip_id IS NOT NULL AND departure_seconds IS NULL",
    "regular_events": "pickup_type = 0",
    "regular_known_departures": f"pickup_type = 0 AND {_DEPARTURE}",
    "regular_missing_departures": "pickup_type = 0 AND departure_seconds IS NULL",
    "no_pickup_events": "pickup_type = 1",
    "on_request_events": "pickup_type BETWEEN 2 AND 3",
    "pickup_type_2_events": "pickup_type = 2",
    "pickup_type_3_events": "pickup_type = 3",
    "exact_timepoint_events": "timepoint = 1",
    "approximate_timepoint_events": "timepoint = 0",
    "approximate_regular_departures": f"timepoint = 0 AND pickup_type = 0 AND {_DEPARTURE}",
}
cte("q_measured", "SELECT service_date, source_start, source_end, calendar_covered, " + ", ".join(
    f"if(calendar_covered, count(*) FILTER (WHERE {rule}), NULL) AS {name}" for name, rule in _MEASURES.items()
) + " FROM q_days LEFT JOIN q_events USING (service_date) "
    "GROUP BY service_date, source_start, source_end, calendar_covered")


def _share(part, whole):
    return f"if({whole} > 0, {part} / {whole}, NULL)"


cte("q_coverage", f"""
    SELECT *, {_share("known_arrivals", "total_events")} AS known_arrival_ratio,
           {_share("known_departures", "total_events")} AS known_departure_ratio,
           {_share("regular_known_departures", "regular_events")} AS known_regular_departure_ratio
    FROM q_measured""")

REPORT_RANGE = f"service_date BETWEEN DATE '{REPORT_START}' AND DATE '{REPORT_END}'"
