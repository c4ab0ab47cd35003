"""KPI values of the lake feed, counted by hand.

Every school day has 11 visits: 10 with a time, 8 with regular pickup of which 7 have a time, one
without pickup and two on request. The market trip adds two regular visits, the fair trip one
regular visit and one without pickup.
"""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tramline.operators import events, gold, reports, service_calendar
from tramline.plans.analysis import Analysis

FIRST, LAST = date(2027, 3, 1), date(2027, 3, 7)
MONDAY, WEDNESDAY, FRIDAY, SATURDAY = (date(2027, 3, n) for n in (1, 3, 5, 6))


def day(number):
    return date(2027, 3, number)


@pytest.fixture(scope="module")
def analysis(lake):
    return Analysis(lake, FIRST, LAST)


def pairs(frame, *columns):
    return sorted(tuple(row) for row in frame.select(*columns).collect())


def of(frame, on, route, stop):
    return frame.filter(
        (F.col("service_date") == F.lit(on)) & (F.col("route_id") == route) & (F.col("stop_id") == stop)
    )


def test_services_run_by_week_and_exception(analysis):
    assert pairs(analysis.active_services, "service_date", "service_id") == [
        (MONDAY, "school"), (WEDNESDAY, "market"), (WEDNESDAY, "school"), (FRIDAY, "fair"), (SATURDAY, "market"),
    ]


def test_trips_per_route_and_day(analysis):
    ran = analysis.route_daily.filter("trip_count > 0")
    assert pairs(ran, "service_date", "route_id", "trip_count") == [
        (MONDAY, "B", 3), (MONDAY, "T", 1), (WEDNESDAY, "B", 4), (WEDNESDAY, "T", 1), (FRIDAY, "T", 1), (SATURDAY, "B", 1),
    ]
    assert analysis.route_daily.count() == 7 * 3


def test_departures_per_stop(analysis):
    monday = analysis.stop_daily.filter(F.col("service_date") == F.lit(MONDAY))
    assert pairs(monday, "stop_id", "regular_known_departures", "distinct_routes") == [
        ("0042", 5, 2), ("HUB-A", 0, 0), ("None", 0, 0), ("nan", 2, 2),
    ]


def test_headways(analysis):
    # 6:00, 6:20, 7:00 and 7:20: gaps of 20, 40 and 20 minutes
    row = of(analysis.route_stop_headways, MONDAY, "B", "0042").first()
    assert (row.departure_count, row.interval_count) == (4, 3)
    assert (row.avg_seconds, row.median_seconds, row.p90_seconds) == (1600, 1200, 2160)
    none = of(analysis.route_stop_headways, MONDAY, "B", "None").first()
    assert (none.departure_count, none.interval_count, none.avg_seconds) == (0, 0, None)
    both = of(analysis.route_stop_headways, WEDNESDAY, "B", "0042").collect()
    assert {row.direction_id: row.departure_count for row in both} == {0: 4, None: 1}


def test_hours_of_the_service_day(analysis):
    assert pairs(of(analysis.route_stop_hourly, MONDAY, "B", "0042"), "service_hour", "departure_count", "approximate_departures") == [
        (6, 2, 0), (7, 2, 1),
    ]
    assert pairs(of(analysis.route_stop_hourly, MONDAY, "T", "nan"), "service_hour") == [(26,)]


def test_coverage(analysis):
    rows = {row.service_date: row for row in analysis.coverage_daily.collect()}
    monday = rows[MONDAY]
    assert (monday.total_events, monday.known_arrivals, monday.known_departures) == (11, 10, 10)
    assert (monday.regular_events, monday.regular_known_departures) == (8, 7)
    assert (monday.no_pickup_events, monday.on_request_events, monday.approximate_timepoint_events) == (1, 2, 2)
    assert rows[day(2)].total_events == 0 and rows[day(2)].known_arrival_ratio is None
    assert [rows[d].total_events for d in (WEDNESDAY, FRIDAY, SATURDAY)] == [13, 2, 2]


def test_span(analysis):
    row = of(analysis.service_span, MONDAY, "B", "None").first()
    assert (row.observation_count, row.regular_event_count, row.missing_regular_departures) == (0, 1, 1)
    assert row.first_departure_seconds is None and row.known_regular_ratio == 0
    tram = of(analysis.service_span, MONDAY, "T", "nan").first()
    assert tram.first_departure_seconds == tram.last_departure_seconds == 26 * 3600 + 300


def overview(analysis, first, last):
    a = analysis
    return reports.overview(
        a.analysis_days, a.coverage_daily, a.route_daily, a.service_span, a.feed.stops, first, last
    ).first()


def test_overview(analysis):
    three = overview(analysis, MONDAY, WEDNESDAY)
    assert (three.trips, three.departures, three.regular_events) == (9, 16, 18)
    assert (three.active_routes, three.served_stops, three.catalog_stops) == (2, 3, 7)
    week = overview(analysis, FIRST, LAST)
    assert (week.trips, week.departures, week.regular_events, week.total_events) == (11, 19, 21, 28)


def test_top_lists_have_the_wanted_length(analysis):
    found = reports.top_routes(analysis.route_daily, analysis.feed.routes, FIRST, LAST, top=2).collect()
    assert [(r.route_id, r.trips) for r in found] == [("B", 8), ("T", 3)]
    stops = reports.top_stops(analysis.stop_daily, analysis.feed.stops, FIRST, LAST).collect()
    assert [(r.stop_id, r.departures) for r in stops][:1] == [("0042", 12)]


def test_group_views(analysis):
    a = analysis
    known = pairs(reports.group_daily(a.analysis_days, a.service_span, FIRST, LAST, "B", "0042", "0"), "service_date", "departures")
    assert known == [(day(n), 4 if n in (1, 3) else 0) for n in range(1, 8)]
    unknown = reports.group_daily(a.analysis_days, a.service_span, FIRST, WEDNESDAY, "B", "0042", "NULL")
    assert pairs(unknown, "service_date", "departures") == [(day(1), 0), (day(2), 0), (day(3), 1)]
    never = reports.group_daily(a.analysis_days, a.service_span, MONDAY, MONDAY, "no'; --", "0042")
    assert pairs(never, "departures", "calendar_covered") == [(0, True)]


def test_direction_choice_is_checked():
    with pytest.raises(ValueError):
        reports.direction_predicate("7")


def test_outside_the_envelope_is_unknown(lake):
    feed = lake.with_tables(
        calendar=lake.calendar.limit(0),
        calendar_dates=lake.calendar_dates.filter("exception_type = 1").withColumn(
            "date", F.when(F.col("service_id") == "fair", F.lit(day(6))).otherwise(F.lit(day(3)))
        ),
    )
    rows = Analysis(feed, FIRST, LAST).analysis_days.orderBy("service_date").collect()
    assert [row.calendar_covered for row in rows] == [False, False, True, True, True, True, False]
    assert [row.trip_instances for row in rows] == [None, None, 1, 0, 0, 1, None]


def test_summary_outside_is_all_unknown(lake):
    later = Analysis(lake, day(20), day(22))
    totals = gold.coverage_totals(later.coverage).first()
    assert totals.total_events is None and totals.covered_days == 0
    assert later.stop_daily.filter("regular_known_departures is not null").isEmpty()


def test_clock_change_days_keep_their_axis(lake):
    """28 March 2027 has 23 wall-clock hours; seconds of the service day do not move."""
    feed = lake.with_tables(
        calendar_dates=lake.calendar_dates.limit(1).select(
            F.lit("school").alias("service_id"), F.lit(day(28)).alias("date"),
            F.lit(1).cast("long").alias("exception_type"), "_source_record", "extra_fields",
        )
    )
    row = of(Analysis(feed, day(28), day(28)).service_span, day(28), "T", "nan").first()
    assert row.first_departure_seconds == 26 * 3600 + 300


def test_limits_are_the_callers(lake):
    with pytest.raises(events.LimitExceeded):
        events.estimate_guard(lake, FIRST, LAST, max_events=27)
    with pytest.raises(events.LimitExceeded):
        events.estimate_guard(lake, FIRST, LAST, max_grid_rows=48)
    with pytest.raises(events.LimitExceeded):
        events.estimate_guard(lake, FIRST, FIRST + timedelta(days=9), max_days=9)
    row = events.estimate_guard(lake, FIRST, LAST, max_days=7, max_events=28, max_grid_rows=49).first()
    assert (row.events, row.instances, row.grid_rows) == (28, 11, 7 * (3 + 4))
    assert events.estimate_guard(lake, FIRST, FIRST + timedelta(days=2000)).first().events > 28


def test_same_second_departures_have_zero_headway(spark):
    rows = [("d", "r", "s", None, second) for second in (50, 50, 80, 80, 80, 200)]
    frame = spark.createDataFrame(
        rows, "service_date string, route_id string, stop_id string, direction_id bigint, departure bigint"
    ).withColumns({"regular": F.lit(1), "departures": F.lit(1), "approximate": F.lit(0)})
    profile = frame.groupBy(*events.GROUP, "departure").agg(
        *[F.sum(n).alias(n) for n in ("regular", "departures", "approximate")]
    )
    row = gold.gold_headways(profile).first()
    # gaps 0, 30, 0, 0, 120; sorted 0 0 0 30 120, so the 90th percentile is 30 + 0.6 * 90
    assert (row.departure_count, row.interval_count) == (6, 5)
    assert (row.avg_seconds, row.median_seconds, round(row.p90_seconds, 9)) == (30, 0, 84)


def test_shared_profile_gives_the_same_tables(analysis, tmp_path):
    shared = Analysis(analysis.feed, FIRST, LAST).share_profile(str(tmp_path / "profile"))
    for name, table in analysis.tables().items():
        other = shared.tables()[name]
        assert table.exceptAll(other).isEmpty() and other.exceptAll(table).isEmpty(), name


def test_bounded_fetch_never_cuts(spark):
    assert reports.bounded_fetch(spark.range(9), 9).count() == 9
    with pytest.raises(reports.TooManyRows):
        reports.bounded_fetch(spark.range(9), 8)


def test_report_range_must_lie_inside(analysis):
    with pytest.raises(ValueError):
        reports.check_range(analysis, day(1), day(8))


def test_reversed_calendar_never_runs(lake):
    feed = lake.with_tables(
        calendar=lake.calendar.withColumn("end_date", F.lit(date(2027, 2, 1))),
        calendar_dates=lake.calendar_dates.limit(0),
    )
    assert service_calendar.active_services(feed, FIRST, LAST).isEmpty()


def test_one_service_with_nearly_all_trips(spark, lake):
    """Nine tenths of the trips share a service; joins without broadcast give the same counts."""
    trips = spark.range(3000).select(
        F.concat(F.lit("x"), "id").alias("trip_id"), F.lit("B").alias("route_id"),
        F.when(F.col("id") % 10 == 0, "market").otherwise("school").alias("service_id"),
        F.lit(0).cast("long").alias("direction_id"),
    )
    feed = lake.with_tables(trips=trips)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {name: spark.conf.get(name) for name in settings}
    counted = pairs(events.trip_instances(feed, FIRST, LAST).groupBy("service_date").count(), "service_date", "count")
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        shuffled = events.trip_instances(feed, FIRST, LAST).groupBy("service_date").count()
        assert pairs(shuffled, "service_date", "count") == counted == [(MONDAY, 2700), (WEDNESDAY, 3000), (SATURDAY, 300)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_span_and_headways_agree_with_both_tables(analysis):
    both = analysis.span_headways
    keys = ["service_date", "route_id", "stop_id", "direction_id"]
    for table, extra in ((analysis.service_span, ["first_departure_seconds", "regular_event_count", "observation_count"]),
                         (analysis.route_stop_headways, ["interval_count", "median_seconds", "p90_seconds"])):
        columns = keys + extra
        assert sorted(map(repr, both.select(columns).collect())) == sorted(map(repr, table.select(columns).collect()))


def test_percentiles_without_a_map_per_group(spark):
    """Places in the sorted group give what the exact percentile with frequencies gives, groups without gaps included."""
    rows = [(date(2024, 1, 1 + k % 2), f"R{k % 3}", f"S{k % 5}", None if k % 4 == 0 else k % 2, None if k % 7 == 0 else k * k % 900, 1, k % 3, 0) for k in range(400)]
    rows.append((date(2024, 1, 9), "R", "S", 0, None, 1, 0, 0))
    profile = spark.createDataFrame(
        rows, "service_date date, route_id string, stop_id string, direction_id bigint, departure bigint, regular bigint, departures bigint, approximate bigint"
    ).groupBy(*events.GROUP, "departure").agg(*[F.sum(n).alias(n) for n in ("regular", "departures", "approximate")])
    wanted = gold._headway_entries(profile).groupBy(*events.GROUP).agg(
        F.percentile("gap", F.lit(0.5), F.col("times")).alias("m"), F.percentile("gap", F.lit(0.9), F.col("times")).alias("p")
    )
    key = lambda r: tuple(map(str, r))
    found = gold.gold_headways(profile)
    assert "percentile(" not in found._jdf.queryExecution().toString()
    shown = found.select(*events.GROUP, "median_seconds", "p90_seconds").collect()
    assert sorted(map(tuple, shown), key=key) == sorted(map(tuple, wanted.collect()), key=key)
    assert any(r.median_seconds is None for r in shown) and any((r.p90_seconds or 0) % 1 for r in shown)


def test_published_headways_and_spans_share_their_totals(lake, tmp_path):
    analysis = Analysis(lake, FIRST, LAST)
    single = [sorted(map(str, f.collect())) for f in (analysis.route_stop_headways, analysis.service_span)]
    shared = analysis.share_profile(str(tmp_path / "profile"))
    tables = (shared.route_stop_headways, shared.service_span)
    assert [sorted(map(str, f.collect())) for f in tables] == single
    assert all("Exchange" not in f._jdf.queryExecution().executedPlan().toString() for f in tables)


def test_counts_of_headways_need_no_sorted_groups(spark, analysis):
    """The number of groups is counted without windows over their departures."""
    counted = analysis.route_stop_headways.agg(F.count("*"))
    assert "Window" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert counted.first()[0] == analysis.service_span.count()


def test_published_stops_start_from_totals(lake, tmp_path):
    """Stops read a row per group, not one per group and second."""
    shared = Analysis(lake, FIRST, LAST).share_profile(str(tmp_path / "profile"))
    files = shared.stop_daily.inputFiles()
    assert any("profile-totals" in name for name in files) and not any("/profile/" in name for name in files)
