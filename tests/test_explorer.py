from datetime import date

import pytest
from pyspark.sql import functions as F

from tramline.functions import labels
from tramline.operators import explorer

FAIR = date(2027, 3, 5)
MONDAY = date(2027, 3, 1)


def test_active_trips_follow_exceptions(lake):
    assert [r.trip_id for r in explorer.active_trips(lake, FAIR).collect()] == ["f1"]
    assert {r.trip_id for r in explorer.active_trips(lake, MONDAY).collect()} == {"s1", "s2", "s3", "s4"}
    assert {r.route_id for r in explorer.active_routes(lake, MONDAY).collect()} == {"B", "T"}


def test_repeated_visits_are_kept(lake):
    found = explorer.trip_visits(lake, MONDAY, trip="s3")
    assert [(v.stop_sequence, v.stop_id) for v in found.collect()] == [(10, "0042"), (20, "None"), (30, "0042")]
    markers = explorer.stop_markers(found, "None").collect()
    assert {(m.stop_id, m.selected) for m in markers} == {("0042", False), ("None", True)}
    summary = explorer.trip_summary(found).first()
    assert (summary.first_stop, summary.last_stop, summary.visits) == ("Pier", "Pier", 3)


def test_variants_group_equal_patterns(lake):
    found = explorer.variants(lake, MONDAY, route="B").collect()
    assert sorted((v.trip_count, v.first_seconds) for v in found) == [(1, 25200), (2, 21600)]
    times = {t.trip_id: (t.start_seconds, t.end_seconds) for t in explorer.trip_patterns(lake).collect()}
    assert times["s4"] == (81000, 93900)


def test_trip_without_visits_stays(lake):
    trips = lake.with_tables(stop_times=lake.stop_times.filter(F.col("trip_id") != "s1"))
    rows = {r.trip_id: r for r in explorer.trip_patterns(trips).collect()}
    assert len(rows) == 6 and rows["s1"].start_seconds is None


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_positions_equal_brute_force(spark, monkeypatch, block):
    """Sparse sequences and one trip far longer than a block."""
    monkeypatch.setattr(explorer, "BLOCK", block)
    visits = spark.range(300).select(
        F.when(F.col("id") < 250, F.lit("long")).otherwise(F.lit("short")).alias("trip_id"),
        (F.col("id") * F.col("id")).alias("stop_sequence"),
    )
    rows = explorer.positioned_visits(visits).collect()
    for trip in ("long", "short"):
        mine = sorted((r.stop_sequence, r.position) for r in rows if r.trip_id == trip)
        assert [position for _, position in mine] == list(range(1, len(mine) + 1))


def test_equal_stops_with_other_numbers_share_a_pattern(spark):
    def visits(trip, numbers, stops):
        return [(trip, s, n, 1, 1) for n, s in zip(numbers, stops, strict=True)]

    rows = (
        visits("a", (0, 1, 2), "xyx") + visits("b", (5, 5000, 9_000_000), "xyx")
        + visits("c", (0, 1, 2), "xxy") + visits("d", (0, 1), "xy")
    )
    found = explorer.stop_patterns(
        spark.createDataFrame(
            rows,
            "trip_id string, stop_id string, stop_sequence bigint, arrival_seconds bigint, departure_seconds bigint",
        )
    )
    pattern = {r.trip_id: r.stop_pattern for r in found.collect()}
    assert pattern["a"] == pattern["b"] and len(set(pattern.values())) == 3


def test_departures_and_labels(lake):
    rows = explorer.stop_departures(lake, MONDAY, "B", "None").collect()
    assert {r.trip_id: r.departure_seconds for r in rows} == {"s1": 22500, "s2": None, "s3": 25800}
    table = explorer.timetable_view(explorer.trip_visits(lake, MONDAY, trip="s2")).collect()
    assert [(r.departure, r.boarding, r.time_kind) for r in table] == [
        ("06:20:00", "Regularne", "Dokładny"),
        ("Brak czasu", "Regularne", "Przybliżony"),
        ("07:05:00", "Na żądanie telefoniczne", "Dokładny"),
    ]


def test_texts(spark):
    frame = spark.createDataFrame(
        [(90600, 13, 16), (3_600_000_000, 1, 0), (None, None, 5), (59, 1, 3)],
        "seconds bigint, part bigint, whole bigint",
    )
    found = frame.select(
        labels.service_time(F.col("seconds")), labels.percent(F.col("part"), F.col("whole"))
    ).collect()
    assert [tuple(r) for r in found] == [
        ("25:10:00", "81.2%"), ("1000000:00:00", "Nieokreślone"), ("Brak czasu", "Nieokreślone"),
        ("00:00:59", "33.3%"),
    ]


@pytest.mark.parametrize("whole", [7, 8, 16, 40, 200, 2000, 2048, 10_000, 30_000])
def test_shares_are_rounded_as_the_binary_value(spark, whole):
    parts = spark.range(0, whole + 1, max(1, whole // 600)).select(
        F.col("id").alias("part"), F.lit(whole).cast("long").alias("whole")
    )
    found = parts.select("part", labels.percent(F.col("part"), F.col("whole")).alias("share")).collect()
    assert {r.part: r.share for r in found} == {r.part: f"{100 * r.part / whole:.1f}%" for r in found}


def test_route_search(lake):
    routes = explorer.routes_view(lake)
    assert [r.route_id for r in explorer.route_search(routes, labels.TRAM).collect()] == ["T"]
    assert [r.route_id for r in explorer.route_search(routes, text="US TEN").collect()] == ["B"]
    street = routes.withColumn("route_long_name", F.when(F.col("route_id") == "Q", "Lange Straße ΟΔΟΣ").otherwise("x"))
    for text in ("STRASSE", "straße", "οδος"):
        assert [r.route_id for r in explorer.route_search(street, text=text).collect()] == ["Q"]
    doubled = routes.withColumn("route_short_name", F.lit("1"))
    label = {r.route_id: r.route_label for r in explorer.with_route_label(doubled).collect()}
    assert label["T"] == "1 · Tramwaj · Lake Lines · agency_id=None · route_id=T"
