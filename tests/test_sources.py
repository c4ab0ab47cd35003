import contextlib
import csv
import hashlib
import io
import json
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import as_raw, lake_tables
from tramline.functions import identity
from tramline.operators import positions
from tramline.plans.analysis import Analysis
from tramline.sources import feed_csv, positions_json, warehouse
from tramline.operators.silver import RECORD

NOW = datetime(2026, 10, 9, 12, tzinfo=UTC)


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_values_stay_text(spark, tmp_path):
    path = write(
        tmp_path / "stops.txt",
        '﻿stop_id,stop_name,note\r\n0001,"Łódź, ""N""",NA\r\n,,\r\nNULL, x ,\r\n',
    )
    rows = feed_csv.read_feed_csv(spark, path, "stops").orderBy(RECORD).collect()
    assert [tuple(r) for r in rows] == [
        ("0001", 'Łódź, "N"', "NA", 1), ("NULL", " x ", "", 3),
    ]


def python_records(text):
    """(number, fields) as the csv module reads them, blank records left out."""
    rows = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), strict=True)
    next(rows)
    return [(n, tuple(row)) for n, row in enumerate(rows, 1) if any(field.strip() for field in row)]


TEXTS = [
    'a,b\n1,"two\nlines"\n2,b\n',
    '\ufeffa,b\r\n"x, y","say ""hi"""\r\n\r\n1,"in\r\nside"\r\n,\r\n2,\r\n',
    'a,b\n1,5" pipe\n2,6"" pipe\n3,"""q"""\n4,""\n',
    'a,b\n1,"x\n\n,""\n""y,\n"\n"","\n"\n3,z',
    'a,b\n\n  ,\n1,2\n"",""\n3,\ufffd\n',
    "a,b\n",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("split", [9, 100_000])
def test_csv_equals_the_csv_module(spark, tmp_path, text, split):
    """Whole and cut into splits of a few bytes."""
    path = write(tmp_path / "a.txt", text)
    with splits_of(spark, split):
        rows = feed_csv.read_feed_csv(spark, path, "stops").collect()
    assert sorted((r[RECORD], (r.a, r.b)) for r in rows) == python_records(text)


@contextlib.contextmanager
def splits_of(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def test_csv_random_texts(spark, tmp_path):
    chance = random.Random(5)
    for number in range(3):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=chance.choice(["\n", "\r\n"]))
        writer.writerow(["a", "b"])
        for _ in range(30):
            writer.writerow(["".join(chance.choice('ab",\n ') for _ in range(chance.randint(0, 6))) for _ in range(2)])
        path = write(tmp_path / f"{number}.txt", out.getvalue())
        with splits_of(spark, chance.randint(30, 90)):
            rows = feed_csv.read_feed_csv(spark, path, "stops").collect()
        assert sorted((r[RECORD], (r.a, r.b)) for r in rows) == python_records(out.getvalue())


def test_csv_folder_is_numbered_by_file(spark, tmp_path):
    for name, size in (("b0", 3), ("a0", 50), ("c0", 1)):
        write(tmp_path / f"{name}.csv", "t\n" + "".join(f"{name}-{k}\n" for k in range(size)))
    rows = feed_csv.read_feed_csv(spark, str(tmp_path), "trips").collect()
    wanted = [f"{name}-{k}" for name, size in (("a0", 50), ("b0", 3), ("c0", 1)) for k in range(size)]
    assert [r.t for r in sorted(rows, key=lambda r: r[RECORD])] == wanted
    assert sorted(r[RECORD] for r in rows) == list(range(1, 55))


def test_csv_long_file_is_read_in_splits(spark, tmp_path):
    """One without line breaks in its fields as lines, in splits; one with some whole, and right all the same."""
    for name, quoted in (("split", "a b"), ("whole", "a\nb")):
        text = "trip_id,note\n" + "".join(f'T{i},5" pipe\n' if i % 7 else f'T{i},"{quoted}"\n' for i in range(1, 3001))
        path = write(tmp_path / f"{name}.txt", text)
        with splits_of(spark, 2000):
            frame = feed_csv.read_feed_csv(spark, path, "trips")
            assert feed_csv.read_lines(spark, path).rdd.getNumPartitions() > 10
            assert frame.count() == 3000
            assert frame.filter(F.concat(F.lit("T"), F.col(RECORD)) != F.col("trip_id")).isEmpty()
            assert frame.filter(F.col("note") == quoted).count() == 3000 // 7


def test_csv_folder_of_both_kinds(spark, tmp_path):
    """Only the file with a line break is read whole; numbers go on from file to file."""
    write(tmp_path / "a.csv", 't,n\nA1,x\n\nA2,y\n')
    write(tmp_path / "b.csv", 't,n\nB1,"two\nlines"\n" ",\n\nB2,z\n')
    write(tmp_path / "c.csv", "t,n\nC1,\n")
    rows = feed_csv.read_feed_csv(spark, str(tmp_path), "trips").collect()
    assert sorted((r[RECORD], r.t, r.n) for r in rows) == [
        (1, "A1", "x"), (3, "A2", "y"), (4, "B1", "two\nlines"), (7, "B2", "z"), (8, "C1", ""),
    ]


def test_large_files_with_line_breaks_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed_csv, "WHOLE_BYTES", 10)
    with pytest.raises(feed_csv.FeedError, match="bytes"):
        feed_csv.read_feed_csv(spark, write(tmp_path / "a.txt", 'a,b\n1,"x\ny"\n'), "stops")
    assert feed_csv.read_feed_csv(spark, write(tmp_path / "b.txt", 'a,b\n1,"x,y"\n'), "stops").count() == 1


@pytest.mark.parametrize("text", [
    'a,b\n1,a\n2,"unterminated\n3,b\n4,c\n5,d\n', 'a,b\n1,"x"y\n', 'a,b\n1,"x\ny"z\n2,b\n', 'a,b\n1,"',
])
@pytest.mark.parametrize("split", [9])
def test_csv_broken_quotes_are_refused(spark, tmp_path, text, split):
    with splits_of(spark, split), pytest.raises(feed_csv.FeedError, match="quoted"):
        feed_csv.read_feed_csv(spark, write(tmp_path / "a.txt", text), "stops")


@pytest.mark.parametrize("text", ["a,a\n1,2\n", "a, \n1,2\n", f"{RECORD}\n1\n", ""])
def test_bad_headers_are_refused(spark, tmp_path, text):
    with pytest.raises(feed_csv.FeedError):
        feed_csv.read_feed_csv(spark, write(tmp_path / "c.txt", text), "stops")


def test_short_records_and_bad_text_are_refused(spark, tmp_path):
    short = feed_csv.read_feed_csv(spark, write(tmp_path / "d.txt", "a,b\n1\n"), "stops")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        short.collect()
    latin = write(tmp_path / "e.txt", "a\nłó\n", "cp1250")
    with pytest.raises(feed_csv.FeedError, match="UTF-8"):
        feed_csv.read_feed_csv(spark, latin, "stops")


def feed_files(tmp_path, leave=()):
    paths = {}
    for name, (columns, rows) in lake_tables().items():
        if name not in leave:
            text = "\n".join([",".join(columns), *[",".join(map(str, row)) for row in rows]]) + "\n"
            paths[name] = write(tmp_path / f"{name}.txt", text)
    return paths


def issues_of(spark, folder):
    return {(r.code, r.file, r.detail) for r in feed_csv.feed_structure_check(spark, str(folder)).collect()}


def test_structure(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    feed_files(folder, leave=("agency", "calendar"))
    write(folder / "calendar_dates.txt", "service_id,date,exception_type\n,,\n")
    write(folder / "routes.txt", "route_id\nA\n")
    write(folder / "notes.txt", "a,a\n")
    assert issues_of(spark, folder) == {
        ("missing_file", "agency", ""), ("empty_calendar", None, ""),
        ("missing_columns", "routes", "route_type"), ("missing_route_name", "routes", ""),
    }


def test_structure_of_odd_files(spark, tmp_path):
    feed_files(tmp_path, leave=("calendar", "calendar_dates", "trips"))
    write(tmp_path / "agency.txt", "")
    write(tmp_path / "stops.txt", '\ufeffstop_id,"stop_name","stop_lat",stop_lon,stop_id," "\r\n,,\r\n"","",  ,\r\n')
    (tmp_path / "trips.txt").mkdir()
    write(tmp_path / "trips.txt" / "part-0.csv", "route_id,service_id,trip_id\n")
    write(tmp_path / "trips.txt" / "part-1.csv", "route_id,service_id,trip_id\nR,S,T\n")
    assert issues_of(spark, tmp_path) == {
        ("missing_columns", "agency", "agency_name,agency_timezone,agency_url"), ("empty_table", "agency", ""),
        ("duplicate_column", "stops", ""), ("empty_column", "stops", ""), ("empty_table", "stops", ""),
        ("missing_calendar", None, ""),
    }


def test_absent_calendar_is_a_typed_table_without_rows(spark, tmp_path):
    raw, present = feed_csv.read_feed(spark, feed_files(tmp_path, leave=("calendar",)))
    rows = {r.table_name: r for r in feed_csv.tables_present(raw, present).collect()}
    assert [(t, r.source_present) for t, r in rows.items() if r.normalized_empty] == [("calendar", False)]
    assert rows["calendar"].row_count == 0 and "monday:bigint" in rows["calendar"].absent_columns
    assert "start_date:date" in rows["calendar"].absent_columns and rows["trips"].row_count == 6
    with pytest.raises(feed_csv.FeedError):
        feed_csv.tables_present(raw, {**present, "trips": False})


def test_feed_to_published_kpis(spark, tmp_path):
    """CSV files to typed tables, warehouse and KPI tables, each step once and again."""
    raw, present = feed_csv.read_feed(spark, feed_files(tmp_path))
    warehouse.write_bronze(raw, str(tmp_path / "bronze"))
    bronze = {name: spark.read.parquet(str(tmp_path / "bronze" / name)) for name in raw}
    folder, store = str(tmp_path / "silver"), str(tmp_path / "store")
    manifest = warehouse.silver_gate(bronze, folder, "ab" * 32, present=present)
    flags = warehouse.verify_silver(spark, folder).collect()
    assert all(r.schema_matches and r.count_matches and r.content_matches for r in flags)
    state, entry = warehouse.load_silver(spark, folder, store)
    assert (state, entry["row_counts"]["stop_times"]) == ("LOADED", 15)
    assert warehouse.load_silver(spark, folder, store)[0] == "ALREADY_LOADED"
    name = manifest["dataset_id"]
    assert name == identity.dataset_id("ab" * 32)
    shapes = write(
        tmp_path / "shapes.txt",
        "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nS,51,17,0\nS,51.1,17.1,2\n",
    )
    assert warehouse.import_geometry(spark, store, name, "ab" * 32, shapes)[1]["point_count"] == 2
    assert warehouse.import_geometry(spark, store, name, "ab" * 32, shapes)[0] == "ALREADY_IMPORTED"
    scratch = str(tmp_path / "scratch")
    first, last = date(2027, 3, 1), date(2027, 3, 7)
    state, entry = warehouse.publish_gold(spark, store, name, first, last, scratch)
    assert state == "ANALYZED" and entry["coverage"]["total_events"] == 28
    assert entry["source_context"]["agency_timezones"] == ["Europe/Zurich"]
    assert warehouse.publish_gold(spark, store, name, first, last, scratch)[0] == "ALREADY_ANALYZED"
    tables, _ = warehouse.read_gold(spark, store, entry["analysis_id"])
    assert {n: t.count() for n, t in tables.items()} == entry["row_counts"]
    feed = warehouse.loaded_feed(spark, store, name)
    assert feed.shapes.count() == 2
    with pytest.raises(warehouse.Rejected):
        warehouse.read_gold(spark, store, "analysis_none")


def test_gate_refuses_errors_and_keeps_the_report(spark, tmp_path):
    tables = lake_tables()
    tables["trips"] = (tables["trips"][0], [(r[0], "gone", *r[2:]) for r in tables["trips"][1]])
    with pytest.raises(warehouse.QualityFailed) as failure:
        warehouse.silver_gate(as_raw(spark, tables), str(tmp_path / "s"), "cd" * 32)
    assert failure.value.report["error_count"] == 6
    assert warehouse.read_document(spark, str(tmp_path / "s" / "quality"))["status"] == "failed"
    with pytest.raises(warehouse.Rejected):
        warehouse.load_silver(spark, str(tmp_path / "s"), str(tmp_path / "w"))


def test_frequencies_block_kpis(spark, tmp_path):
    raw = as_raw(spark, lake_tables())
    templates = spark.createDataFrame([("T1",)], "trip_id string")
    folder, store = str(tmp_path / "s"), str(tmp_path / "w")
    manifest = warehouse.silver_gate(raw, folder, "ef" * 32, frequencies=templates)
    warehouse.load_silver(spark, folder, store)
    with pytest.raises(warehouse.Rejected, match="FREQUENCIES"):
        warehouse.publish_gold(
            spark, store, manifest["dataset_id"], "2027-03-01", "2027-03-02", str(tmp_path / "x")
        )


def test_fingerprint_ignores_order_and_sees_repeats(spark):
    frame = spark.range(100).select("id", F.col("id").cast("string").alias("text"))
    one = identity.content_fingerprint(frame).first()
    assert one == identity.content_fingerprint(frame.repartition(7)).first()
    assert one != identity.content_fingerprint(frame.union(frame.limit(1))).first()
    assert one != identity.content_fingerprint(frame.withColumn("text", F.lit(None).cast("string"))).first()


def test_identities_agree_with_their_columns(spark):
    frame = spark.createDataFrame([("ab" * 32,)], "h string")
    first, last = date(2026, 10, 1), date(2026, 10, 2)
    row = frame.select(
        identity.dataset_id_column(F.col("h")).alias("d"),
        identity.analysis_id_column(identity.dataset_id_column(F.col("h")), first, last).alias("a"),
    ).first()
    assert row.d == identity.dataset_id("ab" * 32)
    assert row.a == identity.analysis_id(row.d, first, last)


def observation(time="2026-10-09T14:00:00", lat=51.1, lon=17.1, vehicle="0001", line="A"):
    return {
        "Data_Aktualizacji": time, "Ostatnia_Pozycja_Szerokosc": lat,
        "Ostatnia_Pozycja_Dlugosc": lon, "Nr_Boczny": vehicle, "Nazwa_Linii": line,
    }


def test_positions(spark, tmp_path):
    records = [
        observation(), observation(time=(NOW - timedelta(hours=1)).isoformat()),
        observation(time=(NOW + timedelta(hours=1)).isoformat()),
        observation(time="2026-10-09T14:00:00+0200"), observation(time="2026-10-09 12:00:00.5Z"),
        observation(lat=900), observation(lon="NaN"), observation(lat=0, lon=0),
        observation(lat="51,1", lon="17,1", vehicle="2", line=""), "no record",
        observation(time=None, vehicle=None), None, 7,
    ]
    path = write(tmp_path / "p.json", json.dumps({"meta": {"tytul": "t"}, "dane": records}))
    raw = positions_json.read_positions(spark, path)
    rows = {r.observation_id: r for r in positions.normalize_positions(raw, NOW, True).collect()}
    assert set(rows) == {"0", "1", "2", "3", "4", "8", "10"}
    assert rows["0"].state == positions.STATE_UNKNOWN and rows["0"].age_seconds is None
    assert rows["1"].state == positions.STATE_STALE and rows["1"].age_seconds == 3600
    assert rows["2"].state == positions.STATE_FUTURE
    assert rows["3"].state == positions.STATE_RECENT and rows["3"].age_seconds == 0
    assert rows["4"].age_seconds == -0.5
    assert rows["8"].latitude == 51.1 and rows["8"].line == "Niepodana" and not rows["8"].duplicate_id
    assert rows["0"].duplicate_id and rows["10"].vehicle_id == "Niepodany"
    assert rows["10"].label.split("\n")[1] == "Brak czasu"
    summary = positions.position_summary(raw, NOW).first()
    assert tuple(summary) == (13, 6, 3)
    repeated = {r.vehicle_id: r.observations for r in positions.duplicate_vehicle_ids(raw).collect()}
    assert repeated == {"0001": 8}
    with pytest.raises(ValueError):
        positions.normalize_positions(raw, datetime(2026, 10, 9))


@pytest.mark.parametrize("text", [
    "2026-10-09T14:00:00+02:00", "2026-10-09 14:00+02", "2026-10-09T14+02", "20261009T140000+0200", "20261009T14Z",
    "2026-10-09T11:59:59.1234567Z", "2026-10-09T12:00:00,25Z", "2026-10-09T14:00:30+02:00:30", "20261009 1200Z",
    "2026-10-09T12:00:00", "2026-10-09", "2026-13-09T12:00Z", "2026-10-09T25:00Z", "2026-10-09T12:00+24:00", "soon",
])
def test_times_are_read_as_the_iso_forms_say(spark, text):
    try:
        when = datetime.fromisoformat(text)
        wanted = None if when.tzinfo is None else (NOW - when).total_seconds()
    except ValueError:
        wanted = None
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(positions.age_seconds(F.col("t"), NOW)).first()[0] == wanted


def test_position_lines(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", "\n".join(json.dumps(observation(vehicle=str(k % 3))) for k in range(9)) + "\n\nnone\n")
    rows = positions_json.read_position_lines(spark, path).collect()
    assert len(rows) == 10 and len({r.observation_id for r in rows}) == 10
    assert [r.is_object for r in rows].count(False) == 1


@pytest.mark.parametrize(
    ("title", "licence", "expected"),
    [("t", "CC0 1.0", (True, True)), ("x", "CC0 1.0", (False, False)), ("t", "other", (True, False))],
)
def test_source_terms(spark, tmp_path, title, licence, expected):
    export = write(tmp_path / "p.json", json.dumps({"meta": {"tytul": "t"}, "dane": []}))
    metadata = write(tmp_path / "m.json", json.dumps({"tytul": title, "licencja": licence}))
    assert tuple(positions_json.source_terms(spark, export, metadata).first()) == expected


def test_a_failed_run_leaves_what_was_published(spark, tmp_path):
    folder = str(tmp_path / "s")
    good = warehouse.silver_gate(as_raw(spark, lake_tables()), folder, "ab" * 32)
    before = {name: frame.count() for name, frame in warehouse.read_silver(spark, folder).items()}
    broken = lake_tables()
    broken["trips"] = (broken["trips"][0], [(r[0], "gone", *r[2:]) for r in broken["trips"][1]])
    with pytest.raises(warehouse.QualityFailed):
        warehouse.silver_gate(as_raw(spark, broken), folder, "cd" * 32)
    assert warehouse.published(spark, folder) == good
    assert {name: frame.count() for name, frame in warehouse.read_silver(spark, folder).items()} == before
    flags = warehouse.verify_silver(spark, folder).collect()
    assert all(r.schema_matches and r.count_matches and r.content_matches for r in flags)
    report = warehouse.read_document(spark, f"{folder}/quality")
    assert report["status"] == "failed" and report["row_counts"]["trips"] == 6 and "frequencies" in report["capabilities"]


def test_changed_tables_are_noticed(spark, tmp_path):
    folder = str(tmp_path / "s")
    manifest = warehouse.silver_gate(as_raw(spark, lake_tables()), folder, "ab" * 32)
    path = f"{folder}/{manifest['run']}/stops"
    changed = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    changed.withColumn("stop_name", F.concat("stop_name", F.lit("!"))).write.mode("overwrite").parquet(path)
    flags = {r.table_name: r for r in warehouse.verify_silver(spark, folder).collect()}
    assert not flags["stops"].content_matches and flags["stops"].count_matches and flags["trips"].content_matches
    with pytest.raises(warehouse.Rejected):
        warehouse.load_silver(spark, folder, str(tmp_path / "w"))


def prepared(spark, tmp_path, name="s", source="ab", tables=None):
    folder = str(tmp_path / name)
    manifest = warehouse.silver_gate(as_raw(spark, tables or lake_tables()), folder, source * 32)
    return folder, manifest["dataset_id"]


def test_of_two_loads_at_once_one_publishes(spark, tmp_path, monkeypatch):
    """The second load runs whole between the tables and the marker of the first."""
    folder, name = prepared(spark, tmp_path)
    store, states = str(tmp_path / "w"), []
    publish = warehouse.publish_once

    def interrupted(session, path, document):
        monkeypatch.setattr(warehouse, "publish_once", publish)
        states.append(warehouse.load_silver(session, folder, store))
        return publish(session, path, document)

    monkeypatch.setattr(warehouse, "publish_once", interrupted)
    states.append(warehouse.load_silver(spark, folder, store))
    assert [state for state, _ in states] == ["LOADED", "ALREADY_LOADED"]
    assert states[0][1]["run"] == states[1][1]["run"]
    assert warehouse.loaded_feed(spark, store, name).stop_times.count() == 15
    runs = list((tmp_path / "w" / "silver" / "trips" / f"dataset_id={name}" / "runs").iterdir())
    assert [run.name for run in runs] == [states[0][1]["run"].removeprefix("runs/")]


def test_a_load_that_meets_other_content_is_a_conflict(spark, tmp_path, monkeypatch):
    folder, _ = prepared(spark, tmp_path)
    other_tables = lake_tables()
    other_tables["trips"] = (other_tables["trips"][0], [(*r[:4], "Changed") for r in other_tables["trips"][1]])
    other, _ = prepared(spark, tmp_path, "other", tables=other_tables)
    store, publish = str(tmp_path / "w"), warehouse.publish_once

    def interrupted(session, path, document):
        monkeypatch.setattr(warehouse, "publish_once", publish)
        warehouse.load_silver(session, other, store)
        return publish(session, path, document)

    monkeypatch.setattr(warehouse, "publish_once", interrupted)
    with pytest.raises(warehouse.Rejected, match="CONFLICT"):
        warehouse.load_silver(spark, folder, store)


def test_a_marker_is_published_once(spark, tmp_path):
    path = str(tmp_path / "m" / "marker")
    assert warehouse.publish_once(spark, path, {"a": 1}) and not warehouse.publish_once(spark, path, {"a": 2})
    assert warehouse.read_document(spark, path) == {"a": 1}
    warehouse.replace_document(spark, path, {"a": "ż"})
    assert warehouse.published_document(spark, path) == {"a": "ż"}
    assert warehouse.read_document(spark, str(tmp_path / "m" / "none")) is None
    (tmp_path / "m" / "begun").write_text("")
    with pytest.raises(warehouse.Rejected, match="never finished"):
        warehouse.published_document(spark, str(tmp_path / "m" / "begun"), seconds=1)


def test_a_failed_analysis_leaves_the_former_rows(spark, tmp_path, monkeypatch):
    """The fifth output of a new run fails; what was published stays until a whole run replaces it."""
    folder, name = prepared(spark, tmp_path)
    store, scratch = str(tmp_path / "w"), str(tmp_path / "x")
    warehouse.load_silver(spark, folder, store)
    dates = date(2027, 3, 1), date(2027, 3, 7)
    _, entry = warehouse.publish_gold(spark, store, name, *dates, scratch)
    before, _ = warehouse.read_gold(spark, store, entry["analysis_id"])
    rows = {o: sorted(map(str, f.collect())) for o, f in before.items()}
    whole = Analysis.tables

    def broken(analysis):
        tables = whole(analysis)
        fifth = list(tables)[4]
        tables[fifth] = tables[fifth].filter(F.raise_error(F.lit("lost")).isNull())
        return tables

    monkeypatch.setattr(Analysis, "tables", broken)
    with pytest.raises(Exception, match="lost"):
        warehouse.publish_gold(spark, store, name, *dates, scratch, replace=True)
    monkeypatch.setattr(Analysis, "tables", whole)
    after, found = warehouse.read_gold(spark, store, entry["analysis_id"])
    assert found == entry and {o: sorted(map(str, f.collect())) for o, f in after.items()} == rows
    state, new = warehouse.publish_gold(spark, store, name, *dates, scratch, replace=True)
    assert state == "ANALYZED" and new["run"] != entry["run"]
    assert {o: sorted(map(str, f.collect())) for o, f in before.items()} == rows
    assert warehouse.read_gold(spark, store, entry["analysis_id"])[1]["run"] == new["run"]


def test_a_damaged_folder_is_described(spark, tmp_path):
    folder, _ = prepared(spark, tmp_path)
    run = f"{folder}/{warehouse.published(spark, folder)['run']}"
    stops = spark.read.parquet(f"{run}/stops")
    warehouse.write_parquet(spark.createDataFrame(stops.collect(), stops.schema).drop("stop_lat"), f"{run}/stops")
    trips = spark.read.parquet(f"{run}/trips")
    warehouse.write_parquet(spark.createDataFrame(trips.collect(), trips.schema).withColumn("direction_id", F.col("direction_id").cast("string")), f"{run}/trips")
    warehouse.discard(spark, [f"{run}/routes"])
    flags = {r.table_name: (r.schema_matches, r.count_matches, r.content_matches) for r in warehouse.verify_silver(spark, folder).collect()}
    assert flags["stops"] == (False, True, False) and flags["trips"] == (False, True, True)
    assert flags["routes"] == (False, False, False) and flags["agency"] == (True, True, True)


def test_position_documents(spark, tmp_path):
    exports, metadata = tmp_path / "exports", tmp_path / "metadata"
    for folder in (exports, metadata):
        folder.mkdir()
    documents = {
        "a": {"meta": {"tytul": "one"}, "dane": [observation(), "no record", None, 7]},
        "b": {"meta": {"tytul": "two"}, "dane": [observation(vehicle="9")]}, "c": {"meta": {"tytul": "gone"}, "dane": []},
        "d": {"meta": {"tytul": "one"}, "dane": "no list"}, "e": {"dane": [observation(line="Z")]},
        "f": {"meta": {"tytul": "three"}, "dane": [observation(line="Q")]},
    }
    for name, document in documents.items():
        write(exports / f"{name}.json", json.dumps(document, indent=1))
    for k, (title, licence) in enumerate([("one", "CC0 1.0"), ("two", "CC0 1.0"), ("two", "other"), ("three", None)]):
        write(metadata / f"{k}.json", json.dumps({"tytul": title, "licencja": licence}))
    rows = positions_json.read_position_documents(spark, str(exports), str(metadata)).collect()
    found = sorted((r.title or "", -1 if r.place is None else r.place, r.status, r.metadata_consistent, r.terms_confirmed, r.is_object) for r in rows)
    assert found == [
        ("", 0, "available", False, False, True), ("gone", -1, "available", False, False, False),
        ("one", -1, "unavailable", False, False, False), ("one", 0, "available", True, True, True),
        ("one", 1, "available", True, True, False), ("one", 2, "available", True, True, False),
        ("one", 3, "available", True, True, False), ("three", 0, "available", True, False, True),
        ("two", 0, "available", True, False, True),
    ]


def test_manifest_rows(spark, tmp_path):
    """What a write observed equals what a reader computes from the files."""
    written = warehouse.write_bronze(as_raw(spark, lake_tables()), str(tmp_path))
    for row in warehouse.manifest_rows(spark, written).collect():
        found = identity.content_fingerprint(spark.read.parquet(str(tmp_path / row.table_name))).first()
        assert (row.row_count, row.content_hash) == tuple(found)
        assert [c.split(":")[0] for c in row.columns.split(",")] == spark.read.parquet(str(tmp_path / row.table_name)).columns


def test_the_structure_check_sorts_no_lines(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name\n1,x\n")
    found = feed_csv.feed_structure_check(spark, str(tmp_path))
    assert ("missing_file", "trips") in {(r.code, r.file) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "min(struct(" not in plan and "min(CASE WHEN" in plan


def test_fingerprint_sums_lanes_exactly(spark):
    """Count and hash of texts worked out in plain Python; NULL, empty text, signs and large lanes included."""
    rows = [(1, None), (None, ""), (3, "-"), (4, "=1:a"), (4, "=1:a"), (5, "\U0001f600 x")] + [(k, f"t{k}") for k in range(300)]
    texts = ["".join("-" if v is None else f"={len(str(v))}:{v}" for v in row) for row in rows]
    digests = [hashlib.sha256(text.encode()).hexdigest() for text in texts]
    low, high = (sum(int(d[at : at + 15], 16) for d in digests) for at in (0, 15))
    wanted = (len(rows), hashlib.sha256(f"{len(rows)}:{low}:{high}".encode()).hexdigest())
    frame = spark.createDataFrame(rows, "`a b` long, text string")
    assert tuple(identity.content_fingerprint(frame).first()) == wanted
    empty = hashlib.sha256(b"0:0:0").hexdigest()
    assert tuple(identity.content_fingerprint(frame.limit(0)).first()) == (0, empty)
    names = {part for name in identity.LANES for part in (f"_{name}_0", f"_{name}_20", f"_{name}_40")}
    kinds = {f.name: f.dataType.simpleString() for f in identity.with_lanes(frame).schema if f.name not in frame.columns}
    assert kinds == dict.fromkeys(names, "bigint")  # rows are summed as whole numbers


def test_a_load_checks_what_it_writes(spark, tmp_path, monkeypatch):
    """Tables are read once; one that differs from its manifest leaves nothing behind."""
    folder, name = prepared(spark, tmp_path)
    run = f"{folder}/{warehouse.published(spark, folder)['run']}"
    monkeypatch.delattr(warehouse, "content_fingerprint")
    assert warehouse.load_silver(spark, folder, str(tmp_path / "w"))[0] == "LOADED"
    stops = spark.read.parquet(f"{run}/stops")
    changed = spark.createDataFrame(stops.collect(), stops.schema).withColumn("stop_name", F.lit("x"))
    warehouse.write_parquet(changed, f"{run}/stops")
    with pytest.raises(warehouse.Rejected, match="stops"):
        warehouse.load_silver(spark, folder, str(tmp_path / "v"))
    assert not list((tmp_path / "v").rglob("*.parquet"))


def test_times_are_written_as_the_formatter_does(spark):
    from tramline.functions import labels

    times = [0, 59, 60, 3599, 36000, 359_999, 360_000, 10**9, -1, -3661]
    frame = spark.createDataFrame([(t,) for t in times], "t bigint").select("t", labels.service_time(F.col("t")).alias("x"))
    signed = lambda t, n: (-1 if t < 0 else 1) * (abs(t) // n)
    rest = lambda t: (-1 if t < 0 else 1) * (abs(t) % 60)
    assert {r.t: r.x for r in frame.collect()} == {t: "%02d:%02d:%02d" % (signed(t, 3600), rest(signed(t, 60)), rest(t)) for t in times}
