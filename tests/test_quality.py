"""Typing rules and quality checks by injected faults."""

import pytest
from pyspark.sql import functions as F

from tests.fixtures import as_raw, lake_tables
from tramline.functions import parsing
from tramline.operators import quality, silver
from tramline.operators.silver import RECORD


def codes(raw, frequencies=None):
    found = quality.summarize(quality.all_findings(raw, frequencies)).collect()
    return {row.code for row in found if row.severity == "error"}


def test_clean_feed_has_only_warnings(spark):
    checks = quality.summarize(quality.all_findings(as_raw(spark, lake_tables())))
    assert {(r.code, r.findings) for r in checks.collect()} == {
        ("unknown_departure", 1), ("unknown_arrival", 1),
    }
    assert quality.report_status(checks).first().status == "passed"


# For each kind of column: texts that are no value of it.
NO_VALUE = {
    "integer": ("+4", "4,0", "iv"),
    "float": ("47.1.0", "inf", "1e400"),
    "date": ("20270229", "01.03.2027", ""),
}


def rule_faults():
    """(table, column, text, code) from the table of column rules."""
    for table, rules in silver.RULES.items():
        for name, rule in rules.items():
            if rule.kind == "id":
                yield table, name, "x\t", "id_whitespace"
                if rule.required:
                    yield table, name, "", "required_id"
            elif rule.kind == "text" and rule.required:
                yield table, name, "  ", "required_text"
            elif rule.kind in NO_VALUE:
                code = {"integer": "invalid_integer_or_enum", "float": "invalid_coordinate", "date": "invalid_date"}[rule.kind]
                for text in NO_VALUE[rule.kind]:
                    yield table, name, text, code
                if rule.choices:
                    yield table, name, str(max(rule.choices) + 1), code
                if rule.kind == "integer" and rule.required:
                    yield table, name, "", code
    yield "stops", "stop_lat", "-90.5", "invalid_coordinate"
    yield "stops", "stop_lon", "180.01", "invalid_coordinate"
    yield "stops", "stop_lon", "", "required_coordinate"
    yield "stops", "stop_name", " ", "required_stop_name"
    yield "agency", "agency_timezone", "Lake/Shore", "invalid_timezone"
    yield "stop_times", "arrival_time", "6:7:08", "invalid_gtfs_time"
    yield "stop_times", "departure_time", "noon", "invalid_gtfs_time"


def with_value(table, column, text):
    """The lake feed with another text in the first row of a table; a missing column is added."""
    tables = lake_tables()
    columns, rows = tables[table]
    if column not in columns:
        columns, rows = [*columns, column], [(*row, "") for row in rows]
    place = columns.index(column)
    tables[table] = (columns, [(*rows[0][:place], text, *rows[0][place + 1 :]), *rows[1:]])
    return tables


@pytest.mark.parametrize("table", list(silver.RULES))
def test_faults_of_single_rows(spark, table):
    """All faults of a table's columns, each in a feed of its own, looked for in one pass."""
    found = []
    wanted = [fault for fault in rule_faults() if fault[0] == table]
    for number, (_, column, text, code) in enumerate(wanted):
        raw = as_raw(spark, with_value(table, column, text))
        row = quality.row_findings(table, raw[table].filter(F.col(RECORD) == 1), raw["agency"], {code})
        found.append(row.filter(F.col("column_name") == column).select(F.lit(number).alias("fault")))
    assert {r.fault for r in silver.union_all(found).collect()} == set(range(len(wanted)))


@pytest.mark.parametrize(("table", "column", "text", "check"), [
    ("routes", "agency_id", "elsewhere", quality.orphan_references), ("stops", "parent_station", "nowhere", quality.orphan_references),
    ("trips", "service_id", "never", quality.unknown_services), ("stop_times", "stop_id", "nowhere", quality.orphan_references),
    ("stop_times", "arrival_time", "", quality.missing_exact_times), ("calendar", "end_date", "20270228", quality.calendar_ranges),
])
def test_faults_across_rows(spark, table, column, text, check):
    assert check(silver.silver_tables(as_raw(spark, lake_tables()))).isEmpty()
    assert not check(silver.silver_tables(as_raw(spark, with_value(table, column, text)))).isEmpty()


def test_repeated_rows_are_found_per_table(spark):
    tables = {name: (c, [*rows, rows[0]]) for name, (c, rows) in lake_tables().items()}
    found = quality.duplicate_keys(silver.silver_tables(as_raw(spark, tables))).collect()
    assert {row.table_name for row in found} == set(silver.TABLES)


def visits(spark, rows):
    return spark.createDataFrame(
        [(trip, seq, arr, dep, i) for i, (trip, seq, arr, dep) in enumerate(rows, 1)],
        f"trip_id string, stop_sequence bigint, arrival_seconds bigint, departure_seconds bigint, {RECORD} bigint",
    )


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_time_decreases_equals_brute_force(spark, monkeypatch, block):
    import random

    chance = random.Random(7)
    rows = [
        (chance.choice("ABC"), chance.randint(0, 30), chance.choice([None, chance.randint(0, 50)]),
         chance.choice([None, chance.randint(0, 50)]))
        for _ in range(200)
    ]
    monkeypatch.setattr(quality, "BLOCK", block)
    found = quality.time_decreases({"stop_times": visits(spark, rows)})
    expected = 0
    for trip in "ABC":
        points = sorted(
            (seq, phase, seconds)
            for t, seq, *times in rows if t == trip
            for phase, seconds in enumerate(times) if seconds is not None
        )
        expected += sum(b[2] < a[2] for a, b in zip(points, points[1:], strict=False))
    assert expected > 10
    assert found.agg(F.sum("occurrences")).first()[0] == expected


def test_missing_time_does_not_reset_the_comparison(spark):
    rows = [("A", 0, 100, 100), ("A", 1, None, None), ("A", 2, 50, 60)]
    assert quality.time_decreases({"stop_times": visits(spark, rows)}).count() == 1


def test_endpoints(spark):
    rows = [("A", 0, None, 1), ("A", 5, 2, 2), ("B", 0, 1, 1), ("B", 1, None, 2), ("B", 2, None, 3),
            ("C", 4, None, 1)]
    found = quality.missing_endpoint_arrivals({"stop_times": visits(spark, rows)}).collect()
    assert {(row.value, row.occurrences) for row in found} == {("A", 1), ("B", 1), ("C", 1)}


def test_only_examples_are_cut(spark):
    tables = lake_tables()
    columns, rows = tables["stop_times"]
    tables["stop_times"] = (columns, [(f"{'y' * 150}{i}", *row[1:]) for i, row in enumerate(rows)])
    found = quality.all_findings(as_raw(spark, tables))
    lost = [r for r in found.collect() if r.code == "orphan_reference"]
    assert len(lost) == 15 and all(len(r.value) > 150 for r in lost)
    shown = [r for r in quality.examples(found).collect() if r.code == "orphan_reference"]
    assert len(shown) == 5 and all(len(r.value) == 100 for r in shown)
    few = quality.examples(found, per_check=2, total=3, length=9).collect()
    assert len(few) == 3 and all(r.value is None or len(r.value) <= 9 for r in few)


def test_agency_rules(spark):
    tables = lake_tables()
    tables["agency"] = (
        ["agency_id", "agency_name", "agency_url", "agency_timezone"],
        [("A", "a", "u", "Europe/Warsaw"), ("", "b", "u", "Europe/Berlin"), ("C", "c", "u", "Mars/Base")],
    )
    raw = as_raw(spark, tables)
    assert {"ambiguous_agency", "multi_agency_missing_id", "multiple_agency_timezones",
            "invalid_timezone"} <= codes(raw)
    single = as_raw(spark, lake_tables())
    routes = silver.to_silver("routes", single["routes"], single["agency"])
    assert {row[0] for row in routes.select("_agency_key").collect()} == {"__single_agency__"}


def test_parent_rules(spark):
    tables = lake_tables()
    columns, rows = tables["stops"]
    tables["stops"] = (columns, [*rows, ("X", "x", "1", "1", "1", "HUB-A"), ("Y", "y", "1", "1", "2", "HUB-A"),
                                 ("Z", "", "", "", "4", "HUB"), ("Q", "q", "1", "1", "3", "")])
    typed = silver.silver_tables(as_raw(spark, tables))
    found = quality.invalid_parent_types(typed)
    assert found.agg(F.sum("occurrences")).first()[0] == 3
    assert [row.value for row in quality.required_parents(typed).collect()] == ["Q"]


VALUES = [
    (parsing.parse_seconds, [("8:00:00", 28800), ("25:10:00", 90600), ("1000000:00:00", 3_600_000_000),
                             ("0000000000000000000001:00:00", 3600), ("8:60:00", None), ("8:00", None),
                             ("08:00:00\n", None), ("9999999999999999:00:00", None), ("", None)]),
    (parsing.parse_int, [("5", 5), ("007", 7), (" 5", None), ("5\n", None), ("-1", None), ("1.0", None),
                         ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("", None),
                         ("00000000000000000000000012", 12)]),
    (parsing.parse_number, [("51.5", 51.5), ("5e1", 50.0), (" 1 ", 1.0), ("1_0", 10.0), (".5", 0.5),
                            ("5.", 5.0), ("51d", None), ("NaN", None), ("Infinity", None), ("1e999", None),
                            ("", None), ("1 0", None), ("0x10", None)]),
    (parsing.has_outer_blank, [(" a", True), ("a ", True), ("a ", True), ("a b", False), ("", False)]),
]


@pytest.mark.parametrize(("function", "cases"), VALUES, ids=lambda v: getattr(v, "__name__", ""))
def test_parsers(spark, function, cases):
    frame = spark.createDataFrame([(text,) for text, _ in cases], "text string")
    found = frame.select("text", function(F.col("text")).alias("value")).collect()
    assert {row.text: row.value for row in found} == dict(cases)


def test_ids_are_kept_and_extras_become_json(spark):
    raw = as_raw(spark, lake_tables())
    stops = silver.to_silver("stops", raw["stops"])
    assert {"0042", "None", "nan"} <= {row.stop_id for row in stops.collect()}
    trips = raw["trips"].withColumn("block_id", F.lit("")).withColumn("note", F.lit("x"))
    packed = silver.with_extra_fields("trips", silver.to_silver("trips", trips)).first()
    assert packed.extra_fields == '{"block_id":null,"note":"x"}'
    types = silver.to_silver("stop_times", raw["stop_times"].drop("timepoint")).dtypes
    assert dict(types)["timepoint"] == "bigint" and dict(types)["arrival_seconds"] == "bigint"


def test_frequencies_are_a_warning(spark):
    raw = as_raw(spark, lake_tables())
    found = quality.unsupported_frequencies(spark.range(3)).first()
    assert (found.severity, found.occurrences) == ("warning", 3)
    assert codes(raw, spark.range(1)) == set()


def test_a_check_stages_the_tables_it_reads(spark):
    from tramline.plans import queries as Q

    Q._STAGED.clear()
    assert Q.QUERIES["dq_invalid_date"](spark, "/root/testdata/sf0.001").count() == 2
    (raw, typed), = Q._STAGED.values()
    assert "stop_times" not in raw._written and not typed._written
    assert set({**typed}) == set(silver.TABLES) and all(f.columns for f in {**typed}.values())


def test_falling_times_keep_one_row_per_visit(spark):
    """Falls within a visit, between visits and over the end of a block, without a row per known time."""
    rows = [("a", 1, 10, 5, 1), ("a", 2, None, 4, 2), ("a", 3, 9, None, 3), ("a", 4, None, None, 4), ("a", 10**6, 8, 8, 5),
            ("b", 1, 5, 6, 6), ("b", 1, 4, 9, 7), ("b", 2, 8, 8, 8), ("c", None, 9, 1, 9), (None, 1, 5, 2, 10), ("d", 1, None, 7, None), ("d", 2, 6, 7, 11)]
    visits = spark.createDataFrame(rows, "trip_id string, stop_sequence bigint, arrival_seconds bigint, departure_seconds bigint, _source_record bigint")
    found = quality.time_decreases({"stop_times": visits})
    assert sorted((r.value or "", r.record) for r in found.collect()) == [("", 10), ("a", 1), ("a", 2), ("a", 5), ("b", 8), ("d", 11)]
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_findings_are_not_spread(spark):
    """Rows are filtered before their marks become an array; NULL marks count as none."""
    raw = as_raw(spark, lake_tables())
    found = quality.row_findings("stop_times", raw["stop_times"])
    plan = found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 0 and "Filter" in plan[plan.index("Generate") :]


def test_endpoints_are_counted_per_trip(spark):
    """Repeated ends, trips of one sequence, missing keys; visits are not grouped by sequence to find the ends."""
    rows = [("A", 0, None, 1), ("A", 0, None, 2), ("A", 0, 3, 3), ("A", 5, None, 2), ("A", 3, None, 2), ("B", 2, None, 1), ("B", 2, None, 1),
            ("C", 1, 1, 1), ("C", 2, None, 1), ("C", 3, 1, 1), (None, 1, None, 1), ("D", None, None, 1), ("D", 1, 1, 1)]
    found = quality.missing_endpoint_arrivals({"stop_times": visits(spark, rows)})
    assert {(row.value, row.occurrences, row.record) for row in found.collect()} == {("A", 3, 1), ("B", 2, 6)}
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_visits_are_walked_once(spark):
    found = quality.time_decreases({"stop_times": visits(spark, [("A", 0, 5, 4), ("A", 9000, 1, 1)])})
    assert found.count() == 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1


@pytest.mark.parametrize(("text", "good"), [("", True), ("3", True), ("003", True), ("4", False), ("3\n", False), (" 3", False), ("1.0", False), ("13", False)])
def test_codes_with_choices(spark, text, good):
    raw = as_raw(spark, lake_tables())
    trips = raw["stop_times"].limit(1).withColumn("pickup_type", F.lit(text))
    assert quality.row_findings("stop_times", trips, codes={"invalid_integer_or_enum"}).isEmpty() == good
