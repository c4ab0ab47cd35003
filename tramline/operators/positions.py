"""Vehicle observations of one export; never joined to trips."""

from datetime import UTC

from pyspark.sql import functions as F

from ..functions.parsing import MAX_LATITUDE, MAX_LONGITUDE, parse_number

# Age limits in seconds and the texts shown.
FUTURE_SECONDS = -60
STALE_SECONDS = 600
STATE_UNKNOWN = "Niepotwierdzony czas / strefa"
STATE_FUTURE = "Czas w przyszłości"
STATE_STALE = "Stara obserwacja"
STATE_RECENT = "Niedawna obserwacja"
STATE_TERMS = "Warunki źródła niepotwierdzone"
NO_VEHICLE = "Niepodany"
NO_LINE = "Niepodana"
NO_MEASURED_TIME = "Niepodany"
NO_TIME = "Brak czasu"
# ISO times with an explicit offset, in the extended and in the compact form. The groups are
# year, month, day, hour, minute, second, fraction, sign, and hours, minutes and seconds of the offset.
_OFFSET = r"(?:Z|([+-])([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.][0-9]+)?)?)?)\z"
_TIME = r"([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?"
_COMPACT_TIME = r"([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?)?"
_DATE, _COMPACT_DATE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})", r"^([0-9]{4})([0-9]{2})([0-9]{2})"
OFFSET_TIMES = tuple(
    f"{day}[^0-9]{time}{_OFFSET}" for day in (_DATE, _COMPACT_DATE) for time in (_TIME, _COMPACT_TIME)
)


def coordinates_usable():
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = (F.abs(lat) <= MAX_LATITUDE) & (F.abs(lon) <= MAX_LONGITUDE)
    return inside & ((lat != 0) | (lon != 0))


def with_coordinates(records):
    """Numbers with a decimal comma or point; NULL where the text is no number."""
    return records.withColumns(
        {name: parse_number(F.replace(F.col(name), F.lit(","), F.lit(".")))
         for name in ("latitude", "longitude")}
    )


def _measured(text, form):
    """Microseconds since 1970 of a time in one of the forms; NULL for any other text."""
    part = lambda group: F.regexp_extract(text, form, group)
    number = lambda group: F.coalesce(F.nullif(part(group), F.lit("")).cast("long"), F.lit(0))
    clock = F.concat(
        part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"),
        F.lpad(part(5), 2, "0"), F.lit(":"), F.lpad(part(6), 2, "0"), F.lit("."),
        F.rpad(F.substring(part(7), 1, 6), 6, "0"), F.lit("Z"),
    )
    offset = (number(9) * 3600 + number(10) * 60 + number(11)) * F.when(part(8) == "-", -1).otherwise(1)
    real = (number(9) < 24) & (number(10) < 60) & (number(11) < 60)
    return F.when(
        text.rlike(form) & real, F.unix_micros(clock.try_cast("timestamp")) - offset * F.lit(1_000_000)
    )


def age_seconds(measured_at, now):
    """Seconds since an ISO time with an offset; NULL without one, since the zone is unknown."""
    if now.tzinfo is None:
        raise ValueError("the check time needs a zone")
    measured = F.coalesce(*[_measured(measured_at, form) for form in OFFSET_TIMES])
    now_micros = int(now.astimezone(UTC).timestamp() * 1_000_000)
    return (F.lit(now_micros) - measured) / F.lit(1e6)


def freshness(age, terms_confirmed):
    confirmed = STATE_RECENT if terms_confirmed else STATE_TERMS
    return (
        F.when(age.isNull(), F.lit(STATE_UNKNOWN))
        .when(age < FUTURE_SECONDS, F.lit(STATE_FUTURE))
        .when(age > STALE_SECONDS, F.lit(STATE_STALE))
        .otherwise(F.lit(confirmed))
    )


def duplicate_vehicle_ids(records):
    """Vehicle ids that occur more than once among all records, usable or not.

    Records known not to be objects have no id and aren't counted.
    """
    if "is_object" in records.columns:
        records = records.filter("is_object")
    return (
        records.groupBy(F.coalesce("vehicle_id", F.lit("None")).alias("vehicle_id"))
        .agg(F.count("*").alias("observations"))
        .filter(F.col("observations") > 1)
    )


def normalize_positions(records, now, terms_confirmed=False):
    """Usable observations with labels, age and state.

    ``records`` holds text columns observation_id, vehicle_id, line, latitude, longitude and
    measured_at. Repeated vehicle ids are counted first and joined back, so an id shared by
    many records is not gathered in one task.
    """
    repeated = duplicate_vehicle_ids(records).select("vehicle_id", F.lit(True).alias("_repeated"))
    time = F.nullif("measured_at", F.lit(""))
    usable = with_coordinates(records).filter(coordinates_usable())
    labelled = usable.select(
        "observation_id",
        F.coalesce(F.nullif("line", F.lit("")), F.lit(NO_LINE)).alias("line"),
        F.coalesce("vehicle_id", F.lit(NO_VEHICLE)).alias("vehicle_id"),
        "latitude",
        "longitude",
        F.coalesce(time, F.lit(NO_MEASURED_TIME)).alias("measured_at"),
        F.coalesce(time, F.lit(NO_TIME)).alias("_shown_time"),
        age_seconds(F.col("measured_at"), now).alias("age_seconds"),
    ).withColumn("state", freshness(F.col("age_seconds"), terms_confirmed))
    head = F.concat(F.lit("Linia "), "line", F.lit(" · pojazd "), "vehicle_id")
    return (
        labelled.join(repeated, "vehicle_id", "left")
        .withColumn("duplicate_id", F.coalesce("_repeated", F.lit(False)))
        .withColumn("label", F.concat_ws("\n", head, "_shown_time", "state"))
        .drop("_repeated", "_shown_time")
    )


def position_summary(records, now):
    """How many records came, how many are unusable and how many have no known age."""
    usable = F.coalesce(coordinates_usable(), F.lit(False))
    aged = with_coordinates(records).withColumn("_age", age_seconds(F.col("measured_at"), now))
    return aged.agg(
        F.count("*").alias("received"),
        F.count_if(~usable).alias("skipped"),
        F.count_if(usable & F.col("_age").isNull()).alias("unconfirmed_time"),
    )


def positions_for_line(positions, routes):
    """Observations whose line is the short name of some route of ``routes``."""
    names = routes.select(F.col("route_short_name").alias("line")).distinct()
    return positions.join(names, "line", "left_semi")
