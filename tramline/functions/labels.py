"""Display texts of times, shares and codes, as column expressions."""

from pyspark.sql import functions as F

# Texts shown for codes and for missing values.
NO_TIME = "Brak czasu"
UNDEFINED = "Nieokreślone"
TRAM = "Tramwaj"
BUS = "Autobus"
OTHER_TRANSPORT = "Inny transport"
ALL_MODES = "Wszystkie"
NO_LABEL = "Bez oznaczenia"
BOARDING = {
    0: "Regularne",
    1: "Bez wsiadania",
    2: "Na żądanie telefoniczne",
    3: "Na żądanie",
}
EXACT = "Dokładny"
APPROXIMATE = "Przybliżony"
# Extended route types counted as tram and bus.
TRAM_BASE, TRAM_FROM, TRAM_TO = 0, 900, 907
BUS_BASE, BUS_FROM, BUS_TO, TROLLEYBUS = 3, 700, 716, 800


def lookup(mapping, key):
    """Value of a small fixed mapping, NULL for unknown keys."""
    entries = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


def whole_div(value, divisor):
    """Integer division that stays exact for 64-bit values."""
    return F.call_function("div", value, F.lit(divisor))


def _two_digits(number):
    text = number.cast("string")
    return F.when(number < 10, F.concat(F.lit("0"), text)).otherwise(text)


def service_time(seconds):
    """HH:MM:SS with unbounded hours; a text for a missing time.

    The formatter is left to times below zero: it takes several times as long as putting digits together.
    """
    parts = [whole_div(seconds, 3600), whole_div(seconds, 60) % 60, seconds % 60]
    return (
        F.when(seconds >= 0, F.concat_ws(":", *map(_two_digits, parts)))
        .when(seconds.isNull(), F.lit(NO_TIME))
        .otherwise(F.format_string("%02d:%02d:%02d", *parts))
    )


def percent(part, whole):
    """Share with one decimal, rounded as the binary value of 100 * part / whole; a text where undefined.

    A share that lies between two tenths is hardly ever a binary value: the nearest one lies a bit
    above or below. Scaled by a power of two it is a whole number, so the side is found exactly.
    """
    whole = F.nullif(whole, F.lit(0)).cast("long")
    exact = (100 * part).cast("decimal(20,0)") / whole.cast("decimal(20,0)")
    value = (100 * part).cast("double") / whole.cast("double")
    halves = F.call_function("div", 2000 * part, whole)
    between = (halves * whole == 2000 * part) & (halves % 2 != 0)
    bits = F.when(value >= 1, F.lit(52)).otherwise(F.lit(60))
    scaled = (value * F.pow(F.lit(2.0), bits)).cast("long").cast("decimal(20,0)") * F.lit(20).cast("decimal(4,0)")
    middle = halves.cast("decimal(6,0)") * F.pow(F.lit(2.0), bits).cast("long").cast("decimal(20,0)")
    low = whole_div(halves - 1, 2)
    tenths = F.when(scaled > middle, low + 1).when(scaled < middle, low).otherwise(low + low % 2)
    rounded = F.when(between, (tenths / F.lit(10.0)).cast("decimal(30,1)")).otherwise(
        F.bround(exact, 1).cast("decimal(30,1)")
    )
    return F.coalesce(F.concat(rounded.cast("string"), F.lit("%")), F.lit(UNDEFINED))


def fold_case(text):
    """Text for comparison in any case: lower case, with a sharp s as a double one and one small sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def transport_mode(route_type):
    tram = (route_type == TRAM_BASE) | route_type.between(TRAM_FROM, TRAM_TO)
    bus = (
        (route_type == BUS_BASE) | route_type.between(BUS_FROM, BUS_TO) | (route_type == TROLLEYBUS)
    )
    return F.when(tram, F.lit(TRAM)).when(bus, F.lit(BUS)).otherwise(F.lit(OTHER_TRANSPORT))


def boarding_label(pickup_type):
    return lookup(BOARDING, pickup_type.cast("int"))


def timepoint_label(timepoint):
    return F.when(timepoint != 0, F.lit(EXACT)).otherwise(F.lit(APPROXIMATE))


def first_text(*columns):
    """First column that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(column, F.lit("")) for column in columns])


def route_main_name():
    return F.coalesce(
        first_text(F.col("route_short_name"), F.col("route_long_name")), F.lit(NO_LABEL)
    )


def route_label(ambiguous):
    """Name and mode; agency and ids are added only where the name is ambiguous."""
    detail = F.concat(
        F.lit(" · "), F.col("agency_name"),
        F.lit(" · agency_id="), F.coalesce("agency_id", F.lit("None")),
        F.lit(" · route_id="), F.col("route_id"),
    )
    return F.concat(
        route_main_name(), F.lit(" · "), transport_mode(F.col("route_type")),
        F.when(ambiguous, detail).otherwise(F.lit("")),
    )
