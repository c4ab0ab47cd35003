"""Which services run on which dates.

A service runs on a date when its weekly calendar or an added exception says so and no
removed exception does. All work is grouped by service; the date axis is the requested
range, which the caller knows, so no join against a table of days is needed.
"""

from pyspark.sql import functions as F

from ..feed import service_range

# GTFS weekday columns in ISO order, exception codes and state names.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
ADDED = 1
REMOVED = 2
WITHIN = "within-calendar-envelope"
OUTSIDE = "outside-calendar-envelope"


def dates_between(start, end):
    """Array of all dates of a closed range, as a column."""
    first, last = service_range(start, end)
    return F.sequence(F.lit(first), F.lit(last))


def weekday_flag(day):
    """The weekly flag of the row that applies to the date column ``day``."""
    flags = F.array(*[F.col(name).cast("long") for name in DAYS])
    return F.element_at(flags, F.weekday(day) + F.lit(1))


def calendar_envelope(calendar, calendar_dates):
    """Smallest and largest date any calendar table mentions; one row."""
    bounds = calendar.select(
        F.col("start_date").alias("first_day"), F.col("end_date").alias("last_day")
    ).unionByName(
        calendar_dates.select(F.col("date").alias("first_day"), F.col("date").alias("last_day"))
    )
    return bounds.agg(
        F.least(F.min("first_day"), F.min("last_day")).alias("source_start"),
        F.greatest(F.max("first_day"), F.max("last_day")).alias("source_end"),
    )


def covered_by_envelope(day, envelope):
    """Whether a date column lies in the one-row ``envelope``; false when it is empty."""
    start = envelope.select("source_start").scalar()
    end = envelope.select("source_end").scalar()
    return F.coalesce(day.between(start, end), F.lit(False))


def analysis_days(feed, start, end):
    """Every requested date with the envelope and whether it is covered."""
    envelope = calendar_envelope(feed.calendar, feed.calendar_dates)
    return envelope.select(
        F.explode(dates_between(start, end)).alias("service_date"), "source_start", "source_end"
    ).withColumn(
        "calendar_covered",
        F.coalesce(F.col("service_date").between(F.col("source_start"), F.col("source_end")),
                   F.lit(False)),
    )


def service_dates(feed, start, end):
    """One row per running service with the array of its dates in the range.

    The arrays hold distinct dates of the range, so their length has a fixed bound.
    """
    first, last = service_range(start, end)
    low = F.greatest(F.col("start_date"), F.lit(first))
    high = F.least(F.col("end_date"), F.lit(last))
    weekly = feed.calendar.withColumn(
        "service_date", F.explode(F.when(low <= high, F.sequence(low, high)))
    ).filter(weekday_flag(F.col("service_date")) == 1)
    exceptions = feed.calendar_dates.filter(F.col("date").between(F.lit(first), F.lit(last)))
    marks = weekly.select(
        "service_id", F.col("service_date").alias("added"), F.lit(None).cast("date").alias("removed")
    ).unionByName(
        exceptions.select(
            "service_id",
            F.when(F.col("exception_type") == ADDED, F.col("date")).alias("added"),
            F.when(F.col("exception_type") == REMOVED, F.col("date")).alias("removed"),
        )
    )
    return (
        marks.groupBy("service_id")
        .agg(F.array_except(F.collect_set("added"), F.collect_set("removed")).alias("service_dates"))
        .filter(F.size("service_dates") > 0)
    )


def active_services(feed, start, end):
    """One row per date and running service."""
    return service_dates(feed, start, end).select(
        F.explode("service_dates").alias("service_date"), "service_id"
    )


def services_catalog(calendar, calendar_dates):
    """Distinct service ids of both calendar tables."""
    return calendar.select("service_id").union(calendar_dates.select("service_id")).distinct()


def day_in_envelope(feed, start, end):
    """Dates outside the envelope are told apart from covered dates without service."""
    days = analysis_days(feed, start, end)
    running = active_services(feed, start, end).groupBy("service_date").agg(
        F.count("*").alias("services")
    )
    return days.join(running, "service_date", "left").select(
        "service_date",
        F.when(~F.col("calendar_covered"), F.lit(OUTSIDE))
        .when(F.col("services").isNull(), F.lit("no-service"))
        .otherwise(F.lit(WITHIN))
        .alias("day_state"),
    )
