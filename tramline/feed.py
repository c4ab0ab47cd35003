"""One feed snapshot as a set of typed DataFrames."""

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Feed:
    """Typed tables of one snapshot. Keys are unique: the quality checks guarantee it."""

    agency: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    shapes: DataFrame | None = None

    @property
    def spark(self):
        return self.trips.sparkSession

    def with_tables(self, **tables):
        return replace(self, **tables)


def service_range(start, end):
    """A closed range of service dates, both ends as ``datetime.date``."""
    first, last = (
        value if type(value) is date else date.fromisoformat(value) for value in (start, end)
    )
    if first > last:
        raise ValueError(f"start {first} lies after end {last}")
    return first, last
