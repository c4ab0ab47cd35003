"""A whole analysis: all KPI tables of one feed over one range."""

from functools import cached_property

from ..feed import service_range
from ..operators import events, gold
from ..operators.service_calendar import active_services

# Names of the eight KPI tables, in publication order.
OUTPUTS = (
    "analysis_days",
    "active_services",
    "route_daily",
    "stop_daily",
    "route_stop_hourly",
    "route_stop_headways",
    "service_span",
    "coverage_daily",
)


class Analysis:
    """Lazy KPI tables. Nothing runs until a table is read or written.

    Single tables read straight from events. ``share_profile`` writes the departure profile
    once, and the hours then start from it instead of repeating the big join; headways, spans and
    stops come from totals per group, which are written beside it.
    """

    def __init__(self, feed, start, end):
        self.feed = feed
        self.start, self.end = service_range(start, end)
        self._shared = self._totals = None

    @cached_property
    def events(self):
        return events.stop_events(self.feed, self.start, self.end)

    @cached_property
    def profile(self):
        return events.departure_profile(self.feed, self.start, self.end)

    def share_profile(self, path, totals=True):
        """Write the profile to a shared folder, and the totals of its groups beside it, and use them for all tables that can."""
        self.profile.write.mode("overwrite").parquet(path)
        self._shared = self.feed.spark.read.parquet(path)
        if not totals:
            return self
        folder = f"{path}-totals"
        gold.group_totals(self._shared).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        self._totals = self.feed.spark.read.parquet(folder)
        return self

    @property
    def _profile(self):
        return self.profile if self._shared is None else self._shared

    @property
    def _measures(self):
        return events.with_measures(self.events) if self._shared is None else self._shared

    @property
    def analysis_days(self):
        return gold.gold_days(self.feed, self.start, self.end)

    @property
    def active_services(self):
        return active_services(self.feed, self.start, self.end)

    @property
    def route_daily(self):
        return gold.gold_routes(self.feed, self.start, self.end)

    @property
    def stop_daily(self):
        measures = self._measures
        if self._totals is not None:  # a group with a first departure has all its departures in one row
            measures = self._totals.withColumnsRenamed(
                {"first_departure_seconds": "departure", "observation_count": "departures"}
            )
        return gold.gold_stops(measures, self.feed, self.start, self.end)

    @property
    def route_stop_hourly(self):
        return gold.gold_hourly(self._measures)

    @property
    def route_stop_headways(self):
        if self._totals is not None:
            return self._totals.select(*events.GROUP, *gold.HEADWAY_COLUMNS)
        return gold.gold_headways(self._profile)

    @property
    def service_span(self):
        if self._totals is not None:
            return self._totals.drop(*gold.HEADWAY_COLUMNS)
        return gold.gold_span(self._measures)

    @property
    def span_headways(self):
        """Span and headways of the same groups."""
        return gold.span_and_headways(self._profile)

    @cached_property
    def coverage(self):
        return gold.gold_coverage(self.feed, self.start, self.end)

    @property
    def coverage_daily(self):
        return self.coverage.drop("source_start", "source_end")

    def tables(self):
        return {name: getattr(self, name) for name in OUTPUTS}
