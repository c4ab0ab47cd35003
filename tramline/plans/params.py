"""Ranges and days the registered queries use."""

from datetime import UTC, date, datetime

START = date(2023, 12, 30)  # two days before the derived calendar begins
END = date(2024, 1, 5)
REPORT_START = date(2023, 12, 31)
REPORT_END = date(2024, 1, 3)
DAY = date(2024, 1, 3)
NOW = datetime(2024, 1, 4, tzinfo=UTC)
