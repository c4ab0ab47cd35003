"""DataFrame operators: calendars, events, KPIs, reports, typing and quality checks."""
