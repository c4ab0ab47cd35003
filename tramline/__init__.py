"""Public-transport timetable analytics as composable Spark DataFrame functions."""
