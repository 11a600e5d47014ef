"""Shop-event analytics as composable Spark DataFrame functions."""
