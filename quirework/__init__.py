"""Document operations on Spark: catalog, telemetry, text and layout jobs as DataFrame functions."""
