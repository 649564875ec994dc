"""A Spark-first engine for observational and time-series tables, image arrays and link listings."""
