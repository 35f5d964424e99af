"""Event, time-series and text analytics written Spark-first: DataFrames, SQL and Structured Streaming."""
