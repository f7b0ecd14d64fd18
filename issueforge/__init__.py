"""Error-event grouping, alerting and grouping-quality analytics on Spark DataFrames."""
