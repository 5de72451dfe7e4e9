"""KPI time-series and event-log anomaly analytics on Spark DataFrames."""
