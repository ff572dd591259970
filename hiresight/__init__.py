"""hiresight: job-posting market analytics as Spark DataFrame jobs.

Layout
------
sources/    schemas, table readers, sinks, and the job-market views derived from the driver tables
functions/  column expressions: cleaning rules, text rules, fixed label tables
operators/  parametric DataFrame operators (aggregation, joins, windows, statistics, features, models)
plans/      named report queries, dashboard queries and their DuckDB SQL twins
streaming/  incremental cleaning of new posting files with Structured Streaming
"""

__version__ = "0.1.0"
