"""envspark: environmental-monitoring analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers, ingest/validation of uploads and messages, domain views
functions  Column -> Column helpers (time, geometry, JSON, raster indices)
operators  DataFrame -> DataFrame operators (listings, joins, aggregates,
           windows, series cleaning, features, anomalies, events, rasters)
plans      composed end-to-end plans (monitor, overview, threat map) and the
           query catalog used by ``__spark_entry__``
streaming  Structured Streaming versions of the ingest and statistics
"""

__version__ = "0.1.0"
