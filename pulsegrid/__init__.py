"""Sensor-stream analytics on Spark DataFrames.

Everything is ``DataFrame(s) in -> DataFrame out`` and lazy.  Key and time
columns are arguments (``pid``, ``ts``).  A stream is one long table; no
function loops over participants or brings data to the driver.
"""
