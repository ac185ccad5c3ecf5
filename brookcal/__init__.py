"""Spark-native calibration analytics for time-series models.

Every operator takes Spark DataFrames (plus small configuration) and returns a
Spark DataFrame; nothing is collected on the driver.
"""

__version__ = "0.1.0"
