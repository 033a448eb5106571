"""eventframe: Spark-native preparation, scoring and evaluation of event-level classification data.

Everything is expressed with the DataFrame API (expressions, aggregates, windows, joins) so Catalyst
and AQE plan the work; Python runs only inside Arrow-batched model scoring.
"""

from eventframe.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
