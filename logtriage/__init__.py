"""Request-log threat analytics on Spark.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function, so it
composes with ``df.transform`` and runs unchanged in batch and in Structured Streaming.
"""

__version__ = "0.1.0"
