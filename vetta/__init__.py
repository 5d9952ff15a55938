"""vetta: review-moderation data preparation, training and cascade scoring on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column expression)
built from Spark SQL functions, ``spark.ml`` and Structured Streaming. There are no
row-at-a-time Python UDFs.
"""

__version__ = "0.1.0"
