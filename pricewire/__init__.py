"""pricewire: news-and-prices analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``pyspark.ml``
stage) built from Spark SQL expressions, windows, joins and aggregates, so it
runs distributed and stays inside whole-stage codegen.  There are no Python
UDFs in the data path.

Layout
------
``functions``  column expressions (text cleaning, price labels, vectors)
``sources``    readers: the provided tables and the reference's file formats
``operators``  DataFrame jobs: labels, text, topics, splits, terms, models, evaluation
``plans``      the query catalogue used by ``__spark_entry__`` and ``bench.py``
``streaming``  the stateless operators wired to Structured Streaming
"""

__version__ = "0.1.0"
