"""penmark: writing-style analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions  column expressions over text (tokens, normalisation, syllables, ...)
sources    article loading, typing, file listing, page concatenation, sinks
operators  per-article features, TF-IDF, syntax aggregates, pairs, prep, models
plans      end-to-end jobs and the query registry used by ``__spark_entry__``
streaming  incremental (Structured Streaming) form of the per-article features
"""

__version__ = "0.1.0"
