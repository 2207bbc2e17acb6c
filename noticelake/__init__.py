"""Notice analytics on Spark: extraction, curation and exploration of published offense notices.

Every operator takes and returns DataFrames (or Columns) and stays lazy until the caller acts on it.
"""
