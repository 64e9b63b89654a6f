"""tickloom: tick and OHLCV candle analytics as plain Spark DataFrame jobs.

Every public function takes and returns DataFrames and is lazy unless its
docstring says that it runs a job.
"""
