"""What the tests of the library share."""

from datetime import datetime

START = datetime(2024, 4, 11, 23, 59, 58)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(tuple(row) for row in df.collect())
