"""File sizes of tables on disk."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, suffix: str = "*.parquet") -> DataFrame:
    """(table, dt, path, length) of the data files under ``root``.

    The table is the first folder below ``root``. Only path and length are
    selected, so file contents are not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix)
        .load(root)
        .select("path", "length")
    )
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.substring_index("path", f"{base}/", -1)
    return files.select(
        F.substring_index(below, "/", 1).alias("table"),
        F.nullif(F.regexp_extract("path", r"/dt=([^/]+)/", 1), F.lit("")).alias("dt"),
        "path",
        "length",
    )
