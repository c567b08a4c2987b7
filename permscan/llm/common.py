"""What several operators share: the definition of a word and settings read from the session."""

from pyspark.sql import SparkSession

WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of groups by which operators deal out their work; it grows with the data as the session's setting does."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
