"""Session settings."""

from pyspark.sql import SparkSession


def session(name: str = "tierwise", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays on."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()
