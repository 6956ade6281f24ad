"""The ledger in a database over JDBC, if there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str, url: str | None, **options: str) -> DataFrame | None:
    """A table (or a query in brackets) of the database at ``url``; None without one. Filters and columns are pushed down;
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` among the options share the read out."""
    if not url:
        return None
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def append_table(rows: DataFrame, name: str, url: str | None, **options: str) -> bool:
    """Append rows in batches; False without a database."""
    if not url:
        return False
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()
    return True
