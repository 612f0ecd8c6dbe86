"""How many partitions a step gets: by the bytes of its input files, not by those of a shuffle whose rows grow later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT_AS = {"spark.sql.adaptive.enabled": "false", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false"}
_SAME = ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.caseSensitive")


def parts_for(table: DataFrame, kilobytes: int) -> int:
    """One partition for every so many kilobytes of the table's files, and at least one for each core."""
    known = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(table.sparkSession.sparkContext.defaultParallelism, min(known // (kilobytes << 10) + 1, 1 << 14))


def keep_dealt(spark: SparkSession, table: Callable[[SparkSession], DataFrame]) -> None:
    """Keeps a table for all later plans that hold it, such that they know how its rows are dealt and need not shuffle them again.

    Joins on the dealing's column and others use it too, if Spark is told that a part of their keys will do. Spark forgets the dealing of what an adaptive plan made; the setting against that is made in a session of its own, as what is
    kept is shared by all sessions."""
    own = spark.newSession()
    for name in _SAME:
        own.conf.set(name, spark.conf.get(name))
    for name, value in _KEPT_AS.items():
        own.conf.set(name, value)
    table(own).persist()
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
