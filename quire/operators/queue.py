"""Task queues: order of running, counts by status, bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.frontier import dense_index


def ordered(tasks: DataFrame, priority: str = "priority", order: str = "seq", name: str = "position") -> DataFrame:
    """0, 1, ... in the order in which tasks run: higher priority first, then as they came."""
    ranked = dense_index(tasks.withColumn("__o", F.struct(-F.col(priority), F.col(order))), "__o", name)
    return ranked.drop("__o")


def by_status(tasks: DataFrame, queue: str, statuses: list[str], status: str = "status") -> DataFrame:
    """Tasks of each queue in each status, and all."""
    return tasks.groupBy(queue).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.count("*").alias("total"))


def history(done: DataFrame, queue: str, task: str, order: str, most: int = 100) -> DataFrame:
    """The ``most`` tasks of each queue that ended last, each by its last end; older ones are evicted.

    Ends of a task are pre-aggregated, and no task of the plan passes on more than ``most`` rows a queue.
    """
    last = done.groupBy(queue, task).agg(F.max_by(F.struct(*[c for c in done.columns if c not in (queue, task)]), order).alias("__v")).select(queue, task, "__v.*")
    w = Window.partitionBy(queue).orderBy(F.col(order).desc())
    return last.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)
