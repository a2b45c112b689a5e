"""Tables that cut a plan's lineage, joins on heavy keys, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.shared import cut, drop, shared_dir

__all__ = ["cut", "drop", "heavy_join", "shared_dir", "small_batches"]

#: Rows a Python worker gets at once: a batch of whole texts then stays at some MB.
ARROW_ROWS = 1000
#: Keys that :func:`heavy_join` broadcasts at most, and rows that a key may have without being heavy.
HEAVY, LIGHT = 10_000, 1000


def heavy_join(rows: DataFrame, side: DataFrame, *key: str) -> DataFrame:
    """``rows`` joined with ``side``, a written table with one row per key and the number ``n`` of its rows (left out).

    A key of more than LIGHT rows and a share of 1 in HEAVY is heavy. There are HEAVY of those at most, so their rows of
    ``side`` are broadcast and their ``rows`` stay where they are; the others meet by a shuffle. No key fills a task.
    """
    keys = list(key)
    total = side.agg(F.sum("n")).first()[0] or 0
    most = max(LIGHT, total // HEAVY)
    light = side.filter(F.col("n") <= most).drop("n")
    heavy = side.filter(F.col("n") > most).drop("n")
    if heavy.limit(1).count() == 0:
        return rows.join(light, keys)
    met = rows.join(F.broadcast(heavy), keys)
    return rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light, keys).select(met.columns).unionByName(met)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
