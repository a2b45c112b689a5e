"""A table that arrives part by part, as the files of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from storyloom.sources.shared import cut


def in_parts(rows: DataFrame, part: str, at: str) -> Iterator[DataFrame]:
    """For each value of ``part``, in order: its rows are written to ``at``, and a stream of what lies there is given.

    Whoever runs that stream from its checkpoint takes the new part alone."""
    held = cut(rows, "arrivals")
    values = [r[0] for r in held.select(part).distinct().orderBy(part).collect()]  # the parts of a run
    plain = held.drop(part)
    for value in values:
        held.filter(held[part] == value).drop(part).write.mode("append").parquet(at)
        yield stream_of(rows.sparkSession, plain.schema, at)


def stream_of(spark: SparkSession, schema, at: str) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).parquet(at)
