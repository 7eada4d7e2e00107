"""Running jobs: tags to cancel them by, and rates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started within can be cancelled by their tag, from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the tag's running jobs."""
    spark.sparkContext.cancelJobsWithTag(tag)


def rate(processed: int, total: int, elapsed: float) -> tuple[float, float | None]:
    """Items a second, and the seconds that the rest takes at that rate; None if nothing is known."""
    per_second = processed / elapsed if elapsed > 0 else 0.0
    return per_second, max(0, total - processed) / per_second if per_second > 0 else None
