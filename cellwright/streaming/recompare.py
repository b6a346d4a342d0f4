"""Compare each micro-batch of a stream with a reference table by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cellwright.config import Config
from cellwright.plans.engine import CompareEngine, Result


def recompare(stream: DataFrame, reference: DataFrame, config: Config, sink: Callable[[Result, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that hands sink the comparison of `reference` with every micro-batch.

    Rows of the reference that a batch lacks count as only before. A restarted query repeats a batch
    with its number, so a sink that stores by number is exactly-once.
    """

    def one(batch: DataFrame, number: int) -> None:
        engine = CompareEngine(config, batch.sparkSession)
        try:
            sink(engine.compare(reference, batch.persist()), number)
        finally:
            engine.close()
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
