"""Moments of a stream: each micro-batch adds to mergeable sums, from which a path can be refitted at any time."""

from __future__ import annotations

import pickle

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ridgeline.operators.moments import Moments, moments
from ridgeline.operators.paths import PathResult, Spec, path_from_moments


class RunningMoments:
    """One running total, kept in the folder `state` with the number of the last batch in it.

    A batch that is replayed, also after a restart, replaces itself: the totals after the last two batches are kept, so the one before it
    is at hand. Sums are those of all batches so far however long the stream runs; memory and storage don't grow with it.
    """

    def __init__(self, features: list[str] | str, responses: list[str], state: str):
        self.features, self.responses, self.state = features, responses, state.rstrip("/")

    def _totals(self, spark: SparkSession) -> dict[int, Moments | None]:
        """Batch number -> total with it, from the two places that are written in turn."""
        out = {}
        for place in range(2):
            try:
                r = spark.read.schema("batch long, data binary").parquet(f"{self.state}/{place}").first()
            except AnalysisException:  # not written yet
                continue
            if r is not None:
                out[r["batch"]] = pickle.loads(r["data"])
        return out

    def update(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = {k: m for k, m in self._totals(spark).items() if k < number}
        total, own = before[max(before)] if before else None, moments(batch, self.features, self.responses)
        if own.n:
            total = own if total is None else total + own
        # Batches alternate between two places, so a write that breaks off leaves the total before it as it is.
        spark.createDataFrame([(number, pickle.dumps(total))], "batch long, data binary").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/{number % 2}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def total(self, spark: SparkSession) -> Moments | None:
        found = self._totals(spark)
        return found[max(found)] if found else None

    def fit(self, spark: SparkSession, penalty, **grid) -> PathResult:
        m = self.total(spark)
        return path_from_moments(m, Spec(penalty, m.names), **grid)
