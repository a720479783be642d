"""Questions and metadata as they arrive: ST03, ST04."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stackquarry.functions.questions import route_backend
from stackquarry.functions.redact import scrub
from stackquarry.operators.pairs import make_pairs
from stackquarry.schemas import METADATA

MAX_FILES = 1000


def stream_scrub_route(questions: DataFrame, has_architecture_backend: bool = True) -> DataFrame:
    """ST04: numbering starts anew in every row, so this keeps no state."""
    routed = questions.withColumn(
        "backend", route_backend(F.col("question"), has_architecture_backend)
    )
    return scrub(routed, ["question", "context"])


def stream_metadata(spark: SparkSession, folder: str, max_files: int = MAX_FILES) -> DataFrame:
    """New metadata files under ``folder``, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(METADATA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .json(folder)
    )


class BatchCounts(StreamingQueryListener):
    """A08 for streams: rows of each micro-batch, counted as they pass by, not in a second
    pass. ``wait`` returns once all of a run's progress has arrived: its events come in
    order, and the one of its end is the last."""

    def __init__(self):
        self.name = f"rows_{uuid.uuid4().hex}"
        self.batches: dict[int, int] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[event.progress.batchId] = row["records"]

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def wait(self, run: str, seconds: float = 60) -> None:
        with self._news:
            if not self._news.wait_for(lambda: run in self._ended, seconds):
                raise TimeoutError(f"no end of run {run} was reported")


def stream_pairs(
    spark: SparkSession, raw: str, out: str, progress: str, max_files: int = MAX_FILES, counts: dict[int, int] | None = None
):
    """ST03: turn metadata files not seen before into pairs, then stop. Run it on the
    daily schedule; ``progress`` remembers what has been read. ``counts`` receives the number
    of pairs of each micro-batch of this run."""
    pairs = make_pairs(stream_metadata(spark, raw, max_files))
    listener = None
    if counts is not None:
        listener = BatchCounts()
        spark.streams.addListener(listener)
        pairs = pairs.observe(listener.name, F.count(F.lit(1)).alias("records"))
    query = (
        pairs.writeStream.format("json")
        .option("path", out)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if listener is not None:
        listener.wait(str(query.runId))
        spark.streams.removeListener(listener)
        counts.update(listener.batches)
    return query
