"""Starting streams and reading their results.

Every micro-batch overwrites its own ``batch_id`` folder, so a batch that is replayed
after a failure replaces its earlier output instead of repeating it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from roadpass.sources.tables import read_watch_list


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


class DropCounter(StreamingQueryListener):
    """Late rows that each run has dropped, added up over all of its micro-batches; a query
    itself remembers the last hundred only."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(int(state.numRowsDroppedByWatermark) for state in p.stateOperators)
        self.dropped[str(p.runId)] = self.dropped.get(str(p.runId), 0) + late

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


_counters: dict[str, DropCounter] = {}


def _counter(spark: SparkSession) -> DropCounter:
    """The counter that listens to the application's streams."""
    key = spark.sparkContext.applicationId
    if key not in _counters:
        _counters[key] = DropCounter()
        spark.streams.addListener(_counters[key])
    return _counters[key]


def start(
    stream: DataFrame, write: Callable, checkpoint: str, mode: str, trigger: dict
) -> StreamingQuery:
    _counter(stream.sparkSession)
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def start_updates(
    stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write every changed row of an aggregation; read it back with ``latest``."""
    return start(stream, write_batch(out), checkpoint, "update", trigger or {"availableNow": True})


def start_watch_list(
    passes: DataFrame, watch_path: str, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the passes of watched cars. The list is read again for every micro-batch, so
    plates can be added or removed while the stream runs. Its file size decides
    whether Catalyst broadcasts it."""
    write = write_batch(out)

    def matched(batch: DataFrame, batch_id: int) -> None:
        listed = read_watch_list(batch.sparkSession, watch_path)
        write(batch.join(listed, "car", "left_semi"), batch_id)

    return start(passes, matched, checkpoint, "append", trigger or {"availableNow": True})


def stop_after(query: StreamingQuery, batches: int, patience: float = 120.0) -> None:
    """Stop a running query between micro-batches, once it has finished so many or has ended
    by itself; another start on the same checkpoint goes on from there."""
    end = time.monotonic() + patience
    while query.isActive and (query.lastProgress is None or query.lastProgress.batchId + 1 < batches):
        if time.monotonic() > end:
            raise RuntimeError(f"no {batches} micro-batches within {patience} seconds")
        time.sleep(0.05)
    query.stop()


def state_table(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """The keys and values that a stopped query's state store holds, as rows."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def start_console(stream: DataFrame, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Print each micro-batch, for watching a stream by hand."""
    return (
        stream.writeStream.outputMode(mode)
        .format("console")
        .option("checkpointLocation", checkpoint)
        .option("truncate", "false")
        .start()
    )


def dropped_rows(query: StreamingQuery, patience: float = 60.0) -> int:
    """Rows of an ended run that came after the watermark had passed their window and were
    not counted."""
    counter, run_id = _counter(SparkSession.active()), str(query.runId)
    # The last reports may still be under way to the listener.
    end = time.monotonic() + patience
    while run_id not in counter.ended:
        if time.monotonic() > end:
            raise RuntimeError("no report of the stream's end")
        time.sleep(0.02)
    return counter.dropped.get(run_id, 0)


def finish(query: StreamingQuery) -> None:
    """Wait for the end of a run over available data; late rows that were dropped are an error."""
    query.awaitTermination()
    if dropped := dropped_rows(query):
        raise RuntimeError(f"{dropped} late rows were dropped; use a longer watermark or rebuild from the passes")


def read_batches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All rows a stream has written so far, with their ``batch_id``."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(out)


def latest(batches: DataFrame, keys: Sequence[str], newest: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Last written row per key."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*values), F.struct(*newest)).alias("last")
    return batches.groupBy(*keys).agg(last).select(*keys, "last.*")
