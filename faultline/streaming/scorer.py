"""Label-free scoring of micro-batches into append-only partitions."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.evaluate import confusion, hybrid, with_metrics
from faultline.operators.joins import refuse, require
from faultline.sources.ingest import write_partition


@dataclasses.dataclass(frozen=True)
class State:
    """Where a replay stands. run_seq never goes back; the rest starts anew with each cycle."""

    pointer: int = 0
    cycle_id: int = 0
    batch_id: int = 0
    run_seq: int = 0
    dataset_rows: int = 0


def next_state(state: State, batch_rows: int, dataset_rows: int) -> State:
    """The state after one more batch; at the end of the table the next cycle begins. A table of another size starts over."""
    if state.dataset_rows != dataset_rows:
        state = State(run_seq=state.run_seq, dataset_rows=dataset_rows)
    pointer = state.pointer if state.pointer < dataset_rows else 0
    if pointer + batch_rows >= dataset_rows:
        return State(0, state.cycle_id + 1, 0, state.run_seq + 1, dataset_rows)
    return State(pointer + batch_rows, state.cycle_id, state.batch_id + 1, state.run_seq + 1, dataset_rows)


def load_state(path: str | Path) -> State:
    """The state in a file; a missing or unreadable one, or one that lacks something, is a fresh state."""
    try:
        told = json.loads(Path(path).read_text())
        return State(**{f.name: int(told[f.name]) for f in dataclasses.fields(State)})
    except (OSError, ValueError, TypeError, KeyError):
        return State()


def save_state(state: State, path: str | Path) -> None:
    """Writes the state by a new file that replaces the old one."""
    p = Path(path)
    new = p.with_name(p.name + ".new")
    new.write_text(json.dumps(dataclasses.asdict(state)))
    new.replace(p)


def replay_window(placed: DataFrame, pointer: int, batch: int, *, threshold: int, percent: float, position: str = "pos", n: int | None = None) -> tuple[DataFrame, int]:
    """(one row of what the hybrid policy does to the next `batch` rows of labelled scores, the next pointer).

    placed: rows with their place. A pointer outside the table starts at 0, and so does the one after its end.
    """
    n = placed.count() if n is None else n
    start = pointer if 0 <= pointer < n else 0
    end = min(n, start + batch)
    got = hybrid(placed.where(F.col(position).between(start, end - 1)), threshold, percent)
    return _logged(confusion(got, F.col("decision")), F.lit(start), F.lit(end), n), 0 if end >= n else end


def _logged(counts: DataFrame, start: Column, end: Column, n: int) -> DataFrame:
    return with_metrics(counts).select(
        start.cast("long").alias("start"), end.cast("long").alias("end"), (end - start).cast("long").alias("rows"), (end >= n).alias("reset"),
        "recall", "precision", F.col("positives_pct").alias("flagged_pct"), "tp", "fp", "fn", "tn")


def replay_windows(placed: DataFrame, pointer: int, batch: int, *, threshold: int, percent: float, position: str = "pos", n: int | None = None) -> DataFrame:
    """The rows that replay_window gives for one window after the other, from the pointer to the end of the table: all windows in one pass."""
    n = placed.count() if n is None else n
    first = pointer if 0 <= pointer < n else 0
    start = F.col("__window") * batch + first
    rows = placed.where(F.col(position) >= first).withColumn("__window", F.floor((F.col(position) - first) / batch))
    got = hybrid(rows, threshold, percent, "__window")
    return _logged(confusion(got, F.col("decision"), "__window"), start, F.least(start + batch, F.lit(n)), n)


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, schema: str = "id long, q int, pred double", threshold: int = 9200, percent: float = 10.0, cycle: int = 0, files_per_batch: int = 1) -> None:
    """Scores all files that have come to `source` since the last call, a partition of `target` for each micro-batch.

    The checkpoint is the pointer: a call after a lost driver goes on where the last committed
    batch ended, and a batch that was written but not yet noted is found and not written twice.
    Sources with labels are refused before the stream starts.
    """
    stream = refuse(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source), "response", "Response")
    require(stream, "id", "q")

    def write(batch: DataFrame, number: int) -> None:
        scored = hybrid(batch, threshold, percent).withColumn("run_seq", F.lit(number).cast("long")).withColumn("scored_at_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        write_partition(scored, target, {"cycle": cycle, "batch": number})

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events and sums for each type and window of event time, for streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
