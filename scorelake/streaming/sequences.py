"""Sequence operators on streams: windows of time, state kept by key, incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """A Parquet folder or file as a stream, its schema taken from what is there.

    The path is given as a pattern of itself: a stream takes a plain path for a folder only.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(pattern)


def event_time(stream: DataFrame, column: str = "ts", lateness: str = "1 day") -> DataFrame:
    """A timestamp without zone as an event time with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def tumbling(stream: DataFrame, column: str, length: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by window (sliding, if ``slide`` is given) and keys."""
    w = F.window(column, length, slide) if slide else F.window(column, length)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n"
    )


def sessions(stream: DataFrame, column: str, gap: str, *keys: str) -> DataFrame:
    """Sessions parted by a gap, with their number of events."""
    return stream.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"
    )


def live_intervals(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, order, value, interval)`` of each event against the one before it, kept as state between batches.

    The state of a key is its last order and value. Events of one batch are put in order; one
    older than the state is given a null interval and does not change it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, interval double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([order, value], ignore_index=True)  # a key's events of one batch
        last = state.get if state.exists else None
        out = []
        for o, v in zip(rows[order], rows[value]):
            late = last is not None and o.value < last[0] if hasattr(o, "value") else last is not None and o < last[0]
            out.append(None if last is None or late else float(v - last[1]))
            if not late:
                last = (o.value if hasattr(o, "value") else int(o), float(v))
        if last is not None:
            state.update(last)
        yield rows[[key, order, value]].assign(interval=out)

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "at bigint, last double", "append", GroupStateTimeout.NoTimeout)


def _stateful(stream: DataFrame, key: str, order: list[str], value: str, schema: str, state_schema: str, step: Callable[[tuple | None, list], tuple[tuple, list[tuple]]]) -> DataFrame:
    """Rows that ``step`` makes of a key's state and its values of one batch in order."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)  # a key's events of one batch
        fresh, out = step(state.get if state.exists else None, rows[value].tolist())
        state.update(fresh)
        yield pd.DataFrame([(k[0], *r) for r in out], columns=[f.split()[0] for f in schema.split(", ")])

    return stream.select(key, *order, value).groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def live_ngrams(stream: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """``(key, gram)``: every n values in a row of each key, its last n - 1 values kept as state between batches."""
    kind = dict(stream.dtypes)

    def step(last: tuple | None, values: list) -> tuple[tuple, list[tuple]]:
        seen = (list(last[0]) if last else []) + values
        return (seen[len(seen) - n + 1 :] if len(seen) >= n else seen,), [(seen[i : i + n],) for i in range(len(seen) - n + 1)]

    return _stateful(stream, key, order, value, f"{key} {kind[key]}, gram array<{kind[value]}>", f"last array<{kind[value]}>", step)


def live_segments(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``(key, value, length)``: runs of equal values of each key once they are closed; the open run is kept as state."""
    kind = dict(stream.dtypes)

    def step(last: tuple | None, values: list) -> tuple[tuple, list[tuple]]:
        now, length = last if last else (None, 0)
        out = []
        for v in values:
            if length and v != now:
                out.append((now, length))
                length = 0
            now, length = v, length + 1
        return (now, length), out

    return _stateful(stream, key, order, value, f"{key} {kind[key]}, {value} {kind[value]}, length bigint", f"{value} {kind[value]}, length bigint", step)


def run_all(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and return what was written to ``target``.

    Appended rows go to a file sink, exactly once by its log; a complete result replaces the last
    one batch by batch.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Append what ``source`` holds that was not ingested before: the checkpoint remembers the files."""
    return run_all(transform(file_stream(spark, source)), target, checkpoint)
