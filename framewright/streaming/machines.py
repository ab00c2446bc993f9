"""Streaming twins: the machines of operators.ordered over a stream, with the state of each key kept
between micro-batches, and event-time windows as an extension."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], make: Callable, name: str, kind: str, keep: Sequence[str]) -> DataFrame:
    """The stream's rows with the machine's output. Within a micro-batch a key's rows are gathered and
    sorted; only the machine's state lives on. So memory is bounded by a key's rows in one micro-batch:
    bound those by the source's maxFilesPerTrigger or maxBytesPerTrigger. Null keys are one key."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [key, *keep]) + f", `{name}` {kind}"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = make()
        if state.exists:
            machine.state = pickle.loads(state.get[0])
        b = pd.concat([f for f in frames if len(f)]).sort_values(list(order))
        out = [machine(*args) for args in zip(*[b[v].tolist() for v in values], strict=True)]
        state.update((pickle.dumps(machine.state),))
        yield b[[key, *keep]].assign(**{name: out})

    return rows.groupBy(key).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def latest_per_key(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The latest value of each key so far (complete or update mode)."""
    return rows.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def windowed(rows: DataFrame, time: str, keys: Sequence[str], length: str, value: str, late: str = "1 hour") -> DataFrame:
    """Count and mean by tumbling window, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def sessions(rows: DataFrame, time: str, keys: Sequence[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Rows by session: a gap in time ends one."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: str, late: str = "1 hour") -> DataFrame:
    """Rows of left with those of right at most `before` earlier; watermarks bound what is kept."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    k = b[key]
    return a.join(b, (a[key] == k) & (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"interval {before}"))).drop(k)


def once(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote below `path`, as a table. Rows go
    from the executors to Parquet files; in complete mode each micro-batch writes the whole result
    anew, and the last one counts."""
    start = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    spark, schema = rows.sparkSession, rows.schema
    if mode == "append":
        start.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{path}/rows")
    done = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows_{number}")
        done.append(number)

    start.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows_{max(done)}") if done else spark.createDataFrame([], schema)


def to_jsonl(rows: DataFrame, path: str, checkpoint: str, every: str = "30 seconds"):
    """A stream as JSON lines, flushed by time; nothing is dropped when it is slow."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
