"""Streams of changes and events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from changeloom.operators.history import advance


def new_commits(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each commit (repo, hash) once, however often a log is read again within the delay."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo", "hash"])


def append_history(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends new commits to the history: restarts go on from the checkpoint, and a batch that fails is written once."""
    return new_commits(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("repo")


def stored(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The history that ``follow_history`` keeps at path: its commits, and (repo, old) the high-water mark of each repo.

    A folder a batch; of each repo, batches from its last rebuild on count. ``before``: as it was before that batch."""
    kept = StructType([*schema.fields, StructField("mode", StringType()), StructField("head", StringType()), StructField("batch", IntegerType())])
    spark.createDataFrame([], kept).write.partitionBy("batch").mode("ignore").parquet(path)
    rows = spark.read.schema(kept).parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    since = rows.filter("mode = 'rebuild'").groupBy("repo").agg(F.max("batch").alias("_since"))
    live = rows.join(since, "repo").filter("batch >= _since")
    return live.select(*schema.names), live.groupBy("repo").agg(F.max_by("head", "batch").alias("old"))


def follow_history(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps histories up to date from logs(repo, seq, hash, parents, ...): see ``operators.history.advance``.

    A batch is decided against the batches before it and replaces its own folder, so one that is run again after a failure leaves
    the same history; readers see a batch's commits with its mark, in one write.
    """

    def keep(log: DataFrame, number: int) -> None:
        known, heads = stored(log.sparkSession, path, log.schema, number)
        advance(known, heads, log).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def activity(stream: DataFrame, ts: str, keys: list[str], width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts by key and window of event time; what is later than the delay is dropped."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).groupBy(F.window("_ts", width), *keys).count()


def bounded_log(stream: DataFrame, key: str, line: str, most: int = 400) -> DataFrame:
    """(key, lines, dropped): the last so many lines of each key and how many went before them."""

    def keep(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines, dropped = state.get if state.exists else ([], 0)
        lines = list(lines)
        for part in parts:
            lines += part[line].tolist()
            gone = max(0, len(lines) - most)
            lines, dropped = lines[gone:], dropped + gone
        state.update((lines, dropped))
        yield pd.DataFrame({key: [who[0]], "lines": [lines], "dropped": [dropped]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, line).groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, lines array<string>, dropped bigint", "lines array<string>, dropped bigint", "update", GroupStateTimeout.NoTimeout)


class Logs(StatefulProcessor):
    """Of each owner at most so many keys, each with at most so many lines; the key that was written to least recently goes.

    A key's lines are an entry of their own in a map of states, so a batch reads and writes only the keys it has lines of. ``idle``:
    an owner that had none for so many milliseconds of processing time is dropped whole by its timer.
    """

    def __init__(self, owner: str, key: str, line: str, most_lines: int, most_keys: int, idle: int | None) -> None:
        self.owner, self.key, self.line, self.most_lines, self.most_keys, self.idle = owner, key, line, most_lines, most_keys, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "key string", "lines array<string>, dropped bigint")
        self.seen = handle.getMapState("seen", "key string", "at bigint")
        self.clock = handle.getValueState("clock", "at bigint")

    def handleInputRows(self, who: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, touched = (self.clock.get()[0] if self.clock.exists() else 0), {}
        for part in rows:
            for name, line in zip(part[self.key], part[self.line]):
                at += 1
                if name not in touched:
                    had = self.lines.getValue((name,)) if self.lines.containsKey((name,)) else ([], 0)
                    touched[name] = [deque(had[0], self.most_lines), had[1], at]
                lines, dropped, _ = touched[name]
                touched[name][1:] = [dropped + (len(lines) == self.most_lines), at]
                lines.append(line)
        for name, (lines, dropped, last) in touched.items():
            self.lines.updateValue((name,), (list(lines), int(dropped)))
            self.seen.updateValue((name,), (last,))
        self.clock.update((at,))
        order = sorted((v[0], k[0]) for k, v in self.seen.iterator())
        gone = {name for _, name in order[: max(0, len(order) - self.most_keys)]}
        for name in gone:
            self.lines.removeKey((name,))
            self.seen.removeKey((name,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)
        out = [(who[0], k, None if k in gone else list(v[0]), int(v[1]), k in gone) for k, v in touched.items()]
        out += [(who[0], k, None, 0, True) for k in sorted(gone - set(touched))]
        yield pd.DataFrame(out, columns=[self.owner, self.key, "lines", "dropped", "evicted"])

    def handleExpiredTimer(self, who: tuple, timers: TimerValues, expired: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = [k[0] for k in self.seen.keys()]
        for state in (self.lines, self.seen, self.clock):
            state.clear()
        yield pd.DataFrame([(who[0], k, None, 0, True) for k in names], columns=[self.owner, self.key, "lines", "dropped", "evicted"])

    def close(self) -> None:
        pass


def bounded_logs(stream: DataFrame, owner: str, key: str, line: str, most_lines: int = 400, most_keys: int = 2000, idle: int | None = None) -> DataFrame:
    """(owner, key, lines, dropped, evicted): after each batch the last lines of the keys that it wrote to, how many went before
    them, and the keys that went because their owner has more than ``most_keys`` (the one written to least recently goes first).

    Needs the RocksDB state store (``STATE_STORE``). An evicted key that comes again begins anew. Lines of one batch count in the
    order in which they come. See ``Logs``.
    """
    kind = stream.schema[owner].dataType.simpleString()
    schema = f"{owner} {kind}, {key} string, lines array<string>, dropped bigint, evicted boolean"
    rows = stream.select(owner, F.col(key).cast("string").alias(key), line)
    return rows.groupBy(owner).transformWithStateInPandas(Logs(owner, key, line, most_lines, most_keys, idle), schema, "Update", "None" if idle is None else "ProcessingTime")


#: The setting that states of several kinds and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
