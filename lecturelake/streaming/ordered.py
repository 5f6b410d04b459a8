"""State machines over streams that read each key's rows in the order of their times, whatever order they arrive in.

Rows wait in the key's state until the watermark has passed their time, are then fed to the step in order, and go; a timer
wakes keys that get nothing more. A key that stays idle is flushed and forgotten, so state holds what is within the
watermark's delay and the machines of keys that were active within the idle time. Keys are dealt to buckets, and a bucket's
machines are read and written together: calls to the state store and timers cost more than most keys' rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Step
from ..storage import new_path
from .sessions import drained_rows

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Buckets that keys are dealt to, and rows of a file of a replayed table.
BUCKETS, FILE_ROWS = 1024, 250_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def micros(duration: str) -> int:
    """The microseconds of, say, "3 hours"."""
    n, unit = re.fullmatch(r"\s*(\d+)\s+(\w+?)s?\s*", duration).groups()
    return int(n) * UNITS[unit] * 1_000_000


class _Machines(StatefulProcessor):
    """The machines of a bucket of keys. Rows are (us, tie, key, columns of the step)."""

    def __init__(self, step: Step, flush: Callable[[tuple], list[tuple]], names: list[str], key: str, state: str, row: str, time: str, idle: int):
        self.step, self.flush, self.names, self.key_ddl, self.state_ddl, self.row_ddl, self.time, self.idle = step, flush, names, key, state, row, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: a key, its machine's state, and the time of the last row it has read
        self.machines = handle.getListState("machines", f"k {self.key_ddl}, {self.state_ddl}, last_us long")
        self.waiting = handle.getListState("waiting", self.row_ddl)

    def _advance(self, watermark: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        rows = sorted([*map(tuple, self.waiting.get()), *new], key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= watermark]
        kept, out = {k: (tuple(state), last) for k, *state, last in map(tuple, self.machines.get())}, []
        for us, _, k, *row in ready:
            state, last = kept.get(k, (None, us))
            if state is not None and us - last >= self.idle:
                out += [(k, *x) for x in self.flush(state)]
                state = None
            state, sent = self.step(state, tuple(row))
            out += [(k, *x) for x in sent]
            kept[k] = (state, us)
        for k, (state, last) in list(kept.items()):
            if state is None or last + self.idle <= watermark:  # what still waits is at least idle away
                out += [(k, *x) for x in self.flush(state)] if state is not None else []
                del kept[k]
        rest = rows[len(ready) :]
        for store, left in ((self.machines, [(k, *state, last) for k, (state, last) in kept.items()]), (self.waiting, rest)):
            if left:
                store.put(left)
            else:
                store.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest or kept:
            # the first of what waits or falls idle
            self.handle.registerTimer(min([*(r[0] for r in rest[:1]), *(last + self.idle for _, last in kept.values())]) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            frame = frame.drop(columns=["bucket", self.time])
            new += list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
        yield from self._advance(timerValues.getCurrentWatermarkInMs() * 1000, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass


def ordered_machine(events: DataFrame, key: str, time: str, tie: str, columns: list[str], step: Step, flush: Callable[[tuple], list[tuple]], state: str, schema: str, delay: str, idle: str, buckets: int = BUCKETS) -> DataFrame:
    """Feed each key's rows, by time and then tie, to a step; flush gives what a machine's state still holds once the key has
    had no row for idle. state (of the step) and schema (key first) are DDL; columns are the step's row.

    Rows later than delay are dropped. Rows with a null time or tie, and keys that are null, are no rows; such a row's time
    still moves the watermark on. Two rows of a key that are idle apart belong to two machines, as in a batch. A task holds
    the machines and the batch's rows of one of so many buckets.
    """
    x = events.withWatermark(time, delay)
    # rows that only tell the time go once it is told (the test reads the time, so as to stay behind the watermark): nulls
    # among a batch's keys would make floats of them in pandas
    x = x.filter(F.when(F.col(key).isNotNull() & F.col(tie).isNotNull(), F.col(time)).isNotNull())
    x = x.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.unix_micros(time).alias("us"), F.col(tie).alias("tie"), F.col(key).alias("k"), time, *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema if f.name not in ("bucket", time))
    machines = _Machines(step, flush, [c.split()[0] for c in schema.split(",")], x.schema["k"].dataType.simpleString(), state, parts, time, micros(idle))
    return x.groupBy("bucket").transformWithStateInPandas(statefulProcessor=machines, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def replayed(table: DataFrame, time: str, parts: int, after: str, per_file: int = FILE_ROWS) -> DataFrame:
    """A table as a stream that arrives in parts by time, one a micro-batch, and then rows of nothing but a time that lies
    `after` behind the last, so that timers up to there come due. For what is at rest and is to be read as it came.

    Each part is as many files as any other, which their tasks write side by side and a micro-batch reads together; a row of
    nothing but its part's first time is in each, so that none is left out as empty."""
    spark, path = table.sparkSession, new_path(table.sparkSession, "stream/in")
    micro = F.unix_micros(time)
    low, high, n = table.agg(F.min(micro), F.max(micro), F.count(F.lit(1))).first()
    # the same number in every part, and no other file: a micro-batch is so many files
    files = max(1, -(-n // (parts * per_file)))

    def ticks(at: int) -> DataFrame:
        when = F.timestamp_micros(F.lit(at))
        names = [when.alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
        return spark.range(files).select(*names, F.col("id").cast("int").alias("file"))

    def arrive(rows: DataFrame) -> None:
        rows.repartitionById(files, F.col("file")).drop("file").write.mode("append").parquet(path)

    if low is not None:
        step = (high - low) // parts + 1
        dealt = table.withColumn("file", F.pmod(F.xxhash64(*table.columns), F.lit(files)).cast("int"))
        for i in range(parts):
            arrive(dealt.filter(F.floor((micro - low) / step) == i).unionByName(ticks(low + i * step)))
        for i in (1, 2):
            arrive(ticks(high + i * micros(after)))
    else:
        spark.createDataFrame([], table.schema).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame) -> DataFrame:
    """Run a stream of ordered machines over what is there now; the rows that it has sent. Their state needs RocksDB, which the
    session gets for as long as the stream runs, unless it has it anyway."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drained_rows(stream)
    finally:
        conf.set(PROVIDER, before)
