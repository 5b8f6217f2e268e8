"""Folds of keyed events in event order, on streams: what came in any order and any micro-batches is held back until the
watermark has passed it.

An event is folded once the watermark is beyond its time, so all earlier ones are there; later arrivals from before
the watermark are dropped by Spark. A state may have a deadline, which takes effect without a further event when the
watermark has passed it. The same rows come out for any split of the input into micro-batches, as long as no row is
later than the lateness. Times are milliseconds since 1970; equal times are put in order by `seq`.

A key's held rows and state live in the state store (RocksDB), which every key has for itself; a task takes the held
rows of one key at a time.
"""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
State = dict
# Spark hands the processor to a process of its own on the driver, too, which doesn't get what is shipped to workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def names_of(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


class OrderedFold(StatefulProcessor):
    """step(state, event) gives the next state; expire(state) the one after deadline(state), None for no deadline.

    over(state, watermark) says that a key without held rows may be forgotten.
    """

    def __init__(self, keys: list[str], events: str, start: State, states: str, step: Callable, deadline: Callable, expire: Callable, over: Callable, changes: bool) -> None:
        self.keys, self.events, self.start, self.states = keys, events, start, states
        self.step, self.deadline, self.expire, self.over, self.changes = step, deadline, expire, over, changes
        self.columns = [*keys, "at", *names_of(states)]
        self.names = names_of(events)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.events)
        self.state = handle.getValueState("state", self.states)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in part[self.names].itertuples(index=False, name=None)]
        at = self.names.index("at")
        self.held.appendList(new)
        self.handle.registerTimer(min(r[at] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        event = namedtuple("Event", self.names)
        held = [event(*r) for r in self.held.get()] if self.held.exists() else []
        ready, rest = sorted((r for r in held if r.at < mark), key=lambda r: (r.at, r.seq)), [r for r in held if r.at >= mark]
        names = self.columns[len(self.keys) + 1 :]
        state = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict(self.start)
        out: list[tuple] = []

        def move(to: State, at: int) -> State:
            if not self.changes or to != state:
                out.append((*key, at, *(to[n] for n in names)))
            return to

        for r in ready:
            while (due := self.deadline(state)) is not None and due <= r.at:
                state = move(self.expire(state), due)
            state = move(self.step(state, r), r.at)
        while (due := self.deadline(state)) is not None and due < mark:
            state = move(self.expire(state), due)
        if rest:
            self.held.put([tuple(r) for r in rest])
            self.handle.registerTimer(min(r.at for r in rest) + 1)
        else:
            self.held.clear()
        if not rest and self.over(state, mark):
            self.state.clear()
        else:
            self.state.update(tuple(state[n] for n in names))
            if due is not None:
                self.handle.registerTimer(due + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def never(state: State, *_: object) -> None:
    """No deadline; nothing to forget."""


def ordered_fold(stream: DataFrame, keys: list[str], events: str, start: State, states: str, step: Callable, lateness: str | None, deadline: Callable = never, expire: Callable = never, over: Callable = never, changes: bool = False) -> DataFrame:
    """keys, at and the state after each event and deadline (with `changes`, where it changed), in event order by key.

    stream has an event time `ts`, the keys and the columns of `events`, among them `seq`; `at`, if it has none, is that
    of ts. Without a lateness the watermark is that of what comes before.
    """
    rows = stream if lateness is None else stream.withWatermark("ts", lateness)
    rows = rows if "at" in rows.columns else rows.withColumn("at", F.unix_millis("ts"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (rows.schema[k] for k in keys))
    fold = OrderedFold(keys, events, start, states, step, deadline, expire, over, changes)
    return rows.groupBy(*keys).transformWithStateInPandas(fold, f"{kinds}, at long, {states}", "append", "EventTime")
