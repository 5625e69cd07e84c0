"""Events that fire when a condition holds, and passive similarity over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILED, IDLE, FIRED = 0, 1, 2


@dataclass
class Trigger:
    """A predicate on a batch and what to do when it holds; both results go on a shared stack."""

    target: Callable[[DataFrame], object]
    exec: Callable[[DataFrame], object]
    stack: list = field(default_factory=list)

    def __call__(self, batch: DataFrame) -> int:
        try:
            hit = self.target(batch)
            self.stack.append(hit)
            if not hit:
                return IDLE
            self.stack.append(self.exec(batch))
            return FIRED
        except Exception as e:
            self.stack.append(e)
            return FAILED


@dataclass
class Event:
    trigger: Trigger
    times: int | None = None
    hits: int = 0
    errors: int = 0


class Monitor:
    """Looks at every micro-batch of a stream; an event goes after ``times`` hits, and the stream
    stops when no event is left."""

    def __init__(self):
        self.events: dict[str, Event] = {}
        self.finished: dict[str, Event] = {}

    def add_event(self, name: str, trigger: Trigger, times: int | None = None) -> None:
        """``times`` None: for ever; 0: not added."""
        if times != 0:
            self.events[name] = Event(trigger, times)

    def look(self, batch: DataFrame) -> None:
        for name, event in list(self.events.items()):
            code = event.trigger(batch)
            event.errors += code == FAILED
            event.hits += code == FIRED
            if event.times is not None and event.hits >= event.times:
                self.finished[name] = self.events.pop(name)

    def watch(self, stream: DataFrame, interval: str = "1 second", **options: str) -> StreamingQuery:
        """Start watching. The query runs until it is stopped; :meth:`wait` stops it in time."""
        return stream.writeStream.options(**options).foreachBatch(lambda batch, _: self.look(batch)).trigger(processingTime=interval).start()

    def wait(self, query: StreamingQuery, seconds: float) -> bool:
        """Until all events are done (True) or the time is up; then the query is stopped."""
        import time

        end = time.monotonic() + seconds
        while self.events and time.monotonic() < end and query.isActive:
            time.sleep(0.1)
        query.stop()
        return not self.events


def ticks(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A timer as a stream (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def passive_stream(samples: DataFrame, window: int, d: int = 1) -> DataFrame:
    """Passive cosmod similarity of each key's signal as it arrives: rows (tid, n, v) in the order of
    n within a key; out come (tid, i0, v). State is the last window + d - 1 samples of a key."""
    need = window + d

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held = state.get if state.exists else (0, [])
        held = list(held)
        rows = pd.concat(list(frames)).sort_values("n")
        out = []
        for v in rows["v"]:
            held.append(float(v))
            if len(held) == need:
                x, y = held[:window], held[d:]
                a, b, ab = sum(p * p for p in x), sum(p * p for p in y), sum(p * q for p, q in zip(x, y))
                out.append((key[0], at, 2 * ab / (a + b) if a * b else float(a == b)))
                held, at = held[1:], at + 1
        state.update((at, held))
        yield pd.DataFrame(out, columns=["tid", "i0", "v"])

    return samples.groupBy("tid").applyInPandasWithState(step, "tid bigint, i0 bigint, v double", "at bigint, held array<double>", "append", GroupStateTimeout.NoTimeout)
