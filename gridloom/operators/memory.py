"""Key-value memory with staged writes.

Writes (key array<string>, value double, seq) wait until they are committed; a commit folds them
into the table, the last write of a key wins, all or nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import drop_stored, store

SCHEMA = "key array<string>, value double, seq bigint"


def fold(writes: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """The last write of each key; of equal seq the greatest value."""
    return writes.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("s"), F.col(value).alias("x"))).alias("m")).select(*keys, F.col("m.x").alias(value))


@dataclass
class MapMemory:
    """A table of committed values and the writes that wait."""

    spark: SparkSession
    table: DataFrame | None = None
    staged: list = field(default_factory=list)
    frames: list = field(default_factory=list)
    seq: int = 0
    closed: bool = False

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the memory is closed")

    def save(self, key: str | tuple[str, ...], value: float) -> None:
        self._open()
        self.staged.append(([key] if isinstance(key, str) else list(key), float(value), self.seq))
        self.seq += 1

    def save_all(self, writes: DataFrame) -> None:
        """Stage a table of key and value, in the order of its column seq."""
        self._open()
        self.frames.append(writes.select("key", F.col("value").cast("double").alias("value"), (F.col("seq") + self.seq).alias("seq")))
        self.seq += 1 << 40

    def commit(self) -> None:
        self._open()
        parts = [self.spark.createDataFrame(self.staged, SCHEMA)] if self.staged else []
        parts += self.frames
        if not parts:
            return
        if self.table is not None:
            parts.append(self.table.withColumn("seq", F.lit(-1).cast("bigint")))
        writes = parts[0]
        for p in parts[1:]:
            writes = writes.unionByName(p)
        old, self.table = self.table, store(fold(writes, ["key"]), "memory")
        if old is not None:
            drop_stored(old)
        self.rollback()

    def rollback(self) -> None:
        self.staged, self.frames = [], []

    def refer(self, key: str | tuple[str, ...], default: float | None = None) -> float | None:
        """The committed value of one key."""
        self._open()
        if self.table is None:
            return default
        at = F.array(*[F.lit(k) for k in ([key] if isinstance(key, str) else key)])
        row = self.table.filter(F.col("key") == at).first()
        return default if row is None else row["value"]

    def keys(self) -> DataFrame:
        return self.items().select("key")

    def items(self) -> DataFrame:
        self._open()
        return self.table if self.table is not None else self.spark.createDataFrame([], "key array<string>, value double")

    def close(self) -> None:
        self.closed = True
        if self.table is not None:
            drop_stored(self.table)


class MemoryPool:
    """Named memories with levels."""

    def __init__(self):
        self.members: dict[str, tuple[int, MapMemory]] = {}

    def add(self, name: str, memory: MapMemory, level: int = 0) -> None:
        self.members[name] = (level, memory)

    def __getitem__(self, name: str) -> MapMemory:
        return self.members[name][1]

    def level(self, level: int) -> list[str]:
        return sorted(n for n, (at, _) in self.members.items() if at == level)

    def commit(self) -> None:
        for _, m in self.members.values():
            m.commit()
