"""Seeded sampling. Draws depend on the seed and on row keys, not on how rows are partitioned."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = float(1 << 52)


def _draw(seed: int, *keys: str | Column) -> Column:
    """md5 of seed and keys, written as text: any database can draw the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def uniform(seed: int, *keys: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) for the row's keys."""
    h = F.conv(F.substring(_draw(seed, *keys), 1, 13), 16, 10).cast("bigint")
    return F.lit(low) + h.cast("double") / _STEPS * F.lit(high - low)


def randint(seed: int, *keys: str | Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    if low > high:
        raise ValueError("low is above high")
    return (F.floor(uniform(seed, *keys) * (high - low + 1)) + low).cast("bigint")


def randrange(seed: int, *keys: str | Column, start: int, stop: int, step: int = 1) -> Column:
    n = len(range(start, stop, step))
    if not n:
        raise ValueError("an empty range")
    return F.lit(start) + F.lit(step) * randint(seed, *keys, low=0, high=n - 1)


def choice(seed: int, *keys: str | Column, values: list) -> Column:
    """One of ``values`` for the row's keys."""
    if not values:
        raise IndexError("nothing to choose from")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (randint(seed, *keys, low=0, high=len(values) - 1) + 1).cast("int"))


def choices(seed: int, *keys: str | Column, values: list, weights: list[float]) -> Column:
    """One of ``values`` by weight, with replacement."""
    if len(values) != len(weights) or not values:
        raise ValueError("values and weights must match")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative, and not all zero")
    u = uniform(seed, *keys) * F.lit(float(sum(weights)))
    live = [(v, w) for v, w in zip(values, weights) if w > 0]
    out, upto = F.lit(live[-1][0]), sum(w for _, w in live)
    for (v, _), (_, above) in zip(reversed(live[:-1]), reversed(live)):
        upto -= above
        out = F.when(u < upto, F.lit(v)).otherwise(out)
    return out


def _told_apart(population: DataFrame, unique: bool) -> tuple[DataFrame, list]:
    """The rows with a column ``_n`` that numbers equal rows from 1: rows are counted, and the counts
    written out, so that many equal rows are no window of one task. ``unique`` says there are none."""
    names = population.columns
    if unique:
        return population.withColumn("_n", F.lit(1).cast("bigint")), names
    some = 1 << 16
    counted = population.groupBy(*names).agg(F.count("*").alias("_c"))
    counted = counted.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / some))))
    within = F.sequence(F.col("_p") * some + 1, F.least(F.col("_c"), (F.col("_p") + 1) * some))
    return counted.withColumn("_n", F.explode(within)).drop("_c", "_p"), names


def weighted_choices(population: DataFrame, weight: str, k: int, seed: int, unique: bool = False) -> DataFrame:
    """k draws with replacement from a table, by weight: draw, then the population's columns.

    Rows stand in the order of their md5, in 256 buckets by its first byte; cumulative weights are
    formed by bucket, then within it, and draws fall into them by one sorted pass over rows and draws
    of a bucket, so no task holds the table and none pairs all draws with all rows.
    """
    spark = population.sparkSession
    rows, names = _told_apart(population.filter(F.col(weight) > 0), unique)
    rows = rows.withColumn("_h", _draw(0, *names, "_n")).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    per = rows.groupBy("_b").agg(F.sum(weight).alias("_s"))
    ends, total = [], 0.0
    for r in sorted(per.collect()):  # at most 256 rows
        total += float(r["_s"])
        ends.append((r["_b"], total))
    if not ends:
        return spark.createDataFrame([], "draw bigint").join(population, F.lit(False))
    draws = spark.range(k).select(F.col("id").alias("draw"), (uniform(seed, "id") * F.lit(total)).alias("_u"))
    upto = F.array(*[F.lit(t) for _, t in ends])
    place = F.least(F.size(F.filter(upto, lambda t: t <= F.col("_u"))), F.lit(len(ends) - 1))
    before = F.element_at(F.array(F.lit(0.0), *[F.lit(t) for _, t in ends]), place + 1)
    draws = draws.select("draw", F.element_at(F.array(*[F.lit(b) for b, _ in ends]), place + 1).alias("_b"), (F.col("_u") - before).alias("_at"))
    up = Window.partitionBy("_b").orderBy("_h", "_n").rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    starts = rows.select("_b", F.coalesce(F.sum(weight).over(up), F.lit(0.0)).cast("double").alias("_at"), F.lit(None).cast("bigint").alias("draw"), row.alias("_row"))
    both = starts.unionByName(draws.select("_b", "_at", "draw", F.lit(None).cast(starts.schema["_row"].dataType).alias("_row")))
    # a draw takes the last row that starts at or before it
    so_far = Window.partitionBy("_b").orderBy("_at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_row", F.last("_row", ignorenulls=True).over(so_far)).filter("draw is not null").select("draw", "_row.*")


def sample(population: DataFrame, k: int, seed: int, unique: bool = False) -> DataFrame:
    """k rows without replacement; all of them if there are fewer. Equal rows have draws of their own;
    ``unique`` says there are none, which saves the shuffle that counts them. The k smallest draws
    are kept by a top-k, not by a full sort."""
    rows, names = _told_apart(population, unique)
    return rows.withColumn("_u", _draw(seed, *names, "_n")).orderBy("_u").limit(k).select(*[F.col(f"`{c}`") for c in names])


def shuffle(population: DataFrame, seed: int, unique: bool = False) -> DataFrame:
    """All rows in a random order, equal ones apart."""
    rows, names = _told_apart(population, unique)
    return rows.orderBy(_draw(seed, *names, "_n")).select(*[F.col(f"`{c}`") for c in names])


def secure_seed() -> int:
    return secrets.randbits(63)
