"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked (through a hub for each text, so a group of n has n links, not
n*n/2). All rows start in shards of equal counts, in hash order. Then, in rounds, each linked
document wants the shard where most of its group already is; a plan for the 16 x 16 matrix of
wishes admits as many moves into a shard as documents leave it or unlinked ones can make room, and
unlinked documents fill the places that fall free. So every round keeps the counts of the shards
as they were, at most one apart (law ``rows``). When no wish can be met, shards without unlinked
documents are full: what remains of a group looks for the next best shard, also from within a full
one, if the group has no more rows there. A move goes from fewer rows of the group to as many or
more, so the sum of squares rises and rounds need no limit: they end when no wish can be met. Then
the groups that fit a shard unite once more, with the rows of larger ones as further fillers, and
at last the larger ones gather again without touching them.

At scale: no window or group is as large as a shard. Ranks come from counts by (shard, bucket)
plus a rank within the bucket, with buckets of about BUCKET rows. The driver sees the matrix of
wishes, shards squared numbers. A group with a third of all rows meets its hub's one row in a join
that adaptive execution splits; group counts are pre-aggregated.

Defined results: null text links like empty text (size 1, crc 0); null and repeated doc_ids are
documents like others, with slots of their own; an empty table gives an empty result; further
columns are ignored. ``grown_shard`` is null under this law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stored, fresh, identified, store, table, text_of

SHARDS = 16
BUCKET = 5_000


def _ranked(df: DataFrame, name: str, by: list[str], rows: int) -> DataFrame:
    """``df`` with a gapless rank from 0 within the columns ``by``, in even pieces."""
    buckets = max(1, -(-rows // BUCKET))
    df = df.withColumn("_b", F.pmod("k", F.lit(buckets)))
    counts = df.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = Window.partitionBy(*by, "_b").orderBy("k", "doc_id", "text_crc32", "size")
    return df.withColumn("_r", F.row_number().over(within)).join(counts, [*by, "_b"]).withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_b", "_o", "_r")


def _admit(wishes: dict[tuple[int, int], int], fillers: list[int]) -> dict[tuple[int, int], int]:
    """As many of the wishes (from, to) as the shards can take: what comes in is at most what goes
    out and the unlinked documents that can leave."""
    take = dict(wishes)
    n = len(fillers)
    while True:
        for j in range(n):
            into = [p for p in take if p[1] == j and take[p]]
            room = sum(v for (i, _), v in take.items() if i == j) + fillers[j]
            excess = sum(take[p] for p in into) - room
            if excess > 0:
                for p in sorted(into, key=lambda p: (take[p], p)):
                    cut = min(take[p], excess)
                    take[p] -= cut
                    excess -= cut
                break
        else:
            return {p: v for p, v in take.items() if v}


def _quota(pairs: dict[tuple[int, int], int]) -> Column:
    out = F.lit(0)
    for (i, j), v in sorted(pairs.items()):
        out = F.when((F.col("shard") == i) & (F.col("want") == j), F.lit(v)).otherwise(out)
    return out


def label_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked: one row a document."""
    raw = text_of("text")
    file, row = fresh(docs, "gl_file", "gl_row")
    rows = identified(docs, file, row).select(
        F.col(row).alias("at"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).cast("bigint").alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("group"),
    )
    # with the place in the file, so that many equal rows do not share a bucket
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text_crc32", "size", "at")).drop("at")
    rows = store(rows, "shard-rows")
    total = rows.count()
    # stored, here and below, so that the join can split the side of a large group
    linked = store(rows.groupBy("group").count().filter("count > 1").select(F.col("group").alias("g"), F.lit(True).alias("linked"), (F.col("count") > -(-total // shards)).alias("big")), "linked")
    state = rows.join(linked, F.col("group") == F.col("g"), "left").drop("g").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("linked", "big")})
    state = store(_ranked(state.withColumn("all", F.lit(0)), "rank", ["all"], total).withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).drop("all", "rank"), "shards")
    drop_stored(rows, linked)
    large = state.filter("big").limit(1).count() > 0
    state = _settle(state, shards, total, "linked", "not linked")
    if large:
        state = _settle(state, shards, total, "linked and not big", "not linked or big")
        state = _settle(state, shards, total, "big", "not linked")
    out = _ranked(state, "slot", ["shard"], total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")


def _settle(state: DataFrame, shards: int, total: int, moves: str, fills: str) -> DataFrame:
    """Rounds until no wish of the rows ``moves`` can be met; the rows ``fills`` make room."""
    closing, stuck = False, 0
    full: list[int] = []
    while True:
        held = store(state.filter(moves).groupBy("group", "shard").agg(F.count("*").alias("n")), "held")
        choice = F.max(F.struct(F.col("n"), F.xxhash64("group", "shard").alias("h"), F.col("shard").alias("to")))
        best = held.filter(~F.col("shard").isin(*full)) if full else held
        best = best.groupBy("group").agg(choice.alias("best"))
        # one row for each group and shard: where its rows there want to go
        goal = held.join(best, "group", "left").select("group", "shard", F.when(F.col("best.n") >= F.col("n"), F.col("best.to")).otherwise(F.col("shard")).alias("want"))
        goal = store(goal, "goals")
        moving = state.filter(moves).join(goal, ["group", "shard"]).select(*state.columns, "want")
        others = state.filter(f"not ({moves})").withColumn("want", F.when(F.expr(fills), F.lit(None).cast("int")).otherwise(F.col("shard")))
        wanted = store(moving.unionByName(others), "wishes")
        drop_stored(held, goal)
        seen = wanted.groupBy("shard", "want").count().collect()  # at most shards * (shards + 1) rows
        fillers = [0] * shards
        wishes: dict[tuple[int, int], int] = {}
        for r in seen:
            if r["want"] is None:
                fillers[r["shard"]] = r["count"]
            elif r["want"] != r["shard"]:
                wishes[r["shard"], r["want"]] = r["count"]
        pairs = _admit(wishes, fillers)
        if not pairs:
            drop_stored(wanted)
            stuck += 1
            # neither with all shards open nor with the full ones closed
            if stuck == 2 or not (wishes or closing):
                return state
            closing = not closing
            full = [j for j in range(shards) if closing and not fillers[j]]
            if closing and not full:
                return state
            continue
        stuck = 0
        moved = wanted.filter("want <> shard")
        if any(pairs.get(p, 0) < v for p, v in wishes.items()):
            moved = _ranked(moved, "_at", ["shard", "want"], total).withColumn("want", F.when(F.col("_at") < _quota(pairs), F.col("want")).otherwise(F.col("shard"))).drop("_at")
        net = [0] * shards
        for (i, j), v in pairs.items():
            net[j] += v
            net[i] -= v
        free = _fill(wanted.filter("want is null"), net, total)
        after = wanted.filter("want = shard").unionByName(moved).unionByName(free)
        old, state = state, store(after.withColumn("shard", F.col("want")).drop("want"), "shards")
        drop_stored(old, wanted)
        full = [j for j in range(shards) if closing and fillers[j] == net[j]]


def _fill(free: DataFrame, net: list[int], total: int) -> DataFrame:
    """Unlinked documents leave the shards that gained and go to those that lost."""
    start, at = [], 0
    for v in net:
        start.append(at)
        at += max(v, 0)
    ranked = _ranked(free, "_at", ["shard"], total)
    offset = F.element_at(F.array(*[F.lit(v) for v in start]), F.col("shard") + 1)
    leaves = F.col("_at") < F.element_at(F.array(*[F.lit(max(v, 0)) for v in net]), F.col("shard") + 1)
    place = F.col("_at") + offset
    to, at = F.col("shard"), sum(max(-v, 0) for v in net)
    for j in reversed(range(len(net))):
        at -= max(-net[j], 0)
        if net[j] < 0:
            to = F.when((place >= at) & (place < at - net[j]), F.lit(j)).otherwise(to)
    return ranked.withColumn("want", F.when(leaves, to).otherwise(F.col("shard"))).drop("_at")


def op09_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards(table(spark, sf_dir, "documents")).drop("linked")


QUERIES = {"op9_label_shards": op09_query}
ORACLE: dict[str, str] = {}
