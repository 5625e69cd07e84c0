"""Graphs as edge tables (src, dst); repeated rows are parallel edges, src = dst is a loop.

Iterative operators write their state to the shared folder each round, which ends its lineage and
survives lost executors. No operator collects vertices or edges; the driver sees counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import drop_stored, store, store_counted

ROUNDS = 10_000


def _rounds(most: int | None, what: str):
    """Round numbers from 1; beyond ``most``, if given, an error: no operator ends quietly unfinished."""
    for k in count(1):
        if most is not None and k > most:
            raise RuntimeError(f"{what} did not end in {most} rounds")
        yield k


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("v", F.col("in_degree").alias("degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("v", F.col("out_degree").alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """v, in_degree, out_degree of every vertex, parallel edges counted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.v").alias("v")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def neighbors(edges: DataFrame, v=None) -> DataFrame:
    """Distinct successors (src, dst); of one vertex, which must be known, if given."""
    if v is not None:
        if edges.filter((F.col("src") == F.lit(v)) | (F.col("dst") == F.lit(v))).isEmpty():
            raise KeyError(v)
        edges = edges.filter(F.col("src") == F.lit(v))
    return edges.select("src", "dst").distinct()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """v, component: the smallest vertex that v is connected with, ignoring direction.

    Each round hangs every vertex's larger neighbours, then its smaller ones, on its smallest
    neighbour; the depth falls geometrically, so rounds grow with the logarithm of the diameter.
    """
    both = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("w"))
    now, seen = store_counted(both.filter("u <> w").distinct(), "edges")
    for _ in _rounds(rounds, "components"):
        n = 2 * seen.get("rows", 0)
        if not n:
            break
        around = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        # stored, so that the joins can split the side of a hub
        least = around.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("all"), F.count_if(F.col("w") < F.col("u")).alias("below"))
        # a forest of stars: every vertex hangs on one other, or others hang on it
        loose = F.count_if((F.col("below") > 0) & (F.col("all") > 1))
        least, found = store_counted(least, "least", n, loose=loose)
        if not found["loose"]:
            drop_stored(least)
            break
        least_of = least.select("u", F.least("u", "m").alias("m"))
        large = store(around.join(least_of, "u").filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w").distinct(), "large", n)
        low = store(large.groupBy("u").agg(F.min("w").alias("m")), "low", n)
        hung = large.join(low, "u")
        after, seen = store_counted(hung.select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(hung.select("u", F.col("m").alias("w"))).filter("u <> w").distinct(), "edges", n)
        drop_stored(now, least, large, low)
        now = after
    hung = now.select(F.col("u").alias("v"), F.col("w").alias("component"))
    return vertices(edges).join(hung, "v", "left").withColumn("component", F.coalesce("component", "v"))


@dataclass(frozen=True)
class Counts:
    vertices: int
    edges: int
    components: int

    @property
    def euler_characteristic(self) -> int:
        """Vertices - edges + components, as this engine defines it."""
        return self.vertices - self.edges + self.components

    @property
    def cycle_rank(self) -> int:
        return self.edges - self.vertices + self.components

    @property
    def is_connected(self) -> bool:
        return self.components <= 1


def counts(edges: DataFrame) -> Counts:
    c = components(edges).agg(F.count("*"), F.count_distinct("component")).first()
    return Counts(c[0], edges.count(), c[1])


def counts_table(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, components, euler_characteristic, cycle_rank, is_connected."""
    c = components(edges).agg(F.count("*").alias("vertices"), F.count_distinct("component").alias("components")).withColumn("_k", F.lit(1))
    e = edges.agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1))  # two tables of one row
    v, n, k = F.col("vertices"), F.col("edges"), F.col("components")
    return c.join(e, "_k").select("vertices", "edges", "components", (v - n + k).alias("euler_characteristic"), (n - v + k).alias("cycle_rank"), (k <= 1).alias("is_connected"))


def euler_characteristic_of_cells(cells: list[int]) -> int:
    """Alternating sum of the numbers of cells by dimension."""
    for c in cells:
        if isinstance(c, bool) or not isinstance(c, int):
            raise TypeError("numbers of cells are whole")
        if c <= 0:
            raise ValueError("numbers of cells are positive")
    return sum(c * (-1) ** k for k, c in enumerate(cells))


#: Rows of a frontier, or of the vertices seen, up to which they are broadcast: they are counted.
SMALL = 100_000


def _little(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _one_way_in(steps: DataFrame) -> bool:
    """Has every vertex at most one predecessor?"""
    return steps.groupBy("dst").count().filter("count > 1").isEmpty()


def _hang(up: DataFrame, n: int) -> DataFrame:
    """v, root, level for (v, p), every vertex with its only predecessor or null, by doubling the
    distance each round; vertices that hang on a cycle have root null."""
    state = store(up.select("v", "p", F.when(F.col("p").isNull(), F.col("v")).alias("root"), F.col("p").isNotNull().cast("bigint").alias("level")), "doubling")
    for _ in range(max(n, 1).bit_length() + 1):
        above = state.select(F.col("v").alias("p"), F.col("p").alias("pp"), F.col("root").alias("top"), F.col("level").alias("more"))
        next_, found = store_counted(
            state.join(above, "p", "left").select("v", F.col("pp").alias("p"), F.coalesce("root", "top").alias("root"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")),
            "doubling",
            open=F.count_if(F.col("p").isNotNull()),
        )
        drop_stored(state)
        state = next_
        if not found.get("open"):
            break
    return state.select("v", "root", "level")


def distances(edges: DataFrame, source, rounds: int | None = None, target=None) -> DataFrame:
    """v, dist, pred: fewest edges from ``source``; of several predecessors the smallest. Stops at
    ``target`` if given. An unknown source gives no rows. Rounds follow the depth, but where no vertex
    has two predecessors their number is logarithmic in it."""
    steps = store(edges.select("src", "dst").distinct(), "steps")
    start = vertices(edges).filter(F.col("v") == F.lit(source))
    seen, found = store_counted(start.select("v", F.lit(0).alias("dist"), F.lit(None).cast(dict(start.dtypes)["v"]).alias("pred")), "seen", 1)
    frontier, n, parts = seen, found.get("rows", 0), [seen]
    if not n:
        return seen
    if _one_way_in(steps):
        every = vertices(steps)
        up = steps.filter(F.col("dst") != F.lit(source)).select(F.col("dst").alias("v"), F.col("src").alias("p"))
        hung = _hang(every.join(up, "v", "left"), every.count()).filter(F.col("root") == F.lit(source))
        return hung.join(up, "v", "left").select("v", F.col("level").cast("int").alias("dist"), F.col("p").alias("pred"))
    new = n
    for at in _rounds(rounds, "distances"):
        reached = _little(frontier.select(F.col("v").alias("src")), new).join(steps, "src").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("pred"))
        fresh = reached.join(_little(seen.select("v"), n), "v", "left_anti").select("v", F.lit(at).alias("dist"), "pred")
        fresh, found = store_counted(fresh, "frontier", hit=F.count_if(F.col("v") == F.lit(source if target is None else target)))
        new = found.get("rows", 0)
        if not new:
            drop_stored(fresh)
            break
        n += new
        parts.append(fresh)
        seen, frontier = seen.unionByName(fresh), fresh
        if len(parts) == 8:
            whole = store(seen, "seen", n)
            drop_stored(*parts[:-1])
            seen, parts = whole, [whole, fresh]
        if target is not None and found.get("hit"):
            break
    return seen


def reachable(edges: DataFrame, source, target) -> bool:
    """A known vertex reaches itself."""
    return not distances(edges, source, target=target).filter(F.col("v") == F.lit(target)).isEmpty()


def shortest_path(edges: DataFrame, source, target) -> list | None:
    """A path of fewest edges, None if there is none; from a vertex to itself it is that vertex,
    known or not. The path alone is brought to the driver."""
    if source == target:
        return [source]
    seen = store(distances(edges, source, target=target), "paths")
    end = seen.filter(F.col("v") == F.lit(target)).first()
    if end is None:
        return None
    # the vertices on the way back, found by doubling the distance each round
    back, on = seen.select("v", F.col("pred").alias("p")), seen.filter(F.col("v") == F.lit(target)).select("v")
    for _ in range(int(end["dist"]).bit_length()):
        on = store(on.unionByName(on.join(back, "v").filter("p is not null").select(F.col("p").alias("v"))), "on")
        back = store(back.join(back.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p", "left").select("v", F.col("pp").alias("p")), "back")
    return [r["v"] for r in seen.join(on.distinct(), "v").orderBy("dist").collect()]


def topological_levels(edges: DataFrame, rounds: int | None = None) -> DataFrame | None:
    """v, level: sources have level 0 and every edge leads to a higher level; None with a cycle.

    A graph where every vertex has at most one predecessor takes a number of rounds logarithmic in
    its depth (:func:`path_levels`); others are peeled, one level a round."""
    if _one_way_in(edges.select("src", "dst").distinct()):
        levels = path_levels(edges)
        return None if levels is None else levels.select("v", F.col("level").cast("int").alias("level"))
    rest = store(edges.select("src", "dst").distinct(), "rest")
    left, seen = store_counted(vertices(edges), "vertices")
    out, parts, n = None, [], seen.get("rows", 0)
    for k in _rounds(rounds, "topological levels"):
        free = left.join(rest.select(F.col("dst").alias("v")).distinct(), "v", "left_anti").withColumn("level", F.lit(k - 1))
        free, found = store_counted(free, "level", n)
        if not found.get("rows"):
            return None
        n -= found["rows"]
        parts.append(free)
        out = free if out is None else out.unionByName(free)
        if not n:
            return out
        gone = free.select("v")
        before, left = left, store(left.join(gone, "v", "left_anti"), "vertices", n)
        old, rest = rest, store(rest.join(gone.withColumnRenamed("v", "src"), "src", "left_anti"), "rest")
        drop_stored(before, old)
        if len(parts) == 32:
            out = store(out, "levels")
            drop_stored(*parts)
            parts = [out]
    return None


def path_levels(edges: DataFrame) -> DataFrame | None:
    """Like :func:`topological_levels` where every vertex has at most one predecessor: doubling the
    distance each round, so a path of n vertices takes log n rounds."""
    up = store(edges.select(F.col("dst").alias("v"), F.col("src").alias("p")).distinct(), "up")
    if not up.groupBy("v").count().filter("count > 1").isEmpty():
        raise ValueError("a vertex has several predecessors")
    every = vertices(edges)
    levels = _hang(every.join(up, "v", "left"), every.count())
    return levels.select("v", "level") if levels.filter("root is null").isEmpty() else None


def topological_sort(edges: DataFrame) -> list | None:
    """One valid order, None with a cycle; for graphs whose order fits the driver."""
    levels = topological_levels(edges)
    return None if levels is None else [r["v"] for r in levels.orderBy("level", "v").toLocalIterator()]


def is_dag(edges: DataFrame) -> bool:
    return topological_levels(edges) is not None


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """v, component: vertices that reach each other share the smallest of them.

    Colouring: vertices without predecessors or successors are cut off as components of their own;
    then every vertex takes the smallest vertex that reaches it, and those that reach back to their
    colour's root within the colour are its component. What is left goes round again.
    """
    todo = store(edges.select("src", "dst").filter("src <> dst").distinct(), "todo")
    every = store(vertices(edges), "vertices")
    done = None
    for _ in _rounds(rounds, "strong components"):
        # a forest has no cycle, however deep it is: its depth costs a logarithm of rounds
        if _one_way_in(todo) and path_levels(todo) is not None:
            break
        # cut off what cannot be on a cycle
        while True:
            ends = todo.select(F.col("src").alias("v")).distinct().join(todo.select(F.col("dst").alias("v")).distinct(), "v")
            core = store(todo.join(ends.withColumnRenamed("v", "src"), "src", "left_semi").join(ends.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"), "todo")
            smaller = core.count() < todo.count()
            todo = core
            if not smaller:
                break
        if todo.isEmpty():
            break
        colour = store(vertices(todo).withColumn("c", F.col("v")), "colour")
        while True:
            came = todo.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("n"))
            after = store(colour.join(came, "v", "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c")), "colour")
            same = after.join(colour, ["v", "c"], "left_anti").isEmpty()
            colour = after
            if same:
                break
        inside = todo.join(colour.select(F.col("v").alias("src"), F.col("c")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("d")), "dst").filter("c = d").select("src", "dst", "c")
        inside = store(inside, "inside")
        found = store(colour.filter("v = c"), "found")
        while True:
            back = inside.join(found.select(F.col("v").alias("dst"), F.col("c").alias("k")), "dst").filter("k = c").select(F.col("src").alias("v"), "c").distinct()
            fresh = store(back.join(found, "v", "left_anti"), "found")
            if fresh.isEmpty():
                break
            found = store(found.unionByName(fresh), "found")
        done = found if done is None else done.unionByName(found)
        gone = found.select("v")
        todo = store(todo.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"), "todo")
    if done is None:
        return every.withColumn("component", F.col("v"))
    return every.join(done.select("v", F.col("c").alias("component")), "v", "left").withColumn("component", F.coalesce("component", "v"))


def euler_tests(edges: DataFrame) -> DataFrame:
    """One row: has_circuit, has_path. A circuit needs equal in- and out-degrees and one component
    of edges; a path may start with one edge more and end with one less."""
    d = degrees(edges).withColumn("x", F.col("out_degree") - F.col("in_degree"))
    s = d.agg(F.count_if(F.col("x") != 0).alias("odd"), F.count_if(F.col("x") == 1).alias("starts"), F.count_if(F.col("x") == -1).alias("ends")).withColumn("_k", F.lit(1))
    c = components(edges).agg(F.count_distinct("component").alias("n")).withColumn("_k", F.lit(1))  # two tables of one row
    one = F.col("n") <= 1
    circuit = one & (F.col("odd") == 0)
    return s.join(c, "_k").select(circuit.alias("has_circuit"), (circuit | (one & (F.col("odd") == 2) & (F.col("starts") == 1) & (F.col("ends") == 1))).alias("has_path"))
