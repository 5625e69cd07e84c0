"""Conditional probabilities and rules.

Beliefs are rows (outcome, condition, p, seq): P(outcome | condition) = p; of rows for the same
pair the one with the highest seq holds. Events are strings; :func:`event` writes joint events so
that the order of their members does not matter and the two kinds never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.graph import _rounds, distances, reachable, shortest_path
from gridloom.session import drop_stored, store, store_counted

GLOBAL = "global"


def event(kind: str, *members: str) -> str:
    """Key of a union or intersection of events."""
    if kind not in ("union", "intersection"):
        raise ValueError("kind is 'union' or 'intersection'")
    return f"{kind}({','.join(sorted(set(members)))})"


def bind(beliefs: DataFrame) -> DataFrame:
    """The rows that hold, as outcome, condition, p, first (the lowest seq of the pair); a p outside
    [0, 1] fails the query."""
    sound = F.when(F.col("p").between(0, 1), F.col("p")).otherwise(F.raise_error(F.lit("a probability lies between 0 and 1")).cast("double"))
    return beliefs.groupBy("outcome", "condition").agg(F.max_by("p", "seq").alias("p"), F.min("seq").alias("first")).select("outcome", "condition", sound.alias("p"), "first")


def unbind(beliefs: DataFrame, outcome: str, condition: str) -> DataFrame:
    return beliefs.filter(~((F.col("outcome") == outcome) & (F.col("condition") == condition)))


def bind_exists(binds: DataFrame, outcome: str, condition: str) -> bool:
    return not binds.filter((F.col("outcome") == outcome) & (F.col("condition") == condition)).isEmpty()


def chains(binds: DataFrame, conditions: DataFrame, rounds: int | None = None) -> DataFrame:
    """condition, outcome, dist, p for every condition: the product of p along a path of fewest steps
    to each outcome; of several such paths the one through the smallest predecessors. Runs until
    nothing new is reached; an explicit number of ``rounds`` that does not suffice is an error."""
    arcs = store(binds.select(F.col("condition").alias("src"), F.col("outcome").alias("dst"), F.col("p").alias("_p")), "arcs")
    seen = store(conditions.select("condition").distinct().select("condition", F.col("condition").alias("outcome"), F.lit(0).alias("dist"), F.lit(1.0).alias("p")), "seen")
    front, parts = seen, [seen]
    for at in _rounds(rounds, "chains"):
        step = front.select("condition", F.col("outcome").alias("src"), F.col("p").alias("so_far")).join(arcs, "src")
        came = step.groupBy("condition", F.col("dst").alias("outcome")).agg(F.min_by(F.col("so_far") * F.col("_p"), "src").alias("p"))
        fresh, found = store_counted(came.join(seen.select("condition", "outcome"), ["condition", "outcome"], "left_anti").select("condition", "outcome", F.lit(at).alias("dist"), "p"), "front")
        if not found.get("rows"):
            drop_stored(fresh)
            return seen
        parts.append(fresh)
        seen, front = seen.unionByName(fresh), fresh
        if len(parts) == 8:
            whole = store(seen, "seen")
            drop_stored(*parts[:-1])
            seen, parts = whole, [whole, fresh]
    raise AssertionError("rounds end by themselves")


def chain(binds: DataFrame, condition: str, rounds: int | None = None) -> DataFrame:
    """outcome, dist, p of :func:`chains` for one condition."""
    one = binds.sparkSession.createDataFrame([(condition,)], "condition string")
    return chains(binds, one, rounds).select("outcome", "dist", "p")


def exact(binds: DataFrame, pairs: DataFrame) -> DataFrame:
    """outcome, condition, p for pairs: 1 for an event given itself, the belief, or null."""
    got = pairs.join(binds.select("outcome", "condition", F.col("p").alias("_p")), ["outcome", "condition"], "left")
    return got.select("outcome", "condition", F.when(F.col("outcome") == F.col("condition"), F.lit(1.0)).otherwise(F.col("_p")).alias("p"))


def bayes(binds: DataFrame, pairs: DataFrame) -> DataFrame:
    """outcome, condition, p: P(B|A) * P(A|C) / P(B|C) for the first reference event C that has both
    (the global event first, then conditions by the seq of their first belief); null without one."""
    rank = F.when(F.col("condition") == GLOBAL, F.lit(-1)).otherwise(F.col("first"))
    order = store(binds.groupBy("condition").agg(F.min(rank).alias("at")).select(F.col("condition").alias("c"), "at"), "order")
    ba = binds.select(F.col("outcome").alias("condition"), F.col("condition").alias("outcome"), F.col("p").alias("pba"))
    ac = binds.select("outcome", F.col("condition").alias("c"), F.col("p").alias("pac"))
    bc = binds.select(F.col("outcome").alias("condition"), F.col("condition").alias("c"), F.col("p").alias("pbc")).filter("pbc <> 0")
    tried = pairs.join(ba, ["outcome", "condition"]).join(ac, "outcome").join(bc, ["condition", "c"]).filter("c <> outcome and c <> condition").join(order, "c")
    best = tried.groupBy("outcome", "condition").agg(F.min_by(F.col("pba") * F.col("pac") / F.col("pbc"), "at").alias("p"))
    return pairs.join(best, ["outcome", "condition"], "left")


def probabilities(binds: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """outcome, condition, p, how: for every pair 1 if the two are the same, the belief (exact), with
    ``strict`` by Bayes (bayes), else the chain product (chain), else 0 (none)."""
    pairs = pairs.select("outcome", "condition").distinct()
    got = exact(binds, pairs).withColumn("how", F.when(F.col("outcome") == F.col("condition"), "same").when(F.col("p").isNotNull(), "exact"))
    got, found = store_counted(got, "exact", open=F.count_if(F.col("p").isNull()))
    if not found.get("open"):
        return got
    parts, open_ = [got.filter("p is not null")], got.filter("p is null").select("outcome", "condition")
    if strict:
        tried = store(bayes(binds, open_).withColumn("how", F.lit("bayes")), "bayes")
        parts.append(tried.filter("p is not null"))
        open_ = tried.filter("p is null").select("outcome", "condition")
    reached = chains(binds, open_).select("outcome", "condition", "p")
    rest = open_.join(reached, ["outcome", "condition"], "left")
    parts.append(rest.select("outcome", "condition", F.coalesce("p", F.lit(0.0)).alias("p"), F.when(F.col("p").isNull(), "none").otherwise("chain").alias("how")))
    out = parts[0].select("outcome", "condition", "p", "how")
    for more in parts[1:]:
        out = out.unionByName(more.select("outcome", "condition", "p", "how"))
    return out


def _of(binds: DataFrame, triples: DataFrame, strict: bool, *wanted: tuple[str, str]) -> DataFrame:
    """``triples`` (a, b, c) with a column p_xy for P(x | y) of each wanted pair, by one resolution."""
    triples = store(triples.select("a", "b", "c").distinct(), "triples")
    pairs = None
    for x, y in wanted:
        part = triples.select(F.col(x).alias("outcome"), F.col(y).alias("condition"))
        pairs = part if pairs is None else pairs.unionByName(part)
    known = store(probabilities(binds, pairs, strict), "known")
    for x, y in wanted:
        triples = triples.join(known.select(F.col("outcome").alias(x), F.col("condition").alias(y), F.col("p").alias(f"p_{x}{y}")), [x, y])
    return triples


def intersections(binds: DataFrame, triples: DataFrame, strict: bool = False) -> DataFrame:
    """a, b, c, p: P(AB|C) as P(A|B) * P(B|C)."""
    return _of(binds, triples, strict, ("a", "b"), ("b", "c")).select("a", "b", "c", (F.col("p_ab") * F.col("p_bc")).alias("p"))


def unions(binds: DataFrame, triples: DataFrame, strict: bool = False) -> DataFrame:
    """a, b, c, p: P(A|C) + P(B|C) - P(AB|C)."""
    got = _of(binds, triples, strict, ("a", "c"), ("b", "c"), ("a", "b"))
    return got.select("a", "b", "c", (F.col("p_ac") + F.col("p_bc") - F.col("p_ab") * F.col("p_bc")).alias("p"))


def consistency(binds: DataFrame, triples: DataFrame, strict: bool = False) -> DataFrame:
    """a, b, c, left, right, consistent: both decompositions of P(AB|C), and whether they agree."""
    got = _of(binds, triples, strict, ("b", "a"), ("a", "c"), ("a", "b"), ("b", "c"))
    left, right = F.col("p_ba") * F.col("p_ac"), F.col("p_ab") * F.col("p_bc")
    return got.select("a", "b", "c", left.alias("left"), right.alias("right"), (left == right).alias("consistent"))


def _triple(binds: DataFrame, a: str, b: str, c: str) -> DataFrame:
    return binds.sparkSession.createDataFrame([(a, b, c)], "a string, b string, c string")


def probability(binds: DataFrame, outcome: str, condition: str, strict: bool = False) -> float:
    """One pair of :func:`probabilities`."""
    return float(probabilities(binds, binds.sparkSession.createDataFrame([(outcome, condition)], "outcome string, condition string"), strict).first()["p"])


def chain_intersection(binds: DataFrame, a: str, b: str, c: str) -> float:
    return float(intersections(binds, _triple(binds, a, b, c)).first()["p"])


def union_probability(binds: DataFrame, a: str, b: str, c: str) -> float:
    return float(unions(binds, _triple(binds, a, b, c)).first()["p"])


def consistency_diagnostic(binds: DataFrame, a: str, b: str, c: str) -> dict:
    row = consistency(binds, _triple(binds, a, b, c)).first()
    return {k: row[k] for k in ("left", "right", "consistent")}


class Beliefs:
    """A context of beliefs: rows that are added and taken back, questions, and counters of how they
    were answered (hits: the same or exact; bayes; chain; miss; adds)."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.spark, self.seq = spark, 0
        self.rows = None if rows is None else rows.select("outcome", "condition", F.col("p").cast("double").alias("p"), F.col("seq").cast("bigint").alias("seq"))
        if self.rows is not None:
            self.seq = 1 + int(self.rows.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0])
        self.stats = dict.fromkeys(("hits", "bayes", "chain", "miss", "adds"), 0)

    def add(self, outcome: str, condition: str, p: float) -> None:
        if not 0 <= p <= 1:
            raise ValueError("a probability lies between 0 and 1")
        row = self.spark.createDataFrame([(outcome, condition, float(p), self.seq)], "outcome string, condition string, p double, seq bigint")
        self.rows = row if self.rows is None else self.rows.unionByName(row)
        self.seq += 1
        self.stats["adds"] += 1
        if self.seq % 32 == 0:
            self.rows = store(self.rows, "beliefs")

    def remove(self, outcome: str, condition: str) -> None:
        self.rows = unbind(self.binds(), outcome, condition).withColumnRenamed("first", "seq")

    def binds(self) -> DataFrame:
        none = self.spark.createDataFrame([], "outcome string, condition string, p double, seq bigint")
        return bind(none if self.rows is None else self.rows)

    def ask(self, pairs: DataFrame, strict: bool = False) -> DataFrame:
        """:func:`probabilities` of the pairs, counted."""
        got = store(probabilities(self.binds(), pairs, strict), "answers")
        for r in got.groupBy("how").count().collect():  # five rows at most
            self.stats[{"same": "hits", "exact": "hits", "none": "miss"}.get(r["how"], r["how"])] += r["count"]
        return got

    def initialize(self) -> None:
        """Forget everything."""
        self.__init__(self.spark)


# rules: (reason, result, limit, status); limit and status are carried, derivation ignores them
TRUE, SURE = 1, 2


def rule(reason: str, result: str, limit: str | None = None, status: int = TRUE) -> tuple[str, str, str | None, int]:
    """A row of a table of rules; no limit is null."""
    return reason, result, limit, status


def with_status(rules: DataFrame, flags: int) -> DataFrame:
    """The rules that carry all of the flags."""
    return rules.filter(F.col("status").bitwiseAND(flags) == flags)


def derivable(rules: DataFrame, a: str, b: str) -> bool:
    """Does b follow from a along rules?"""
    return a == b or reachable(rules.select(F.col("reason").alias("src"), F.col("result").alias("dst")), a, b)


def derivation(rules: DataFrame, a: str, b: str) -> list | None:
    """The rules that lead from a to b, [] if they are the same, None if there are none."""
    path = shortest_path(rules.select(F.col("reason").alias("src"), F.col("result").alias("dst")), a, b)
    if path is None:
        return None
    return [rules.filter((F.col("reason") == x) & (F.col("result") == y)).first() for x, y in zip(path, path[1:])]


def consequences(rules: DataFrame, a: str) -> DataFrame:
    """result, steps: everything that follows from a."""
    seen = distances(rules.select(F.col("reason").alias("src"), F.col("result").alias("dst")), a)
    return seen.select(F.col("v").alias("result"), F.col("dist").alias("steps"))


