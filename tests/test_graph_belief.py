import random

import pytest
from pyspark.errors import PySparkException

from gridloom.operators import belief, graph, memory, sampling


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string") if text else spark.createDataFrame([], "src string, dst string")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["v"])
    return {k: v for k, v in out.items()}


def test_components_and_counts(spark):
    e = edges(spark, "b>a c>b e>d f>f a>b")
    assert groups(graph.components(e)) == {"a": {"a", "b", "c"}, "d": {"d", "e"}, "f": {"f"}}
    c = graph.counts(e)
    assert (c.vertices, c.edges, c.components, c.euler_characteristic, c.cycle_rank, c.is_connected) == (6, 5, 3, 4, 2, False)
    assert tuple(graph.counts_table(e).first()) == (6, 5, 3, 4, 2, False)
    assert graph.counts(edges(spark, "")).is_connected
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = groups(graph.components(spark.createDataFrame(pairs, "src bigint, dst bigint")))
    root = {v: v for p in pairs for v in p}
    for _ in pairs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {}
    for v, r in root.items():
        want.setdefault(r, set()).add(v)
    assert got == want
    assert graph.euler_characteristic_of_cells([8, 12, 6]) == 2
    for bad, kind in (([0], ValueError), ([True], TypeError), ([1.0], TypeError)):
        with pytest.raises(kind):
            graph.euler_characteristic_of_cells(bad)


def test_directed(spark):
    e = edges(spark, "a>b b>c c>a b>d d>e e>d")
    assert sorted(map(sorted, groups(graph.strong_components(e)).values())) == [["a", "b", "c"], ["d", "e"]]
    assert len(groups(graph.strong_components(edges(spark, "a>b b>c c>a d>e")))) == 3
    assert {r["v"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(edges(spark, "a>b a>b c>c")).collect()} == {"a": (0, 2), "b": (2, 0), "c": (1, 1)}
    assert [r["dst"] for r in graph.neighbors(edges(spark, "a>b a>b"), "a").collect()] == ["b"]
    with pytest.raises(KeyError):
        graph.neighbors(e, "z")
    order = graph.topological_sort(edges(spark, "a>b b>c a>c d>b"))
    assert all(order.index(x) < order.index(y) for x, y in ("ab", "bc", "ac", "db"))
    assert graph.topological_sort(edges(spark, "a>b a>b")) == ["a", "b"]
    assert graph.topological_sort(edges(spark, "a>b b>c c>a")) is None and not graph.is_dag(edges(spark, "a>a"))
    path = spark.range(10_000).selectExpr("id as src", "id + 1 as dst")
    assert graph.path_levels(path).filter("v <> level").isEmpty()
    assert graph.path_levels(edges(spark, "a>b b>a")) is None


def test_paths(spark):
    e = edges(spark, "a>b b>c c>d a>x x>d d>a q>q")
    assert graph.shortest_path(e, "a", "d") == ["a", "x", "d"] and graph.shortest_path(e, "a", "q") is None
    assert graph.shortest_path(e, "z", "z") == ["z"] and not graph.reachable(e, "z", "z") and graph.reachable(e, "q", "q")
    assert graph.reachable(e, "c", "x") and not graph.reachable(e, "a", "q")
    tests = lambda t: tuple(graph.euler_tests(edges(spark, t)).first())
    assert tests("a>b b>c c>a") == (True, True) and tests("a>b b>c") == (False, True)
    assert tests("a>b c>d") == (False, False) and tests("a>b a>c") == (False, False) and tests("a>a") == (True, True)


def test_beliefs(spark):
    rows = [("A", "B", 0.2, 0), ("A", "B", 0.3, 5), ("B", "C", 0.5, 1), ("C", "D", 0.4, 2), ("A", "G", 0.1, 3), ("B", "G", 0.4, 4), ("X", belief.GLOBAL, 0.6, 9), ("Y", belief.GLOBAL, 0.3, 9), ("Y", "X", 0.25, 9)]
    b = belief.bind(spark.createDataFrame(rows, "outcome string, condition string, p double, seq bigint"))
    p = lambda *a, **k: round(belief.probability(b, *a, **k), 9)
    assert p("A", "B") == 0.3 and p("A", "A") == 1 and p("A", "C") == 0.15 and p("A", "D") == 0.06 and p("D", "A") == 0 and p("Z", "B") == 0
    assert p("B", "A", strict=True) == round(0.3 * 0.4 / 0.1, 9) and p("X", "Y", strict=True) == round(0.25 * 0.6 / 0.3, 9)
    assert round(belief.union_probability(b, "A", "B", "C"), 9) == round(0.15 + 0.5 - 0.3 * 0.5, 9)
    assert belief.consistency_diagnostic(b, "A", "B", "C")["consistent"] is False
    assert belief.bind_exists(b, "A", "B") and not belief.bind_exists(belief.unbind(b, "A", "B"), "A", "B")
    with pytest.raises(PySparkException):
        belief.bind(spark.createDataFrame([("A", "B", 1.5, 0)], "outcome string, condition string, p double, seq bigint")).collect()
    assert belief.event("union", "b", "a") == belief.event("union", "a", "b", "a") != belief.event("intersection", "a", "b")
    rules = spark.createDataFrame([("a", "b", "", 1), ("b", "c", "", 3)], "reason string, result string, limit string, status int")
    assert belief.derivable(rules, "a", "c") and belief.derivable(rules, "z", "z") and not belief.derivable(rules, "c", "a")
    assert [r["result"] for r in belief.derivation(rules, "a", "c")] == ["b", "c"] and belief.derivation(rules, "c", "a") is None and belief.derivation(rules, "a", "a") == []


def test_memory(spark):
    m = memory.MapMemory(spark)
    m.save("k", 42)
    assert m.refer("k") is None
    m.commit()
    assert m.refer("k") == 42
    m.save("k", 1)
    m.rollback()
    m.commit()
    assert m.refer("k") == 42
    m.save(("a", "b"), 7)
    m.save("k", 2)
    m.save("k", 3)
    m.commit()
    assert m.refer(("a", "b")) == 7 and m.refer("k") == 3 and m.refer("no", -1) == -1 and m.items().count() == 2
    m.close()
    with pytest.raises(ValueError):
        m.refer("k")


def test_sampling(spark):
    t = spark.range(20_000)
    row = t.agg({"id": "count"}).first()
    assert row[0] == 20_000
    u = t.select(sampling.uniform(7, "id").alias("u"), sampling.randint(8, "id", low=1, high=6).alias("d"), sampling.choices(9, "id", values=["a", "b", "c"], weights=[6, 0, 2]).alias("c"), sampling.choice(1, "id", values=[1, 2]).alias("k"), sampling.randrange(2, "id", start=10, stop=0, step=-3).alias("r")).toPandas()
    assert 0 <= u.u.min() and u.u.max() < 1 and abs(u.u.mean() - 0.5) < 0.01
    assert set(u.d) == set(range(1, 7)) and abs((u.d == 3).mean() - 1 / 6) < 0.01
    assert set(u.c) == {"a", "c"} and abs((u.c == "a").mean() - 0.75) < 0.02 and set(u.k) == {1, 2} and set(u.r) == {10, 7, 4, 1}
    s = sampling.sample(t, 50, 3).collect()
    assert len({r["id"] for r in s}) == 50 and s == sampling.sample(t.repartition(7), 50, 3).collect()
    assert sampling.sample(t, 50, 4).collect() != s and sampling.sample(t.limit(3), 9, 1).count() == 3
    p = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 0.0)], "name string, weight double")
    got = sampling.weighted_choices(p, "weight", 4000, 1).groupBy("name").count().collect()
    share = {r["name"]: r["count"] / 4000 for r in got}
    assert set(share) == {"x", "y"} and abs(share["y"] - 0.75) < 0.03 and sum(r["count"] for r in got) == 4000
    assert sampling.shuffle(t.limit(9), 1).count() == 9 and sampling.secure_seed() != sampling.secure_seed()
