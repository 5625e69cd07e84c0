"""Iterative operators run to their end or fail; none stops quietly."""

import struct

import pytest

from gridloom.grid import from_nested
from gridloom.operators import belief, graph, sampling
from gridloom.plans import shells
from gridloom.sources import files, images


def _path(spark, n):
    return spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")


def _ladder(spark, n):
    """Two ways from each step to the next, so that vertices have several predecessors."""
    return spark.range(n).selectExpr("explode(array(named_struct('src', 3 * id, 'dst', 3 * id + 1), named_struct('src', 3 * id, 'dst', 3 * id + 2), named_struct('src', 3 * id + 1, 'dst', 3 * id + 3), named_struct('src', 3 * id + 2, 'dst', 3 * id + 3))) as e").select("e.*")


def test_deep_chains(spark):
    n = 10_000
    order = graph.topological_sort(_path(spark, n))
    assert order == list(range(n))
    n = 5_000
    g = _path(spark, n)
    assert graph.strong_components(g).select("component").distinct().count() == n
    assert graph.reachable(g, 0, n - 1) and not graph.reachable(g, n - 1, 0)
    assert graph.shortest_path(g, 0, n - 1) == list(range(n)) and graph.shortest_path(g, 7, 3) is None
    ring = g.union(spark.createDataFrame([(n - 1, 0)], "src bigint, dst bigint"))
    assert not graph.is_dag(ring) and graph.topological_sort(ring) is None


def test_a_cap_that_bites_is_an_error(spark):
    g = _ladder(spark, 6)
    assert graph.distances(g, 0).count() == 19 and graph.topological_levels(g).agg({"level": "max"}).first()[0] == 12
    for call in (lambda: graph.distances(g, 0, rounds=3), lambda: graph.topological_levels(g, rounds=3), lambda: graph.strong_components(_both(g), rounds=0), lambda: graph.components(_path(spark, 40), rounds=1)):
        with pytest.raises(RuntimeError):
            call()
    binds = belief.bind(_path(spark, 8).selectExpr("cast(dst as string) as outcome", "cast(src as string) as condition", "0.5D as p", "src as seq"))
    with pytest.raises(RuntimeError):
        belief.chain(binds, "0", rounds=3)
    assert belief.probability(binds, "7", "0") == 0.5**7 and belief.probability(binds, "0", "7") == 0.0
    # a path that leads into a cycle has no order
    tail = g.union(spark.createDataFrame([(18, 30), (30, 31), (31, 30)], "src bigint, dst bigint"))
    assert graph.topological_levels(tail) is None


def _both(g):
    return g.union(g.selectExpr("dst as src", "src as dst"))


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert graph.components(none).count() == 0 and graph.strong_components(none).count() == 0
    assert graph.topological_levels(none).count() == 0 and graph.distances(none, 1).count() == 0
    loop = spark.createDataFrame([(4, 4)], "src bigint, dst bigint")
    assert [tuple(r) for r in graph.components(loop).collect()] == [(4, 4)]


def test_equal_rows_have_draws_of_their_own(spark):
    t = spark.range(50).selectExpr("id").union(spark.range(50).selectExpr("cast(-1 as bigint) as id"))
    met = [sum(r["id"] == -1 for r in sampling.sample(t, 10, seed).collect()) for seed in range(40)]
    assert 3.5 < sum(met) / len(met) < 6.5 and all(sampling.sample(t, 500, 1).count() == 100 for _ in range(2))
    order = [r["id"] for r in sampling.shuffle(t, 2).collect()]
    assert sorted(order) == sorted(r["id"] for r in t.collect()) and order.count(-1) == 50
    runs = sum(a != b for a, b in zip([x == -1 for x in order], [x == -1 for x in order][1:]))
    assert runs > 20
    heavy = spark.createDataFrame([("a", 3.0)] * 4 + [("b", 0.0), ("c", 4.0)], "name string, w double")
    got = {r["name"]: r["count"] for r in sampling.weighted_choices(heavy, "w", 4000, 1).groupBy("name").count().collect()}
    assert set(got) == {"a", "c"} and abs(got["a"] - 3000) < 150
    assert sampling.weighted_choices(heavy.filter("w < 0"), "w", 5, 1).count() == 0


def test_buffers_that_do_not_fit(spark):
    for n in (3, 6):
        df = spark.createDataFrame([(0, struct.pack(f"{n}d", *range(n)))], "tid bigint, data binary")
        with pytest.raises(Exception, match="does not fit"):
            files.decode_buffers(df, "data", "d", (2, 2)).df.collect()


def test_image_formats():
    import numpy as np

    rng = np.random.default_rng(0)
    for c in (1, 2, 3, 4):
        p = rng.integers(0, 256, (5, 7, c))
        assert (images.decode_image(images.encode_png(p)) == p).all()
    # every line filter of the format, from lines that were filtered here
    p = rng.integers(0, 256, (5, 6, 3)).astype(int)
    lines = []
    for y in range(5):
        line = [y]
        for x in range(18):
            left, up = (p[y].ravel()[x - 3] if x >= 3 else 0), (p[y - 1].ravel()[x] if y else 0)
            corner = p[y - 1].ravel()[x - 3] if y and x >= 3 else 0
            near = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            line.append((p[y].ravel()[x] - (0, left, up, (left + up) // 2, near)[y]) % 256)
        lines.append(line)
    assert (images._unfilter(np.array(lines, np.uint8), 3).reshape(5, 6, 3) == p).all()
    with pytest.raises(ValueError):
        images.decode_image(b"GIF89a")
    images.register(b"GIF8", lambda data: np.zeros((1, 1, 1)))
    assert images.decode_image(b"GIF89a").shape == (1, 1, 1)
    images.READERS.pop(0)


def test_shells(spark):
    g = from_nested(spark, [[1.0, 2.0], [3.0, 4.0]])
    made = shells.Generator(from_nested(spark, [[0.0, 0.0], [0.0, 0.0]]))
    assert made.copy(g, shape=(1, 2)) == 2 and made.set_point((1, 1), 7.0).grid.rows() == [1, 2, 0, 7]
    assert shells.Delegate(made).grid is made.grid
    table = shells.Lookup(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"))
    asked = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {r["k"]: r["contained"] for r in table.contains(asked, "k").collect()} == {"a": True, "z": False}
    assert table.keys().count() == table.items().count() == 2
    said = []

    class Bad:
        def __enter__(self):
            raise KeyError("no")

        def __exit__(self, *_):
            said.append("bad")

    class Good(Bad):
        def __enter__(self):
            return 1

        def __exit__(self, *_):
            said.append("good")

    with pytest.raises(KeyError), shells.contexts(Good(), Bad()):
        pass
    assert said == ["good"]
    calls = shells.Calls({"twice": lambda x: 2 * x})
    assert calls.call("twice", 4) == 8
    with pytest.raises(KeyError):
        calls.get("thrice")
    thread = shells.run_in_thread(said.append, "thread")
    thread.join()
    assert said[-1] == "thread"
