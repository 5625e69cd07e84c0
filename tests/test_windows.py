import itertools
import math
import random

import pytest

from gridloom.functions.combine import python_combiner
from gridloom.grid import Grid, from_nested
from gridloom.operators import windows as w

FORMS = {
    "cos": lambda a, b, ab: ab / math.sqrt(a * b) if a * b else float(a == b),
    "mod": lambda a, b, ab: 2 * math.sqrt(a * b) / (a + b) if a * b else float(a == b),
    "cosmod": lambda a, b, ab: 2 * ab / (a + b) if a * b else float(a == b),
    "convolution": lambda a, b, ab: ab,
}


def cells(shape):
    return itertools.product(*map(range, shape))


def brute(v, shape, window, d, start, end, step, f, lin=(1, 1, 0, 0), kernel=None):
    w1, w2, b1, b2 = lin
    out = {}
    num = [(e - s - q - x) // t + 1 for s, e, q, x, t in zip(start, end, window, d, step)]
    for o in cells(num):
        a = b = ab = 0.0
        for q in cells(window):
            p = tuple(s + t * i + k for s, t, i, k in zip(start, step, o, q))
            x = w1 * v[p] + b1
            y = w2 * (kernel[q] if kernel else v[tuple(i + j for i, j in zip(p, d))]) + b2
            a, b, ab = a + x * x, b + y * y, ab + x * y
        out[o] = f(a, b, ab)
    return out


def nest(v, shape, at=()):
    return [nest(v, shape, (*at, i)) for i in range(shape[len(at)])] if len(at) < len(shape) else v[at]


def got(g):
    return {tuple(r[a] for a in g.axes): r["v"] for r in g.df.collect()}


def near(a, b):
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)


@pytest.mark.parametrize("rank", [1, 2, 3, 4])
def test_passive_and_active_against_brute_force(spark, rank):
    rng = random.Random(rank)
    for _ in range(4):
        shape = tuple(rng.randint(4, 9 if rank < 3 else 5) for _ in range(rank))
        v = {p: rng.choice([0.0, 1.0, rng.uniform(-2, 2)]) for p in cells(shape)}
        g = from_nested(spark, nest(v, shape))
        window = tuple(rng.randint(1, 2) for _ in shape)
        d = tuple(rng.randint(0, 1) for _ in shape)
        start = tuple(rng.randint(0, 1) for _ in shape)
        end = tuple(n - rng.randint(0, 1) for n in shape)
        step = tuple(rng.randint(1, 2) for _ in shape)
        end = tuple(max(e, s + q + x) for e, s, q, x in zip(end, start, window, d))
        name, lin = rng.choice(list(FORMS)), (1.5, -0.5, 0.25, 1.0)
        for strategy in ("separable", "scatter"):
            out = w.passive(g, window, d=d, start=start, end=end, step=step, algorithm=name, w1=lin[0], w2=lin[1], b1=lin[2], b2=lin[3], strategy=strategy)
            near(got(out), brute(v, shape, window, d, start, end, step, FORMS[name], lin))
        kernel = {q: rng.uniform(-1, 1) for q in cells(window)}
        out = w.active(g, nest(kernel, window), start=start, end=end, step=step, algorithm=name, w1=lin[0], w2=lin[1], b1=lin[2], b2=lin[3])
        near(got(out), brute(v, shape, window, [0] * rank, start, end, step, FORMS[name], lin, kernel))


def test_known_values(spark):
    step = w.passive(from_nested(spark, [1, 1, 1, 5, 5, 5]), 2, d=1)
    near(got(step), dict(zip([(i,) for i in range(4)], [1, 3 / 7, 0.7894736842105263, 1])))
    pyramid = w.active(from_nested(spark, [1, 2, 3, 4, 5, 4, 3, 2, 1]), [3, 4, 5])
    assert [round(x, 6) for x in pyramid.rows()] == [0.8125, 0.962025, 1, 0.971963, 0.92, 0.860759, 0.679688][:6] + [0.6875]
    v = [[((3 * i + j) % 5) * 0.5 for j in range(8)] for i in range(8)]
    parity = w.passive(from_nested(spark, v), (3, 3), d=(0, 1))
    assert parity.shape == (6, 5) and [round(x, 9) for x in parity.rows()[:3]] == [0.769230769, 0.672268908, 0.660869565]
    assert w.passive(from_nested(spark, [[1.0] * 4] * 4)).shape == (3, 4)
    uniform = w.passive(from_nested(spark, [[1.0] * 6] * 6), (3, 3), d=(1, 0))
    assert set(uniform.rows()) == {1.0}
    square = [[float(i < 2 and j < 2) for j in range(5)] for i in range(5)]
    match = w.active(from_nested(spark, square), [[1, 1], [1, 1]])
    assert match.shape == (4, 4) and max(match.rows()) > 0.9


def test_local_statistics(spark):
    rows = from_nested(spark, [[float(i)] * 6 for i in range(6)])
    assert got(w.mean_local(rows, (2, 2)))[3, 0] == 3.5 and w.mean_local(rows, (2, 2)).shape == (5, 5)
    assert got(w.local_variance(rows, (2, 2)))[3, 0] == 0.25
    assert w.mean_local(from_nested(spark, [1, 2, 3, 4, 5, 6]), 3).rows() == [2, 3, 4, 5]
    assert w.mean_local(from_nested(spark, [1, 2, 3, 4]), 2, weight=[1, 3, 9]).rows() == [3.5, 5.5, 7.5]
    out = w.mean_local(rows, (2, 2), step=(2, 2), output_step=(2, 2), output_start=(1, 0))
    assert set(got(out)) == {(1 + 2 * i, 2 * j) for i in range(3) for j in range(3)}
    assert w.densify(out).df.count() == 6 * 5


def test_whole_grids(spark):
    cos = lambda a, b, **k: w.similarity(from_nested(spark, a), from_nested(spark, b), **k).first()["v"]
    assert math.isclose(cos([2, 0], [1, 1]), 1 / math.sqrt(2))
    assert cos([[1, 0], [0, 1]], [[0, 1], [1, 0]]) == 0
    assert cos([0, 0], [0, 0]) == 1.0 and cos([0, 0], [1, 0]) == 0.0
    assert math.isclose(cos([2, 1, 2], [1, 1, 2], algorithm="cosmod"), 2 * 7 / 15)
    with pytest.raises(ValueError):
        cos([1, 2], [1, 2, 3])


def test_errors(spark):
    g = from_nested(spark, [[1.0] * 4] * 4)
    for bad in (dict(window=(5, 1)), dict(window=(1,)), dict(d=(-1, 0)), dict(end=(-1, 4)), dict(step=(0, 1)), dict(start=(-1, 0)), dict(end=(9, 4))):
        with pytest.raises(ValueError):
            w.passive(g, **bad)
    with pytest.raises(ValueError):
        w.active(g, [1, 2])
    with pytest.raises(ValueError):
        w.passive(g, algorithm="none")
    with pytest.raises(ValueError):
        from_nested(spark, [[1], [2, 3]])
    with pytest.raises(ValueError):
        w.data_match(g, [[1.0]], low=2, high=1)


def test_opaque_combiner_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 5)
    v = [math.sin(i) for i in range(37)]
    g = from_nested(spark, v)
    want = brute({(i,): x for i, x in enumerate(v)}, (37,), (4,), (2,), (0,), (37,), (1,), FORMS["cosmod"])
    near(got(w.passive(g, 4, d=2, strategy="separable")), want)
    near(got(w.passive(g, 4, d=2, algorithm=python_combiner(FORMS["cosmod"]))), want)
    near(got(w.active(g, [1, 2, 3])), got(w.active(g, [1, 2, 3], strategy="scatter")))
    zero = w.passive(g, 2, algorithm=python_combiner(lambda a, b, ab: 1 / 0, on_error="zero"))
    assert set(zero.rows()) == {0.0}


def test_gaps_make_no_windows(spark):
    g = from_nested(spark, [1.0, 2, 3, 4, 5, 6, 7])
    holes = Grid(g.df.filter("i0 <> 3"), 1)
    assert set(got(w.passive(holes, 2, strategy="separable"))) == set(got(w.passive(holes, 2, strategy="scatter"))) == {(0,), (4,)}
