"""Named queries over the driver's tables and the DuckDB SQL that gives the same rows.

Values are rounded to six places on both sides: sums of floats depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.threshold import threshold_judge
from gridloom.grid import Grid, create_void, matrix
from gridloom.operators import arith, belief, fourier, graph, memory, regions, stats, windows
from gridloom.sources.signals import signal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> Grid:
    return signal(_table(spark, d, "events"), "user_id", "event_id", "value")


def _vectors(spark: SparkSession, d: str) -> Grid:
    df = _table(spark, d, "embeddings")
    return matrix(df, "vec_id", "embedding", df.count(), 64)


def _out(g: Grid, *names: str) -> DataFrame:
    names = names or ("v",)
    # adding zero turns -0.0 into 0.0
    return g.df.select(*g.pick(*[(F.round(n, 6) + 0.0).alias(n) for n in names]))


# ---- SQL pieces
_S1 = "s AS (SELECT user_id AS tid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS i0, value AS v FROM events)"
_S2 = "s AS (SELECT CAST(0 AS BIGINT) AS tid, CAST(vec_id AS INTEGER) AS i0, CAST(unnest(range(64)) AS INTEGER) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_FORM = {"cosmod": "2*ab/(a+b)", "cos": "ab/sqrt(a*b)", "mod": "2*sqrt(a*b)/(a+b)"}


def _combine(name: str) -> str:
    return "round(ab, 6) + 0.0" if name == "convolution" else f"round(CASE WHEN a*b <> 0 THEN {_FORM[name]} WHEN a = b THEN 1.0 ELSE 0.0 END, 6) + 0.0"


def _passive1(alg="cosmod", w=3, d=1, x="v", y="y", start=0, end=None, step=1) -> str:
    cut = f"WHERE i0 >= {start}" + (f" AND i0 < {end}" if end else "")
    return f"""WITH {_S1},
p AS (SELECT tid, i0, {x} AS x, {y} AS y FROM (SELECT tid, i0, v, lead(v, {d}) OVER (PARTITION BY tid ORDER BY i0) AS y FROM s {cut}) WHERE y IS NOT NULL),
r AS (SELECT tid, i0, sum(x*x) OVER f AS a, sum(y*y) OVER f AS b, sum(x*y) OVER f AS ab, count(*) OVER f AS n FROM p
  WINDOW f AS (PARTITION BY tid ORDER BY i0 ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))
SELECT tid, CAST((i0 - {start}) // {step} AS INTEGER) AS i0, {_combine(alg)} AS v FROM r WHERE n = {w} AND (i0 - {start}) % {step} = 0"""


def _passive2(d0: int, d1: int, alg="cosmod") -> str:
    return f"""WITH {_S2},
p AS (SELECT a.i0, a.i1, a.v AS x, b.v AS y FROM s a JOIN s b ON b.i0 = a.i0 + {d0} AND b.i1 = a.i1 + {d1}),
r AS (SELECT i0 - q AS i0, i1 - p AS i1, sum(x*x) AS a, sum(y*y) AS b, sum(x*y) AS ab FROM p, range(3) t(q), range(3) u(p) GROUP BY ALL HAVING count(*) = 9)
SELECT CAST(0 AS BIGINT) AS tid, CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, {_combine(alg)} AS v FROM r"""


for _a in ("cosmod", "cos", "mod", "convolution"):
    _query(f"passive_1d_{_a if _a != 'convolution' else 'conv'}", _passive1(_a))(lambda s, d, a=_a: _out(windows.passive(_events(s, d), 3, algorithm=a)))
_query("passive_1d_affine", _passive1(x="2.0*v - 1.0", y="0.5*y + 3.0"))(lambda s, d: _out(windows.passive(_events(s, d), 3, w1=2.0, b1=-1.0, w2=0.5, b2=3.0)))
_query("passive_1d_step", _passive1(w=4, d=2, step=3))(lambda s, d: _out(windows.passive(_events(s, d), 4, d=2, step=3)))
_query("passive_1d_region", _passive1(start=2, end=20))(lambda s, d: _out(windows.passive(_long_enough(_events(s, d), 20), 3, start=2, end=20)))
SQL["passive_1d_region"] = SQL["passive_1d_region"].replace("FROM s WHERE i0 >= 2 AND i0 < 20", "FROM s WHERE i0 >= 2 AND i0 < 20 AND tid IN (SELECT tid FROM s WHERE i0 = 19)")


def _long_enough(g: Grid, n: int) -> Grid:
    """The keys with at least ``n`` cells, whole."""
    return g.with_df(g.df.join(g.df.filter(F.col("i0") == n - 1).select(*g.by), list(g.by)))


for _d in ((1, 0), (0, 1), (1, 1)):
    _query(f"passive_2d_d{_d[0]}{_d[1]}", _passive2(*_d))(lambda s, d, m=_d: _out(windows.passive(_vectors(s, d), (3, 3), d=m)))
_query("passive_2d_scatter", _passive2(1, 0))(lambda s, d: _out(windows.passive(_vectors(s, d), (3, 3), strategy="scatter")))

_K1 = [1.0, 2.0, 3.0, 2.0, 1.0]
_K2 = [[1.0, 0.5, -1.0], [0.25, 2.0, -0.5]]


def _active1(alg: str) -> str:
    return f"""WITH {_S1}, k(q, k) AS (VALUES {", ".join(f"({q}, {k})" for q, k in enumerate(_K1))}),
r AS (SELECT tid, i0 - q AS i0, sum(v*v) AS a, sum(k*k) AS b, sum(v*k) AS ab FROM s, k GROUP BY ALL HAVING count(*) = {len(_K1)} AND i0 - q >= 0)
SELECT tid, CAST(i0 AS INTEGER) AS i0, {_combine(alg)} AS v FROM r""".replace("GROUP BY ALL HAVING", "GROUP BY tid, i0 - q HAVING").replace(" AND i0 - q >= 0", "")


def _active2(alg: str) -> str:
    cells = ", ".join(f"({i}, {j}, {k})" for i, row in enumerate(_K2) for j, k in enumerate(row))
    return f"""WITH {_S2}, k(q0, q1, k) AS (VALUES {cells}),
r AS (SELECT i0 - q0 AS i0, i1 - q1 AS i1, sum(v*v) AS a, sum(k*k) AS b, sum(v*k) AS ab FROM s, k GROUP BY i0 - q0, i1 - q1 HAVING count(*) = 6)
SELECT CAST(0 AS BIGINT) AS tid, CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, {_combine(alg)} AS v FROM r"""


_query("active_1d", _active1("cosmod"))(lambda s, d: _out(windows.active(_events(s, d), _K1)))
_query("active_1d_scatter", _active1("cos"))(lambda s, d: _out(windows.active(_events(s, d), _K1, algorithm="cos", strategy="scatter")))
_query("active_2d", _active2("cosmod"))(lambda s, d: _out(windows.active(_vectors(s, d), _K2)))
_query("active_2d_conv", _active2("convolution"))(lambda s, d: _out(windows.active(_vectors(s, d), _K2, algorithm="convolution")))


def _local(exprs: str, two: bool) -> str:
    if two:
        return f"""WITH {_S2}, r AS (SELECT i0 - q AS i0, i1 - p AS i1, sum(v) AS sv, sum(v*v) AS ss FROM s, range(2) t(q), range(3) u(p) GROUP BY i0 - q, i1 - p HAVING count(*) = 6)
SELECT CAST(0 AS BIGINT) AS tid, CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, round({exprs.replace("N", "6")}, 6) AS v FROM r"""
    return f"""WITH {_S1}, r AS (SELECT tid, i0, sum(v) OVER f AS sv, sum(v*v) OVER f AS ss, count(*) OVER f AS n FROM s WINDOW f AS (PARTITION BY tid ORDER BY i0 ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT tid, i0, round({exprs.replace("N", "4")}, 6) AS v FROM r WHERE n = 4"""


_query("mean_local_1d", _local("sv/N", False))(lambda s, d: _out(windows.mean_local(_events(s, d), 4)))
_query("mean_local_2d", _local("sv/N", True))(lambda s, d: _out(windows.mean_local(_vectors(s, d), (2, 3))))
_query("local_variance_1d", _local("ss/N - (sv/N)*(sv/N)", False))(lambda s, d: _out(windows.local_variance(_events(s, d), 4)))
_query("local_variance_2d", _local("ss/N - (sv/N)*(sv/N)", True))(lambda s, d: _out(windows.local_variance(_vectors(s, d), (2, 3))))
_query("mean_local_weighted", _active1("convolution").replace("round(ab, 6)", f"round(ab / {len(_K1)}, 6)"))(lambda s, d: _out(windows.mean_local(_events(s, d), len(_K1), weight=_K1)))
_BARE = lambda sql: sql.replace("round(CASE", "(CASE").replace(", 6) + 0.0 AS v", ") AS v")
_query("data_match", f"SELECT tid, i0 FROM ({_BARE(_active1('cos'))}) WHERE v >= 0.75 AND v < 0.95")(lambda s, d: windows.data_match(_events(s, d), _K1, algorithm="cos", low=0.75, high=0.95, inclusive=(True, False)).df.select("tid", "i0"))
_query("data_match_2d", f"SELECT tid, i0, i1 FROM ({_BARE(_active2('cos'))}) WHERE v >= 0.3")(lambda s, d: windows.data_match(_vectors(s, d), _K2, algorithm="cos", low=0.3).df.select("tid", "i0", "i1"))


@_query("cos_pairs", """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS v
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(windows.packed_similarity("embedding", "other"), 6).alias("v"))


@_query("cos_whole", f"""WITH {_S2}, p AS (SELECT a.v AS x, b.v AS y FROM s a JOIN s b ON b.i0 = a.i0 AND b.i1 = 63 - a.i1),
r AS (SELECT sum(x*x) AS a, sum(y*y) AS b, sum(x*y) AS ab FROM p) SELECT CAST(0 AS BIGINT) AS tid, {_combine("cos")} AS v FROM r""")
def _(spark, d):
    g = _vectors(spark, d)
    return windows.similarity(g, regions.slice_view(g, slice(None), slice(None, None, -1))).select("tid", F.round("v", 6).alias("v"))


# ---- regions
@_query("slice_view", f"WITH {_S2} SELECT tid, CAST((60 - i1) // 4 AS INTEGER) AS i0, round(v, 6) AS v FROM s WHERE i0 = 7 AND i1 <= 60 AND i1 > 3 AND (60 - i1) % 4 = 0")
def _(spark, d):
    return _out(regions.slice_view(_vectors(spark, d), 7, slice(60, 3, -4)))


@_query("load_region", f"WITH {_S2} SELECT tid, CAST((i0 - 3) // 2 AS INTEGER) AS i0, CAST((i1 - 1) // 5 AS INTEGER) AS i1, round(v, 6) AS v FROM s WHERE i0 BETWEEN 3 AND 21 AND (i0 - 3) % 2 = 0 AND i1 >= 1 AND (i1 - 1) % 5 = 0 AND i1 < 41")
def _(spark, d):
    return _out(regions.load(_vectors(spark, d), (3, 1), (10, 8), (2, 5)))


@_query("copy_region", f"""WITH {_S2}, m AS (SELECT 2 * (i0 - 1) AS i0, 10 + i1 AS i1, v FROM s WHERE i0 >= 1 AND i0 <= 30 AND i1 < 40)
SELECT s.tid, s.i0, s.i1, round(coalesce(m.v, -s.v), 6) AS v FROM s LEFT JOIN m ON m.i0 = s.i0 AND m.i1 = s.i1""")
def _(spark, d):
    g = _vectors(spark, d)
    return _out(regions.copy_region(arith.neg(g), g, source_start=(1, 0), shape=(30, 40), target_start=(0, 10), target_step=(2, 1))[0])


@_query("data_filter", f"WITH {_S2} SELECT tid, CAST(100 + 3 * ((i0 - 2) // 2) AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1 FROM s WHERE i0 >= 2 AND (i0 - 2) % 2 = 0 AND v * v > 0.01")
def _(spark, d):
    return regions.data_filter(_vectors(spark, d), lambda v: v * v > 0.01, start=(2, 0), step=(2, 1), origin=(100, 0), basis=(3, 1))


@_query("data_mapping", f"WITH {_S2} SELECT tid, i0, i1, round(CASE WHEN i0 % 2 = 0 AND v > 0 THEN sqrt(v) ELSE v END, 6) AS v FROM s")
def _(spark, d):
    g = _vectors(spark, d)
    return _out(regions.data_mapping(g, lambda v: F.when(v > 0, F.sqrt(v)), step=(2, 1), out=g, out_step=(2, 1)))


@_query("threshold_filter", f"WITH {_S2} SELECT tid, i0, i1 FROM s WHERE v > -0.05 AND v <= 0.075 AND NOT isnan(v)")
def _(spark, d):
    return regions.threshold_filter(_vectors(spark, d), -0.05, 0.075, inclusive=(False, True))


@_query("threshold_map", f"WITH {_S2} SELECT tid, i0, i1, CASE WHEN v < -0.1 THEN -1.0 WHEN v < 0 THEN -0.5 WHEN v > 0.1 THEN 1.0 ELSE 0.25 END AS v FROM s")
def _(spark, d):
    pairs = [(lambda v: v < -0.1, -1.0), (lambda v: v < 0, -0.5), (lambda v: v > 0.1, 1.0), (False, 9.0)]
    return _out(regions.threshold_map(_vectors(spark, d), pairs, default_value=0.25))


@_query("threshold_judge", "SELECT event_id, CAST(value >= 10 AND value < 50 AS INTEGER) AS hit FROM events")
def _(spark, d):
    return _table(spark, d, "events").select("event_id", threshold_judge(10, 50, (True, False))(F.col("value")).alias("hit"))


@_query("set_region", f"WITH {_S2} SELECT tid, i0, i1, round(CASE WHEN i0 BETWEEN 1 AND 4 AND i1 BETWEEN 2 AND 9 THEN 7.5 ELSE v END, 6) AS v FROM s")
def _(spark, d):
    return _out(regions.assign(_vectors(spark, d), 7.5, (1, 2), (4, 8)))


@_query("get_set_item", f"WITH {_S2} SELECT tid, round(v + 0.5, 6) AS v FROM s WHERE i0 = 5 AND i1 = 6")
def _(spark, d):
    g = _vectors(spark, d)
    return regions.get_item(regions.set_item(arith.add(g, 0.5), (5, 7), 1.0), (5, 6)).select("tid", F.round("v", 6).alias("v"))


@_query("create_void", "SELECT CAST(0 AS BIGINT) AS tid, CAST(n // 300 AS INTEGER) AS i0, CAST(n // 10 % 30 AS INTEGER) AS i1, CAST(n % 10 AS INTEGER) AS i2, 1.5 AS v FROM range(6000) t(n)")
def _(spark, d):
    return create_void(spark, (20, 30, 10), 1.5).df


@_query("heat_levels", f"WITH {_S2}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM s) SELECT tid, i0, i1, round((v - lo) / (hi - lo), 6) AS v FROM s, m")
def _(spark, d):
    return _out(regions.heat_levels(_vectors(spark, d)))


# ---- arithmetic and statistics
def _next_row(g: Grid) -> tuple[Grid, Grid]:
    n = g.shape[0] - 1
    return regions.load(g, (0, 0), (n, 64)), regions.load(g, (1, 0), (n, 64))


for _n, _f, _e in (("add", arith.add, "a.v + b.v"), ("sub", arith.sub, "a.v - b.v"), ("mul", arith.mul, "a.v * b.v"), ("div", lambda x, y: arith.div(x, arith.add(arith.mul(y, y), 1.0)), "a.v / (b.v * b.v + 1.0)"), ("pow", lambda x, y: arith.power(arith.add(arith.mul(x, x), 0.5), y), "pow(a.v * a.v + 0.5, b.v)")):
    _query(f"tensor_{_n}", f"WITH {_S2} SELECT a.tid, a.i0, a.i1, round({_e}, 6) + 0.0 AS v FROM s a JOIN s b ON b.i0 = a.i0 + 1 AND b.i1 = a.i1")(lambda s, d, f=_f: _out(f(*_next_row(_vectors(s, d)))))
_query("tensor_scalar", f"WITH {_S2} SELECT tid, i0, i1, round(-(1.0 - v) * 2.0 / 4.0, 6) AS v FROM s")(lambda s, d: _out(arith.neg(arith.div(arith.mul(arith.sub(_vectors(s, d), 1.0, reflected=True), 2.0), 4.0))))
for _n, _f, _e, _t in (("norm", arith.norm, "sqrt(sum(v*v))", _S1), ("mean", stats.mean, "avg(v)", _S1), ("variance", stats.variance, "var_pop(v)", _S1), ("sum", stats.total, "sum(v)", _S1)):
    _query(f"tensor_{_n}", f"WITH {_t} SELECT tid, round({_e}, 6) AS v FROM s GROUP BY tid")(lambda s, d, f=_f: f(_events(s, d)).select("tid", F.round("v", 6).alias("v")))
_W = [((7 * k) % 11 - 5) / 4 for k in range(64)]
_query("chain_dot", f"WITH {_S2}, w AS (SELECT unnest(range(64)) AS i1, unnest([{', '.join(map(str, _W))}]) AS w) SELECT tid, i0, round(sum(v * CAST(w AS DOUBLE)), 6) AS v FROM s JOIN w USING (i1) GROUP BY tid, i0")(lambda s, d: _out(arith.matvec(_vectors(s, d), _W)))


@_query("chains", "SELECT o_orderkey, CAST(o_custkey % 7 * (o_orderkey % 5) * 3 AS BIGINT) AS product, CAST(o_custkey % 7 + o_orderkey % 5 + 2 AS BIGINT) AS total FROM orders")
def _(spark, d):
    parts = F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 5)
    return _table(spark, d, "orders").select("o_orderkey", stats.multiple_chain(parts, 3).alias("product"), stats.add_chain(parts, 2).alias("total"))


# ---- Fourier
_DFT = "p AS (SELECT tid, i0, k, sum(v * cos(2 * pi() * ((k * i1) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((k * i1) % 64) / 64)) AS im FROM s, range(64) t(k) GROUP BY ALL)"
_query("dft_rows", f"WITH {_S2}, {_DFT} SELECT tid, i0, CAST(k AS INTEGER) AS i1, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM p")(lambda s, d: _complex(fourier.dft(_vectors(s, d), 1, "direct")))
_query("dft_rows_fft", f"WITH {_S2}, {_DFT} SELECT tid, i0, CAST(k AS INTEGER) AS i1, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM p")(lambda s, d: _complex(fourier.dft(_vectors(s, d), -1, "fft")))
_query("power_spectrum", f"WITH {_S2}, {_DFT} SELECT tid, i0, CAST(k AS INTEGER) AS i1, round(re*re + im*im, 4) + 0.0 AS v FROM p")(lambda s, d: fourier.power_spectrum(_vectors(s, d), 1).df.select("tid", "i0", "i1", (F.round("v", 4) + 0.0).alias("v")))


def _complex(g: Grid) -> DataFrame:
    return g.df.select(*g.pick(*[(F.round(c, 5) + 0.0).alias(c) for c in ("re", "im")]))


@_query("idft_roundtrip", f"WITH {_S2} SELECT tid, i0, i1, round(v, 6) + 0.0 AS re, 0.0 AS im FROM s")
def _(spark, d):
    g = fourier.idft(fourier.dft(_vectors(spark, d), 1), 1, norm="axis")
    return g.df.select(*g.pick((F.round("re", 6) + 0.0).alias("re"), (F.abs(F.round("im", 6)) + 0.0).alias("im")))


@_query("dft_kernel", "SELECT CAST(0 AS BIGINT) AS tid, CAST(a AS INTEGER) AS i0, CAST(b AS INTEGER) AS i1, round(cos(2*pi()*(a*3/8.0 + b*2/6.0)), 6) + 0.0 AS re, round(sin(2*pi()*(a*3/8.0 + b*2/6.0)), 6) + 0.0 AS im FROM range(8) t(a), range(6) u(b)")
def _(spark, d):
    re, im = (f(spark, (8, 6), (3, 2)).df for f in (fourier.dft_kernel_real, fourier.dft_kernel_imag))
    pair = re.withColumnRenamed("v", "re").join(im.withColumnRenamed("v", "im"), ["tid", "i0", "i1"])
    return pair.select("tid", "i0", "i1", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])


# ---- graphs
def _moves(spark: SparkSession, d: str) -> DataFrame:
    """From each event type to the user's next one."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null")


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _talk(spark: SparkSession, d: str) -> DataFrame:
    """From each turn of a conversation to the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, d, "conversations").select("conv_id", "turn").distinct()
    here, then = F.col("conv_id") * 1000000 + F.col("turn"), F.col("conv_id") * 1000000 + F.lead("turn").over(w)
    return c.select(here.alias("src"), then.alias("dst")).filter("dst is not null")


_MOVES = "e AS (SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
_SUPPLY = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
_TALK = "c AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT * FROM (SELECT conv_id, conv_id*1000000 + turn AS src, conv_id*1000000 + lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM c) WHERE dst IS NOT NULL)"
_ENDS = "SELECT v, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS v, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY v"
_query("graph_degrees", f"WITH {_SUPPLY} {_ENDS}")(lambda s, d: graph.degrees(_supply(s, d)))
_query("graph_neighbors", f"WITH {_SUPPLY} SELECT DISTINCT src, dst FROM e")(lambda s, d: graph.neighbors(_supply(s, d)))
_query("graph_components", f"WITH {_TALK}, f AS (SELECT conv_id, min(src) AS component FROM e GROUP BY conv_id) SELECT DISTINCT v, component FROM (SELECT src AS v, conv_id FROM e UNION SELECT dst, conv_id FROM e) JOIN f USING (conv_id)")(lambda s, d: graph.components(_talk(s, d)))
_query(
    "graph_counts",
    f"""WITH {_TALK}, n AS (SELECT (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e)) AS vertices, count(*) AS edges, count(DISTINCT conv_id) AS components FROM e)
SELECT vertices, edges, components, vertices - edges + components AS euler_characteristic, edges - vertices + components AS cycle_rank, components <= 1 AS is_connected FROM n""",
)(lambda s, d: graph.counts_table(_talk(s, d)))
_query("graph_levels", f"WITH {_TALK} SELECT v, row_number() OVER (PARTITION BY conv_id ORDER BY v) - 1 AS level FROM (SELECT src AS v, conv_id FROM e UNION SELECT dst, conv_id FROM e)")(lambda s, d: graph.path_levels(_talk(s, d)))
_query("graph_topological", f"WITH {_TALK} SELECT v, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY v) - 1 AS INTEGER) AS level FROM (SELECT src AS v, conv_id FROM e UNION SELECT dst, conv_id FROM e)")(lambda s, d: graph.topological_levels(_talk(s, d)))
_query(
    "graph_distances",
    f"WITH RECURSIVE {_SUPPLY}, u AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT 's1' AS v, 0 AS dist UNION SELECT u.b, dist + 1 FROM r JOIN u ON u.a = r.v WHERE dist < 8) SELECT v, min(dist) AS dist FROM r GROUP BY v",
)(lambda s, d: graph.distances(_both(_supply(s, d)), "s1").select("v", "dist"))
_CLOSURE = "t AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT src, dst FROM t UNION SELECT r.src, t.dst FROM r JOIN t ON t.src = r.dst)"
_query("graph_strong_components", f"WITH RECURSIVE {_MOVES}, {_CLOSURE}, v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT v, least(v, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = v.v), v)) AS component FROM v")(lambda s, d: graph.strong_components(_moves(s, d)))
_query("graph_strong_talk", f"WITH {_TALK} SELECT DISTINCT v, v AS component FROM (SELECT src AS v FROM e UNION SELECT dst FROM e)")(lambda s, d: graph.strong_components(_talk(s, d)))
_query(
    "graph_euler_tests",
    f"""WITH RECURSIVE {_MOVES}, d AS (SELECT out_degree - in_degree AS x FROM ({_ENDS})), u AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT a AS v, a AS w FROM u UNION SELECT r.v, u.b FROM r JOIN u ON u.a = r.w), k AS (SELECT count(DISTINCT m) AS n FROM (SELECT v, min(w) AS m FROM r GROUP BY v)),
q AS (SELECT count(*) FILTER (x <> 0) AS odd, count(*) FILTER (x = 1) AS s, count(*) FILTER (x = -1) AS t FROM d)
SELECT n <= 1 AND odd = 0 AS has_circuit, n <= 1 AND (odd = 0 OR (odd = 2 AND s = 1 AND t = 1)) AS has_path FROM q, k""",
)(lambda s, d: graph.euler_tests(_moves(s, d)))


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


# ---- beliefs and rules
def _binds(spark: SparkSession, d: str) -> DataFrame:
    m = _moves(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    n = m.groupBy("src").agg(F.sum("n").alias("all"))
    rows = m.join(n, "src").select(F.col("dst").alias("outcome"), F.col("src").alias("condition"), (F.col("n") / F.col("all")).alias("p"), F.row_number().over(Window.orderBy("src", "dst")).cast("bigint").alias("seq"))  # pairs of event types, a handful
    return belief.bind(rows)


_BINDS = f"{_MOVES}, b AS (SELECT dst AS outcome, src AS condition, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM e GROUP BY src, dst)"
_query("prob_exact", f"WITH {_BINDS}, v AS (SELECT DISTINCT src AS v FROM e) SELECT x.v AS outcome, y.v AS condition, round(CASE WHEN x.v = y.v THEN 1.0 ELSE p END, 6) AS p FROM v x, v y LEFT JOIN b ON b.outcome = x.v AND b.condition = y.v")(lambda s, d: belief.exact(_binds(s, d), _all_pairs(s, d)).select("outcome", "condition", F.round("p", 6).alias("p")))


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of event types, a fixed handful."""
    kinds = _moves(spark, d).select(F.col("src").alias("k")).distinct().agg(F.collect_set("k").alias("k"))
    return kinds.select(F.explode("k").alias("outcome"), "k").select("outcome", F.explode("k").alias("condition"))


@_query("prob_chain", f"WITH {_BINDS}, m AS (SELECT min(src) AS c FROM e) SELECT outcome, 1 AS dist, round(p, 6) AS p FROM b, m WHERE condition = c AND outcome <> c UNION ALL SELECT c, 0, 1.0 FROM m")
def _(spark, d):
    first = _moves(spark, d).agg(F.min("src")).first()[0]
    return belief.chain(_binds(spark, d), first).select("outcome", "dist", F.round("p", 6).alias("p"))


@_query("prob_union", f"""WITH {_BINDS}, v AS (SELECT DISTINCT src AS v FROM e), q AS (SELECT x.v AS outcome, y.v AS condition, CASE WHEN x.v = y.v THEN 1.0 ELSE coalesce(p, 0) END AS p FROM v x, v y LEFT JOIN b ON b.outcome = x.v AND b.condition = y.v)
SELECT x.outcome AS a, y.outcome AS b, x.condition AS c, round(x.p + y.p - z.p * y.p, 6) AS p FROM q x JOIN q y ON y.condition = x.condition JOIN q z ON z.outcome = x.outcome AND z.condition = y.outcome""")
def _(spark, d):
    pairs = _all_pairs(spark, d).withColumnRenamed("outcome", "a").withColumnRenamed("condition", "b")
    third = _all_pairs(spark, d).select(F.col("outcome").alias("a"), F.col("condition").alias("c"))
    return belief.unions(_binds(spark, d), pairs.join(third, "a")).select("a", "b", "c", F.round("p", 6).alias("p"))


@_query("prob_bayes", f"""WITH {_BINDS}, o AS (SELECT condition AS c, min(n) AS k FROM (SELECT condition, row_number() OVER (ORDER BY condition, outcome) AS n FROM b) GROUP BY condition),
v AS (SELECT DISTINCT src AS v FROM e), t AS (SELECT ba.condition AS outcome, ba.outcome AS condition, arg_min(ba.p * ac.p / bc.p, k) AS p
  FROM b ba JOIN b ac ON ac.outcome = ba.condition JOIN b bc ON bc.outcome = ba.outcome AND bc.condition = ac.condition JOIN o ON o.c = ac.condition
  WHERE bc.p <> 0 AND ac.condition <> ba.condition AND ac.condition <> ba.outcome GROUP BY ALL)
SELECT x.v AS outcome, y.v AS condition, round(t.p, 6) AS p FROM v x JOIN v y ON x.v <> y.v LEFT JOIN t ON t.outcome = x.v AND t.condition = y.v""")
def _(spark, d):
    return belief.bayes(_binds(spark, d), _all_pairs(spark, d).filter("outcome <> condition")).select("outcome", "condition", F.round("p", 6).alias("p"))


_RULES = "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@_query("logic_consequences", f"WITH RECURSIVE {_RULES}, r AS (SELECT 'c1' AS result, 0 AS steps UNION SELECT e.dst, steps + 1 FROM r JOIN e ON e.src = r.result) SELECT result, min(steps) AS steps FROM r GROUP BY result")
def _(spark, d):
    c = _table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("reason"), F.concat(F.lit("n"), "c_nationkey").alias("result"))
    n = _table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("reason"), F.concat(F.lit("r"), "n_regionkey").alias("result"))
    return belief.consequences(c.unionByName(n), "c1")


@_query("store_fold", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    return memory.fold(_table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


def queries() -> dict[str, Query]:
    from gridloom.plans import catalog_more  # noqa: F401  it adds to the two tables

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
