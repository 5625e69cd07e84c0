"""More named queries: constructors, files, shells, draws, beliefs, rules, memories, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.combine import python_combiner
from gridloom.grid import Grid, create_void, flatten, from_nested, from_packed, infer_shape, matrix
from gridloom.operators import arith, belief, fourier, graph, memory, regions, sampling, stats, windows
from gridloom.plans import control, diagnostics, shells
from gridloom.plans.catalog import _DFT, _S1, _S2, _both, _events, _moves, _MOVES, _out, _query, _supply, _SUPPLY, _table, _talk, _TALK, _vectors, _passive1
from gridloom.sources import files, images
from gridloom.sources.database import DatabaseMemory, sql
from gridloom.sources.transport import command, pipe
from gridloom.streaming.monitor import Monitor, Trigger

# ---- constructors, shapes, buffers
_SHAPES = [("scalar", 3.5), ("text", "abc"), ("empty", []), ("row", [1, 2, 3]), ("table", [[1, 2, 3], [4, 5, 6]]), ("cube", [[[0.0] * 4] * 3] * 2), ("bytes", b"12")]
_PACKED = "s AS (SELECT vec_id AS tid, CAST(k // 8 AS INTEGER) AS i0, CAST(k % 8 AS INTEGER) AS i1, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(k))"


@_query("infer_shape", "SELECT * FROM (VALUES ('scalar', NULL), ('text', NULL), ('empty', '0'), ('row', '3'), ('table', '2x3'), ('cube', '2x3x4'), ('bytes', NULL)) t(what, shape)")
def _(spark, d):
    rows = [(what, None if (s := infer_shape(x)) is None else "x".join(map(str, s))) for what, x in _SHAPES]
    return spark.createDataFrame(rows, "what string, shape string")


def _packed(spark: SparkSession, d: str) -> Grid:
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("vals"))
    return from_packed(e, (8, 8))


_query("from_packed", f"WITH {_PACKED} SELECT tid, i0, i1, round(v, 6) AS v FROM s")(lambda s, d: _out(_packed(s, d)))
_query("buffer_roundtrip", f"WITH {_PACKED} SELECT tid, i0, i1, round(v, 6) AS v FROM s")(lambda s, d: _out(files.decode_buffers(files.encode_buffers(_packed(s, d)), "data", "d", (8, 8))))
_query("buffer_bytes", f"WITH {_PACKED} SELECT tid, i0, i1, CAST(floor(128 + 100 * v) AS DOUBLE) AS v FROM s")(
    lambda s, d: _out(files.decode_buffers(files.encode_buffers((lambda g: g.with_df(g.df.withColumn("v", F.floor(128 + 100 * F.col("v")).cast("double"))))(_packed(s, d)), "B"), "data", "B", (8, 8)))
)
_query("assign_flat", f"WITH {_S2} SELECT tid, i0, i1, round(CASE WHEN i0 IN (2, 5) AND i1 IN (1, 2, 3) THEN (i0 - 2) // 3 * 3 + i1 ELSE v END, 6) AS v FROM s")(
    lambda s, d: _out(regions.assign(_vectors(s, d), [1, 2, 3, 4, 5, 6], (2, 1), (2, 3), (3, 1)))
)
_query("sized_array", "SELECT k AS n, CASE WHEN k >= 3 AND k - 3 < 25 THEN CAST(n_regionkey AS DOUBLE) ELSE 0.0 END AS v FROM range(40) t(k) LEFT JOIN nation ON n_nationkey = k - 3")(
    lambda s, d: files.sized_array(_table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("double").alias("v")), 40, 3)
)
_query("void_of_ones", "SELECT CAST(0 AS BIGINT) AS tid, CAST(n // 5 AS INTEGER) AS i0, CAST(n % 5 AS INTEGER) AS i1, 1.0 AS v FROM range(35) t(n)")(lambda s, d: create_void(s, (7, 5), 1.0).df)
_query("flatten_nested", "SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS DOUBLE) AS v FROM range(24) t(n)")(
    lambda s, d: s.createDataFrame(list(enumerate(flatten([[[(12 * a + 4 * b + c) ** 2 for c in range(4)] for b in range(3)] for a in range(2)]))), "n bigint, v double")
)


# ---- metadata, order, operators
@_query("grid_facts", "SELECT 2 AS rank, count(*) * 64 AS size, count(*) AS length, '64' AS columns FROM embeddings")
def _(spark, d):
    g = _vectors(spark, d).check_dense()
    return spark.createDataFrame([(g.rank, g.size, len(g), str(g.shape[1]))], "rank int, size bigint, length bigint, columns string")


@_query("rows_in_order", f"WITH {_S2} SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS n, round(v, 6) AS v FROM s WHERE i0 IN (4, 6, 8) AND i1 BETWEEN 10 AND 14")
def _(spark, d):
    part = regions.load(_vectors(spark, d), (4, 10), (3, 5), (2, 1))
    return spark.createDataFrame(list(enumerate(part.rows())), "n bigint, v double").select("n", F.round("v", 6).alias("v"))


@_query("default_entries", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'none') AS name FROM nation")
def _(spark, d):
    n = _table(spark, d, "nation")
    table = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("name"), F.col("n_name"))).otherwise(F.create_map(F.lit("other"), F.col("n_name")))
    return n.withColumn("m", table).select("n_nationkey", regions.get_default("m", "name", "none").alias("name"))


@_query("in_place", f"WITH {_S2} SELECT tid, i0, i1, round(pow((v + 1.5) * 2.0 - 0.25, 2) / 4.0, 6) AS v FROM s")
def _(spark, d):
    g = _vectors(spark, d)
    g += 1.5
    g *= 2.0
    g -= 0.25
    g **= 2
    g /= 4.0
    return _out(g)


_query("reflected", f"WITH {_S2} SELECT tid, i0, i1, round(-(1.0 / (2.0 - v)), 6) AS v FROM s")(lambda s, d: _out(-(1.0 / (2.0 - _vectors(s, d)))))
_query("sqrt_nan", f"WITH {_S2} SELECT tid, i0, i1, CASE WHEN v < 0 THEN -1.0 ELSE round(sqrt(v), 6) END AS v FROM s")(
    lambda s, d: _out((lambda g: g.with_df(g.df.withColumn("v", F.when(F.col("v").eqNullSafe(F.lit(arith.NAN)), F.lit(-1.0)).otherwise(F.col("v")))))(arith.sqrt(_vectors(s, d))))
)
_query("reduce_max", "SELECT vec_id, round(list_max(CAST(embedding AS DOUBLE[])), 6) AS v FROM embeddings")(
    lambda s, d: _table(s, d, "embeddings").select("vec_id", F.round(stats.reduce("embedding", F.lit(float("-inf")), lambda a, x: F.greatest(a, x.cast("double"))), 6).alias("v"))
)
_query("view_mean", f"WITH {_S2} SELECT tid, round(avg(CASE WHEN i0 = 9 THEN 0.0 ELSE v END), 6) AS v FROM s WHERE i0 IN (5, 7, 9) AND i1 < 60 GROUP BY tid")(
    lambda s, d: stats.mean(regions.assign(regions.slice_view(_vectors(s, d), slice(5, 10, 2), slice(0, 60)), 0.0, (2, 0), (1, 60))).select("tid", F.round("v", 6).alias("v"))
)

# ---- windows: shells, hooks, own combiners
_RAW1 = _passive1().replace("round(CASE", "(CASE").replace(", 6) + 0.0 AS v", ") AS v")
_query("receptor_point", f"WITH {_S2} SELECT tid, round(v, 6) AS v FROM s WHERE i0 = 3 AND i1 = 4")(lambda s, d: shells.Receptor(_vectors(s, d)).point((3, 4)).select("tid", F.round("v", 6).alias("v")))
_query("receptor_passive", _passive1("cos"))(lambda s, d: _out(shells.Receptor(_events(s, d)).passive(3, algorithm="cos")))
_query("generator_steps", f"WITH {_S2} SELECT tid, i0, i1, round(-(CASE WHEN i0 = 1 AND i1 = 2 THEN 9.0 ELSE v END), 6) AS v FROM s")(lambda s, d: _out(shells.Generator(_vectors(s, d)).set_point((1, 2), 9.0).generate(arith.neg).grid))
_query("transform_hook", _passive1("mod"))(lambda s, d: _out(_events(s, d).transform(windows.passive, 3, algorithm="mod")))
_query("python_combiner", _passive1("convolution").replace("round(ab, 6)", "round(ab - a / 2, 6)"))(lambda s, d: _out(windows.passive(_events(s, d), 3, algorithm=python_combiner(lambda a, b, ab: ab - a / 2))))
_query("column_combiner", _passive1("convolution").replace("round(ab, 6)", "round(a + b - 2 * ab, 6)"))(lambda s, d: _out(windows.passive(_events(s, d), 3, algorithm=lambda a, b, ab: a + b - 2 * ab)))

# ---- images
_PIXELS = "p AS (SELECT vec_id, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, CAST(floor(128 + 100 * CAST(embedding[k + 1] AS DOUBLE)) AS DOUBLE) AS v FROM embeddings, range(64) t(k) WHERE vec_id < 100)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    g = _packed(spark, d).df.filter("tid < 100")  # a region of the table: images are made of it
    return g.select(F.col("tid").cast("string").alias("path"), F.col("i0").alias("y"), F.col("i1").alias("x"), F.lit(0).alias("c"), F.floor(128 + 100 * F.col("v")).cast("double").alias("v"))


for _kind in ("pnm", "png"):
    _query(f"image_{_kind}", f"WITH {_PIXELS} SELECT CAST(vec_id AS VARCHAR) AS path, y, x, 0 AS c, v FROM p")(lambda s, d, k=_kind: images.decode_images(images.write_images(_images(s, d), k)))
_query("image_ps", f"WITH {_PIXELS} SELECT CAST(vec_id AS VARCHAR) AS path, '%!PS-Adobe-3.0' AS first FROM p GROUP BY ALL")(lambda s, d: images.write_images(_images(s, d), "ps").select("path", F.substring_index(F.decode("content", "UTF-8"), "\n", 1).alias("first")))
_query("luma", f"WITH {_PIXELS} SELECT vec_id, y, x, CAST(floor(0.299 * v + 0.587 * (255 - v) + 0.114 * 7) AS INTEGER) AS v FROM p")(
    lambda s, d: _images(s, d).select(F.col("path").cast("bigint").alias("vec_id"), "y", "x", images.luma(F.col("v"), 255 - F.col("v"), F.lit(7)).alias("v"))
)
_T = "greatest(0.0, least(1.0, v / 256))"
_query(
    "jet_colours",
    f"""WITH {_PIXELS}, t AS (SELECT vec_id, y, x, {_T} AS t FROM p)
SELECT vec_id, y, x, CAST(floor(255 * CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN (t - 0.5) * 4 ELSE 1 END) AS INTEGER) AS r,
CAST(floor(255 * CASE WHEN t < 0.25 THEN t * 4 WHEN t < 0.75 THEN 1 ELSE (1 - t) * 4 END) AS INTEGER) AS g, CAST(floor(255 * CASE WHEN t < 0.25 THEN 1 WHEN t < 0.5 THEN (0.5 - t) * 4 ELSE 0 END) AS INTEGER) AS b FROM t""",
)(lambda s, d: _images(s, d).select(F.col("path").cast("bigint").alias("vec_id"), "y", "x", images.jet(F.col("v") / 256).alias("c")).select("vec_id", "y", "x", "c.r", "c.g", "c.b"))


# ---- databases, processes, calls
@_query("database_rows", "SELECT n_regionkey, count(*) AS nations, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def _(spark, d):
    db = DatabaseMemory(spark)
    db.execute("create table nation (key int, name text, region int)")
    db.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    db.commit()
    db.execute("delete from nation")
    db.rollback()
    out = db.table("select region, count(*), min(name) from nation group by region", "n_regionkey int, nations bigint, first string")
    db.close()
    return out


_query("sql_over_tables", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")(
    lambda s, d: sql(s, "SELECT r_name, count(*) AS n FROM {n} JOIN {r} ON n_regionkey = r_regionkey GROUP BY r_name", n=_table(s, d, "nation"), r=_table(s, d, "region"))
)
_query("pipe_lines", "SELECT upper(n_name) AS line FROM nation")(lambda s, d: pipe(_table(s, d, "nation").select("n_name"), "tr a-z A-Z"))


@_query("command_output", "SELECT 0 AS code, CAST(sum(length(r_name) + 1) AS BIGINT) AS bytes FROM region")
def _(spark, d):
    names = [r[0] for r in _table(spark, d, "region").select("r_name").collect()]  # five rows
    code, out, _ = command(["cat"], "".join(n + "\n" for n in names).encode())
    return spark.createDataFrame([(code, len(out))], "code int, bytes bigint")


_query("call_column", "SELECT n_nationkey, CAST(gcd(n_nationkey, 12) AS BIGINT) AS v FROM nation")(lambda s, d: _table(s, d, "nation").select("n_nationkey", shells.Calls("math").column("gcd", "bigint", "n_nationkey", F.lit(12)).alias("v")))


@_query("nested_contexts", "SELECT * FROM (VALUES (0, 'in a'), (1, 'in b'), (2, 'out b'), (3, 'out a')) t(n, said)")
def _(spark, d):
    said = []

    class Named:
        def __init__(self, name):
            self.name = name

        def __enter__(self):
            said.append(f"in {self.name}")
            return self

        def __exit__(self, *_):
            said.append(f"out {self.name}")

    with shells.contexts(Named("a"), Named("b")):
        pass
    return spark.createDataFrame(list(enumerate(said)), "n int, said string")


@_query("probes", "SELECT 'calls' AS what, count(*) AS n FROM region UNION ALL SELECT 'errors', count(*) FILTER (r_regionkey = 0) FROM region UNION ALL SELECT 'traced', count(*) FROM region UNION ALL SELECT 'grew', 1")
def _(spark, d):
    watch, trace, times = shells.ErrorWatcher(keep=True), shells.TraceProbe(), {}
    divide, half = watch.watch(lambda x: 1 / x), trace.trace(lambda x: x / 2)
    with shells.MemoryProbe() as probe, diagnostics.timed(times, "loop"):
        kept = [bytearray(10_000) for _ in range(10)]
        for r in _table(spark, d, "region").collect():
            divide(r["r_regionkey"])
            half(r["r_regionkey"])
    n = {k: sum(v for (_, kind), v in watch.stats.items() if (kind == "calls") == (k == "calls")) for k in ("calls", "errors")}
    grew = int(probe.grown >= 100_000 and len(kept) == 10 and times["loop"] > 0)
    return spark.createDataFrame([("calls", n["calls"]), ("errors", n["errors"]), ("traced", len(trace.calls)), ("grew", grew)], "what string, n bigint")


@_query("observed_counts", "SELECT count(*) AS rows, round(sum(value), 4) AS total FROM events")
def _(spark, d):
    df, watch = diagnostics.observed(_table(spark, d, "events"), "events", F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))
    df.write.format("noop").mode("overwrite").save()
    got = watch.get
    return spark.createDataFrame([(got["rows"], round(got["total"], 4))], "rows bigint, total double")


# ---- control
@_query("control_flow", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey >= 0 THEN (n_nationkey + 1) * 8 END AS BIGINT) AS v FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, d):
    n = _table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("bigint").alias("v"))
    plus = lambda df: df.withColumn("v", F.col("v") + 1)
    twice = lambda state: (state[0] + 1, state[1].withColumn("v", F.col("v") * 2))
    odd = control.Branch((lambda df: "w" in df.columns, lambda df: df.drop("w")), otherwise=lambda df: df.filter("n_nationkey % 2 = 1"))
    loop = control.Loop(lambda state: True, twice, until=lambda state: state[0] == 3)
    return control.compose(control.Sequence(plus, odd), lambda df: loop((0, df))[1])(n)


@_query("call_all", "SELECT * FROM (SELECT 0 AS n, count(*) AS rows, FALSE AS failed FROM nation UNION ALL SELECT 1, count(*), FALSE FROM region UNION ALL SELECT 2, -1, TRUE)")
def _(spark, d):
    out, errors = control.call_all([lambda t=t: _table(spark, d, t).count() for t in ("nation", "region", "nothing")])
    return spark.createDataFrame([(k, -1 if n is None else n, e is not None) for k, (n, e) in enumerate(zip(out, errors))], "n int, rows bigint, failed boolean")


# ---- Fourier, with the default scaling
_query("idft_default", f"WITH {_S2} SELECT tid, i0, i1, round(v / (SELECT count(*) FROM embeddings), 8) + 0.0 AS re FROM s")(
    lambda s, d: (lambda g: g.df.select(*g.pick((F.round("re", 8) + 0.0).alias("re"))))(fourier.idft(fourier.dft(_vectors(s, d), 1), 1))
)
_query("idft_frequencies", f"WITH {_S2}, {_DFT.replace('-sum(v * sin', 'sum(v * sin')} SELECT tid, i0, CAST(k AS INTEGER) AS i1, round(re / 64, 6) + 0.0 AS re, round(im / 64, 6) + 0.0 AS im FROM p")(
    lambda s, d: (lambda g: g.df.select(*g.pick(*[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])))(fourier.idft(_vectors(s, d), 1, norm="axis"))
)

# ---- graphs
_query("euler_of_cells", "SELECT 8 - 12 + 6 AS cube, 4 - 6 + 4 - 1 AS simplex")(lambda s, d: s.createDataFrame([(graph.euler_characteristic_of_cells([8, 12, 6]), graph.euler_characteristic_of_cells([4, 6, 4, 1]))], "cube int, simplex int"))
_query("neighbours_of_one", f"WITH {_SUPPLY} SELECT DISTINCT src, dst FROM e WHERE src = 's1'")(lambda s, d: graph.neighbors(_supply(s, d), "s1"))


@_query("graph_reachable", f"WITH {_TALK}, b AS (SELECT min(conv_id) AS c, max(conv_id) AS z FROM e) SELECT w AS what, CASE w WHEN 'down' THEN TRUE WHEN 'self' THEN TRUE ELSE FALSE END AS yes FROM b, (VALUES ('down'), ('up'), ('across'), ('self')) t(w)")
def _(spark, d):
    e = _talk(spark, d)
    first, last, other = e.agg(F.min("src"), F.min_by("dst", F.struct(F.floor(F.col("src") / 1000000), -F.col("src"))), F.max("dst")).first()
    asked = {"down": (first, last), "up": (last, first), "across": (first, other), "self": (first, first)}
    return spark.createDataFrame([(k, graph.reachable(e, *v)) for k, v in asked.items()], "what string, yes boolean")


@_query("graph_path", f"WITH {_TALK}, b AS (SELECT min(conv_id) AS c FROM e), v AS (SELECT src AS v, conv_id FROM e UNION SELECT dst, conv_id FROM e) SELECT row_number() OVER (ORDER BY v) - 1 AS n, v FROM v, b WHERE conv_id = c")
def _(spark, d):
    e = _talk(spark, d)
    first, last = e.agg(F.min("src"), F.min_by("dst", F.struct(F.floor(F.col("src") / 1000000), -F.col("src")))).first()
    return spark.createDataFrame(list(enumerate(graph.shortest_path(e, first, last))), "n bigint, v bigint")


@_query("graph_dag", f"WITH {_TALK} SELECT TRUE AS talk, FALSE AS moves, count(DISTINCT v) AS sorted FROM (SELECT src AS v FROM e UNION SELECT dst FROM e)")
def _(spark, d):
    order = graph.topological_sort(_talk(spark, d))
    place = {v: k for k, v in enumerate(order)}
    sound = all(place[r["src"]] < place[r["dst"]] for r in _talk(spark, d).toLocalIterator())
    return spark.createDataFrame([(sound, graph.is_dag(_moves(spark, d)), len(order))], "talk boolean, moves boolean, sorted bigint")


# ---- beliefs: a customer's nation, a nation's region
def _places(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("outcome"), F.concat(F.lit("c"), "c_custkey").alias("condition"), (1 / (1 + F.col("c_custkey") % 7)).alias("p"), F.col("c_custkey").alias("seq"))
    n = _table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("outcome"), F.concat(F.lit("n"), "n_nationkey").alias("condition"), (1 / (2 + F.col("n_nationkey"))).alias("p"), F.col("n_nationkey").cast("bigint").alias("seq"))
    return belief.bind(c.unionByName(n))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("c"), "c_custkey")
    each = F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit("r0"), F.lit("r3"), c, F.lit("nowhere"))
    return _table(spark, d, "customer").filter("c_custkey <= 60").select(F.explode(each).alias("outcome"), c.alias("condition"))  # questions, not a part of the answer


_PN, _PR = "CAST(1 AS DOUBLE) / (1 + c_custkey % 7)", "CAST(1 AS DOUBLE) / (2 + n_nationkey)"
_ASKED = f"""q AS (SELECT c_custkey, c_nationkey, n_regionkey, {_PN} AS pn, {_PR} AS pr, 'c' || c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey <= 60),
a AS (SELECT 'n' || c_nationkey AS outcome, c AS condition, pn AS p, 'exact' AS how FROM q UNION ALL SELECT c, c, 1.0, 'same' FROM q UNION ALL SELECT 'nowhere', c, 0.0, 'none' FROM q
UNION ALL SELECT 'r' || r, c, CASE WHEN r = n_regionkey THEN pn * pr ELSE 0.0 END, CASE WHEN r = n_regionkey THEN 'chain' ELSE 'none' END FROM q, (VALUES (0), (3)) t(r))"""
_query("prob_resolved", f"WITH {_ASKED} SELECT outcome, condition, round(p, 9) AS p, how FROM a")(lambda s, d: belief.probabilities(_places(s, d), _asked(s, d)).select("outcome", "condition", F.round("p", 9).alias("p"), "how"))


@_query("belief_stats", f"WITH {_ASKED}, g AS (SELECT CASE how WHEN 'same' THEN 'hits' WHEN 'exact' THEN 'hits' WHEN 'none' THEN 'miss' ELSE how END AS what FROM a) SELECT what, count(*) AS n FROM g GROUP BY what UNION ALL SELECT 'adds', 2 UNION ALL SELECT 'bayes', 0")
def _(spark, d):
    b = belief.Beliefs(spark, _places(spark, d).withColumnRenamed("first", "seq"))
    b.add("elsewhere", "c1", 0.25)
    b.add("elsewhere", "c1", 0.5)
    b.ask(_asked(spark, d))
    return spark.createDataFrame(list(b.stats.items()), "what string, n bigint")


@_query("belief_context", "SELECT 'elsewhere' AS outcome, 'c1' AS condition, 0.5 AS p")
def _(spark, d):
    b = belief.Beliefs(spark)
    for outcome, p in (("elsewhere", 0.25), ("gone", 0.125), ("elsewhere", 0.5)):
        b.add(outcome, "c1", p)
    b.remove("gone", "c1")
    return b.binds().select("outcome", "condition", "p")


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation and customer, and the same with another region."""
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = _table(spark, d, "customer").filter("c_custkey <= 40").join(n, "c_nationkey")  # the questions
    region = F.explode(F.array(F.concat(F.lit("r"), "n_regionkey"), F.lit("r4"))).alias("a")
    return c.select(region, F.concat(F.lit("n"), "c_nationkey").alias("b"), F.concat(F.lit("c"), "c_custkey").alias("c"))


_TRIPLES = f"q AS (SELECT DISTINCT 'r' || r AS a, 'n' || c_nationkey AS b, 'c' || c_custkey AS c, {_PN} AS pbc, CASE WHEN r = n_regionkey THEN {_PR} ELSE 0.0 END AS pab FROM customer JOIN nation ON n_nationkey = c_nationkey, LATERAL (SELECT unnest([n_regionkey, 4]) AS r) WHERE c_custkey <= 40)"
_query("prob_intersections", f"WITH {_TRIPLES} SELECT a, b, c, round(pab * pbc, 9) AS p FROM q")(lambda s, d: belief.intersections(_places(s, d), _triples(s, d)).select("a", "b", "c", F.round("p", 9).alias("p")))
_query("prob_unions", f"WITH {_TRIPLES} SELECT a, b, c, round(pab * pbc + pbc - pab * pbc, 9) AS p FROM q")(lambda s, d: belief.unions(_places(s, d), _triples(s, d)).select("a", "b", "c", F.round("p", 9).alias("p")))
_query("prob_consistency", f'WITH {_TRIPLES} SELECT a, b, c, 0.0 AS "left", round(pab * pbc, 9) AS "right", pab * pbc = 0 AS consistent FROM q')(
    lambda s, d: belief.consistency(_places(s, d), _triples(s, d)).select("a", "b", "c", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"), "consistent")
)
_query("prob_unbind", f"SELECT 'c' || c_custkey AS condition, 'n' || c_nationkey AS outcome, round({_PN}, 9) AS p FROM customer WHERE c_custkey <> 1 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, round({_PR}, 9) FROM nation")(
    lambda s, d: belief.unbind(_places(s, d), [r["o"] for r in _table(s, d, "customer").filter("c_custkey = 1").select(F.concat(F.lit("n"), "c_nationkey").alias("o")).collect()][0], "c1").select("condition", "outcome", F.round("p", 9).alias("p"))
)
_query("joint_events", "SELECT * FROM (VALUES ('union(a,b)', 0.5), ('intersection(a,b)', 0.125)) t(outcome, p)")(
    lambda s, d: belief.bind(s.createDataFrame([(belief.event(k, *m), belief.GLOBAL, p, n) for n, (k, m, p) in enumerate([("union", "ab", 0.25), ("intersection", "ba", 0.125), ("union", "ba", 0.5)])], "outcome string, condition string, p double, seq bigint")).select("outcome", "p")
)


# ---- rules
def _rules(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("reason"), F.concat(F.lit("n"), "c_nationkey").alias("result"), F.lit(None).cast("string").alias("limit"), F.lit(belief.TRUE).alias("status"))
    n = _table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("reason"), F.concat(F.lit("r"), "n_regionkey").alias("result"), F.lit(None).cast("string").alias("limit"), (F.col("n_nationkey") % 4).cast("int").alias("status"))
    return c.unionByName(n)


@_query("logic_derivation", "SELECT 0 AS n, 'c1' AS reason, 'n' || c_nationkey AS result FROM customer WHERE c_custkey = 1 UNION ALL SELECT 1, 'n' || c_nationkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def _(spark, d):
    rules = _rules(spark, d)
    region = belief.consequences(rules, "c1").filter("steps = 2").first()["result"]
    return spark.createDataFrame([(k, r["reason"], r["result"]) for k, r in enumerate(belief.derivation(rules, "c1", region))], "n int, reason string, result string")


@_query("logic_derivable", "SELECT 'r' || r_regionkey AS result, r_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1) AS follows FROM region")
def _(spark, d):
    rules = _rules(spark, d)
    return spark.createDataFrame([(f"r{r[0]}", belief.derivable(rules, "c1", f"r{r[0]}")) for r in _table(spark, d, "region").select("r_regionkey").collect()], "result string, follows boolean")


_query("logic_flags", "SELECT 'n' || n_nationkey AS reason, 'r' || n_regionkey AS result FROM nation WHERE n_nationkey % 4 = 3")(lambda s, d: belief.with_status(_rules(s, d), belief.TRUE | belief.SURE).select("reason", "result"))


@_query("lookup", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey = 3 THEN 'three' WHEN c_nationkey < 20 THEN n_name END, 'none') AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    names = shells.Lookup(_table(spark, d, "nation").filter("n_nationkey < 20"), "n_nationkey", "n_name")
    names = names.put(spark.createDataFrame([(3, "three")], "key int, value string"))
    return names.get(_table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "none").select("c_custkey", "value")


# ---- memories
@_query("memory_commit", "SELECT event_type || '/' || user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    m = memory.MapMemory(spark)
    e = _table(spark, d, "events").select(F.array("event_type", F.col("user_id").cast("string")).alias("key"), "value", F.col("event_id").alias("seq"))
    m.save_all(e.filter("seq % 2 = 0"))
    m.commit()
    m.save(("gone", "0"), 1.0)
    m.rollback()
    # the second half is staged later; an earlier write of the first half must not come back
    m.save_all(e)
    m.commit()
    return m.items().select(F.concat_ws("/", "key").alias("key"), "value")


@_query("table_memory", "SELECT n_regionkey, n_name, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def _(spark, d):
    t = memory.MapMemory(spark)  # keys are paths
    for r in _table(spark, d, "nation").collect():  # 25 rows
        t.save((str(r["n_regionkey"]), r["n_name"]), r["n_nationkey"])
    t.commit()
    return t.items().select(F.col("key")[0].cast("int").alias("n_regionkey"), F.col("key")[1].alias("n_name"), "value")


@_query("memory_pool", "SELECT * FROM (VALUES ('deep', 1, 2.5), ('flat', 0, 1.5)) t(name, level, value)")
def _(spark, d):
    pool = memory.MemoryPool()
    for name, level, value in (("flat", 0, 1.5), ("deep", 1, 2.5)):
        pool.add(name, memory.MapMemory(spark), level)
        pool[name].save("k", value)
    pool.commit()
    return spark.createDataFrame([(n, at, pool[n].refer("k")) for at in (0, 1) for n in pool.level(at)], "name string, level int, value double")


# ---- monitors
@_query("monitor_hits", "SELECT * FROM (SELECT 'any' AS name, 3 AS hits, 0 AS errors UNION ALL SELECT 'broken', 0, 3 UNION ALL SELECT 'once', 1, 0 UNION ALL SELECT 'big', CAST(count(DISTINCT event_id % 3) AS INTEGER), 0 FROM events WHERE value > 100)")
def _(spark, d):
    m, e = Monitor(), _table(spark, d, "events")
    m.add_event("any", Trigger(lambda b: True, lambda b: b))
    m.add_event("once", Trigger(lambda b: True, lambda b: b), times=1)
    m.add_event("never", Trigger(lambda b: True, lambda b: b), times=0)
    m.add_event("broken", Trigger(lambda b: 1 / 0, lambda b: b))
    m.add_event("big", Trigger(lambda b: not b.filter("value > 100").isEmpty(), lambda b: b))
    for k in range(3):  # the batches that a stream would bring
        m.look(e.filter(F.col("event_id") % 3 == k))
    return spark.createDataFrame([(n, x.hits, x.errors) for n, x in {**m.events, **m.finished}.items()], "name string, hits int, errors int")


# ---- draws: md5 of seed and key, so that the database can draw the same
def _u(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0)"


_query("sample_rows", "SELECT c_custkey, c_nationkey FROM customer ORDER BY md5(concat_ws('|', 5, c_custkey, c_nationkey, 1)) LIMIT 20")(lambda s, d: sampling.sample(_table(s, d, "customer").select("c_custkey", "c_nationkey"), 20, 5))
_query("sample_of_repeats", "SELECT c_nationkey FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey) AS n FROM customer) ORDER BY md5(concat_ws('|', 9, c_nationkey, n)) LIMIT 40")(lambda s, d: sampling.sample(_table(s, d, "customer").select("c_nationkey"), 40, 9))
_query("shuffled", "SELECT row_number() OVER (ORDER BY md5(concat_ws('|', 3, n_nationkey, 1))) - 1 AS n, n_nationkey FROM nation")(
    lambda s, d: s.createDataFrame([(k, r[0]) for k, r in enumerate(sampling.shuffle(_table(s, d, "nation").select("n_nationkey"), 3).collect())], "n bigint, n_nationkey int")
)
_query(
    "weighted_choices",
    f"""WITH p AS (SELECT p_partkey, p_size, md5(concat_ws('|', 0, p_partkey, p_size, 1)) AS h FROM part), c AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY h) - p_size AS lo FROM p),
w AS (SELECT id AS draw, {_u(5, "id")} * (SELECT sum(p_size) FROM part) AS u FROM range(200) t(id)) SELECT draw, p_partkey FROM w ASOF JOIN c ON u >= lo""",
)(lambda s, d: sampling.weighted_choices(_table(s, d, "part").select("p_partkey", "p_size"), "p_size", 200, 5, unique=True).select("draw", "p_partkey"))
_query(
    "random_columns",
    f"""SELECT c_custkey, {_u(1, "c_custkey")} AS u, CAST(floor({_u(2, "c_custkey")} * 6) + 1 AS BIGINT) AS die, CASE WHEN {_u(3, "c_custkey")} * 4.0 < 3 THEN 'a' ELSE 'b' END AS pick,
['x', 'y', 'z'][CAST(floor({_u(4, "c_custkey")} * 3) AS INTEGER) + 1] AS letter, CAST(10 - 3 * floor({_u(6, "c_custkey")} * 4) AS BIGINT) AS step FROM customer""",
)(
    lambda s, d: _table(s, d, "customer").select(
        "c_custkey", sampling.uniform(1, "c_custkey").alias("u"), sampling.randint(2, "c_custkey", low=1, high=6).alias("die"), sampling.choices(3, "c_custkey", values=["a", "b"], weights=[3, 1]).alias("pick"),
        sampling.choice(4, "c_custkey", values=["x", "y", "z"]).alias("letter"), sampling.randrange(6, "c_custkey", start=10, stop=0, step=-3).cast("bigint").alias("step"),
    )
)
