import struct
import time

import numpy as np
import pytest

from gridloom.grid import from_nested
from gridloom.operators.windows import passive
from gridloom.plans import control
from gridloom.sources import database, files, images, signals, transport
from gridloom.streaming import monitor


def test_files_and_buffers(spark, tmp_path):
    g = from_nested(spark, [[1.0, 2], [3, 4]])
    files.write_grid(g, str(tmp_path / "g"))
    assert files.read_grid(spark, str(tmp_path / "g"), 2, (2, 2)).rows() == [1, 2, 3, 4]
    df = spark.createDataFrame([(0, struct.pack("4h", 1, -2, 3, 4)), (1, struct.pack("4h", 5, 6, 7, 8))], "tid bigint, data binary")
    assert files.decode_buffers(df, "data", "h", (2, 2)).rows() == [1, -2, 3, 4, 5, 6, 7, 8]
    with pytest.raises(ValueError):
        files.decode_buffers(df, "data", "x", (4,))
    assert bytes(files.encode_buffers(from_nested(spark, [1, 2, 300.9]), "B").first()["data"]) == bytes([1, 2, 44])
    assert bytes(files.encode_buffers(g).first()["data"]) == struct.pack("4d", 1, 2, 3, 4)
    v = spark.createDataFrame([(0, 5.0), (1, 6.0), (2, 7.0)], "n bigint, v double")
    assert [r["v"] for r in files.sized_array(v, 4, 2).orderBy("n").collect()] == [0, 0, 5, 6]


def test_images(spark, tmp_path):
    p = np.arange(24).reshape(2, 4, 3)
    made = {"a.ppm": images.encode_pnm(p), "b.pgm": b"P2 # note\n2 2\n9\n1 2\n3 4\n", "c.pbm": b"P1\n3 1\n1 0\n1", "d.pbm": b"P4\n9 1\n" + bytes([0b10000000, 0b10000000]), "e.ppm": b"P3\n1 1\n255\n7 8 9", "f.pgm": b"P5\n2 1\n255\n\x05\xff"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = images.read_images(spark, str(tmp_path))
    by = {}
    for r in rows.orderBy("path", "y", "x", "c").collect():
        by.setdefault(r["path"][-5:], []).append(r["v"])
    assert by["a.ppm"] == list(range(24)) and by["b.pgm"] == [1, 2, 3, 4] and by["c.pbm"] == [1, 0, 1]
    assert by["d.pbm"] == [1, 0, 0, 0, 0, 0, 0, 0, 1] and by["e.ppm"] == [7, 8, 9] and by["f.pgm"] == [5, 255]
    back = images.write_images(rows.filter("path like '%a.ppm'")).first()
    assert bytes(back["content"]) == made["a.ppm"]
    with pytest.raises(ValueError):
        images.decode_pnm(b"P5\n9 9\n255\nshort")


def test_signals(spark):
    df = spark.createDataFrame([(1, k * 3, float(k)) for k in range(50)] + [(2, 7, 1.0)], "u bigint, o bigint, x double")
    g = signals.signal(df, "u", "o", "x", width=10)
    assert [(r["tid"], r["i0"], r["v"]) for r in g.df.orderBy("tid", "i0").collect()] == [(1, k, float(k)) for k in range(50)] + [(2, 0, 1.0)]
    assert signals.head(g, 20).df.count() == 20


def test_database_and_processes(spark):
    db = database.DatabaseMemory(spark)
    db.execute("create table t (a integer, b text)")
    db.executemany("insert into t values (?, ?)", [(1, "x"), (2, "y")])
    db.commit()
    db.execute("delete from t")
    db.rollback()
    t = db.table("select a, b from t order by a", "a bigint, b string")
    assert t.count() == 2 and database.sql(spark, "select sum(a) as s from {t}", t=t).first()["s"] == 3
    db.close()
    assert transport.command(["cat"], b"hello")[:2] == (0, b"hello")
    assert sorted(r["line"] for r in transport.pipe(spark.range(3).selectExpr("cast(id as string)"), "cat").collect()) == ["0", "1", "2"]


def test_control():
    double, more = (lambda v: v * 2), (lambda v: v + 1)
    assert control.compose(double, more)(3) == 7
    assert control.Branch((lambda v: v > 5, double), otherwise=more)(3) == 4
    assert control.Loop(lambda v: v < 20, double)(3) == 24 and control.Loop(lambda v: True, more, until=lambda v: v == 9)(3) == 9
    results, errors = control.call_all([lambda: 1, lambda: 1 / 0, lambda: 3])
    assert results == [1, None, 3] and isinstance(errors[1], ZeroDivisionError)


def test_monitor(spark, tmp_path):
    seen = monitor.Monitor()
    hit = monitor.Trigger(lambda b: b.count() > 0, lambda b: b.count())
    bad = monitor.Trigger(lambda b: 1 / 0, lambda b: None)
    seen.add_event("rows", hit, times=2)
    seen.add_event("bad", bad)
    seen.add_event("never", hit, times=0)
    assert set(seen.events) == {"rows", "bad"}
    query = seen.watch(monitor.ticks(spark, 50), "200 milliseconds", checkpointLocation=str(tmp_path / "c"))
    end = time.monotonic() + 60
    while "rows" in seen.events and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()
    assert seen.finished["rows"].hits == 2 and seen.events["bad"].errors >= 2


def test_passive_stream_equals_batch(spark, tmp_path):
    rows = [(t, n, float((n * 7 + t) % 5)) for t in (1, 2) for n in range(30)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], "tid bigint, n bigint, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples = spark.readStream.schema("tid bigint, n bigint, v double").parquet(str(tmp_path / "in"))
    query = monitor.passive_stream(samples, 3, 2).writeStream.format("memory").queryName("similar").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["tid"], r["i0"]): round(r["v"], 9) for r in spark.table("similar").collect()}
    for t in (1, 2):
        batch = passive(from_nested(spark, [v for k, _, v in rows if k == t]), 3, d=2)
        assert {k: v for k, v in got.items() if k[0] == t} == {(t, r["i0"]): round(r["v"], 9) for r in batch.df.collect()}
