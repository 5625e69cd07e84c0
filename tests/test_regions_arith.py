import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.functions.threshold import threshold_judge
from gridloom.grid import create_void, from_nested, from_packed, infer_shape, to_packed
from gridloom.operators import arith, fourier, regions, stats


def test_regions(spark):
    g = from_nested(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert regions.load(g, step=(2, 2)).rows() == [1, 3, 7, 9]
    assert regions.load(g, (1, 1), (2, 2)).rows() == [5, 6, 8, 9]
    with pytest.raises(ValueError):
        regions.load(g, (1, 1), (3, 3))
    src = from_nested(spark, [[10.0 * i + j for j in range(6)] for i in range(6)])
    out, n = regions.copy_region(create_void(spark, (2, 2)), src, source_start=(2, 2), shape=(2, 2))
    assert n == 4 and out.rows() == [22, 23, 32, 33]
    out, n = regions.copy_region(create_void(spark, (3, 3)), src, source_start=(4, 0), source_step=(1, 2), target_start=(1, 1))
    assert n == 4 and out.rows() == [0, 0, 0, 0, 40, 42, 0, 50, 52]
    a = np.arange(36.0).reshape(6, 6)
    h = from_nested(spark, a)
    for at in ((2,), (slice(1, 5, 2), 3), (slice(None, None, -1), slice(4, 0, -2)), (-1, slice(None)), (slice(3, 3),)):
        v = regions.slice_view(h, *at)
        assert v.rows() == a[at].ravel().tolist() and v.shape == a[at].shape
    with pytest.raises(IndexError):
        regions.slice_view(h, 6)
    assert regions.assign(g, [0, 0, 0], (0, 1), (3, 1)).rows() == [1, 0, 3, 4, 0, 6, 7, 0, 9]
    for bad in ([1, 2], [[1], [2], [3]]):
        with pytest.raises(ValueError):
            regions.assign(g, bad, (0, 1), (3, 1))
    assert regions.get_item(regions.set_item(g, (1, 1), -1), (1, 1)).first()["v"] == -1


def test_thresholds(spark):
    g = from_nested(spark, [[1, 5], [9, 3]])
    pairs = [(lambda v: v < 3, -1), (lambda v: v < 8, 0), (True, 1)]
    assert regions.threshold_map(g, pairs).rows() == [-1, 0, 1, 0]
    h = from_nested(spark, [[1, 5, 9], [3, 7, 11]])
    assert regions.threshold_map(h, [(lambda v: v >= 7, 1)], default_value=-1, start=(1, 0), shape=(1, 3)).rows() == [-1, 1, 1]
    j = threshold_judge(3, 7)
    k = threshold_judge(3, 7, inclusive=(False, True))
    row = spark.range(1).select(*[f(F.lit(float(x))) for f, x in ((j, 5), (j, 1), (j, 3), (k, 3), (j, math.nan))]).first()
    assert list(row) == [1, 0, 1, 0, 0]
    n = from_nested(spark, [1.0, math.nan, 3.0])
    assert [r["i0"] for r in regions.threshold_filter(n, low=0).collect()] == [0, 2]
    with pytest.raises(ValueError):
        regions.threshold_filter(n)
    m = regions.data_mapping(g, lambda v: F.when(v > 4, v * 10))
    assert m.rows() == [1, 50, 90, 3]


def test_arithmetic_and_statistics(spark):
    a, b = from_nested(spark, [1.0, 2, 3]), from_nested(spark, [4.0, 5, 6])
    assert arith.add(a, b).rows() == [5, 7, 9] and arith.sub(a, 1, reflected=True).rows() == [0, -1, -2]
    assert arith.mul(a, b).rows() == [4, 10, 18] and arith.div(b, a).rows() == [4, 2.5, 2]
    assert arith.power(a, 2).rows() == [1, 4, 9] and arith.neg(a).rows() == [-1, -2, -3]
    assert arith.norm(from_nested(spark, [3.0, 4])).first()["v"] == 5
    with pytest.raises(PySparkException):
        arith.div(a, 0).rows()
    assert arith.div(a, 0, lenient=True).rows() == [None] * 3
    with pytest.raises(ValueError):
        arith.add(a, from_nested(spark, [1.0]))
    m = from_nested(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert stats.mean(m).first()["v"] == 5 and math.isclose(stats.variance(m).first()["v"], 20 / 3)
    assert stats.total(m).first()["v"] == 45 and stats.product(a).first()["v"] == 6
    assert arith.matvec(m, [1, 0, -1]).rows() == [-2, -2, -2] and arith.matvec(m, [2]).rows() == [2, 8, 14]
    row = spark.range(1).select(stats.multiple_chain(F.array(F.lit(2), F.lit(3)), 5), stats.add_chain(F.array(F.lit(0.5)), 0.25)).first()
    assert list(row) == [30, 0.75]


def test_packing_and_shapes(spark):
    assert infer_shape(3) is None and infer_shape("ab") is None and infer_shape([]) == (0,) and infer_shape([[1, 2]]) == (1, 2)
    g = from_nested(spark, [[1.0, 2], [3, 4]])
    back = from_packed(to_packed(g), (2, 2))
    assert back.rows() == g.rows() == [1, 2, 3, 4] and back.check_dense() is back
    with pytest.raises(PySparkException):
        from_packed(to_packed(g), (2, 3)).rows()
    with pytest.raises(ValueError):
        g.with_df(g.df.filter("i0 = 0")).check_dense()


def test_fourier(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4, 6))
    g = from_nested(spark, a)

    def cells(x):
        out = np.zeros(x.shape, complex)
        for r in x.df.collect():
            out[tuple(r[k] for k in x.axes)] = complex(r["re"], r["im"])
        return out

    for strategy in ("direct", "fft"):
        assert np.allclose(cells(fourier.dft(g, strategy=strategy)), np.fft.fft2(a))
        assert np.allclose(cells(fourier.dft(g, 1, strategy)), np.fft.fft(a, axis=1))
        assert np.allclose(cells(fourier.idft(fourier.dft(g, strategy=strategy), strategy=strategy)), a)
    assert np.allclose(cells(fourier.idft(fourier.dft(g, -1), -1, norm="axis")), a)
    assert np.allclose(cells(fourier.idft(fourier.dft(g, -1), -1)), a / 4)
    p = fourier.power_spectrum(g)
    assert np.allclose(np.array(p.rows()).reshape(4, 6), abs(np.fft.fft2(a)) ** 2)
    k = fourier.dft_kernel_real(spark, 8, 3)
    assert np.allclose(k.rows(), np.cos(2 * np.pi * 3 * np.arange(8) / 8))
    with pytest.raises(ValueError):
        fourier.dft_kernel_imag(spark, 8, 8)
