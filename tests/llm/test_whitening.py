"""Whitening: exact cross-products, and components against numpy."""

import math
import random

import numpy as np
import pytest

from staylens.llm import queries, whitening


@pytest.mark.parametrize(("low", "high", "n"), [(-5, 6, 200), (0, 1, 3), (-(1 << 40), 1 << 40, 70), (-(1 << 63), (1 << 63) - 1, 65), (7, 8, 1)])
def test_cross_products_are_exact(low, high, n):
    r = random.Random(n)
    x = np.array([[r.randint(low, high) for _ in range(4)] for _ in range(n)], np.int64)
    sums, products = whitening.cross_products(x)
    rows = x.tolist()
    assert sums.tolist() == [sum(row[a] for row in rows) for a in range(4)]
    assert products.tolist() == [[sum(row[a] * row[b] for row in rows) for b in range(4)] for a in range(4)]


def brute(rows, k=4):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, mean = len(x), x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / n
    values, unit = np.linalg.eigh(cov)
    values, unit = values[::-1][:k], unit[:, ::-1][:, :k]
    sums = [int(s) for s in x.sum(axis=0)]
    out = []
    for i, v in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        w = (np.array(v) - mean) @ unit / np.sqrt(values)
        out += [(i, c + 1, n, dev, abs(w[c]), values[c] / np.trace(cov)) for c in range(len(values))]
    return out


def _check(found, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in found), key=order)
    want = sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def _vectors(n, d, seed):
    r = random.Random(seed)
    return [[r.gauss(0, 1 + i) + (r.gauss(0, 3) if i % 2 else 0) for i in range(d)] for _ in range(n)]


def test_rows_that_are_odd(spark):
    rows = list(enumerate(_vectors(400, 6, 1)))
    rows += [(500, None), (501, []), (502, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(0, rows[0][1])] * 50 + [(None, rows[3][1])] * 3 + [(505, [-0.0] * 6), (506, [1e-9] * 6)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, component int").repartition(4)
    found = whitening.whiten(table)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(found.collect(), brute(rows))


def test_few_dimensions_and_no_variance(spark):
    rows = [(i, [float(i), 2.0 * (i % 3)]) for i in range(20)]
    _check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), brute(rows))
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in flat] == [(c, 1, 0, None, None, None) for c in (1, 2, 1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in line} == {(1, False, 1.0), (2, True, 0.0)} and line[0].identity_error < 1e-9


def test_empty_table_and_several_lengths(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).collect() == []
    for parts in (1, 2):
        with pytest.raises(Exception, match="several lengths"):
            whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").repartition(parts)).collect()


def test_query_of_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    _check(queries.op13_whitening(spark, folder).collect(), brute(rows))
