import numpy as np
import pytest

from wardcast.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, label string, component string, n string, x string, whitened string, i string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "l", "c", "n", "x", "w", "i") for i, v in vectors], SCHEMA).repartition(5)


def test_jacobi_davidson_finds_close_and_equal_eigenvalues():
    r = np.random.default_rng(1)
    for size in (1, 3, 20, 64, 200):
        q = np.linalg.qr(r.standard_normal((size, size)))[0]
        for top in ([9, 8.999, 8.99, 8], [5, 5, 5, 5], [1, 0, 0, 0], [1e6, 1, 1e-3, 1e-6]):
            values = np.r_[top, np.linspace(0.5, 0, size)][:size] if top[1] > 1 else np.r_[top, np.zeros(size)][:size]
            a = (q * values) @ q.T
            found, vectors = w.jacobi_davidson(lambda u, a=a: a @ u, size, 4)
            assert np.abs(found - np.sort(values)[::-1][:4]).max() <= 1e-12 * max(values)
            assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * max(values)
            assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_minres_solves_symmetric_indefinite_systems():
    r = np.random.default_rng(2)
    a = r.standard_normal((12, 12))
    a, rhs = a + a.T, r.standard_normal(12)
    run = w.minres(rhs, 40, 1e-13)
    ask = next(run)
    with pytest.raises(StopIteration) as end:
        while True:
            ask = run.send(a @ ask)
    assert a @ end.value.value == pytest.approx(rhs, abs=1e-9)


def test_whitening_equals_a_dense_solution(spark):
    r = np.random.default_rng(3)
    base = (r.standard_normal((300, 10)) @ r.standard_normal((10, 10))).astype(np.float32)
    vectors = list(enumerate(base)) + [(5, base[5]), (None, base[6])] + [(1000 + i, base[0]) for i in range(100)]
    bad = [(2000, None), (2001, [None] * 10), (2002, [float("nan")] * 10), (2003, [float("inf")] * 10), (2004, [1.0]), (2005, [])]
    rows = w.whitened(table(spark, vectors + bad)).toPandas()
    assert len(rows) == 4 * len(vectors) and rows.vec_id.isna().sum() == 4
    x = np.floor(256 * np.array([v for _, v in vectors], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    assert set(rows.n) == {n}
    c = fit - total / n
    values, dirs = np.linalg.eigh(c.T @ c / n)
    values, dirs = values[::-1][:4], dirs[:, ::-1][:, :4]
    assert rows.identity_error.max() < 1e-10 and rows.identity_error.nunique() == 1
    signs = {}
    for (i, own), part in zip(enumerate(x[:300]), [g for _, g in rows[rows.vec_id.between(0, 299)].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"]).groupby("vec_id")]):
        z = (own - total / n) @ dirs / np.sqrt(values)
        for j, got in enumerate(part.whitened):
            signs.setdefault(j, np.sign(got * z[j]))
            assert got == pytest.approx(signs[j] * z[j], abs=1e-9)
        assert set(part.deviation) == {int(((n * own - total) ** 2).sum())}
        assert list(part.explained) == pytest.approx(list(values / np.trace(c.T @ c / n)), rel=1e-9)


def test_tables_without_spread_few_entries_or_huge_ones(spark):
    one = w.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one} == {(i, c, 1, 0, None, 0.0) for i in (1, 2) for c in (1, 2)}
    line = w.whitened(table(spark, [(1, [-1.0]), (2, [1.0])])).collect()
    assert {(r["vec_id"], r["component"], abs(r["whitened"]), r["deviation"], r["explained"]) for r in line} == {(1, 1, 1.0, 512**2, 1.0), (2, 1, 1.0, 512**2, 1.0)}
    huge = w.whitened(table(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)
    assert w.whitened(table(spark, [(1, None)])).isEmpty() and w.whitened(table(spark, [(1, None)]).limit(0)).isEmpty()
