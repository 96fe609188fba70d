"""Whitening against brute force: exact sums in Python integers, covariance and eigenvectors in NumPy on the driver."""

import math

import numpy as np
import pytest

from tessella.llm import whitening
from tessella.llm.op11_whitening import op11_whitening
from tessella.llm.whitening import WhiteningParams, integers, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component string, d long, v int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "c", 3, 4) for r in rows], SCHEMA).repartition(3)


def brute(rows, k=16):
    """{row place: [(component, n, deviation, whitened, explained)]}, for rows of one length."""
    xs = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(xs.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    out = {}
    for i, x in xs.items():
        exact = [n * a - s for a, s in zip(x, sums, strict=True)]
        w = (np.array([a / n for a in exact]) @ vectors[:, order]) / np.sqrt(values[order])
        out[i] = [(c + 1, n, sum(a * a for a in exact), w[c], values[order[c]] / values.sum()) for c in range(len(order))]
    return out


def vectors(d=24, n=300):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(d, d)) * np.linspace(3, 0.2, d)
    out = [(i, [float(c) for c in (rng.normal(size=d) @ mix)]) for i in range(n)]
    out += [(i + n, out[i][1]) for i in range(40)] + [out[3], (None, out[4][1]), (5, None), (6, [None] + out[0][1][1:]), (7, [math.nan] + out[0][1][1:]), (8, [math.inf] * d), (9, [-math.inf] * d), (10, [])]
    return out


def test_whitening_is_brute_force(spark):
    rows = vectors()
    got = {}
    for r in whitened(table(spark, rows)).collect():
        got.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    want = brute([(i, v) for i, v in rows if v is None or len(v)])
    rows = [r for r in rows if r[1] is None or len(r[1])]
    signs = {}
    assert sum(len(c) for g in got.values() for c in g.values()) == 16 * len(want)
    for i, comps in want.items():
        for c, n, dev, w, explained in comps:
            for r in got[rows[i][0], dev][c]:
                assert (r.n, int(r.deviation)) == (n, dev)
                signs.setdefault(c, np.sign(r.whitened * w))
                assert r.whitened == pytest.approx(signs[c] * w, rel=1e-7, abs=1e-7)
                assert r.explained == pytest.approx(explained, rel=1e-9)
                assert r.identity_error < 1e-9


def test_components_without_variance_have_no_rows(spark):
    rows = [(i, [0.1 * (i % 7), 5.0, 0.3 * (i % 5)]) for i in range(60)]
    out = whitened(table(spark, rows)).collect()
    assert {r.component for r in out} == {1, 2} and len(out) == 120
    assert whitened(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).count() == 0


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(1)
    a = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(50)]
    b = [(i + 50, [float(x) for x in rng.normal(size=2)]) for i in range(30)]
    out = whitened(table(spark, a + b)).collect()
    for part, d in ((a, 3), (b, 2)):
        want = brute(part)
        ids = {v for v, _ in part}
        rows = [r for r in out if r.vec_id in ids]
        assert len(rows) == d * len(part)
        for r in rows:
            w = want[[i for i, (v, _) in enumerate(part) if v == r.vec_id][0]][r.component - 1]
            assert (r.n, int(r.deviation)) == w[1:3] and abs(r.whitened) == pytest.approx(abs(w[3]), abs=1e-7)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 * (-1) ** i + i, float(i * i % 11), 3e12 * (i % 3)]) for i in range(40)]
    got = {r.vec_id: int(r.deviation) for r in whitened(table(spark, rows)).collect()}
    assert got == {rows[i][0]: c[0][2] for i, c in brute(rows).items()}
    assert max(got.values()) > 1 << 63
    beyond = rows + [(99, [1e30, 0.0, 0.0])]
    assert integers(table(spark, beyond)).count() == 40


def test_query_empty_table_and_bound(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op11_whitening(spark, str(tmp_path))
    assert out.count() == 0 and dict(out.dtypes)["deviation"] == "bigint"
    with pytest.raises(ValueError, match="more than"):
        whitened(table(spark, vectors()), WhiteningParams(max_bytes=100))


def test_partial_sums_merge_as_one(spark):
    rows = table(spark, vectors())
    x = integers(rows).select("x").distinct().where("size(x) > 0")
    one, many = (whitening.bases(x.repartition(n))[24] for n in (1, 13))
    assert one.sums == many.sums and one.n == many.n
    assert np.allclose(one.values, many.values, rtol=1e-12)
