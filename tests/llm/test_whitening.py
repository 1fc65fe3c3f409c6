import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, component string, whitened string, d string, j string, n string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], SCHEMA).repartition(3)


def slow(rows):
    """(rows of whole numbers, n, sums, exact covariance) by the contract."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [(i, [math.floor(64 * Fraction(c)) + 1_000_000 for c in v + [0.0] * (d - len(v))]) for i, v in kept]
    n = len(x)
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    cov = [[Fraction(sum((n * v[j] - sums[j]) * (n * v[k] - sums[k]) for _, v in x), n**3) for k in range(d)] for j in range(d)]
    return x, n, sums, cov


def check(got, rows, most=32):
    x, n, sums, cov = slow(rows)
    d = len(sums)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(cov[j][j] for j in range(d)))
    want = {}
    for i, v in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)])
        for k in range(min(most, d)):
            value = None if values[k] <= 1e-12 * max(values[0], 0) else float(centred @ vectors[:, k] / math.sqrt(values[k]))
            want.setdefault((i, k + 1), []).append((deviation if deviation < 2**63 else None, value))
    found = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert trace == 0 and r.explained is None or r.explained == pytest.approx(max(values[r.component - 1], 0) / trace, rel=1e-6, abs=1e-12)
        found.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert found.keys() == want.keys()
    signs = {}
    for key in sorted(want, key=str):
        a, b = sorted(found[key], key=str), sorted(want[key], key=str)
        assert len(a) == len(b) and sorted(str(p[0]) for p in a) == sorted(str(p[0]) for p in b)
        if len(a) == 1 and b[0][1] is not None and abs(b[0][1]) > 1e-3:
            sign = signs.setdefault(key[1], 1 if a[0][1] * b[0][1] > 0 else -1)
            assert a[0][1] * sign == pytest.approx(b[0][1], rel=1e-6, abs=1e-7)
        assert [p[1] is None for p in a] == [p[1] is None for p in b]


def test_planes_count_exactly():
    rng = np.random.default_rng(3)
    for high in (1, 2, 100, 2**31, 2**62):
        x = rng.integers(-high, high, size=(333, 5), endpoint=True)
        x[:, 3] = 7
        total = whitening.Scatter(x.min(0), x.max(0), len(x))
        for at in range(0, 333, 100):
            total.add(np.ascontiguousarray(x[at : at + 100]))
        y = [[int(c) - int(l) for c, l in zip(row, x.min(0), strict=True)] for row in x]
        for j in range(5):
            assert int(total.sums[j]) == sum(r[j] for r in y)
            for k in range(j, 5):
                assert int(total.products[j, k]) == sum(r[j] * r[k] for r in y)


def test_small_table_by_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(c) for c in rng.normal(size=40) * (1 + np.arange(40) / 5) + 3]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (301, None), (302, [1.0] * 39 + [None]), (303, [math.nan] * 40), (304, [math.inf] + [0.0] * 39), (305, [1.0, 2.0]), (306, [])]
    check(whitening.components(frame_of(spark, rows)).collect(), rows)


def test_far_apart_entries_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in [*rng.normal(size=3) * 1e9, 1e12 * (i % 2), rng.normal(), 5.5]]) for i in range(50)]
    x, n, sums, cov = slow(rows)
    model = whitening.fit(frame_of(spark, rows))
    assert model.n == n and [[Fraction(v, n * n) for v in row] for row in model.centred] == cov
    got = whitening.components(frame_of(spark, rows)).collect()
    want = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x}
    assert {(r.vec_id, r.deviation) for r in got} == {(i, v if v < 2**63 else None) for i, v in want.items()}


@pytest.mark.parametrize("rows", [[(1, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.75, -1.0])]])
def test_without_variance(spark, rows):
    got = whitening.components(frame_of(spark, rows)).collect()
    check(got, rows)
    assert len(got) == 2 * len(rows)


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_query(spark, sf):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_embedding_whitening(spark, sf).collect(), rows)
