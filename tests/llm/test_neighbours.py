import itertools
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import neighbours


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_cube(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    place = neighbours.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()


def slow(rows, k=20, width=8):
    """query -> sorted [(rank, id, score)] of all its rows, by the contract."""
    points = []
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            points.append((i, np.array(v + [0.0] * (width - len(v)))))
    out = defaultdict(list)
    for at, (q, point) in enumerate(points):
        if q is not None and q % 20 == 0:
            scored = [(-float((point * v).sum()), i is None, i or 0) for n, (i, v) in enumerate(points) if n != at]
            out[q] += [(rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def same(got, want):
    def in_order(hits):
        return sorted(hits, key=lambda h: (h[0], round(-h[2], 9), h[1] is None, h[1]))

    assert got.keys() == want.keys()
    for q in want:
        mine, theirs = in_order(got[q]), in_order(want[q])
        assert [h[:2] for h in mine] == [h[:2] for h in theirs]
        assert np.allclose([h[2] for h in mine], [h[2] for h in theirs], rtol=1e-12)


def every(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return dict(out)


def found(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=8) * (1 + i % 3), 1)]) for i in range(200)]
    rows += [(300 + i, rows[40][1]) for i in range(40)]  # copies of a query's vector: ties
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0] * 7 + [float("nan")]), (404, [1.0] * 7 + [None]), (405, [1.0] * 7 + [float("inf")])]
    # No id, other lengths, repeated rows and ids, also of queries.
    rows += [(None, rows[0][1]), (None, [5.0] * 8), (406, [1.0, 2.0]), (440, [3.0]), rows[3], rows[60], (20, [9.0] * 8), (420, [0.0] * 7 + [-0.0])]
    frame = spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, ids string, vid string, asks string").repartition(4)
    same(every(neighbours.nearest(frame)), slow(rows))


def test_copies_of_a_query_push_nothing_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.05 * rng.normal(size=8)]) for i in range(2000)]
    rows += [(20 * i, rows[100][1]) for i in range(1000, 1400)]  # 400 query rows of one vector
    rows += [(20 * i, [float(x) for x in centres[3] + 1e-6 * rng.normal(size=8)]) for i in range(2000, 2400)]  # and 400 close to each other
    got = every(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=32))
    assert {len(hits) for hits in got.values()} == {20} and len(got) == 900
    want = slow(rows)
    for queries in (range(0, 2000, 20), range(20000, 28000, 20), range(40000, 48000, 20)):
        hits = sum(len({h[1] for h in got[q]} & {h[1] for h in want[q]}) for q in queries)
        assert hits >= 0.9 * 20 * len(queries)


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(neighbours.nearest(frame)) == {0: [(1, 0.5), (2, 0.0)]}
    assert found(neighbours.nearest(frame.limit(0))) == {}
    assert found(neighbours.nearest(frame.filter("vec_id = 0"))) == {}
    assert found(neighbours.nearest(frame.filter("vec_id > 0"))) == {}


def test_recall_with_many_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + 0.4 * rng.normal(size=16)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    points = np.array([r.embedding for r in frame.orderBy("vec_id").collect()])
    got = found(neighbours.nearest(frame, block=64))
    hits = 0
    for q in range(0, 3000, 20):
        scores = points @ points[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (150 * 20) >= 0.9
