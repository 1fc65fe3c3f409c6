import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import vector_codes
from tidemark.llm.queries import op13_vector_code_compression

SCHEMA = "vec_id long, embedding array<double>, label string, code string, part string, ids string, trees string, error string, _label string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, g, *["clash"] * 6) for i, v, g in rows], SCHEMA).repartition(3)


def slow(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, code, error, label_error): times} and the codebooks' digest, by the contract."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-max(1, max((len(v) for _, v, _ in kept), default=1)) // parts)
    x = [[math.floor(4096 * Fraction(c)) for c in v + [0.0] * (w * parts - len(v))] for _, v, _ in kept]
    cuts = [[v[p * w : p * w + w] for v in x] for p in range(parts)]
    books = [[list(e) for e in cut[:entries]] for cut in cuts]

    def nearest(p, point):
        away = [sum((a - b) ** 2 for a, b in zip(point, e, strict=True)) for e in books[p]]
        return min(range(len(away)), key=lambda k: (away[k], k)), min(away)

    for _ in range(rounds):
        for p, points in enumerate(cuts):
            members = defaultdict(list)
            for point in points:
                members[nearest(p, point)[0]].append(point)
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if members[k] else e for k, e in enumerate(books[p])]
    out, per = [], defaultdict(int)
    for at, (i, _, g) in enumerate(kept):
        found = [nearest(p, cuts[p][at]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(e for _, e in found), g))
        per[g] += out[-1][2]
    return sorted(((i, c, e, per[g]) for i, c, e, g in out), key=str), vector_codes.digest(np.array(books, object))


def check(got, rows):
    want, sha = slow(rows)
    fits = lambda v: v if v < 2**63 else None
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((i, c, fits(e), fits(s)) for i, c, e, s in want), key=str)
    assert {r.codebooks_sha256 for r in got} == ({sha} if want else set())


@pytest.mark.parametrize("seed", range(6))
def test_trees_give_the_nearest_entries(seed):
    rng = np.random.default_rng(seed)
    spread = [3, 50, 4000][seed % 3]
    points = rng.integers(-spread, spread, size=(rng.integers(1, 900), 4))
    points[: len(points) // 3] = points[0]
    entries = rng.integers(-spread, spread, size=(rng.integers(1, 40), 4))
    entries[-1] = entries[0]
    tree = vector_codes.PointTree.unpacked(vector_codes.PointTree.of(points, leaf=8).packed(), True)
    code, counts, sums, _ = vector_codes.assigned(tree, entries)
    away = ((points[tree.order][:, None] - entries[None]) ** 2).sum(2)
    assert (code == away.argmin(1)).all()
    assert (counts == np.bincount(code, minlength=len(entries))).all()
    for k in range(len(entries)):
        assert (sums[k] == points[tree.order][code == k].sum(0)).all()


def test_far_clusters_are_assigned_whole():
    rng = np.random.default_rng(2)
    centres = rng.integers(-100_000, 100_000, size=(8, 8))
    points = centres[rng.integers(0, 8, 4000)] + rng.integers(-50, 50, size=(4000, 8))
    *_, single = vector_codes.assigned(vector_codes.PointTree.of(points), centres)
    assert single < 400


def odd_rows():
    rng = random.Random(1)
    rows = [(k, [round(rng.gauss(0, 0.2), 2) for _ in range(19)], rng.choice(["a", "a", "b", None])) for k in range(30, 330)]
    rows += [(400 + k, rows[4][1], "a") for k in range(150)]
    rows += [(30, rows[9][1], "b"), rows[0], (None, rows[3][1], None), (None, rows[3][1], "c")]
    return rows + [(1, None, "a"), (2, [1.0, None], "a"), (3, [math.nan], "a"), (4, [math.inf], "a"), (5, [], "d"), (6, [1.5, -2.25], "a")]


def test_small_table_by_brute_force(spark):
    check(vector_codes.codes(frame_of(spark, odd_rows())).collect(), odd_rows())


def test_wide_components_stay_exact(spark):
    rows = [(k, [c * 10.0 ** (k % 12) for c in v], g) for k, v, g in odd_rows()[:120]]
    check(vector_codes.codes(frame_of(spark, rows)).collect(), rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16])
def test_few_rows(spark, n):
    rows = [r for r in odd_rows() if r[1] and len(r[1]) == 19][:n]
    check(vector_codes.codes(frame_of(spark, rows)).collect(), rows)


def test_only_empty_vectors(spark):
    check(vector_codes.codes(frame_of(spark, [(1, [], "a"), (2, [], None)])).collect(), [(1, [], "a"), (2, [], None)])


def test_query(spark, sf):
    rows = [(r.vec_id, [float(c) for c in r.embedding], r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op13_vector_code_compression(spark, sf).collect(), rows)
