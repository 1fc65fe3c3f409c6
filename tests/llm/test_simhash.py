import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_texts import odd_texts

from tidemark.llm import simhash


def slow_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(fps: list[int]) -> dict[int, int]:
    """fingerprint -> least fingerprint of its component."""
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(label), 2):
            if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_fingerprints_of_odd_texts(odd_docs):
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(odd_docs).collect())
    assert got == Counter((i, slow_fingerprint(t)) for i, t in odd_texts())


def test_groups_of_odd_texts(odd_docs, no_docs):
    rows = odd_texts()
    fps = [slow_fingerprint(t) for _, t in rows]
    label = slow_groups(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = Counter((i, least.get(label[f])) for (i, _), f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()) == want
    assert simhash.near_duplicates(no_docs).collect() == []
    first = {(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None and i == least[label[f]]}
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i, _ in first] + [i for i, _ in rows if i is None])


@pytest.mark.parametrize("parts", [None, [simhash.Part(tuple(range(32)), 2), simhash.Part(tuple(range(32, 64)), 1)]])
def test_links_lose_nothing(spark, parts):
    """Clusters, chains and noise, in blocks of three: the components are those of all pairs."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:8]:
        at = centre
        for _ in range(12):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << bit
            fps.add(at)
            fps.add(centre ^ 1 << rng.randrange(64))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.links(rows, parts or simhash.plan_parts(rows), block=3).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in found)
    label = {f: f for f in fps}
    for _ in range(len(fps)):
        for r in found:
            label[r.a & mask] = label[r.b & mask] = min(label[r.a & mask], label[r.b & mask])
    assert label == slow_groups(list(fps))


def test_thresholds_always_cover_the_distance():
    rng = np.random.default_rng(3)
    for parts in (2, 3, 5):
        total, thresholds = simhash.allocate(rng.random((parts, 5)).cumsum(1).tolist(), 4)
        assert sum(t + 1 for t in thresholds) == 5 and total > 0


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    left = np.unique(base[rng.integers(0, 4, 60)] ^ (np.uint64(1) << rng.integers(0, 5, 60).astype(np.uint64)))
    ends = simhash.forest(left, None, 4)
    label = {int(f): int(f) for f in left}
    for _ in left:
        for a, b in ends.tolist():
            label[a] = label[b] = min(label[a], label[b])
    assert label == slow_groups([int(f) for f in left]) and len(ends) <= len(left)
