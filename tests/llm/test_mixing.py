import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest_texts import odd_texts

from tidemark.llm import mixing


def slow_targets(sizes: dict, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Share, find sources above their limit, share the excess among the rest; again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left, open_ = set(), share * sum(sizes.values()), set(names)
    while True:
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target | {s: Fraction(most * sizes[s]) for s in full}
        full |= above
        open_ -= above
        left -= sum(most * sizes[s] for s in above)
        if not open_:
            return {s: Fraction(most * sizes[s]) for s in full}


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_shared_until_none_is_above(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 5, 50, 1000, 10**9]) for k in range(rng.randint(1, 12))} | ({None: 70} if seed % 2 else {})
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s]), rel=1e-12) for s in want)


def test_takes_come_near_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.randint(0, 400)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    taken = mixing.copies(frame).collect()
    again = mixing.copies(frame.repartition(2)).collect()
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, taken)) == sorted(map(key, again)) and len(taken) == len(rows)
    words, target = defaultdict(int), {}
    for r in taken:
        assert 0 <= r.copies <= 2
        words[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(words[s] - target[s]) <= 400 for s in target)


def test_odd_texts(odd_docs, no_docs):
    rows = mixing.mixture(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_texts())
    assert {r.doc_id: r.size for r in rows if r.doc_id in (1, 4, 5, 6, 7, 8)} == {1: 70, 4: 0, 5: 0, 6: 0, 7: 1, 8: 3}
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixture(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def test_the_mix_holds_every_copy(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    mixed = mixing.mix(stored).collect()
    want = Counter()
    for r in mixing.mixture(stored).collect():
        if r.size:
            want[r.doc_id] += r.taken // r.size
    assert Counter(r.doc_id for r in mixed if r.text and r.text.split()) == +want
