import random
from collections import Counter

import numpy as np
import pytest
from conftest_texts import odd_texts

import corpus_pipeline
from tidemark.llm import near_copies, simhash


def slow_words(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    return tuple(w for w in words.split(" ") if w)


def slow_kept(rows):
    """The (id, words) that stay, with every pair of texts compared."""
    words = [slow_words(t) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return {(i, w) for (i, _), w, x in zip(rows, words, label, strict=True) if i is not None and i == least[x]}


def edited(words, changes, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"other{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near_rows():
    """Edited copies on both sides of 0.8, a chain, and a group that fills several small blocks."""
    rng, rows = random.Random(7), []
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(40):
        base = fresh(rng.randrange(60, 300))
        rows += [base, *(edited(base, rng.randrange(1, 2 + len(base) // 30), rng) for _ in range(2))]
    chain = fresh(120)
    for _ in range(6):
        rows.append(chain)
        chain = edited(chain, 2, rng)
    base = fresh(150)
    rows += [edited(base, 1, rng) for _ in range(25)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, " ".join(w)) for i, w in zip(ids, rows, strict=True)]


def test_stage_drops_edited_copies(spark, near_rows):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    want = {i for i, _ in slow_kept(near_rows)}
    assert len(want) < len(near_rows) - 60
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_blocks_change_nothing(spark, near_rows):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_first(docs, block=4).collect()} == {i for i, _ in slow_kept(near_rows)}


def test_odd_texts(odd_docs, no_docs):
    rows = odd_texts()
    kept = near_copies.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i, _ in slow_kept(rows)] + [i for i, _ in rows if i is None])
    assert near_copies.keep_first(no_docs).collect() == []


def test_stage_finds_candidates_by_simhash(spark, near_rows, monkeypatch):
    """A plan that lets no bit differ, not even none, leaves every text."""
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "plan_wide", lambda rows, similarity: simhash.Wide(8, 4, 128, -1))
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == len(near_rows)


@pytest.mark.parametrize("rows", [100, 250_000, 15_000_000])
def test_wide_fingerprints_of_similar_sets_meet(rows):
    """Sets that share exactly 0.8 agree in a part and in enough check bits."""
    rng, wide = np.random.default_rng(11), simhash.plan_wide(rows, 0.8)
    met = 0
    for k in range(500):
        only = 1 + k % 8
        both = rng.integers(0, 1 << 63, 8 * only, dtype=np.uint64)
        pair = [np.r_[both, rng.integers(0, 1 << 63, only, dtype=np.uint64)] for _ in range(2)]
        check, values = simhash.wide_keys([simhash.wide_fingerprint(x, wide.words) for x in pair], wide)
        assert values.shape == (2, wide.parts) and values.max() < 1 << wide.width
        met += (values[0] == values[1]).any() and np.bitwise_count(check[0] ^ check[1]).sum() <= wide.distance
    assert met >= 498
