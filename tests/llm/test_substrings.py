import hashlib
import random
from collections import Counter

import pytest
from conftest_texts import odd_texts

from tidemark.llm import substrings


def slow(rows, window):
    """doc_id -> number of words, of removed words, hash of the rest; for every row."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - window + 1):
                gram = tuple(w[k : k + window])
                first[gram] = min(i, first.get(gram, i))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def rows_of(frame):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def test_odd_texts_against_brute_force(odd_docs, no_docs):
    assert rows_of(substrings.without_repeats(odd_docs)) == slow(odd_texts(), 50)
    assert substrings.without_repeats(no_docs).collect() == []


@pytest.mark.parametrize("seed", [1, 3, 6])
def test_random_words(spark, seed):
    """Few different words: chance repeats, ties between anchors and passages that touch."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(6)]
    rows = [(rng.randrange(12), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substrings.without_repeats(docs, window=8, seed=seed)) == slow(rows, 8)


def test_repeats_are_maximal_spans(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c d {passage} e"), (3, passage)], "doc_id long, text string")
    spans = {r.doc_id: (list(r.starts), list(r.ends)) for r in substrings.repeats(docs).collect()}
    assert spans == {2: ([2], [62]), 3: ([0], [60])}
