import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
from conftest_texts import odd_texts

from tidemark.llm import quality


def test_passes_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths = [3, 0, 1, 5]
    owner = np.repeat(np.arange(4), lengths)
    node, move = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    marginal, pairs, log_z = quality.Chains(owner, 4).passes(node, move)
    for d, n in enumerate(lengths):
        own = node[owner == d]
        weights = {}
        for labels in itertools.product((0, 1), repeat=n):
            weights[labels] = math.exp(sum(own[t, y] for t, y in enumerate(labels)) + sum(move[a, b] for a, b in itertools.pairwise(labels)))
        total = sum(weights.values())
        assert abs(log_z[d] - math.log(total)) < 1e-9
        good = [sum(w for y, w in weights.items() if y[t]) / total for t in range(n)]
        assert np.allclose(marginal[owner == d, 1], good)
        for a, b in itertools.product((0, 1), repeat=2):
            assert abs(pairs[d, a, b] - sum(w * sum((x, y) == (a, b) for x, y in itertools.pairwise(k)) for k, w in weights.items()) / total) < 1e-9


def test_long_chains_stay_finite():
    marginal, _, log_z = quality.Chains(np.zeros(5000, np.int64), 1).passes(np.tile([[0.0, 400.0]], (5000, 1)), np.zeros((2, 2)))
    assert np.isfinite(marginal).all() and np.isfinite(log_z).all()


def corpus(spark):
    rows, labels = [], []
    for k in range(240):
        clean = f"The harbour master said on day {k} that the wall will be built again.\nNobody spoke against it."
        junk = clean + "\n" + f"buy&&& now### stone{k}$$$ wall*** " * 9
        rows.append((k, junk if k % 3 == 0 else clean))
        labels.append((k, 0 if k % 3 == 0 else 1, 0, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = quality.quality(docs, labels).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and all(r.predicted == (r.doc_id % 3 != 0) for r in held)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} >= {r.doc_id for r in held if r.doc_id % 3}


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(quality.quality(docs, labels).collect()) == sorted(quality.quality(docs, turned).collect())


def test_odd_texts_and_tables(spark, odd_docs, no_docs):
    _, labels = corpus(spark)
    rows = quality.quality(odd_docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_texts())
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert quality.quality(no_docs, labels).collect() == []
    same = quality.quality(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in same} == {0.5}
