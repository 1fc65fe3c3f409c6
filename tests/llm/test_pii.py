import random
import re
from collections import Counter

import numpy as np
from conftest_texts import odd_texts

from tidemark.llm import pii


def slow_luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def slow_base(text: str) -> list[tuple[int, int, int]]:
    """The base patterns as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and slow_luhn(digits(m))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    for k in range(60_000):
        text = "".join(rng.choice("a.@-+ 0123456789()bZ_%é\n" if k % 3 else "0123 .-+@a") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == slow_base(text)
    for text in ("9" * 200_000, "a" * 200_000 + "@", "+1" * 50_000, "1 " * 80_000, "4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8"):
        assert len(text) > 1000 or pii.base_spans(text) == slow_base(text)
        pii.candidates(text)


def test_em_finds_the_reliable_labelers():
    """Four labelers with known error rates on 4,000 candidates: the estimates come near, and beat the majority."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.6, 0.55, 0.85])
    ballots = np.where(rng.random((4000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    rows, counts = np.unique(ballots, axis=0, return_counts=True)
    chance, likely = pii.reliabilities(rows, counts.astype(float))
    assert np.abs(chance[:, 1, 2] - right).max() < 0.05
    found = {tuple(b): p > 0.5 for b, p in zip(rows.tolist(), likely, strict=True)}
    own = np.mean([found[tuple(b)] == t for b, t in zip(ballots.tolist(), truth, strict=True)])
    assert own > np.mean((ballots.sum(1) > 0) == truth) and own > 0.93


def test_spans_are_added_where_votes_agree(spark):
    texts = [f"mail me: p{k}@mail{k}.example.com or call +1 (499) 555-{1000 + k} today" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(docs)
    added = {
        "write to jan (at) example (dot) org today": "jan (at) example (dot) org",
        "call (499) 555-6503 please": "(499) 555-6503",
        "IBAN DE89 3704 0044 0532 0130 00": "DE89 3704 0044 0532 0130 00",
    }
    for text, span in added.items():
        base, every = model.spans(text)
        assert base == [] and [text[a:b] for _, a, b in every] == [span]
    for text in ("meet at noon. dot the i", "version 10.2.300.4000", "pages 123 456 789 000", "1999 2000 2001 2002", "look at this dot com"):
        assert model.spans(text)[1] == []
    clean = pii.redact(docs, model=model).collect()
    assert {r.text for r in clean} == {"mail me: <EMAIL> or call <PHONE> today"}


def test_odd_texts_and_tables(odd_docs, no_docs):
    rows = pii.find(odd_docs, pii.fit(odd_docs)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_texts())
    assert all(r.base == [] == r.spans for r in rows)
    assert pii.find(no_docs, pii.fit(no_docs)).collect() == []
    redacted = pii.redact(odd_docs)
    assert redacted.columns == odd_docs.columns and Counter((r.doc_id, r.text) for r in redacted.collect()) == Counter(odd_texts())
