import random
import re
from collections import Counter

import pytest
from conftest_texts import odd_texts

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        item = words(item)
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(name)
    return len(own), len(hit), sorted(found - {None})


ITEMS = [
    ("7", " ".join(f"w{k}" for k in range(20, 45))),
    ("70", "W60, w61. w62; w63 w64 w65 w66 w67 w68"),
    ("8", "One"),
    (None, "e F g H"),
    ("9", None),
    ("10", ""),
    ("11", "..., !"),
    ("7", " ".join(f"w{k}" for k in range(20, 45))),
    ("12", "council money Zürich"),
]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500}, {"slice_words": 5}])
def test_odd_texts_against_brute_force(spark, odd_docs, options):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontaminate.contamination(odd_docs, benchmark, **options).select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "items").collect()
    want = Counter((i, *map(str, slow(t, ITEMS))) for i, t in odd_texts())
    assert Counter((r.doc_id, str(r.n_words), str(r.n), str(list(r["items"]))) for r in got) == want


def test_longest_match_and_place(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, "q3 q4 " + " ".join(f"q{k}" for k in range(5, 25)) + " q26"), (3, "q1 q2 q3")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = {r.doc_id: (r.longest, r.longest_item, r.longest_at, list(r.hit_starts), list(r.hit_ends)) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert rows == {1: (30, "5", 2, [2], [32]), 2: (22, "5", 0, [0], [22]), 3: (0, None, None, [], [])}


def test_random_words(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(12)]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n, list(r["items"])) for r in decontaminate.contamination(docs, benchmark, window=6).select("*", decontaminate.n_hit().alias("n")).collect()}
    assert got == {i: slow(t, items, 6) for i, t in texts}


def test_empty_tables_and_removal(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontaminate.contamination(no_docs, benchmark).collect() == []
    assert all(r.n == 0 for r in decontaminate.contamination(odd_docs, benchmark.limit(0)).select(decontaminate.n_hit().alias("n")).collect())
    for options in ({}, {"slice_words": 5}):
        kept = decontaminate.remove_contaminated(odd_docs, benchmark, **options)
        assert kept.columns == odd_docs.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in odd_texts() if not slow(t, ITEMS)[1])
    assert decontaminate.remove_contaminated(odd_docs, benchmark.limit(0)).count() == len(odd_texts())
