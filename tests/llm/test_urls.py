import math
from collections import Counter

import numpy as np

from tidemark.llm import urls

ROWS = [
    (1, None, "", "", None),
    (2, "no scheme", "", "", None),
    (3, "HTTP://EXAMPLE.com", "example.com", "", None),
    (4, "http://www.Example.com/en/x?y/", "www.example.com", "/en/x", "www.example.com/en/"),
    (5, "http://a.example.com/en/#z", "a.example.com", "/en/", "example.com/en/"),
    (6, "x://y://z/q", "y:", "//z/q", None),
    (7, "http://net/fr/", "net", "/fr/", "net/fr/"),
    (8, "http://é.net/fr", "é.net", "/fr", None),
    (9, "http://internet/fr/", "internet", "/fr/", None),
    (10, "://?/x", "", "", None),
    (11, "http://b.com/EN/", "b.com", "/EN/", "com/"),
    (11, "http://b.com/EN/", "b.com", "/EN/", "com/"),
    (None, "http://b.net/es/" + "x" * 50_000, "b.net", "/es/" + "x" * 50_000, "net/es/"),
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u, *_ in ROWS], "page_id long, url string, host string, text string, score string")
    rows = urls.verdicts(frame).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter((i, h, p, r) for i, _, h, p, r in ROWS)
    decided = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    assert all(r.verdict == decided[r.rule] for r in rows if r.rule) and {r.verdict for r in rows} <= {"allow", "block"}
    assert urls.verdicts(frame.limit(0)).collect() == []


def slow_log(counts: dict, context: tuple, symbol: int) -> float:
    """Witten-Bell by its definition, one context at a time from the empty one."""
    p = 1 / urls.SIZE
    for order in range(len(context) + 1):
        own = context[len(context) - order :]
        seen = {s: sum(n for (c, t), n in counts.items() if t == s and c[len(c) - order :] == own) for s in range(urls.SIZE)}
        total, kinds = sum(seen.values()), sum(v > 0 for v in seen.values())
        if total:
            p = (seen[symbol] + kinds * p) / (total + kinds)
    return math.log(p)


def test_model_against_its_definition():
    texts = [b"ab.c/", b"abab", b"\xc3\xa9a", b""]
    codes, lengths = urls.symbols(texts)
    cell, text = urls.cells(codes, lengths)
    counts = Counter()
    for c in cell.tolist():
        digits = [c // urls.SIZE**k % urls.SIZE for k in range(urls.CONTEXT, -1, -1)]
        counts[tuple(digits[:-1]), digits[-1]] += 1
    assert sum(counts.values()) == sum(len(t) + 1 for t in texts) == len(text)
    table = np.zeros(urls.SIZE ** (urls.CONTEXT + 1), np.int64)
    np.add.at(table, cell, 1)
    logs = urls.log_probabilities(table)
    for context, symbol in [*list(counts)[:6], ((1, 2, 3), 4), ((0, 0, 1), 0)]:
        at = 0
        for s in (*context, symbol):
            at = at * urls.SIZE + s
        assert logs[at] == math.log(1) + logs[at] and abs(logs[at] - slow_log(counts, context, symbol)) < 1e-9
    assert abs(np.exp(logs.reshape(-1, urls.SIZE)[:50]).sum(1) - 1).max() < 1e-9


def test_models_tell_sides_apart(spark):
    good = [(f"site{k}.example.org/news/{k}", True) for k in range(200)]
    bad = [(f"win-casino{k}.example.org/bets/{k}", False) for k in range(200)]
    model = urls.fit(spark.createDataFrame(good + bad, "text string, allowed boolean"))
    scores = model.scores([b"site999.example.org/news/x", b"win-casino999.example.org/bets/x", b""])
    assert scores[0] >= model.threshold > scores[1] and scores[2] == 0
