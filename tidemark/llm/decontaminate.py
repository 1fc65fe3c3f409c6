"""Benchmark decontamination: word suffix arrays over shards of the documents.

A shard is a run of whole documents inside one task. Its suffix array is sorted once; then every suffix
of every benchmark item is looked up by binary search, which gives the longest verbatim match and, for the
item's windows, all places where they occur. Documents are never split, so no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import LOWER_AZ, pieces, utf8
from tidemark.sources.checkpoints import cut

WINDOW = 10
#: Bytes of text of a shard (one longer document is a shard of its own).
SHARD_BYTES = 12_000_000
#: Benchmark words that a task holds at a time. A larger benchmark is searched in several passes.
SLICE_WORDS = 2_000_000
#: Suffixes are sorted only if their first words, so many, stand together somewhere in the benchmark.
PREFIX = 3

#: Lower-case, and everything that is no word character becomes a space (bytes of UTF-8).
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER_AZ)

OUT = (
    "doc_id long, n_words long, hit_starts array<int>, hit_ends array<int>, items array<string>, "
    "longest int, longest_item string, longest_at int"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass
class Tests:
    """Benchmark items as numbers: words from 1, each item followed by a 0."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    item: np.ndarray  # of each test suffix: index into names
    at: np.ndarray  # its place in words
    length: np.ndarray  # its words to the end of the item
    window: np.ndarray  # words of the window that starts it
    names: list[str | None]
    prefixes: list[np.ndarray]  # sorted codes of the 2-, 3-, ... word prefixes

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Tests | None:
        vocabulary: dict[bytes, int] = {}
        flat, suffixes, names = [], [], []
        for name, text in items:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            if not words:
                continue
            short = min(window, len(words))
            suffixes += [(len(names), len(flat) + k, len(words) - k, short) for k in range(len(words) - short + 1)]
            names.append(name)
            flat += [*words, 0]
        if not names:
            return None
        item, at, length, windows = np.array(suffixes, np.int64).T
        numbers = np.array([*flat, *[0] * PREFIX], np.int64)
        prefixes, code = [], numbers[: len(flat)].copy()
        for k in range(1, min(PREFIX, int(windows.min()))):
            pair = np.where((code > 0) & (numbers[k : k + len(flat)] > 0), code << 32 | numbers[k : k + len(flat)], 0)
            known = np.unique(pair[pair > 0])
            prefixes.append(known)
            code = _codes(pair, known)
        return cls(vocabulary, numbers, item, at, length, windows, names, prefixes)


def _codes(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 + the place of each value in the sorted known values, or 0."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[place] == values, place + 1, 0)


class Shard:
    """Documents as one sequence of word numbers (0: not in the benchmark, or between documents)."""

    def __init__(self, texts: list[bytes], tests: Tests):
        self.tests = tests
        self.depth = int(tests.length.max())
        known, numbers = tests.vocabulary.get, []
        for text in texts:
            words = words_of(text)
            numbers.append(np.fromiter(map(known, words, repeat(0)), np.int32, len(words)))
        self.sizes = np.array([len(n) for n in numbers], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.n = int((self.sizes + 1).sum())
        self.words = np.zeros(self.n + self.depth + PREFIX + 2, np.int64)
        for start, own in zip(self.starts.tolist(), numbers, strict=True):
            self.words[start : start + len(own)] = own
        self.suffixes = self._sorted(self._candidates())

    def _candidates(self) -> np.ndarray:
        """Places whose first words begin some benchmark suffix; no other place can match."""
        at = np.flatnonzero(self.words[: self.n])
        code = self.words[at]
        for k, known in enumerate(self.tests.prefixes, 1):
            following = self.words[at + k]
            code = np.where(following > 0, _codes(code << 32 | following, known), 0)
            at, code = at[code > 0], code[code > 0]
        return at

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        """The suffix array: places ordered by the words that follow, as deep as the longest item.

        Two words are compared a round, and only places still tied with another go on.
        """
        at, group, tied, depth = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(tied) and depth < self.depth:
            first, second = self.words[at[tied] + depth], self.words[at[tied] + depth + 1]
            key = np.where(first > 0, first << 32 | second, 0)
            order = np.lexsort((key, group[tied]))
            at[tied], key = at[tied][order], key[order]
            new = np.r_[True, (group[tied][1:] != group[tied][:-1]) | (key[1:] != key[:-1])]
            heads = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            group[tied] = tied[heads][which]
            several = np.diff(np.r_[heads, len(tied)])[which] > 1
            tied = tied[several & (key & 0xFFFFFFFF > 0)]
            depth += 2
        return at

    def common(self, places: np.ndarray, tests: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words, up to the limit, each place has in common with the test suffix beside it."""
        same, going, d = np.zeros(len(places), np.int64), np.arange(len(places)), 0
        while len(going):
            on = (limit[going] > d) & (self.words[places[going] + d] == self.tests.words[tests[going] + d])
            going = going[on]
            same[going] += 1
            d += 1
        return same

    def first(self, tests: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
        """Binary search: the first place in the suffix array not before each test suffix, of which
        `limit` words count; with `after`, the first place beyond those that begin with them."""
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(self.suffixes))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            place, test, most = self.suffixes[middle], tests[open_], limit[open_]
            same = self.common(place, test, most)
            whole = same == most
            # Past an item's last word stands 0 in tests.words; with `whole` the words there don't count.
            before = np.where(whole, after, self.words[place + same] < self.tests.words[test + same])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        return low

    def longest(self) -> np.ndarray:
        """For every test suffix the words of its longest match anywhere in the shard."""
        t = self.tests
        if not len(self.suffixes):
            return np.zeros(len(t.at), np.int64)
        here = self.first(t.at, t.length, False)
        best = np.zeros(len(t.at), np.int64)
        for beside in (here - 1, here):
            inside = (beside >= 0) & (beside < len(self.suffixes))
            place = self.suffixes[np.clip(beside, 0, len(self.suffixes) - 1)]
            best = np.maximum(best, np.where(inside, self.common(place, t.at, t.length), 0))
        return best

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffix, place and length of every match that is at least a window long."""
        t = self.tests
        found = np.flatnonzero(self.longest() >= t.window)
        low, high = (self.first(t.at[found], t.window[found], after) for after in (False, True))
        n = high - low
        test = np.repeat(found, n)
        place = self.suffixes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return test, place, self.common(place, t.at[test], t.length[test])

    def rows(self) -> Iterator[tuple]:
        """Per document: words, spans hit by windows, items, and the longest match with item and place."""
        t = self.tests
        test, place, length = self.occurrences()
        doc = np.searchsorted(self.starts, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        test, place, length, doc = test[order], place[order], length[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(self.sizes) + 1))
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a == b:
                yield int(self.sizes[k]), [], [], [], 0, None, None
                continue
            at = place[a:b] - self.starts[k]
            starts, ends = merged(at, at + t.window[test[a:b]])
            items = sorted({t.names[i] for i in np.unique(t.item[test[a:b]]).tolist()} - {None})
            # Ties: the first place, then the item that stands first.
            best = a + int(np.lexsort((test[a:b], at, -length[a:b]))[0])
            yield int(self.sizes[k]), starts, ends, items, int(length[best]), t.names[t.item[test[best]]], int(place[best] - self.starts[k])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover what the given spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], np.r_[ends[:-1][new[1:]], ends[-1]]


def _search(docs: DataFrame, tests: Tests | None, shard_bytes: int) -> DataFrame:
    """docs [row, doc_id, text] -> the same rows with OUT's columns behind `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            out, texts = [], utf8(batch.column(2))
            if tests is None:
                out = [(len(words_of(t)), [], [], [], 0, None, None) for t in texts]
            else:
                for part in pieces(texts, map(len, texts), shard_bytes):
                    out.extend(Shard(part, tests).rows())
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["row", *(c.split()[0] for c in OUT.split(", "))]
            yield pa.record_batch([batch.column(0), batch.column(1), *arrays], names)

    return docs.mapInArrow(run, "row long, " + OUT)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """[doc_id, n_words, hit_starts, hit_ends, items, longest, longest_item, longest_at], one row per document.

    A window is `window` consecutive words of an item, or the whole item if it is shorter. hit_starts and
    hit_ends are disjoint word spans (end exclusive) that windows cover; items are the distinct ids of items
    with such a window, sorted; longest is the longest verbatim match of any test suffix that begins with a
    window, with its item and word place (ties: the first place). Null and empty texts have no words and no
    hits; items without words match nothing; an item with a null id hits words but is not listed; repeated
    documents each get their row; empty tables give no rows or no hits.

    The benchmark is the query set. It is held in the tasks in slices of about `slice_words` words; more
    words mean more passes over the documents, not more memory.
    """
    slices = _slices(benchmark, item_id, item_text, window, slice_words)
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if len(slices) == 1:
        return _search(rows, slices[0], shard_bytes).drop("row")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    return _joined(reduce(DataFrame.unionByName, (_search(rows, tests, shard_bytes) for tests in slices)))


def _slices(benchmark: DataFrame, item_id: str, item_text: str, window: int, slice_words: int) -> list[Tests | None]:
    """The benchmark in slices of about `slice_words` words."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    slices = max(1, -(-total // (slice_words * 6)))
    which = F.pmod(F.xxhash64("item", "words"), F.lit(slices))
    return [
        Tests.of([(r.item, r.words.encode()) for r in items.filter(which == k).orderBy("item", "words").collect()], window)
        for k in range(slices)
    ]


def _joined(found: DataFrame) -> DataFrame:
    """The rows of several passes as one per document."""

    def union(spans):
        """Sorted spans folded into disjoint ones."""
        start = F.array().cast("array<struct<a:int,b:int>>")

        def add(acc, s):
            last = F.element_at(acc, -1)
            longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, s.b).alias("b"))))
            return F.when((F.size(acc) > 0) & (s.a <= F.try_element_at(acc, F.lit(-1)).b), longer).otherwise(F.concat(acc, F.array(s)))

        return F.aggregate(F.array_sort(spans), start, add)

    pairs = F.transform(F.arrays_zip("hit_starts", "hit_ends"), lambda s: F.struct(s.hit_starts.alias("a"), s.hit_ends.alias("b")))
    best = F.struct("longest", -F.col("longest_at"), "longest_item")
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            union(F.flatten(F.collect_list(pairs))).alias("_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max(best).alias("_best"),
        )
        .select(
            "doc_id",
            "n_words",
            F.col("_spans.a").alias("hit_starts"),
            F.col("_spans.b").alias("hit_ends"),
            "items",
            F.col("_best.longest").alias("longest"),
            F.col("_best.longest_item").alias("longest_item"),
            (-F.col("_best.col2")).alias("longest_at"),
        )
    )


def n_hit() -> F.Column:
    """Words inside any hit span."""
    spans = F.arrays_zip("hit_starts", "hit_ends")
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s.hit_ends - s.hit_starts))


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """The rows without any hit, unchanged; cases as in contamination. A filter: nothing is shuffled."""
    for tests in _slices(benchmark, item_id, item_text, window, slice_words):
        docs = docs if tests is None else docs.filter(_clean(docs, tests, shard_bytes)(F.col(text)))
    return docs


def _clean(docs: DataFrame, tests: Tests, shard_bytes: int):
    """A column function: whether a text has no hit."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        whole = [(t or "").encode() for t in texts]
        parts = pieces(whole, map(len, whole), shard_bytes)
        return pd.Series([len(row[1]) == 0 for part in parts for row in Shard(part, shared.value).rows()], dtype=bool)

    return clean
