"""Exact token counts without token ids.

Texts become blocks: a block lists its distinct pre-tokens once, each with the documents that hold it and how
often. Blocks are cut by pre-token into buckets and shuffled; all of a pre-token meets in one task, which counts its
pieces once and returns, per block, sums of frequency times pieces. A pre-token in many documents of a
block is hot: it is dealt by block as well, so no bucket grows with the most frequent words.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.texts import utf8

MAX_TOKENS = 2048
#: Buckets that pre-tokens are dealt to, whatever the partitions: a block has at most a row for each. A
#: task streams through its buckets, so their size is a matter of parallelism, not of memory.
BUCKETS = 4096
#: Bytes of text and number of documents of a block.
BLOCK_BYTES, BLOCK_DOCS = 16_000_000, 32_000
#: A pre-token in at least one of so many documents of its block is hot.
HOT_SHARE = 16
#: Pre-tokens whose counts a task remembers at a time.
KNOWN = 500_000

_INTS = pa.list_(pa.int32())
_DEALT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("block", pa.int64()),
        ("tokens", pa.list_(pa.string())),
        ("holders", _INTS),  # documents that hold each token
        ("docs", _INTS),  # these documents' places in the block, token by token
        ("times", _INTS),
        ("ids", pa.list_(pa.int64())),  # of a block's header row: its documents
        ("sizes", pa.list_(pa.int64())),
        ("parts", pa.list_(pa.int64())),  # pre-tokens of each document
    ]
)
_LONGS = pa.list_(pa.int64())
_SUMMED = pa.schema([("block", pa.int64()), ("docs", _INTS), *((n, _LONGS) for n in ("sums", "seen", "ids", "sizes", "parts"))])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class PreTokens:
    """Pre-tokens of texts and their numbers of pieces, for a tokenizer file that drops white space.

    Such a tokenizer gives the same pieces whether a text is encoded whole or cut at white space; the
    constructor refuses files for which that isn't known to hold.
    """

    def __init__(self, model: str):
        config = json.loads(model)
        steps = config["pre_tokenizer"].get("pretokenizers", [config["pre_tokenizer"]])
        split = steps[0]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not t["content"].split()[1:] for t in config["added_tokens"])
        if split.get("type") != "Split" or not split.get("invert") or split.get("behavior") != "Removed" or r"\s" not in split["pattern"]["Regex"] or not plain:
            raise ValueError("The tokenizer file keeps white space, or its added tokens reach across it.")
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = {s: f" {s}" for s in special}  # a space: no pre-token is written like this
        self.lowers = any(n["type"] == "Lowercase" for n in config["normalizer"].get("normalizers", [config["normalizer"]]))
        self.split = regex.compile(split["pattern"]["Regex"])
        self.printable = regex.compile(rb"[!-~]+")

    def of(self, chunk: bytes) -> list[str]:
        """The pre-tokens of a text without ASCII white space; special tokens behind a space."""
        text = chunk.decode()
        if self.special is not None and self.special.search(text):
            out = []
            for part in self.special.split(text):
                out += [self.marks[part]] if part in self.marks else self._plain(part) if part else []
            return out
        if self.printable.fullmatch(chunk):  # printable ASCII has one normal form, and the pattern is the same here
            return self.split.findall(text.lower() if self.lowers else text)
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def count(self, token: str) -> int:
        return 1 if token[0] == " " else len(self.tokenizer.model.tokenize(token))


@lru_cache(maxsize=2)
def _loaded(model: str) -> PreTokens:
    return PreTokens(model)


def _block(ids: list, texts: list[bytes], number: int, buckets: int, pre: PreTokens) -> pa.RecordBatch:
    """The rows of one block: its header, and one row per bucket."""
    chunks: dict[bytes, int] = defaultdict(count().__next__)
    owner, chunk = [], []
    for k, text in enumerate(texts):
        found = Counter(text.split())
        chunk.append(np.fromiter(map(chunks.__getitem__, found), np.int64, len(found)))
        owner.append((k, np.fromiter(found.values(), np.int64, len(found))))
    tokens: dict[str, int] = defaultdict(count().__next__)
    parts = [[tokens[t] for t in pre.of(c)] for c in chunks]
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.cumsum(width) - width
    flat = np.fromiter((t for p in parts for t in p), np.int64, int(width.sum()))
    docs = np.repeat([k for k, _ in owner], [len(n) for _, n in owner]).astype(np.int64)
    times = np.concatenate([n for _, n in owner]) if owner else np.zeros(0, np.int64)
    chunk = np.concatenate(chunk) if chunk else np.zeros(0, np.int64)
    # chunks -> pre-tokens, then one entry per (token, document)
    n = width[chunk]
    entry = np.repeat(np.arange(len(chunk)), n)
    token = flat[np.repeat(at[chunk] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    pair, place = np.unique(token * len(texts) + docs[entry], return_inverse=True)
    times = np.bincount(place, times[entry], len(pair)).astype(np.int64)
    token, docs = np.divmod(pair, max(1, len(texts)))
    holders = np.bincount(token, minlength=len(tokens))
    names = np.array(list(tokens), object)
    salt = np.where(holders * HOT_SHARE >= len(texts), number, 0)
    bucket = np.fromiter((xxhash.xxh32_intdigest(t, int(s) & 0xFFFFFFFF) % buckets for t, s in zip(names, salt, strict=True)), np.int64, len(names))
    # tokens by bucket, and their entries in the same order
    order = np.argsort(bucket, kind="stable")
    starts = np.cumsum(holders) - holders
    held = holders[order]
    pick = np.repeat(starts[order] - np.cumsum(held) + held, held) + np.arange(held.sum())
    own, first = np.unique(bucket[order], return_index=True)
    bounds = np.r_[first, len(order)]
    entries = np.r_[0, np.cumsum(held)][bounds]
    rows = len(own) + 1

    def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, offsets].astype(np.int32)), values)

    def header(values: np.ndarray | list) -> pa.Array:
        values = pa.array(values, pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(rows, len(values))].astype(np.int32)), values)

    columns = [
        pa.array(np.r_[xxhash.xxh32_intdigest(str(number)) % buckets, own].astype(np.int32)),
        pa.array(np.full(rows, number)),
        lists(pa.array(names[order], pa.string()), np.r_[bounds[:1] * 0, bounds[1:]]),
        lists(pa.array(held.astype(np.int32)), np.r_[0, bounds[1:]]),
        lists(pa.array(docs[pick].astype(np.int32)), np.r_[0, entries[1:]]),
        lists(pa.array(times[pick].astype(np.int32)), np.r_[0, entries[1:]]),
        header(ids),
        header(np.fromiter(map(len, texts), np.int64, len(texts))),
        header(np.bincount(docs, times, len(texts)).astype(np.int64)),
    ]
    return pa.record_batch(columns, schema=_DEALT)


def _deal(docs: DataFrame, model: str, buckets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, number = _loaded(shared.value), TaskContext.get().partitionId() << 32
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True))
        held, total = [], 0
        for row in rows:
            held.append(row)
            total += len(row[1])
            if total >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                yield _block([i for i, _ in held], [t for _, t in held], number, buckets, pre)
                held, total, number = [], 0, number + 1
        if held:
            yield _block([i for i, _ in held], [t for _, t in held], number, buckets, pre)

    return docs.mapInArrow(run, _ddl(_DEALT))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{f.name} " + (f"array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else names[f.type]) for f in schema)


def _weigh(dealt: DataFrame, model: str) -> DataFrame:
    """Rows of whole buckets, sorted by block -> per block the sums of times x pieces, and its header."""
    shared = dealt.sparkSession.sparkContext.broadcast(model)
    none = [pa.array([[]], _LONGS)] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = _loaded(shared.value), {}
        block, sums, seen = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def row() -> pa.RecordBatch:
            docs = np.flatnonzero(seen)
            values = (pa.array([v], t) for v, t in zip((docs, sums[docs], seen[docs]), _SUMMED.types[1:4], strict=True))
            return pa.record_batch([pa.array([block], pa.int64()), *values, *none], schema=_SUMMED)

        for batch in batches:
            for k, number in enumerate(batch.column("block").to_pylist()):
                tokens = batch.column("tokens")[k].as_py()
                if not tokens:
                    header = (batch.column(n).slice(k, 1) for n in ("ids", "sizes", "parts"))
                    empty = (pa.array([[]], t) for t in _SUMMED.types[1:4])
                    yield pa.record_batch([pa.array([number], pa.int64()), *empty, *header], schema=_SUMMED)
                    continue
                if number != block:
                    if block is not None:
                        yield row()
                    block, sums, seen = number, np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(known) > KNOWN:
                    known.clear()
                for t in tokens:
                    if t not in known:
                        known[t] = pre.count(t)
                weight = np.fromiter((known[t] for t in tokens), np.int64, len(tokens))
                holders, docs, times = (batch.column(n)[k].values.to_numpy() for n in ("holders", "docs", "times"))
                need = max(int(docs.max()) + 1, len(sums))
                sums, seen = (np.r_[v, np.zeros(need - len(v), np.int64)] for v in (sums, seen))
                sums += np.bincount(docs, np.repeat(weight, holders) * times, need).astype(np.int64)
                seen += np.bincount(docs, times, need).astype(np.int64)
        if block is not None:
            yield row()

    return dealt.mapInArrow(run, _ddl(_SUMMED))


def _finish(summed: DataFrame, max_tokens: int) -> DataFrame:
    """The sums of each block brought to its documents. A block has at most BLOCK_DOCS of them."""

    def run(table: pa.Table) -> pa.Table:
        lists = {n: table.column(n).combine_chunks().flatten().to_numpy() for n in _SUMMED.names[1:] if n != "ids"}
        total, seen = np.zeros((2, len(lists["sizes"])), np.int64)
        np.add.at(total, lists["docs"], lists["sums"])
        np.add.at(seen, lists["docs"], lists["seen"])
        if not np.array_equal(seen, lists["parts"]):
            raise RuntimeError("Some pre-tokens of a block are missing: the input gave other rows when it was read again.")
        ids = table.column("ids").combine_chunks().flatten()
        return pa.table([ids, lists["sizes"], total, total > max_tokens], schema=_OUT)

    return summed.groupBy("block").applyInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_counts(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS) -> DataFrame:
    """[doc_id, n_bytes, n_tokens, over_limit]: one row per input row.

    n_tokens is the number of tokens that the tokenizer file's library gives for the whole text, without
    added special tokens; strings of special tokens inside a text count as it counts them. Null and
    empty texts have 0 bytes and 0 tokens; rows with a null doc_id and repeated rows keep their rows; an empty table gives an
    empty result. The file is read by the driver and sent to the tasks.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        model = file.read()
    PreTokens(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = _deal(rows, model, buckets)
    met = dealt.repartition("bucket").sortWithinPartitions("block")
    return _finish(_weigh(met, model), max_tokens)
