"""Passages repeated across documents: seeds on winnowed anchors, extension both ways, maximal repeats.

Every window of `window` words picks one of its `seed`-word sequences as its anchor, by its words alone: the one
with the least hash (ties: the last). Equal windows pick equal anchors at equal places, so repeats can
only be found where anchors meet. Neighbouring windows with one anchor form a stretch: the anchor extended to both
sides as far as its windows reach. Stretches meet on their anchor in an equality join:

1. an anchor seen in one document only is no repeat;
2. stretches that agree as a whole are repeats of the one in the least document;
3. of stretches that agree in part, one per distinct content is extended word by word: its windows are
   compared by hash with those of the others that share the anchor.

Covered windows are then merged into maximal repeats. Copies are counted in partial aggregates before any
shuffle and only compared with the least document, so no group of copies is paired with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import merged
from tidemark.llm.texts import Rolling, WordHashes, mix, signed, utf8
from tidemark.sources.checkpoints import cut

WINDOW = 50
SEED_WORDS = 12

#: Words of a text at most, as a power of two.
_PLACE_BITS = 28

_STRETCH = "anchor long, content long, doc_id long, version long, start int, windows int"


def anchors(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window, the place of its anchor: the seed of least hash inside it, the last one of several.

    36 bits of the hash are compared, then the place, so one least number tells both. Sliding minima come from
    running minima from both ends of stretches as long as a window.
    """
    span = window - seed + 1
    n, low = len(hashes), np.uint64((1 << _PLACE_BITS) - 1)
    held = np.full(-(-n // span) * span, np.iinfo(np.uint64).max)
    held[:n] = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    rows = held.reshape(-1, span)
    onward = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - span + 1], onward[span - 1 : n])
    return (low - (least & low)).astype(np.int64)


def stretches(rolling: Rolling, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first window and number of windows of each stretch of a text."""
    seeds = mix(rolling.windows(seed))
    place = anchors(seeds, window, seed)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(place)])
    content = rolling.runs(first, first + count - 1 + window)
    with np.errstate(over="ignore"):  # where the anchor stands and how far the stretch goes count too
        content = mix(content + (place[first] - first).astype(np.uint64) * np.uint64(0x1003F) + count.astype(np.uint64))
    return seeds[place[first]], content, first, count


def _stretch_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs [doc_id, text] -> _STRETCH; rows without id give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            parts, owners, versions, sizes = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = text.split()
                if doc is None or len(words) < window:
                    continue
                part = stretches(Rolling(known.of(words)), window, seed)
                parts.append(part)
                owners.append(doc)
                versions.append(xxhash.xxh64_intdigest(text))
                sizes.append(len(part[0]))
            if parts:
                anchor, content, start, count = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.record_batch(
                    [
                        pa.array(signed(anchor)),
                        pa.array(signed(content)),
                        pa.array(np.repeat(np.array(owners, np.int64), sizes)),
                        pa.array(signed(np.repeat(np.array(versions, np.uint64), sizes))),
                        pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    ["anchor", "content", "doc_id", "version", "start", "windows"],
                )

    return docs.mapInArrow(run, _STRETCH)


def _packed(docs: DataFrame) -> DataFrame:
    """[doc_id, version, packed]: a hash of the text, so that rows that repeat a doc_id with another text stay apart, and
    the text compressed for the way through a shuffle (about half of what Spark's own compression leaves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = utf8(batch.column(1))
            own = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(signed(own)), pa.array(map(pack, texts), pa.binary())], ["doc_id", "version", "packed"])

    return docs.mapInArrow(run, "doc_id long, version long, packed binary")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """docs [doc_id, version, packed, wanted array<anchor, start, windows>] -> one row per window of these stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            wanted = batch.column(3)
            flat, n = wanted.flatten(), np.asarray(wanted.value_lengths())
            fields = [flat.field(k).to_numpy() for k in range(3)]
            at = np.r_[0, np.cumsum(n)]
            docs_, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for k, packed in enumerate(batch.column(2).to_pylist()):
                anchor, start, count = (f[at[k] : at[k + 1]] for f in fields)
                rolling = Rolling(known.of(unpack(packed).split()))
                begins = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                hashes = signed(rolling.runs(begins, begins + window))
                size = len(begins)
                out.append((np.repeat(anchor, count), hashes, np.full(size, docs_[k]), np.full(size, versions[k]), begins.astype(np.int32)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor", "hash", "doc_id", "version", "start"])

    return docs.mapInArrow(run, "anchor long, hash long, doc_id long, version long, start int")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """[doc_id, version, starts, ends]: the maximal repeats of each document, as word spans (end exclusive).

    A word belongs to a repeat if it lies in a window of `window` words that also starts, word for word, in a document
    with a smaller doc_id. Words are separated by ASCII white space. Only documents with repeats
    have a row, one per distinct text (version: a hash of the text). Texts shorter than a window, null texts and rows with a null doc_id neither
    have repeats nor cause any. Rows that repeat one doc_id do not cover each other.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _stretch_rows(rows, window, seed)
    # What is grouped is stored before it is joined, so that Spark may split a hot anchor in the join.
    shared = cut(
        found.groupBy("anchor")
        .agg(
            F.min("doc_id").alias("least"),
            F.max("doc_id").alias("most"),
            (F.min("content") == F.max("content")).alias("alike"),
        )
        .filter("least < most")
        .select("anchor", "least", "alike")
    )
    # The first of stretches that are all alike stays as it is and is needed no more.
    seeds = cut(found.join(shared, "anchor").filter("NOT alike OR doc_id > least").drop("least"))
    own = ["doc_id", "version", "start", "windows"]
    whole = seeds.filter("alike").select(*own)

    mixed = seeds.filter("NOT alike").drop("alike")
    leading = cut(mixed.groupBy("anchor", "content").agg(F.min("doc_id").alias("least")))
    judged = mixed.join(leading, ["anchor", "content"])
    copied = judged.filter("doc_id > least").select(*own)
    extend = judged.filter("doc_id = least").groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    windows = cut(_window_rows(_packed(rows).join(extend, ["doc_id", "version"]).select("doc_id", "version", "packed", "wanted"), window))
    ends = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    first = ends.filter("least < most")
    parted = windows.join(first, ["anchor", "hash"]).filter("doc_id > least").select("doc_id", "version", "start", F.lit(1).alias("windows"))

    covered = whole.unionByName(copied).unionByName(parted)
    spans = covered.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return _merged_rows(spans, window)


def _merged_rows(spans: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat, at = column.flatten(), np.r_[0, np.cumsum(np.asarray(column.value_lengths()))]
            start, count = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            parts = [merged(start[a:b], start[a:b] + count[a:b] - 1 + window) for a, b in zip(at[:-1], at[1:], strict=True)]
            starts, ends = zip(*parts, strict=True) if parts else ([], [])
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)], ["doc_id", "version", "starts", "ends"])

    return spans.mapInArrow(run, "doc_id long, version long, starts array<int>, ends array<int>")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """[doc_id, n_words, n_removed, kept_sha256, kept]: every row's words outside its repeats, joined by one space.

    One row per input row; null texts have no words.
    """
    rows = _packed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    spans = repeats(docs, doc_id, text, window, seed)
    joined = rows.join(spans, ["doc_id", "version"], "left").select("doc_id", "packed", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for packed, starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = unpack(packed).split()
                kept, at = [], 0
                for start, end in zip(starts or [], ends or [], strict=True):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                rest = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([batch.column(0), *arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
