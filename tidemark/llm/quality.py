"""Document quality from a linear-chain conditional random field over lines.

Each non-empty line is good or bad. Its potential comes from its own features and those of the lines beside it; neighbours are tied by
transition weights. Only whole documents are labelled: a good document has good lines only, a bad one has at least one
bad line, and training maximises the likelihood of exactly that. A document's quality is the
length-weighted mean of its lines' marginals of being good (forward-backward), mapped to a probability on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import unused
from tidemark.llm.texts import WordHashes, pieces, utf8

THRESHOLD = 0.3
#: Labelled documents of each class that training reads at most: a bounded sample, taken by hash of the id.
SAMPLE = 2500
#: One document in so many is held out of training, by crc32 of its id.
FOLDS = 5
#: Bytes of text whose features are computed at a time.
PART_BYTES = 1_000_000
#: Texts that are taken out of an Arrow batch at a time.
ROWS = 256

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b".,;:'\"?-()",
    "bang": b"!",
    "bar": b"|<>{}[]\\/_=~^",
    "symbol": b"*#$%&@+`",
    "blank": b" \t\x0b\x0c\r",
}
_ENDS = np.zeros(256, bool)
_ENDS[list(b".?!:;\"')")] = True
FEATURES = ("size", "upper", "digit", "mark", "bang", "bar", "symbol", "stutter", "variety", "word_length", "ended", "junk_words")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [lines, len(FEATURES)], bytes and text number of every non-empty line, in order.

    Words are looked at in parts of PART_BYTES; what is kept of a line are numbers.
    """
    found, number = [_part_features([])], 0
    for part in pieces(texts, map(len, texts), PART_BYTES):
        features, sizes, owner = _part_features(part)
        found.append((features, sizes, owner + number))
        number += len(part)
    features, sizes, owner = (np.concatenate(c) for c in zip(*found, strict=True))
    return features, sizes, owner


def _part_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lines, owner = [], []
    for k, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.strip()]
        lines += own
        owner += [k] * len(own)
    n = len(lines)
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    data = np.frombuffer(b"".join(lines), np.uint8)
    begins = np.cumsum(sizes) - sizes

    def share(members: bytes, of: np.ndarray) -> np.ndarray:
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        return np.add.reduceat(table[data], begins, dtype=np.int64) / np.maximum(of, 1)

    blanks = share(_CLASSES["blank"], np.ones(n))
    solid = sizes - blanks
    shares = {name: share(members, solid) for name, members in _CLASSES.items() if name != "blank"}
    words = [x.split() for x in lines]
    counts = np.fromiter(map(len, words), np.int64, n)
    flat = [w for x in words for w in x]
    known = WordHashes()
    hashes = known.of(flat)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    last = np.fromiter((w[-1] for w in flat), np.uint8, len(flat))
    line = np.repeat(np.arange(n), counts)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])]
    stutter = np.bincount(line, same, n) / np.maximum(counts - 1, 1)
    with np.errstate(over="ignore"):
        keyed = hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.unique(keyed, return_index=True)[1]
    distinct = np.bincount(line[first], minlength=n)
    # Long lines repeat words anyway: compare with what a line of so many words usually has.
    variety = (distinct / np.maximum(counts, 1)) * np.maximum(counts, 1) ** 0.2
    junk = np.isin(last, np.frombuffer(_CLASSES["symbol"] + _CLASSES["bang"] + b"|", np.uint8))
    ended = _ENDS[np.fromiter((x.rstrip()[-1] for x in lines), np.uint8, n)]
    columns = [
        np.log1p(sizes) / 5,
        *(shares[k] for k in ("upper", "digit", "mark", "bang", "bar", "symbol")),
        stutter,
        variety,
        np.bincount(line, lengths, n) / np.maximum(counts, 1) / 10,
        ended,
        np.bincount(line, junk, n) / np.maximum(counts, 1),
    ]
    return np.stack(columns, axis=1).astype(np.float64), sizes.astype(np.float64), np.array(owner, np.int64)


def with_neighbours(features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, whether there is a previous and a next one, and a constant."""
    same = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:][same] = features[:-1][same]
    after[:-1][same] = features[1:][same]
    has = np.zeros((len(features), 3))
    has[1:, 0][same] = 1
    has[:-1, 1][same] = 1
    has[:, 2] = 1
    return np.hstack([features, before, after, has])


class Chains:
    """Lines of many documents, ready for passes along all chains at once."""

    def __init__(self, owner: np.ndarray, documents: int):
        self.lengths = np.bincount(owner, minlength=documents)
        self.begins = np.cumsum(self.lengths) - self.lengths
        order = np.argsort(-self.lengths, kind="stable")
        sizes = self.lengths[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
        self.steps = [self.begins[order[:n]] + t for t, n in enumerate(active)]

    def passes(self, node: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals [lines, 2], pairwise expectations [2, 2] of each document, and log Z of each document.

        Messages are normalised at every step, so chains of any length stay in range.
        """
        top = node.max(1, keepdims=True)
        local, move = np.exp(node - top), np.exp(transition)
        forward, backward, scale = np.empty_like(local), np.ones_like(local), np.empty(len(local))
        for t, at in enumerate(self.steps):
            message = local[at] if t == 0 else (forward[at - 1] @ move) * local[at]
            scale[at] = message.sum(1)
            forward[at] = message / scale[at, None]
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            backward[at - 1] = ((local[at] * backward[at]) @ move.T) / scale[at, None]
        marginal = forward * backward
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        log_z = np.bincount(document, np.log(scale) + top[:, 0], len(self.lengths))
        pairs = np.zeros((len(self.lengths), 2, 2))
        at = np.flatnonzero(np.r_[False, document[1:] == document[:-1]])
        each = forward[at - 1][:, :, None] * move[None] * (local[at] * backward[at])[:, None, :] / scale[at, None, None]
        for i in (0, 1):
            for j in (0, 1):
                pairs[:, i, j] = np.bincount(document[at], each[:, i, j], len(self.lengths))
        return marginal, pairs, log_z


@dataclass
class Model:
    """Potentials of a good line (a bad line has 0), transitions, scaling, and the map to a probability."""

    weights: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.5

    def potentials(self, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
        good = with_neighbours((features - self.mean) / self.spread, owner) @ self.weights
        return np.stack([np.zeros(len(good)), good], axis=1)

    def good_share(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of good; nan for texts without lines."""
        features, sizes, owner = line_features(texts)
        return self._share(features, sizes, owner, len(texts))

    def _share(self, features, sizes, owner, documents) -> np.ndarray:
        marginal = Chains(owner, documents).passes(self.potentials(features, owner), self.transition)[0]
        total = np.bincount(owner, sizes, documents)
        with np.errstate(invalid="ignore"):
            return np.bincount(owner, sizes * marginal[:, 1], documents) / total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        share = self.good_share(texts)
        return np.where(np.isnan(share), self.empty, _sigmoid(self.slope * np.nan_to_num(share) + self.shift))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[bytes], good: np.ndarray, good_share: float, rounds: int = 250, decay: float = 1e-3) -> Model:
    """A model from whole texts and their labels; good_share: the share of good documents among all labelled ones.

    One class only, or no lines: a model that gives every document that share.
    """
    features, sizes, owner = line_features(texts)
    width = len(FEATURES)
    base = float(np.clip(good_share, 0.01, 0.99))
    flat = Model(np.zeros(3 * width + 3), np.zeros((2, 2)), np.zeros(width), np.ones(width), 0.0, float(np.log(base / (1 - base))), base)
    if len(features) == 0 or good.all() or not good.any():
        return flat
    mean, spread = features.mean(0), features.std(0)
    model = Model(flat.weights.copy(), flat.transition.copy(), mean, np.where(spread > 1e-9, spread, 1.0), empty=base)
    inputs = with_neighbours((features - model.mean) / model.spread, owner)
    chains = Chains(owner, len(texts))
    labelled = chains.lengths > 0
    document = np.repeat(np.arange(len(texts)), chains.lengths)
    # Both classes weigh the same, however many documents they have.
    weight = np.where(good, 0.5 / max(1, (good & labelled).sum()), 0.5 / max(1, (~good & labelled).sum())) * labelled
    theta = np.zeros(inputs.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    moves = np.maximum(chains.lengths - 1, 0)
    for step in range(1, rounds + 1):
        own, transition = theta[:-4], theta[-4:].reshape(2, 2)
        line = inputs @ own
        marginal, pairs, log_z = chains.passes(np.stack([np.zeros_like(line), line], axis=1), transition)
        all_good = np.minimum(np.bincount(document, line, len(texts)) + moves * transition[1, 1] - log_z, -1e-9)  # log P(every line good)
        # d/d(log P): 1 for good documents; for bad ones the likelihood is 1 - P.
        chance = np.exp(all_good)
        pull = weight * np.where(good, 1.0, -chance / np.maximum(1 - chance, 1e-9))
        slope = np.empty_like(theta)
        slope[:-4] = (pull[document] * (1 - marginal[:, 1])) @ inputs
        whole = np.zeros((len(texts), 2, 2))
        whole[:, 1, 1] = moves
        slope[-4:] = np.tensordot(pull, whole - pairs, 1).ravel()
        slope -= decay * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.transition = theta[:-4], theta[-4:].reshape(2, 2)
    share = model._share(features, sizes, owner, len(texts))
    model.slope, model.shift = _logistic(share[labelled], good[labelled], base)
    return model


def _logistic(x: np.ndarray, good: np.ndarray, base: float) -> tuple[float, float]:
    """Slope and shift of P(good | x), the classes weighted to the given share (Newton's method, a little shrunk)."""
    weight = np.where(good, base / max(1, good.sum()), (1 - base) / max(1, (~good).sum())) * len(good)
    inputs, theta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(inputs @ theta)
        gradient = inputs.T @ (weight * (good - p)) - 0.1 * theta
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(curve, gradient)
    return max(0.0, float(theta[0])), float(theta[1])


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo FOLDS; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from labelled documents outside the held-out fold: at most `sample` of each class, whole texts."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(f"_id IS NOT NULL AND _label IN (0, 1)")
    known = known.filter(fold(F.col("_id")) != 0)
    share = known.agg(F.avg("_label")).first()[0]
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.filter("_label = 0").orderBy(*order).limit(sample).unionByName(known.filter("_label = 1").orderBy(*order).limit(sample))
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label").collect()  # 2 x sample ids
    rows.sort(key=lambda r: (r._id, r._label, r._text))
    good = np.array([r._label == 1 for r in rows], bool)
    return train([r._text.encode() for r in rows], good, 0.5 if share is None else share)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the quality of every text as a further column (0 to 1). Null and blank texts get the share of
    good documents among the labelled ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for at in range(0, len(texts), ROWS):  # a batch's texts are never all copied at once
            whole = utf8(texts.slice(at, ROWS))
            found += [shared.value.scores(part) for part in pieces(whole, map(len, whole), PART_BYTES)]
        return pa.array(np.concatenate(found), pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """[doc_id, held_out, score, predicted], one row per document.

    Null and blank texts score the share of good documents; repeated rows get equal scores; a null doc_id counts as held
    out; without labels (or with one class only) every document scores the same. An empty table gives an empty result.
    """
    model = fit(docs, labels, doc_id, text, **options)
    rows = scored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns unchanged, whatever these are called."""
    model = fit(docs, labels, doc_id, text, **options)
    (quality,) = unused(docs, "_quality")
    return scored(docs, model, text, quality).filter(F.col(quality) >= threshold).drop(quality)
