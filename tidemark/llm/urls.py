"""URL filter: rules first, then a ratio of character language models.

URLs that a rule accepts or rejects train two variable-order Markov models of their characters. The other
URLs are judged by the difference of the two log-likelihoods per character, against a threshold calibrated on rule-judged
URLs that were held out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host and path that a URL must fall under, and the verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Symbols of the models: these, one for every other character, and one for both ends of a text.
SYMBOLS = b"abcdefghijklmnopqrstuvwxyz0123456789.-/"
OTHER, END = len(SYMBOLS), len(SYMBOLS) + 1
SIZE = len(SYMBOLS) + 2
#: Characters of context at most. The tables have SIZE ** (CONTEXT + 1) cells, 2.8 million, whatever the corpus.
CONTEXT = 3
#: One in so many judged URLs is held out for the threshold, which is looked for on this grid of scores.
HELD_OUT, GRID = 5, np.linspace(-5, 5, 2001)

_CODE = np.full(256, OTHER, np.int64)
for _k, _b in enumerate(SYMBOLS):
    _CODE[_b] = _k
_CODE[np.arange(65, 91)] = _CODE[np.arange(97, 123)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without '://' or for null; the host's A-Z lower-cased."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), or null. Ties: the last by text."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one sequence of symbols, CONTEXT ends before and one after each; their lengths with the last end."""
    blob = (b"\xff" * CONTEXT).join([b"", *(t + b"\xff" for t in texts)])
    codes = _CODE[np.frombuffer(blob, np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths + CONTEXT) - lengths - CONTEXT
    for k in range(CONTEXT):
        codes[begins + k] = END
    codes[begins + CONTEXT + lengths - 1] = END
    return codes, lengths


def cells(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every text, the cell of (context, symbol); and the text it belongs to."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths + CONTEXT) - lengths
    at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    cell = np.zeros(len(at), np.int64)
    for k in range(CONTEXT, -1, -1):
        cell = cell * SIZE + codes[at - k]
    return cell, text


@dataclass
class Model:
    """Log-ratio of accepted to rejected for each cell, and the score from which a URL is accepted."""

    ratio: np.ndarray
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-ratio per character; 0 for empty texts."""
        if not texts:
            return np.zeros(0)
        codes, lengths = symbols(texts)
        cell, text = cells(codes, lengths)
        score = np.bincount(text, self.ratio[cell].astype(np.float64), len(texts)) / lengths
        return np.where(lengths > 1, score, 0.0)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | context) of every cell. Each order of context is mixed with the next shorter one, by
    the number of different symbols seen after it (Witten and Bell); unseen contexts fall back to it."""
    full = counts.reshape((SIZE,) * (CONTEXT + 1)).astype(np.float64)
    mixed = np.full(SIZE, 1 / SIZE)
    for order in range(CONTEXT + 1):
        seen = full.sum(axis=tuple(range(CONTEXT - order)))  # counts with the last `order` symbols as context
        total, kinds = seen.sum(-1, keepdims=True), (seen > 0).sum(-1, keepdims=True)
        with np.errstate(invalid="ignore"):
            own = (seen + kinds * mixed) / (total + kinds)
        mixed = np.where(total > 0, own, mixed)
    return np.log(mixed).ravel()


def _text_of(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def fit(judged: DataFrame) -> Model:
    """judged [text, allowed]: models from four in five distinct texts' rows, the threshold from the rest.

    All rows count. What reaches the driver are the tables' cells (at most 2.8 million) and two counts per grid point.
    Without accepted or without rejected URLs the ratio is 0 and everything is accepted.
    """
    rows = judged.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            allowed = np.array(batch.column(1).to_pylist(), bool)
            cell, text = cells(*symbols(texts)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            keys, n = np.unique(cell * 2 + allowed[text], return_counts=True)
            yield pa.record_batch([pa.array(keys // 2), pa.array(keys % 2 == 1), pa.array(n)], ["cell", "allowed", "n"])

    counted = rows.filter("NOT held").select("text", "allowed").mapInArrow(count, "cell long, allowed boolean, n long")
    table = counted.groupBy("cell", "allowed").agg(F.sum("n").alias("n")).toPandas()
    logs = []
    for side in (True, False):
        own = table[table["allowed"] == side]
        if own.empty:
            return Model(np.zeros(SIZE ** (CONTEXT + 1), np.float32), 0.0)
        counts = np.zeros(SIZE ** (CONTEXT + 1), np.int64)
        counts[own["cell"].to_numpy()] = own["n"].to_numpy()
        logs.append(log_probabilities(counts))
    model = Model((logs[0] - logs[1]).astype(np.float32), 0.0)
    scored = scores(rows.filter("held"), model).select(
        F.least(F.greatest(F.round((F.col("score") + 5) * 200), F.lit(0)), F.lit(2000)).cast("int").alias("bin"), "allowed"
    )
    bins = scored.groupBy("bin").agg(F.count_if("allowed").alias("good"), F.count_if(~F.col("allowed")).alias("bad")).collect()
    good, bad = np.zeros((2, len(GRID)))
    for row in bins:
        good[row.bin], bad[row.bin] = row.good, row.bad
    if good.sum() and bad.sum():
        kept = 1 - (np.cumsum(good) - good) / good.sum()  # accepted share of each side at the threshold GRID[k]
        caught = (np.cumsum(bad) - bad) / bad.sum()
        best = np.flatnonzero(np.isclose(kept + caught, (kept + caught).max()))
        model.threshold = float(GRID[best[np.argmin(np.abs(GRID[best]))]]) - 0.0025
    return model


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """Adds score to rows with a column text (never null)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores([t.encode() for t in texts]))

    return rows.withColumn("score", score("text"))


def verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """[page_id, host, path, rule, score, verdict], one row per page.

    The longest rule that fits decides; where none fits, the models do: allow from the calibrated threshold on. Null
    URLs and URLs without '://' have empty host and path, fit no rule and score 0. Null page ids and repeated rows keep
    their rows; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    parted = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = parted.withColumn("_fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("text", _text_of(F.col("host"), F.col("path")))
    model = fit(ruled.filter("_fit IS NOT NULL").select("text", (F.col("_fit.verdict") == "allow").alias("allowed")))
    own = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return scores(ruled, model).select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), "score", F.coalesce("_fit.verdict", own).alias("verdict")
    )
