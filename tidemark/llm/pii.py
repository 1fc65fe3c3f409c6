"""Personal data by weak supervision.

Exact patterns give base spans, which always count. Looser patterns give candidates. Labelers that look at a candidate's
form, at gazetteers, at its context, at its value and at its surroundings vote personal (1), not personal (-1) or abstain
(0). Expectation-maximisation over the counts of all vote patterns estimates how reliable each labeler is and how likely each
candidate is; a logistic regression trained on these likelihoods then classifies every candidate span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the results; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
LABELERS = ("form", "gazetteer", "context", "value", "surroundings")
#: Spans whose probability of being personal is at least this are added.
ACCEPT = 0.8
#: Characters before and after a candidate in which cue words count.
CONTEXT = 48

# Cue words (four languages), top-level domains, country calling codes, card issuer prefixes.
CUES = {
    "email": "email e-mail mail correo courriel contact contacto kontakt write reply",
    "ip": "ip ipv4 address adresse host server client peer login dirección",
    "card": "card visa mastercard amex credit debit tarjeta carte karte kreditkarte payment pay cvv expires",
    "phone": "phone tel telephone telefon teléfono téléphone mobile móvil handy cell fax call anrufen llamar appeler whatsapp",
    "iban": "iban account konto cuenta compte bank transfer",
}
AGAINST = "version release isbn issn invoice order ticket page chapter section figure table serial model sku build revision id"
DOMAINS = "com org net edu gov mil int info biz io co me de fr es uk us eu it nl ch at be pt pl se no dk fi ie ca mx ar br au nz jp in example"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 60 62 64 65 35"

# Base patterns. The look-behinds change no match (a longer start would have been taken); they stop
# the search from trying every digit of a long number again.
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose patterns. All of them have bounded repeats, so no text makes them slow.
_LOOSE = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "email": re.compile(
        r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,24}){1,4}(?![\w-])"
    ),
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ .\-/]{1,2}[0-9]{4}){2}[ .\-/]{1,2}[0-9]{1,7}(?![\w])"),
    "phone": re.compile(r"(?<![\w.+/-])(?:\(?(?:00|0)[0-9]{1,3}\)?|\([0-9]{2,4}\)|[0-9]{3})(?:[ .\-/][0-9]{2,5}){2,4}(?![\w])"),
}
_HINT = re.compile(r"[0-9@]|[\(\[\{]at[\)\]\}]| at ")
_CUE = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.I) for k, v in CUES.items()}
_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST.split()) + r")\b|[#№]", re.I)
_DOMAINS, _CALLING, _ISSUERS = (frozenset(x.split()) for x in (DOMAINS, CALLING, ISSUERS))
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; code points, end exclusive."""
    out = []
    last = 0
    if "@" in text:
        for tail in _TAIL.finditer(text):
            at = start = tail.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, tail.end()))
                last = tail.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def votes(kind: int, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """What each of LABELERS says about a span: 1, 0 or -1."""
    name, span = KINDS[kind], text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT // 2]
    form = 1 if base else 0
    gazetteer = value = 0
    if name == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in _DOMAINS else -1
        value = 0 if base else 1 if re.search(r"@|[\(\[\{]at", span) else 0 if " dot " in span else -1
    elif name == "ip":
        first = int(span.split(".")[0].lstrip("0") or 0)
        gazetteer = 1 if 1 <= first <= 223 else -1
        value = -1 if re.search(r"(?:^|\.)0[0-9]", span) else 1
    elif name == "card":
        gazetteer = 1 if digits[:1] in _ISSUERS or digits[:2] in _ISSUERS else -1
        value = 1 if 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 2 else -1
    elif name == "phone":
        code = digits.lstrip("0")
        gazetteer = 1 if span[0] in "+0(" and (code[:1] in _CALLING or code[:2] in _CALLING) else -1
        value = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
    else:
        letters = "".join(str(int(c, 36)) for c in (span[4:] + span[:4]).replace(" ", ""))
        form, value = 0, 1 if int(letters) % 97 == 1 else -1
        gazetteer = 0 if 15 <= len(span.replace(" ", "")) <= 34 else -1
    if any(k != name and _CUE[k].search(before) for k in ("card", "phone")) and name in ("card", "phone"):
        context = -1
    else:
        context = 1 if _CUE[name].search(before) else -1 if _AGAINST.search(before[-16:]) else 0
    beside = (before[-1:], after[:1])
    surroundings = -1 if any(c and (c.isalnum() or c in "_/\\=") for c in beside) else 1 if all(not c or c.isspace() or c in ".,;:!?()<>\"'" for c in beside) else 0
    return form, gazetteer, context, value, surroundings


def candidates(text: str) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, base, votes): base spans, and loose matches that touch no base span or earlier candidate."""
    if not _HINT.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, b, True, votes(k, text, a, b, True)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    for name, pattern in _LOOSE.items():
        found = []
        for m in pattern.finditer(text):
            a, b = m.span()
            at = bisect_left(taken, (b, 0)) if taken else 0
            if any(y > a for _, y in taken[max(0, at - 2) : at]):
                continue
            found.append((a, b))
            kind = KINDS.index(name)
            out.append((kind, a, b, False, votes(kind, text, a, b, False)))
        if found:
            taken = sorted(taken + found)
    return sorted(out)


# --- label model --------------------------------------------------------------------------------


@dataclass
class Model:
    """Reliability of each labeler by kind, P(vote | personal or not), and the classifier's weights."""

    reliability: dict[int, np.ndarray] = field(default_factory=dict)  # kind -> [labeler, class, vote + 1]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_width()))

    def probability(self, kind: int, ballot: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(_inputs(np.array([kind]), np.array([ballot])) @ self.weights, -40, 40)))[0])

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans of a text, each by kind, then start."""
        found = candidates(text)
        base = [(k, a, b) for k, a, b, is_base, _ in found if is_base]
        every = [(k, a, b) for k, a, b, is_base, ballot in found if is_base or self.probability(k, ballot) >= ACCEPT]
        return base, every


def _width() -> int:
    return len(KINDS) + 2 * len(LABELERS) + 1


def _inputs(kinds: np.ndarray, ballots: np.ndarray) -> np.ndarray:
    """Kind, each labeler's yes and no, and whether more labelers say yes than no."""
    lead = (ballots == 1).sum(1) > (ballots == -1).sum(1)
    return np.hstack([np.eye(len(KINDS))[kinds], ballots == 1, ballots == -1, lead[:, None]]).astype(np.float64)


def reliabilities(ballots: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: P(vote | class) of each labeler, and P(personal | votes) of each row.

    Starts from the majority. Each class has a weak prior for votes on its side, which keeps the classes from
    changing places and settles what one-sided data leave open.
    """
    balance = ballots.sum(1)
    likely = 1 / (1 + np.exp(-1.5 * balance))
    prior = np.array([[2.0, 1.5, 1.0], [1.0, 1.5, 2.0]])  # class x vote
    for _ in range(rounds):
        chance = np.empty((ballots.shape[1], 2, 3))
        for vote in (-1, 0, 1):
            cast = ballots == vote
            chance[:, 1, vote + 1] = (cast * (counts * likely)[:, None]).sum(0) + prior[1, vote + 1]
            chance[:, 0, vote + 1] = (cast * (counts * (1 - likely))[:, None]).sum(0) + prior[0, vote + 1]
        chance /= chance.sum(2, keepdims=True)
        share = ((counts * likely).sum() + 2) / (counts.sum() + 4)
        logs = np.log(chance[np.arange(ballots.shape[1])[None], :, ballots + 1]).sum(1) + np.log([1 - share, share])
        now = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -40, 40)))
        if np.abs(now - likely).max() < 1e-9:
            break
        likely = now
    return chance, likely


def train(rows: list[tuple[int, tuple[int, ...], int]]) -> Model:
    """rows: kind, votes, how many candidates. At most len(KINDS) x 3 ** len(LABELERS) rows."""
    model = Model()
    if not rows:
        rows = []
    rows = sorted(rows)
    kinds = np.array([k for k, _, _ in rows], np.int64)
    ballots = np.array([b for _, b, _ in rows], np.int64).reshape(len(rows), len(LABELERS))
    counts = np.array([n for _, _, n in rows], np.float64)
    likely = np.zeros(len(rows))
    for kind in np.unique(kinds).tolist():
        own = kinds == kind
        model.reliability[kind], likely[own] = reliabilities(ballots[own], counts[own])
    inputs, theta = _inputs(kinds, ballots), _start()
    weight = np.log1p(counts)  # frequent patterns count more, but don't drown the others
    anchor = theta.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ theta, -40, 40)))
        slope = inputs.T @ (weight * (likely - p)) - (theta - anchor)
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + np.eye(len(theta))
        theta = theta + np.linalg.solve(curve, slope)
    model.weights = theta
    return model


def _start() -> np.ndarray:
    """Weights before any evidence: each yes speaks for, each no against, and silence against."""
    return np.concatenate([np.full(len(KINDS), -2.0), np.full(len(LABELERS), 1.0), np.full(len(LABELERS), -1.5), [0.5]])


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The label model and classifier for the candidates of all documents; only counts of vote patterns leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for whole in batch.column(0).to_pylist():
                for kind, _, _, _, ballot in candidates(whole or ""):
                    seen[kind, ballot] = seen.get((kind, ballot), 0) + 1
        keys = list(seen)
        yield pa.record_batch(
            [
                pa.array([k for k, _ in keys], pa.int32()),
                pa.array([list(b) for _, b in keys], pa.list_(pa.int32())),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            ["kind", "votes", "n"],
        )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, votes array<int>, n long")
    rows = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return train([(r.kind, tuple(r.votes), r.n) for r in rows])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_DDL = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """[doc_id, base, spans]: base spans and all spans of each row, by kind as in KINDS, then start.

    Null and empty texts have none. Null ids, repeated rows and ties keep their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.spans(t or "") for t in batch.column(1).to_pylist()]
            lists = (pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[i]] for f in found], _SPANS) for i in (0, 1))
            yield pa.record_batch([batch.column(0), *lists], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {_SPANS_DDL}, spans {_SPANS_DDL}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of spans replaced by the kind that starts it, as in <EMAIL>."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with personal data in `text` replaced; all other columns, null texts and clean texts are unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        return pd.Series([None if t is None else redacted(t, shared.value.spans(t)[1]) for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
