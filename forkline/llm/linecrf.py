"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. What speaks for a label are features of the
line and of its two neighbours (kinds of characters, lengths, repeated words, lines equal to
an earlier one) and the label of the line before. A document's quality is the mean of its
lines' marginal probabilities of being good, weighted by their lengths, put through a
logistic curve that makes it a probability.

Learning. The field is fitted on at most ``SAMPLE`` labelled documents of each label, the
first by a hash of their ids, with at most ``MAX_LINES`` lines each (only in the sample;
scoring takes every line of every text). Each line of such a document bears the document's
label. Only features and labels of the sample reach the driver. The gradient is exact:
observed less expected counts, from forward and backward sums.

Scoring is one pass over the texts. Sequences of a batch run side by side, longest first.

Nulls: a null text has no lines and is scored like an empty one, by the curve at the share
of good documents. Rows without a label, a null label or a null id do not take part in
learning; a null id counts as not held out. If the sample lacks one of the two labels, every
score is the share of good ones in it, or a half if it is empty. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 2000
MAX_LINES = 400
STEPS = 150
PENALTY = 1e-3

_LOWER, _UPPER, _DIGIT, _BLANK, _SYMBOL, _MARK, _STOP, _OTHER = range(8)
_CLASSES = np.full(256, _STOP, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\n\x0b\f\r", _BLANK), (b"#*$%&|<>", _SYMBOL), (b"!?=~_^\\@{}[]+/", _MARK)):
    _CLASSES[np.frombuffer(_chars, np.uint8)] = _kind
_CLASSES[128:] = _OTHER

#: Steps of the shares: each feature is 1 above its step.
_STEPS = {
    "upper": (0.04, 0.1, 0.3, 0.6),
    "digit": (0.0, 0.05, 0.2),
    "symbol": (0.0, 0.02, 0.08, 0.2),
    "mark": (0.0, 0.02, 0.08, 0.2),
    "stop": (0.0, 0.03, 0.08, 0.2),
    "other": (0.0, 0.2),
    "distinct": (0.3, 0.5, 0.7, 0.85, 0.95),
    "word": (3.0, 4.0, 4.5, 5.5, 6.5, 8.0),
    "words": (1.5, 3.5, 8.5, 20.5, 60.5),
    "again": (0.5,),
}
OWN = 1 + sum(map(len, _STEPS.values()))
WIDTH = 3 * OWN


def lines_of(text: str | None) -> tuple[list[bytes], list[int], list[float], list[float]]:
    """Lines with a word, their numbers of words, shares of distinct words, and repeats."""
    lines, counts, distinct, again = [], [], [], []
    seen: set[bytes] = set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            lines.append(line)
            counts.append(len(words))
            distinct.append(len(set(words)) / len(words))
            again.append(float(line in seen))
            seen.add(line)
    return lines, counts, distinct, again


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, lengths of the lines, and how many lines each text has."""
    lines: list[bytes] = []
    counts: list[int] = []
    distinct: list[float] = []
    again: list[float] = []
    sizes = []
    for text in texts:
        a, b, c, d = lines_of(text)
        lines += a
        counts += b
        distinct += c
        again += d
        sizes.append(len(a))
    n = len(lines)
    if not n:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), np.array(sizes, np.int64)
    lengths = np.fromiter(map(len, lines), np.int64, n)
    kinds = _CLASSES[np.frombuffer(b"".join(lines), np.uint8)]
    starts = np.cumsum(lengths) - lengths
    count = {k: np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int64) for k in (_UPPER, _DIGIT, _BLANK, _SYMBOL, _MARK, _STOP, _OTHER)}
    visible = np.maximum(1, lengths - count[_BLANK])
    share = lambda k: count[k] / visible
    words = np.array(counts, float)
    values = {
        "upper": share(_UPPER),
        "digit": share(_DIGIT),
        "symbol": share(_SYMBOL),
        "mark": share(_MARK),
        "stop": share(_STOP),
        "other": share(_OTHER),
        "distinct": np.array(distinct),
        "word": visible / words,
        "words": words,
        "again": np.array(again),
    }
    own = np.zeros((n, OWN), np.float32)
    own[:, 0] = 1
    at = 1
    for name, steps in _STEPS.items():
        for step in steps:
            own[:, at] = values[name] > step
            at += 1
    full = np.zeros((n, WIDTH), np.float32)
    full[:, :OWN] = own
    ends = np.cumsum(sizes)
    inner = np.ones(n, bool)
    begins = ends - sizes
    inner[begins[np.array(sizes) > 0]] = False  # first lines have none before them
    full[1:, OWN : 2 * OWN] = own[:-1] * inner[1:, None]
    full[:-1, 2 * OWN :] = own[1:] * inner[1:, None]
    return full, visible.astype(float), np.array(sizes, np.int64)


@dataclass
class Field:
    """Weights of the label good over bad, by feature, and of pairs of labels."""

    weights: np.ndarray
    pairs: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)
    constant: float | None = None


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first: their order, their first line, and how many reach each step."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    return order, starts, active


def marginals(field: Field, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected pairs of labels, and the sum of log partition functions."""
    scores = x @ field.weights
    unary = np.stack([np.zeros_like(scores), scores], 1).astype(np.float64)
    trans = np.exp(field.pairs)
    _, starts, active = _lanes(sizes)
    # Scaled sums: each step is normalised, the logarithms of the scales add up.
    peak = unary.max(1, keepdims=True)
    local = np.exp(unary - peak)
    forward, backward = np.zeros_like(local), np.zeros_like(local)
    logs = float(peak.sum())
    for t, k in enumerate(active.tolist()):
        at = starts[:k] + t
        a = local[at] if t == 0 else (forward[at - 1] @ trans) * local[at]
        z = a.sum(1, keepdims=True)
        logs += float(np.log(z).sum())
        forward[at] = a / z
    after = np.append(active[1:], 0) if len(active) else active
    for t in range(len(active) - 1, -1, -1):
        k, longer = int(active[t]), int(after[t])
        at = starts[:k] + t
        b = np.ones((k, 2))
        if longer:
            onward = at[:longer] + 1
            b[:longer] = (local[onward] * backward[onward]) @ trans.T
        backward[at] = b / b.sum(1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    expected = np.zeros((2, 2))
    last = np.cumsum(sizes)[sizes > 0] - 1
    has_next = np.ones(len(good), bool)
    has_next[last] = False
    first = np.flatnonzero(has_next)
    if len(first):
        joint = forward[first][:, :, None] * trans[None] * (local[first + 1] * backward[first + 1])[:, None, :]
        expected = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return good, expected, logs


def document_scores(field: Field, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, empty: float = 0.5) -> np.ndarray:
    """The weighted mean of marginals of every document, before the curve; ``empty`` without lines."""
    if not len(x):
        return np.full(len(sizes), empty)
    good, _, _ = marginals(field, x, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.bincount(owner, lengths, len(sizes))
    total = np.bincount(owner, lengths * good, len(sizes))
    return np.where(weight > 0, total / np.maximum(weight, 1), empty)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, labels: np.ndarray, prior: float, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """The field of greatest likelihood (Adam on the exact gradient), and its curve."""
    rows = np.repeat(labels, sizes)
    n = max(1, len(rows))
    # Documents count alike, however many lines they have.
    observed = np.zeros((2, 2))
    np.add.at(observed, (labels, labels), np.maximum(0, sizes - 1))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    for step in range(1, steps + 1):
        good, expected, _ = marginals(field, x, sizes)
        grad = np.concatenate([x.T @ (rows - good), (observed - expected).ravel()]) / n - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    raw = _logit(document_scores(field, x, lengths, sizes))
    # The sample holds as many of both labels as there are; weights bring back their shares.
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton steps with a ridge
        p = _sigmoid(a + b * raw)
        g = np.array([(weight * (labels - p)).sum(), (weight * (labels - p) * raw).sum() - 0.1 * (b - 0.5)])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[w.sum(), (w * raw).sum()], [(w * raw).sum(), (w * raw * raw).sum() + 0.1]])
        move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a + float(np.clip(move[0], -2, 2)), b + float(np.clip(move[1], -0.5, 0.5))
    field.curve = (a, max(b, 1e-3))
    return field


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x, lengths, sizes = features(batch["text"].tolist())
        ends = np.cumsum(sizes)
        kept = [i for i in range(len(sizes)) if sizes[i] <= MAX_LINES]
        yield pd.DataFrame(
            {
                "id": batch["id"].to_numpy()[kept],
                "label": batch["label"].to_numpy()[kept],
                "x": [np.packbits(x[ends[i] - sizes[i] : ends[i]].astype(bool)).tobytes() for i in kept],
                "lengths": [lengths[ends[i] - sizes[i] : ends[i]].astype("<f4").tobytes() for i in kept],
            }
        )


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field:
    """The field of the first ``sample`` labelled documents of each label by a hash of their ids.

    Documents of more than ``MAX_LINES`` lines take no part in the fit, though all are scored; if that
    leaves no document of one label, the score is the share of good labels. Rows that repeat an id
    in full count once.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), constant=0.5)
    prior = shares.get(1, 0) / sum(shares.values())
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # At most twice ``sample`` small rows: a bound that no table moves.
    joined = rows.join(F.broadcast(picked), "id").select(F.col("id").cast("string").alias("id"), "label", "text")
    rows_of = joined.mapInPandas(_sampled, "id string, label int, x binary, lengths binary").distinct()
    # Ids that repeat with other texts may give more rows; those of the smallest hashes are taken.
    found = rows_of.orderBy(F.xxhash64("id", "x"), "id", "label", "x", "lengths").limit(4 * sample).toPandas()
    sizes = np.array([len(b) // 4 for b in found["lengths"]], np.int64)
    y = found["label"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), constant=prior)
    order = sorted(range(len(y)), key=lambda i: (y[i], sizes[i], found["x"][i], found["lengths"][i]))  # rows come in any order
    parts = [np.unpackbits(np.frombuffer(found["x"][i], np.uint8), count=int(sizes[i]) * WIDTH).reshape(-1, WIDTH) for i in order]
    x = np.concatenate(parts).astype(np.float32)
    lengths = np.concatenate([np.frombuffer(found["lengths"][i], "<f4") for i in order]).astype(float)
    return fit(x, lengths, sizes[order], y[order], prior)


def _scored(field: Field):
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            scores = []
            start = size = 0
            for stop in range(1, len(values) + 1):  # groups of some 4 MB of text
                size += len(values[stop - 1] or "")
                if size > 1 << 22 or stop == len(values):
                    scores.append(score_texts(field, values[start:stop]))
                    start, size = stop, 0
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    return rows


def score_texts(field: Field, texts: list[str | None]) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(texts), field.constant)
    raw = document_scores(field, *features(texts))
    return _sigmoid(field.curve[0] + field.curve[1] * _logit(raw))


def quality_scores(docs: DataFrame, field: Field, text: str = "text") -> Column:
    """The probability that a text is good."""
    return F.pandas_udf(_scored(field), "double")(F.col(text))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    field = learn(docs, labels.filter(remainder != 1))
    scored = docs.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), quality_scores(docs, field).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
