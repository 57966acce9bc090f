"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import ship

SAMPLE = 6000  # rows of each kind, positive and unlabelled, that the classifier is fitted on, about
HIDDEN, STEPS, RATE, DECAY = 16, 600, 0.02, 1e-4
THRESHOLD = 0.7
CONFIDENCE, LEAST_PRIOR, PRIOR_ROUNDS = 0.1, 0.02, 2  # of the estimated class prior
UPPER, LOWER, DIGIT, SPACE, BREAK, SENTENCE, MARK, WIDE = range(8)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[128:] = WIDE
    kinds[ord("A") : ord("Z") + 1] = UPPER
    kinds[ord("a") : ord("z") + 1] = LOWER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[[0x20, 0x09]] = SPACE
    kinds[[0x0A, 0x0D]] = BREAK
    kinds[[ord(c) for c in ".,;:'-"]] = SENTENCE
    return kinds


def features(text: str | None, kinds: np.ndarray) -> list[float]:
    """Shares and lengths that describe how a whole text is written, whatever its language."""
    body = text or ""
    data = body.encode()
    n = max(len(data), 1)
    shares = np.bincount(kinds[np.frombuffer(data, np.uint8)], minlength=8)[:8] / n
    words = body.split()
    m = max(len(words), 1)
    lines = [x for x in body.split("\n") if x.strip()]
    k = max(len(lines), 1)
    again = sum(a == b for a, b in zip(words, words[1:]))
    distinct = len(set(words))
    return [
        *shares.tolist(),
        float(np.log1p(len(words))) / 10,
        sum(map(len, words)) / m / 10,
        again / m,
        distinct / m,
        distinct / m**0.7,
        (len(set(lines)) / k),
        float(np.log1p(len(words) / k)) / 5,
        len(zlib.compress(data, 1)) / n if data else 1.0,
        1.0 if words else 0.0,
    ]


WIDTH = 17


class Network:
    """A small network with one hidden layer over standardised features."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def risk(
    margin: np.ndarray, weight_positive: np.ndarray, weight_unlabelled: np.ndarray, prior: float
) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk with the logistic loss, and the slope by the margins that a step goes against.

    The risk is ``prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)])``. Where the second part
    turns negative, the step goes against its gradient, so that the network unlearns what it has overfitted.
    """
    p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    weight_rest = weight_unlabelled - prior * weight_positive
    rest = float(weight_rest @ np.logaddexp(0, margin))
    value = prior * float(weight_positive @ np.logaddexp(0, -margin)) + max(0.0, rest)
    # by the margin the losses grow with p - 1 as positive, p as negative
    slope = prior * weight_positive * (p - 1) + weight_rest * p if rest >= 0 else -weight_rest * p
    return value, slope


def gradients(model: Network, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
    """How a risk with these slopes by the margins grows with the network's parameters, with weight decay."""
    back = np.outer(slope, model.w2) * (1 - hidden**2)
    return {
        "w1": x.T @ back + DECAY * model.w1,
        "b1": back.sum(axis=0),
        "w2": hidden.T @ slope + DECAY * model.w2,
        "b2": slope.sum(),
    }


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """The network that minimises :func:`risk`."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    model = Network(
        mean, scale, rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
    )
    x = np.clip((both - mean) / scale, -8, 8)
    of_positive = np.arange(len(both)) < len(positive)
    weight_positive = np.where(of_positive, 1 / len(positive), 0)
    weight_unlabelled = np.where(of_positive, 0, 1 / len(unlabelled))
    names = ("w1", "b1", "w2", "b2")
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    for step in range(1, STEPS + 1):
        hidden = np.tanh(x @ model.w1 + model.b1)
        _, slope = risk(hidden @ model.w2 + model.b2, weight_positive, weight_unlabelled, prior)
        for k, g in gradients(model, x, hidden, slope).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, getattr(model, k) - RATE * move)
    return model


def share_of_positives(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of unlabelled values that come from the distribution of the positive ones, from above.

    Above any threshold the unlabelled part is at least the share times the positive part, so the least ratio of the two
    tails bounds it. A term for the error of both empirical tails keeps thresholds out that few positives reach.
    """
    thresholds = np.sort(np.concatenate([positive, unlabelled]))
    tail_positive = 1 - np.searchsorted(np.sort(positive), thresholds) / len(positive)
    tail_unlabelled = 1 - np.searchsorted(np.sort(unlabelled), thresholds) / len(unlabelled)
    error = np.sqrt(np.log(4 / CONFIDENCE) / (2 * len(positive))) + np.sqrt(np.log(4 / CONFIDENCE) / (2 * len(unlabelled)))
    reached = tail_positive > 0
    bound = (tail_unlabelled[reached] + error) / tail_positive[reached]
    best = np.argmin(bound)
    return float(min(1.0, tail_unlabelled[reached][best] / tail_positive[reached][best]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from positive and unlabelled rows alone.

    Networks are fitted to one half of each with the share found so far (first one half); the tails of their margins on
    the other halves bound the share anew. The mean over both ways is taken, and the whole is done PRIOR_ROUNDS times.
    """
    prior = 0.5
    if min(len(positive), len(unlabelled)) < 4:
        return prior
    for _ in range(PRIOR_ROUNDS):
        found = []
        for side in (0, 1):
            model = fit(positive[side::2], unlabelled[side::2], prior)
            margins = [model.margin(rows[1 - side :: 2]) for rows in (positive, unlabelled)]
            found.append(share_of_positives(*margins))
        prior = float(np.clip(np.mean(found), LEAST_PRIOR, 1 - LEAST_PRIOR))
    return prior


def train(
    df: DataFrame,
    labels: DataFrame,
    learn: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Network:
    """A classifier from trusted positives (``label`` 1), unlabelled texts and the estimated class prior.

    ``learn`` is a condition on ``doc_id`` that both the labels and the texts must meet. About ``sample``
    positives and as many unlabelled texts are chosen by a hash of the id; their whole texts are described
    where they lie, and only features come to the driver. The prior is estimated from both by :func:`class_prior`;
    other labels than 1 are not used. Without any positive text, every text gets one half as score.
    """
    ship(df.sparkSession)
    marked = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    marked = marked.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    positives = marked.where(F.col("_label") == 1).count()
    space = 1 << 30

    def chosen(column: str, seed: int, total: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(space)) < int(min(1.0, sample / max(total, 1)) * space)

    trusted = marked.where((F.col("_label") == 1) & chosen("_id", 1, positives)).select("_id", F.lit(True).alias("_positive"))
    texts = df.where(learn).select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    # trusted has about `sample` rows
    rows = (
        texts.withColumn("_unlabelled", F.coalesce(chosen("_id", 2, df.count()), F.lit(False)))
        .join(F.broadcast(trusted), "_id", "left")
        .where(F.col("_unlabelled") | F.col("_positive"))
    )

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = _byte_kinds()
        for batch in batches:
            x = [features(t, kinds) for t in batch["_text"]]
            yield pd.DataFrame({"p": batch["_positive"].eq(True), "u": batch["_unlabelled"], "x": x})

    found = rows.select("_text", "_positive", "_unlabelled").mapInPandas(describe, "p boolean, u boolean, x array<double>")
    # in an order that does not depend on the partitions
    found = sorted(found.collect(), key=lambda r: (r["x"], r["p"], r["u"]))
    x = np.array([r["x"] for r in found], float).reshape(-1, WIDTH)
    p, u = np.array([r["p"] for r in found], bool), np.array([r["u"] for r in found], bool)
    if not p.any():
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    # in a fixed random order, so that the halves of the prior's estimate are alike
    mixed = np.random.default_rng(11).permutation(len(x))
    x, p, u = x[mixed], p[mixed], u[mixed]
    unlabelled = x[u] if u.any() else x[p]
    return fit(x[p], unlabelled, class_prior(x[p], unlabelled))


def score(df: DataFrame, model: Network, text: str = "text") -> DataFrame:
    """``df`` with ``score``: how likely each whole text is of good quality, from 0 to 1.

    Null counts as empty; empty texts are scored as well. A column of that name is replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kinds = _byte_kinds()
        for batch in batches:
            x = np.array([features(t, kinds) for t in batch], float).reshape(-1, WIDTH)
            yield pd.Series(model.score(x))

    return df.withColumn("score", run(F.col(text).cast("string")))


def classify(
    df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (1 from a score of THRESHOLD), fitted on ``labels``.

    Ids and labels are never inputs of a score. Null ids are not learnt from; ids labelled more than once
    count once, with the worst label. Repeated rows get the same score. Null labels are ignored, empty
    inputs give empty results, and columns named ``score`` or ``predicted`` are replaced.
    """
    scored = score(df, train(df, labels, learn, text, doc_id, label), text)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
