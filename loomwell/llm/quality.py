"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; everything else the model sees is unlabelled web
text, good and bad mixed. With a class prior p (the share of good text), the risk over the unknown
negatives is what the unlabelled rows cost as negatives less p times what the positives would cost as
negatives. The sum

    p * E_pos[loss(f, +1)] + max(0, E_unl[loss(f, -1)] - p * E_pos[loss(f, -1)])

is the non-negative unbiased risk; where the second term falls below zero, only its gradient is taken,
reversed, so that the model cannot drive it down by memorising. f is a small network over measures of
the text alone, trained in numpy on bounded samples; scoring reads every whole text.

The prior is estimated from the same two samples, without any bad row: a network is fitted to tell positives
from unlabelled rows, each row is scored by one that has not seen it, and of all scores c the share of
unlabelled rows at or above c is divided by that of positives. Where hardly any bad row scores that high, the
quotient is the share of good ones; the c with the least upper confidence bound of the quotient is taken.
Scores are shifted so that this share of the unlabelled sample reaches ``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Adam, Words, fields, is_held_out, is_training, labelled_sample, sigmoid, sliced, spread, utf8, with_columns

#: Bounds of the training samples, in rows.
POSITIVES = 4000
UNLABELLED = 8000
#: Parts of the samples of which each is scored by a network of the others, to estimate the prior.
FOLDS = 5
HIDDEN = 24
THRESHOLD = 0.7

# Kinds of bytes: lower, upper, digit, blank, newline, sentence mark, other mark, beyond ASCII.
_KIND = np.full(256, 6, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 3, 4
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 5
N_FEATURES = 8 + 64 + 128 + 8


def features(texts: list[bytes]) -> np.ndarray:
    """One row of measures for each text: shares of byte kinds, of pairs of kinds and of ASCII bytes, then
    lengths of words and lines, and how far words and pairs of words repeat. An empty text has zeros."""
    words = Words(texts)
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    sizes = np.maximum(1, np.diff(np.concatenate([[0], words.text_ends])))
    h = words.hashes()
    n_words = np.maximum(1, words.per_text)

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        by = np.lexsort((values, of))
        v, o = values[by], of[by]
        first = np.ones(len(v), dtype=bool)
        first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[first], minlength=len(texts))

    pair = (words.text_of[1:] == words.text_of[:-1]) if len(h) else np.zeros(0, dtype=bool)
    pairs = (h[:-1] * np.uint64(31) + h[1:])[pair]
    n_pairs = np.maximum(1, np.bincount(words.text_of[1:][pair], minlength=len(texts)))
    lengths = (words.ends - words.starts).astype(np.float64)
    mean = np.bincount(words.text_of, lengths, len(texts)) / n_words
    spread_ = np.bincount(words.text_of, lengths**2, len(texts)) / n_words - mean**2
    start = 0
    for i, end in enumerate(words.text_ends.tolist()):
        raw = words.raw[start:end]
        if len(raw):
            kinds = _KIND[raw]
            out[i, :8] = np.bincount(kinds, minlength=8)
            out[i, 8:72] = np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64)
            out[i, 72:200] = np.bincount(raw, minlength=256)[:128]
        start = end
    out[:, :200] = np.sqrt(out[:, :200] / sizes[:, None])
    lines = out[:, 4] ** 2 * sizes + 1
    out[:, 200:] = np.stack(
        [
            np.log1p(sizes), mean, np.sqrt(np.maximum(0, spread_)), distinct(h, words.text_of) / n_words,
            distinct(pairs, words.text_of[1:][pair]) / n_pairs, np.log1p(sizes / lines), np.log1p(words.per_text), words.per_text / sizes,
        ],
        axis=1,
    )
    out[[i for i, t in enumerate(texts) if not t]] = 0
    return out


def _collected(rows: DataFrame, limit: int) -> np.ndarray:
    """Features of the ``limit`` rows (text, u) with the least u, made on the executors before anything moves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            yield with_columns(part, ["u"], f=pa.array([r.tobytes() for r in features(utf8(part.column("text")))], pa.binary()))

    got = rows.select("text", "u").mapInArrow(run, "u double, f binary").orderBy("u", "f").limit(limit).toArrow()
    found = [np.frombuffer(x, dtype=np.float32) for x in got.column("f").to_pylist()]
    return np.array(found, dtype=np.float64).reshape(len(found), N_FEATURES)


class Model:
    """A one-layer network on standardised measures; ``logit`` is the log-odds of good text."""

    def __init__(self, n: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre, self.scale = np.zeros(n), np.ones(n)
        self.w1 = rng.normal(0, 1 / np.sqrt(n), (n, hidden))
        self.b1 = np.zeros(hidden)
        self.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
        self.b2 = np.zeros(1)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 1500, batch: int = 384, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11) -> Model:
        """Minimise the risk of the given prior; without one, tell positives from unlabelled rows, as many of each."""
        rng = np.random.default_rng(seed)
        both = np.concatenate([positive, unlabelled])
        self.centre, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        positive, unlabelled = self._standard(positive), self._standard(unlabelled)
        self.b2[:] = np.log(prior / (1 - prior)) if prior else 0
        adam = Adam([self.w1, self.b1, self.w2, self.b2], rate)
        for _ in range(steps):
            p = positive[rng.integers(0, len(positive), batch)]
            u = unlabelled[rng.integers(0, len(unlabelled), batch)]
            x = np.concatenate([p, u])
            hidden = np.tanh(x @ self.w1 + self.b1)
            f = hidden @ self.w2 + self.b2[0]
            s = sigmoid(f)
            # Logistic loss: loss(f, +1) = log(1 + e^-f), with slope s - 1; loss(f, -1) has slope s.
            slope = np.concatenate([s[:batch] - 1, s[batch:]]) / (2 * batch)
            if prior:
                as_negative = np.logaddexp(0, f)
                rest = as_negative[batch:].mean() - prior * as_negative[:batch].mean()
                negative = np.concatenate([-prior * s[:batch], s[batch:]]) / batch
                if rest >= 0:
                    slope = negative
                    slope[:batch] += prior * (s[:batch] - 1) / batch
                else:
                    slope = -negative
            down = np.outer(slope, self.w2) * (1 - hidden**2)
            adam.step([x.T @ down + decay * self.w1, down.sum(axis=0), hidden.T @ slope + decay * self.w2, np.array([slope.sum()])])
        return self


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = FOLDS, seed: int = 5) -> float:
    """The share of rows like ``positive`` among ``unlabelled``, from 0.05 to 0.95."""
    rng = np.random.default_rng(seed)
    of = [rng.permutation(len(x)) % folds for x in (positive, unlabelled)]
    if min(len(positive), len(unlabelled)) < folds:
        return 0.5
    own, web = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(folds):
        model = Model(positive.shape[1], HIDDEN).fit(positive[of[0] != k], unlabelled[of[1] != k], None, steps=300, decay=1e-2)
        own[of[0] == k], web[of[1] == k] = model.logit(positive[of[0] == k]), model.logit(unlabelled[of[1] == k])
    c = np.sort(own)[::-1]
    of_own = np.arange(1, len(c) + 1) / len(c)
    of_web = 1 - np.searchsorted(np.sort(web), c, side="left") / len(web)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(own)) + 1 / np.sqrt(len(web)))
    best = int(np.argmin((of_web + slack) / of_own))
    return float(np.clip(of_web[best] / of_own[best], 0.05, 0.95))


def learn(docs: DataFrame, labels: DataFrame, training: Column, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fit on at most ``positives`` trusted rows and ``unlabelled`` others of the training fold.

    Labels of bad rows are not read. The prior is estimated, unless given. None if there are no positives or
    nothing unlabelled.
    """
    trusted = labels.where(F.col("quality") == 1)
    p = _collected(labelled_sample(docs, trusted, "quality", training, positives), positives)
    web = docs.where(training)
    n = web.count()
    web = web.select("text", spread(F.col("doc_id"), 2).alias("u")).where(F.col("u") < 1.2 * unlabelled / max(1, n))
    u = _collected(web, unlabelled)
    if not len(p) or not len(u):
        return None
    prior = prior or estimate_prior(p, u)
    model = Model(N_FEATURES, HIDDEN).fit(p, u, prior)
    model.b2 += np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(model.logit(u), 1 - prior)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` followed by ``score`` (0 to 1, higher: better text); without a model it is 0.5.

    Null text is empty, and empty text is scored. Equal texts have equal scores; repeats are scored each for
    itself; texts may be of any length; no rows give no rows. A column named score is replaced, others pass through.
    """
    docs = docs.drop("score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in sliced(parts):
            texts = utf8(part.column("text"))
            values = sigmoid(own.logit(features(texts))) if own else np.full(len(texts), 0.5)
            yield with_columns(part, names, score=pa.array(values, pa.float64()))

    return docs.mapInArrow(run, f"{fields(docs)}score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` for every row of ``docs``, by a model of its training rows and their good labels.

    Null ids are neither held out nor learnt from. Rows that repeat or share an id are judged each for itself; columns
    besides doc_id and text are not read, whatever their names. No rows give no rows.
    """
    model = learn(docs, labels, is_training(F.col("doc_id"), 4, 2))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
