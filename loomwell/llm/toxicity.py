"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the rows of one table that its spelling and its beginnings hash to, so
that words built on one stem share a part. Filters of several widths slide over the vectors, each
filter's greatest response in the text is kept where it is positive (max pooling, rectified), and a linear
layer gives the log-odds. Everything is trained in numpy on a bounded sample of labelled rows; scoring reads
every whole text.

Thresholds are calibrated by language on rows that took no part in fitting. A text's language is
guessed from its words alone, and the score is shifted so that its language's threshold is ``CUT``. What is
known of languages is kept for the words of the sample only, whose size bounds it, however many languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Adam, Words, fields, is_held_out, is_training, labelled_sample, sigmoid, sliced, utf8, with_columns

#: Bounds of the labelled sample, in rows, in characters of all its texts, and of one. Where the rows have more, the
#: longest give a piece from anywhere in them, of one length for all; no row is left out.
SAMPLE = 6000
SAMPLE_CHARS = 24 << 20
TEXT_CHARS = 1 << 20
#: Rows of the embedding table.
BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: The score at which a text counts as toxic.
CUT = 0.3
#: Bytes of a word's beginning that have a row of their own; None is the whole word.
PIECES = (4, 5, 6, 7, None)


def rows_of(words: Words) -> np.ndarray:
    """The table rows of each word, one column for each of ``PIECES``."""
    salted = [words.hashes(k) + np.uint64((0 if k is None else k) * 0x9E37) for k in PIECES]
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in salted], axis=1)


class Batch:
    """Words of several texts with blank rows behind each, so that no filter spans two texts.

    A text's filters begin at its words or at the first blank row behind them, where they see blanks alone.
    """

    def __init__(self, rows: np.ndarray, per_text: np.ndarray):
        gap = max(WIDTHS)
        sizes = per_text + gap
        self.first = np.cumsum(sizes) - sizes
        self.places = per_text + 1
        self.bounds = np.stack([self.first, self.first + self.places], axis=1).ravel()
        self.rows = rows
        self.place = np.arange(len(rows)) + np.repeat(gap * np.arange(len(per_text)), per_text)
        self.total = int(sizes.sum()) + gap


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.full(1, -2.0, dtype=np.float32)
        self.languages = Languages([], [])
        self.thresholds: dict[str, float] = {}
        self.threshold = CUT

    def vectors(self, batch: Batch) -> np.ndarray:
        v = np.zeros((batch.total, DIM), dtype=np.float32)
        own = self.table[batch.rows[:, 0]]
        for k in range(1, batch.rows.shape[1]):
            own += self.table[batch.rows[:, k]]
        v[batch.place] = own
        return v

    def pooled(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        v = self.vectors(batch)
        responses = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            z = v[: len(v) - w + 1] @ f[0]
            for j in range(1, w):
                z += v[j : len(v) - w + 1 + j] @ f[j]
            responses.append(z)
        pools = [np.maximum.reduceat(z, batch.bounds, axis=0)[::2] + b for z, b in zip(responses, self.bias)]
        return v, np.maximum(0, np.concatenate(pools, axis=1)), responses

    def logit(self, batch: Batch) -> np.ndarray:
        _, pooled, _ = self.pooled(batch)
        return pooled @ self.out + self.out_bias[0]

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, langs: list[str | None], epochs: int = 8, size: int = 64, seed: int = 5) -> Network:
        """``rows``: of each text, the table rows of its words."""
        rng = np.random.default_rng(seed)
        fold = rng.random(len(rows)) < 0.25  # calibration
        train = np.flatnonzero(~fold)
        self.languages = Languages(rows, langs)
        weight = np.where(labels == 1, max(1.0, 0.25 * (labels == 0).sum() / max(1, labels.sum())), 1.0)
        dense = [*self.filters, *self.bias, self.out, self.out_bias]
        adam, state = Adam(dense, 0.003), np.full((BUCKETS, 1), 1e-8, dtype=np.float32)
        for _ in range(epochs):
            for chosen in np.array_split(rng.permutation(train), max(1, len(train) // size)):
                self._step([rows[i] for i in chosen], labels[chosen], weight[chosen], adam, state)
        self._calibrate(rows, labels, langs, np.flatnonzero(fold))
        return self

    def gradients(self, batch: Batch, y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slopes of the mean weighted logistic loss: by filters, their biases, the output layer, and by the words' vectors."""
        v, pooled, responses = self.pooled(batch)
        slope = (weight * (sigmoid(pooled @ self.out + self.out_bias[0]) - y) / len(y)).astype(np.float32)
        down = np.outer(slope, self.out) * (pooled > 0)
        filters, d_v = [], np.zeros_like(v)
        for k, (w, f, z) in enumerate(zip(WIDTHS, self.filters, responses)):
            part = down[:, k * FILTERS : (k + 1) * FILTERS]
            best = np.stack([a + np.argmax(z[a : a + n], axis=0) for a, n in zip(batch.first, batch.places)])
            g = np.zeros_like(f)
            for j in range(w):
                at = best + j
                g[j] = np.einsum("nfd,nf->df", v[at], part)
                np.add.at(d_v, at.ravel(), (part[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            filters.append(g)
        biases = [down[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
        return [*filters, *biases, pooled.T @ slope, np.array([slope.sum()], dtype=np.float32)], d_v[batch.place]

    def _step(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, adam: Adam, state: np.ndarray) -> None:
        batch = Batch(np.concatenate(rows), np.array([len(r) for r in rows]))
        dense, d_own = self.gradients(batch, y, weight)
        adam.step(dense)
        moved = np.flatnonzero(np.abs(d_own).sum(axis=1))
        at = batch.rows[moved].ravel()
        step = np.repeat(d_own[moved], batch.rows.shape[1], axis=0)
        np.add.at(state[:, 0], at, (step**2).mean(axis=1))
        np.add.at(self.table, at, -0.05 * step / np.sqrt(state[at] + 1e-6))

    def _calibrate(self, rows: list[np.ndarray], labels: np.ndarray, langs: list[str | None], fold: np.ndarray) -> None:
        """The threshold with the best F1 for each language with ten toxic rows or more, else that of all rows."""
        if not len(fold):
            return
        scores = np.array([sigmoid(self.logit(Batch(rows[i], np.array([len(rows[i])]))))[0] for i in fold])
        y = labels[fold]
        self.threshold = _best_threshold(scores, y)
        for lang in self.languages.names:
            own = np.array([langs[i] == lang for i in fold])
            if own.any() and y[own].sum() >= 10:
                self.thresholds[lang] = _best_threshold(scores[own], y[own])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[str | None]]:
        """Scores, and the language whose threshold each took (None: no words)."""
        words = Words(texts)
        rows = rows_of(words)
        logits = self.logit(Batch(rows, words.per_text))
        guessed = self.languages.guess(rows, words.text_of, words.per_text)
        cuts = np.array([self.thresholds.get(g, self.threshold) for g in guessed])
        odds = lambda p: np.log(p / (1 - p))
        return sigmoid(logits - odds(cuts) + odds(CUT)), guessed


class Languages:
    """Word shares of languages, kept for the (word, language) pairs of the sample only, in order of the words' buckets."""

    def __init__(self, rows: list[np.ndarray], langs: list[str | None]):
        self.names = sorted({x for x, own in zip(langs, rows) if x and len(own)})
        at = {x: i for i, x in enumerate(self.names)}
        n = len(self.names)
        known = [own[:, -1].astype(np.int64) * n + at[x] for x, own in zip(langs, rows) if x and len(own)]
        keys, times = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *known]), return_counts=True)
        bucket, lang = keys // max(1, n), keys % max(1, n)
        total = np.bincount(lang, times, n) + 0.5 * BUCKETS
        # Each word costs a language log(0.5 / total), less what the sample says for it.
        self.unseen = np.log(0.5 / total).astype(np.float32)
        self.lang, self.gain = lang.astype(np.int32), np.log((times + 0.5) / 0.5).astype(np.float32)
        self.start = np.searchsorted(bucket, np.arange(BUCKETS + 1)).astype(np.int32)

    def guess(self, rows: np.ndarray, text_of: np.ndarray, per_text: np.ndarray) -> list[str | None]:
        """The likeliest language of each text's words, the first by name among equals; None without words or languages."""
        n = len(self.names)
        if not n or not len(rows):
            return [None] * len(per_text)
        first, last = self.start[rows[:, -1]], self.start[rows[:, -1] + 1]
        times = last - first
        place = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
        total = np.bincount(np.repeat(text_of, times) * n + self.lang[place], self.gain[place], len(per_text) * n).reshape(-1, n)
        total = total + per_text[:, None] * self.unseen
        return [self.names[k] if w else None for k, w in zip(np.argmax(total, axis=1).tolist(), per_text.tolist())]


def _best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Midway between the two scores where F1 is best, kept inside (0, 1)."""
    if not y.sum():
        return 0.5
    by = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[by])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = scores[by][k + 1] if k + 1 < len(y) else 0.0
    return float(np.clip((scores[by][k] + low) / 2, 0.02, 0.98))


def fair_length(sizes: np.ndarray, total: int) -> int:
    """The greatest length to which texts of these sizes can be cut so that they have at most ``total`` together."""
    sizes = np.sort(sizes)
    left = total - np.append(0, np.cumsum(sizes))[:-1]
    share = left // np.arange(len(sizes), 0, -1)
    over = np.flatnonzero(sizes > share)
    return int(max(1, share[over[0]])) if len(over) else int(sizes[-1]) if len(sizes) else 1


def learn(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, text_chars: int = TEXT_CHARS) -> Network | None:
    """Fit on labelled training rows, collected: at most ``sample`` in order of a hash of the id. None without any.

    Together they have at most ``sample_chars`` characters, and ``text_chars`` each: a longer text gives a piece of it, at a place by
    the id's hash, as long as the bound allows to all that are cut. One long text takes no other out of the sample.
    """
    rows = labelled_sample(docs, labels, "toxic", training, sample, ("lang",)).withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    rows = rows.orderBy("u", "n", "text").limit(sample)
    sizes = rows.select("n").toArrow().column("n").to_numpy()
    if not len(sizes):
        return None
    most = min(text_chars, fair_length(sizes.astype(np.int64), sample_chars))
    begin = (F.pmod(F.xxhash64("u", F.lit(2)), F.lit(1 << 30)) / float(1 << 30) * F.greatest(F.col("n") - most, F.lit(0))).cast("int") + 1
    rows = rows.select(F.substring("text", begin, F.lit(most)).alias("text"), "lang", "label").toArrow()
    texts = [rows_of(Words([t or b""])) for t in rows.column("text").cast(pa.binary()).to_pylist()]
    return Network().fit(texts, np.array(rows.column("label").to_pylist()), rows.column("lang").to_pylist())


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` followed by ``score`` and ``lang_guess``; without a network all score 0.

    Null text is empty and has no words. Equal texts have equal scores; repeats are scored each for itself; texts
    may be of any length; no rows give no rows. Columns of those names are replaced, others pass through.
    """
    docs = docs.drop("score", "lang_guess")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in sliced(parts):
            texts = utf8(part.column("text"))
            scores, langs = own(texts) if own else (np.zeros(len(texts)), [None] * len(texts))
            yield with_columns(part, names, score=pa.array(scores.astype(np.float64), pa.float64()), lang_guess=pa.array(langs, pa.string()))

    return docs.mapInArrow(run, f"{fields(docs)}score double, lang_guess string")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` for every row of ``docs``, by a network of its labelled training rows.

    Null ids are neither held out nor learnt from. Rows that repeat or share an id are judged each for itself; columns
    besides doc_id, text and (to calibrate) lang are not read, whatever their names. No rows give no rows.
    """
    network = learn(docs, labels, is_training(F.col("doc_id"), 4, 2))
    scored = score(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "lang_guess")
