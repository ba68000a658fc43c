"""Encoders: functions from a list of texts to a matrix, one row each, run on Arrow batches.

``hashed_counts`` is the default: how often each of ``dim`` buckets of word hashes occurs. Any other
callable of that shape takes its place, for instance one that runs a model which each worker loads once.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
DIM = 64
#: Sentences whose vectors are held at once; a longer row is held alone.
HELD_SENTENCES = 16384
#: Characters of texts that are cut into words at once; a longer text is cut alone.
HELD_CHARS = 4 << 20
#: Words whose buckets a worker remembers, but for those of one such step.
KNOWN_WORDS = 200_000

#: Words are letters, digits and underscores. Other ASCII characters become blanks by a table of bytes, all others by this pattern.
BETWEEN_WORDS = r"[^\x00-\x7F\p{L}\p{N}]+"
BLANKED = np.arange(256, dtype=np.uint8)
BLANKED[[i for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")]] = 32


class hashed_counts:  # noqa: N801  used like a function
    """Counts of words by bucket: the first 32 bits of a word's MD5, modulo ``dim``. Arrow cuts texts and finds the words that are known.

    Texts may be an Arrow array, whose texts then never become Python's.
    """

    takes_arrow = True

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self._forget()

    def _forget(self) -> None:
        """Know the empty word alone, which stands before, between or behind marks and has no bucket."""
        self.words, self.bucket = pa.array([""], pa.string()), np.array([-1])

    def __call__(self, texts: list[str] | pa.Array) -> np.ndarray:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out, first, size = np.zeros((len(column), self.dim)), 0, 0
        for i, length in enumerate(pc.utf8_length(column).to_pylist()):
            size += length
            if size >= HELD_CHARS or i + 1 == len(column):
                out[first : i + 1] = self._counts(column.slice(first, i + 1 - first))
                first, size = i + 1, 0
        return out

    def _counts(self, texts: pa.Array) -> np.ndarray:
        low = pc.utf8_lower(texts)
        valid, offsets, data = low.buffers()
        if data is not None:
            blanked = pa.py_buffer(BLANKED[np.frombuffer(data, np.uint8)])
            low = pc.replace_substring_regex(pa.StringArray.from_buffers(len(low), offsets, blanked, valid, -1, low.offset), pattern=BETWEEN_WORDS, replacement=" ")
        parts = pc.split_pattern(low, pattern=" ")
        bucket = self._buckets(parts.flatten())
        text_of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        cells = (text_of * self.dim + bucket)[bucket >= 0]
        return np.bincount(cells, minlength=len(texts) * self.dim).reshape(-1, self.dim)

    def _buckets(self, words: pa.Array) -> np.ndarray:
        """The bucket of each word; -1 for the empty one."""
        if len(self.words) > KNOWN_WORDS:
            self._forget()
        place = pc.index_in(words, value_set=self.words)
        if place.null_count:
            missing = place.is_null()
            others = words.filter(missing).dictionary_encode()
            new = [int.from_bytes(hashlib.md5(w).digest()[:4]) % self.dim for w in others.dictionary.cast(pa.binary()).to_pylist()]
            at = place.fill_null(0).to_numpy(zero_copy_only=False).copy()
            at[missing.to_numpy(zero_copy_only=False)] = len(self.words) + others.indices.to_numpy()
            self.words, self.bucket = pa.concat_arrays([self.words, others.dictionary]), np.concatenate([self.bucket, np.array(new, dtype=np.int64)])
            return self.bucket[at]
        return self.bucket[place.to_numpy()]


def _encoded(encode: Encoder, texts: pa.Array) -> np.ndarray:
    """A row for each text, null being empty text; an encoder that gives other rows has failed."""
    if not len(texts):
        return np.zeros((0, 0))
    texts = pc.fill_null(texts, "")
    m = np.asarray(encode(texts if getattr(encode, "takes_arrow", False) else texts.to_pylist()))
    if m.ndim != 2 or len(m) != len(texts):
        raise ValueError(f"the encoder gave an array of shape {m.shape} for {len(texts)} texts")
    return m


def _lists(values: np.ndarray, ends: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Lists of doubles that end where ``ends`` says; null where ``valid`` is false."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64()), mask=mask)


def embed(text: Column, encoder: Encoder | None = None) -> Column:
    """``array<double>`` of each text; null text is encoded as empty text."""
    encode = encoder or hashed_counts()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            m = _encoded(encode, texts)
            yield _lists(m.ravel(), np.arange(1, len(texts) + 1) * m.shape[1])

    return run(text)


def neighbour_similarity(sentences: Column, encoder: Encoder | None = None, failed_as_null: bool = False) -> Column:
    """For an array of sentences, the cosine of each one with the one before it (one less than sentences).

    The sentences of several rows are encoded together, ``HELD_SENTENCES`` or so at once, and row by row where the
    encoder fails on them. Where it fails on a row alone, the job fails; with ``failed_as_null`` that row is null, which
    the worker logs, and the others are not harmed. The function counts as not deterministic, lest Spark evaluates it
    a second time for a filter that it infers.
    """
    encode = encoder or hashed_counts()

    def similarities(rows: pa.ListArray, m: np.ndarray) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        dots = np.einsum("ij,ij->i", m[1:], m[:-1])
        squares = np.einsum("ij,ij->i", m, m)
        norms = np.sqrt(squares[1:] * squares[:-1])
        cosine = np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)  # not a number where a vector is none
        ends = np.cumsum(sizes)
        within = np.ones(len(cosine), dtype=bool)
        within[ends[(ends > 0) & (ends < len(m))] - 1] = False
        return _lists(cosine[within], np.cumsum(np.maximum(sizes - 1, 0)))

    def tried(rows: pa.ListArray) -> list[pa.Array]:
        try:
            m = _encoded(encode, rows.flatten())
        except Exception:  # whatever a pluggable encoder raises
            if len(rows) > 1:
                return [x for i in range(len(rows)) for x in tried(rows.slice(i, 1))]
            if not failed_as_null:
                raise
            logging.getLogger(__name__).exception("The encoder failed on the %d sentences of a row, which is null", len(rows.flatten()))
            return [_lists(np.zeros(0), np.zeros(1), np.array([False]))]
        return [similarities(rows, m)]

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            out, first, size = [], 0, 0
            for i, n in enumerate(pc.fill_null(pc.list_value_length(rows), 0).to_pylist()):
                size += n
                if size >= HELD_SENTENCES or i + 1 == len(rows):
                    out += tried(rows.slice(first, i + 1 - first))
                    first, size = i + 1, 0
            yield pa.concat_arrays(out) if out else _lists(np.zeros(0), np.zeros(0))

    return run.asNondeterministic()(sentences)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if one is all zeros; built-in functions only."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
