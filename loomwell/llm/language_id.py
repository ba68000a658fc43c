"""Language identification by compression with per-language zstandard raw-content dictionaries.

A language's dictionary is the joined text of a bounded random sample of its training documents; of a
long document the sample has a piece from anywhere in it. Every language with a training row has one. A
text is brought to its lower-case letter words, cut into pieces, each piece is compressed once with
every dictionary, and the language whose compressed sizes add up to the least is chosen. Pieces keep the dictionaries decisive: in one long
frame the text's own past would soon take their place. All pieces of a text count.

A text is *rejected* if it holds no letter, or if the runner-up's size is within ``min_margin`` of the
winner's (a share of the winner's size; a tie is always rejected).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, is_held_out, is_training, sliced, spread, with_columns

#: Training documents a language is learnt from at most, and bytes of its dictionary at most.
SAMPLE_DOCS = 60
DICTIONARY_BYTES = 64 << 10
#: Of a sampled document's letter words at most so many characters are taken, so that the sample's size is bounded.
SAMPLE_CHARS = 10_000
#: A task prepares the dictionaries of so many languages at a time; of more languages, block after block for each batch.
BLOCK_LANGUAGES = 400
PIECE_BYTES = 1024
#: Follows every piece: it takes a few bytes, the same in all languages, and keeps zstandard from storing short pieces as they are.
FILLER = b" " * 64
LEVEL = 6
MIN_MARGIN = 0.002
UNKNOWN = "und"

_words = regex.compile(r"\p{L}+").findall


def normal(text: str) -> bytes:
    """The text's words of letters, lower-cased, with blanks around: case and marks say little about a language."""
    words = _words(text.lower())
    return f" {' '.join(words)} ".encode() if words else b""


def piece(text: str, u: float, chars: int) -> str:
    """At most ``chars`` characters of the text's letter words, from a place that ``u`` in [0, 1) chooses."""
    letters = normal(text).decode()
    if len(letters) <= chars:
        return letters
    start = int(u * (1 << 30)) * 40_503 % (len(letters) - chars + 1)  # u itself is low for all that are sampled
    return letters[start : start + chars]


def learn(docs: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of the training rows: a random sample, bounded by the parameters.

    Rows with null text or lang, or without a letter, teach nothing; all others count, however long. Without
    training rows there are no languages, and every text is rejected as unknown.
    """
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", spread(F.col("doc_id")).alias("u"), "text")
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()
    if not found:
        return {}
    # Twice the share that is wanted, by a hash of the id, one row at least; the lowest hashes of each language stay.
    most = docs.sparkSession.createDataFrame([(r["lang"], max(2.0 * sample_docs / r["n"], r["least"])) for r in found], "lang string, most double")
    chars = min(SAMPLE_CHARS, (dictionary_bytes - 1) // 4)  # one piece fits in, whatever its characters

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            taken = [piece(t, u, chars) for t, u in zip(part.column("text").to_pylist(), part.column("u").to_pylist())]
            yield with_columns(part, ["lang", "u"], piece=pa.array(taken, pa.string()))

    def joined(rows: pa.Table) -> pa.Table:
        chosen, size = [], 0  # whole pieces, as many as fit
        for row in rows.sort_by([("u", "ascending"), ("piece", "ascending")]).to_pylist():
            t = row["piece"].encode()
            if t and size + len(t) < dictionary_bytes:
                chosen.append(t)
                size += len(t) + 1
        return pa.table({"lang": rows.column("lang").slice(0, 1), "dictionary": pa.array([b"\n".join(chosen)], pa.binary())})

    sample = known.join(F.broadcast(most), "lang").where("u <= most").select("lang", "u", "text").mapInArrow(pieces, "lang string, u double, piece string")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "piece"))
    kept = sample.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "u", "piece")
    rows = kept.groupBy("lang").applyInArrow(joined, "lang string, dictionary binary").collect()
    return {r["lang"]: bytes(r["dictionary"]) for r in rows if r["dictionary"]}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes], piece_bytes: int = PIECE_BYTES, level: int = LEVEL, block: int = BLOCK_LANGUAGES):
        self.dictionaries = dictionaries
        self.languages = sorted(dictionaries)
        self.piece_bytes, self.level = piece_bytes, level
        self.blocks = [self.languages[i : i + block] for i in range(0, len(self.languages), block)]
        self.prepared: tuple[int, list[zstandard.ZstdCompressor]] = (-1, [])  # one block's encoders

    def encoders(self, i: int) -> list[zstandard.ZstdCompressor]:
        if self.prepared[0] != i:
            self.prepared = (-1, [])
            made = []
            for lang in self.blocks[i]:
                content = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=content, write_content_size=False, write_dict_id=False, write_checksum=False))
            self.prepared = (i, made)
        return self.prepared[1]

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Each text's compressed size with each language's dictionary."""
        out = np.zeros((len(texts), len(self.languages)))
        first = 0
        for i, block in enumerate(self.blocks):
            encoders = self.encoders(i)
            for row, text in zip(out, texts):
                pieces = [text[j : j + self.piece_bytes] + FILLER for j in range(0, len(text), self.piece_bytes)]
                row[first : first + len(block)] = [sum(len(e.compress(p)) for p in pieces) for e in encoders]
            first += len(block)
        return out

    def judge(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score from 0 to 1, margin to the runner-up as a share of the winner's size) of each text."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        letters = [normal(t) if self.languages else b"" for t in texts]
        told = [i for i, t in enumerate(letters) if t]
        for i, sizes in zip(told, self.sizes([letters[i] for i in told])):
            best = int(np.argmin(sizes))
            rest = np.delete(sizes, best)
            margin = float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else 1.0
            # Sizes as code lengths, in units of 4 bytes: the share that the winner has of 2 ** -length.
            score = float(1.0 / np.exp2((sizes[best] - sizes) / 4.0).sum())
            out[i] = (self.languages[best], score, margin)
        return out

    def __call__(self, text: str) -> tuple[str, float, float]:
        return self.judge([text])[0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` followed by ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    Null, empty or letterless text: ``und``, score and margin 0, rejected. Equal sizes go to the language that
    comes first by name, with margin 0, rejected. Texts may be of any length, repeats are judged each for itself,
    no rows give no rows. Columns named like the new ones are replaced; others pass through untouched and unread.
    """
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for part in sliced(parts):
            found = judge.judge([t or "" for t in part.column("text").to_pylist()])
            yield with_columns(
                part,
                names,
                lang_pred=pa.array([f[0] for f in found], pa.string()),
                score=pa.array([f[1] for f in found], pa.float64()),
                margin=pa.array([f[2] for f in found], pa.float64()),
                rejected=pa.array([f[0] == UNKNOWN or f[2] <= 0 or f[2] < min_margin for f in found], pa.bool_()),
            )

    return docs.mapInArrow(run, f"{fields(docs)}lang_pred string, score double, margin double, rejected boolean")


def query(docs: DataFrame) -> DataFrame:
    """``identify`` for every row of ``docs``, by dictionaries of its training rows.

    Null ids are neither held out nor learnt from. Rows that repeat or share an id are judged each for itself; columns
    besides doc_id, text and (to learn) lang are not read, whatever their names. No rows give no rows.
    """
    dictionaries = learn(docs, is_training(F.col("doc_id"), 4, 2))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
