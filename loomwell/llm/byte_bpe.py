"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary is a rank file: each token's bytes and its rank, which is its id. The merges that the
``tokenizers`` library wants follow from the ranks: a token is made by the last of the merges that its
own bytes go through when only lower ranks are known. Bytes are written as the characters of the usual
byte table, in which every byte is one printable character.

A text is first split by the pattern; a piece's ids depend on the piece alone, so each task keeps the
ids of the pieces it has met and asks the library for new ones only, many at a time.

Offsets: token k covers the characters [starts[k], stops[k]) of the text. A token that ends inside a
character covers that whole character, and so does the next token: spans of a split character overlap.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .common import fields, sliced, utf8, with_columns

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a task remembers, and their characters together; the memory is cleared when either is full, and at the end of the task.
CACHE_PIECES = 200_000
CACHE_CHARS = 8_000_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token of several bytes, the two tokens it is merged from, in the order of ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder of one vocabulary; made once in each Python worker."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        ranks = read_ranks(path)
        self.characters = byte_characters()
        self.table = {i: c for i, c in enumerate(self.characters)}
        spell = lambda token: token.decode("latin-1").translate(self.table)
        vocabulary = {spell(t): r for t, r in ranks.items()}
        merges = [(spell(a), spell(b)) for a, b in merges_of(ranks)]
        # ignore_merges: a piece that is a token itself is that token.
        self.model = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.split = regex.compile(pattern).findall
        # Decoding reverses the byte table: token id -> characters -> bytes.
        byte_of = {c: i for i, c in enumerate(self.characters)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for word, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in word)
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        self.held = 0  # characters of the pieces in it

    def forget(self) -> None:
        self.cache.clear()
        self.held = 0

    def _learn(self, pieces: set[str]) -> None:
        """Ask the library for the ids of new pieces; they are kept as little-endian 32-bit integers.

        The memory holds what its bounds allow, or one text's pieces: those have to be there to encode it.
        """
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES or self.held + sum(map(len, new)) > CACHE_CHARS:
            self.forget()
            new = list(pieces)
        self.held += sum(map(len, new))
        spelt = [p.encode().decode("latin-1").translate(self.table) for p in new]
        for piece, got in zip(new, self.model.encode_batch(spelt, add_special_tokens=False)):
            self.cache[piece] = np.array(got.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out = []
        for text in texts:
            pieces = self.split(text)
            try:
                out.append(b"".join(map(self.cache.__getitem__, pieces)))
            except KeyError:
                self._learn(set(pieces))
                out.append(b"".join([self.cache[p] for p in pieces]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a row of ids. Characters whose bytes several ids share come out whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last that each token touches."""
        stops = np.cumsum(self.sizes[ids])
        starts = stops - self.sizes[ids]
        begins = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80  # bytes that begin a character
        count = np.concatenate([[0], np.cumsum(begins)])
        return count[starts + 1] - 1 if len(ids) else starts, count[stops]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` followed by ``ids`` and, if asked for, ``starts`` and ``stops`` in characters.

    Null text is empty and has no ids. Columns named like the new ones are replaced; others pass through.
    """
    df = df.drop("ids", "starts", "stops")
    names = df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in sliced(parts, text):
            texts = part.column(text).to_pylist()
            ids = [np.frombuffer(x, dtype="<u4") for x in own.encode([t or "" for t in texts])]
            columns = {"ids": _list(ids, pa.int32())}
            if offsets:
                spans = [own.offsets(t, i) for t, i in zip(utf8(part.column(text)), ids)]
                columns |= {"starts": _list([s[0] for s in spans], pa.int32()), "stops": _list([s[1] for s in spans], pa.int32())}
            yield with_columns(part, names, **columns)
        own.forget()

    more = ", starts array<int>, stops array<int>" if offsets else ""
    return df.mapInArrow(run, f"{fields(df)}ids array<int>{more}")


def _list(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32), kind))


def decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` (with ``ids``) followed by ``decoded``, the bytes its ids stand for; null ids give empty bytes."""
    df = df.drop("decoded")
    names = df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in parts:
            rows = part.column("ids").to_pylist()
            yield with_columns(part, names, decoded=pa.array([own.decode(r or []) for r in rows], pa.binary()))

    return df.mapInArrow(run, f"{fields(df)}decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, in one pass.

    The ids are those of ``encode`` and the bytes those of ``decode``, digested batch by batch. Null text is empty and
    has no tokens. Texts may be of any length, and so may pieces of them; rows that repeat are encoded each for itself;
    no rows give no rows; further columns, whatever their names, are not read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in sliced(parts):
            packed = own.encode([t or "" for t in part.column("text").to_pylist()])
            decoded = [own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in packed]
            yield with_columns(
                part,
                ["doc_id"],
                n_tokens=pa.array([len(x) // 4 for x in packed], pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                decoded_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            )
        own.forget()  # the worker lives on

    return df.select("doc_id", "text").mapInArrow(run, f"{fields(df, ['doc_id'])}n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``round_trip`` by the ranks of ``path``, or of the public file; it says how odd rows count."""
    return round_trip(docs, path or public_tokenizers.path(VOCABULARY))
