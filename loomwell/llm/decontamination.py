"""Benchmark decontamination: an FM-index per training shard, searched for windows of test items.

A *phrase* is ``window`` consecutive words of an item, or the whole item if it has fewer. Each task
reads its share of the documents in shards of bounded size, indexes a shard's words, searches every
phrase backwards through the wavelet tree, locates the occurrences by sampled suffix positions, and
merges them into one list of word spans for each document. Documents never move between tasks.

The alphabet is the phrases' own words. Every other word is one separator symbol, which no phrase
contains; stretches between separators that are shorter than the shortest phrase cannot hold an
occurrence and are not indexed. Both reductions are exact.

The phrases are broadcast in blocks, each of at most ``BLOCK_WORDS`` words of items; longer items are parted,
with their windows whole. A task holds one block at a time: each shard is searched for the phrases of one block
after the other, so that a larger test set takes more time, never more memory nor more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, fields, sliced, utf8, with_columns
from .fm_index import FMIndex

WINDOW = 10
#: Words of a block of items.
BLOCK_WORDS = 100_000
#: Words of a shard's index; a document is never parted between shards.
SHARD_WORDS = 1 << 20

SPANS = "array<struct<start:int,stop:int>>"
ITEMS = "array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Phrases:
    """The distinct phrases of some items (id, words) by length, over symbols 2, 3, ... (1 is the separator).

    Phrases of items without an id are found like the others, and name no item.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.symbols: dict[bytes, int] = {}
        self.owners: list[str] = sorted({i for i, _ in items if i is not None})
        rank = {i: k for k, i in enumerate(self.owners)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, own_words in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in own_words]
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                owned = found.setdefault(tuple(ids[a : a + window]), set())
                if item is not None:
                    owned.add(rank[item])
        self.by_length = []
        for size in sorted({len(p) for p in found}):
            own = sorted(p for p in found if len(p) == size)
            bounds = np.cumsum([0, *(len(found[p]) for p in own)])
            self.by_length.append((size, np.array(own, dtype=np.int32), bounds, np.array([k for p in own for k in sorted(found[p])], dtype=np.int32)))
        self.shortest = self.by_length[0][0] if self.by_length else 0

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, the merged spans of words that phrases cover, the items found."""
        ids, bounds = [], [0]
        for text in texts:
            ids.append(np.array([self.symbols.get(w, 1) for w in words(text)], dtype=np.int32))
            bounds.append(bounds[-1] + len(ids[-1]))
        n_words = np.diff(bounds)
        out = [(int(n), [], []) for n in n_words]
        if not self.shortest or not bounds[-1]:
            return out
        # The index holds stretches of known words, each followed by a separator.
        flat = np.concatenate(ids)
        known = np.zeros(len(flat) + 1, dtype=bool)
        known[:-1] = flat > 1
        starts_text = np.zeros(len(flat) + 1, dtype=bool)
        starts_text[bounds] = True
        begin = np.flatnonzero(known & (~np.roll(known, 1) | starts_text))
        end = np.flatnonzero(np.roll(known, 1) & (~known | starts_text))
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        lengths = end - begin + 1
        first = np.cumsum(lengths) - lengths
        origin = np.arange(lengths.sum()) + np.repeat(begin - first, lengths)
        sequence = flat[np.minimum(origin, len(flat) - 1)].astype(np.int64)
        sequence[first + lengths - 1] = 1
        index = FMIndex(sequence)
        starts, stops, items, of = [], [], [], []
        for size, phrases, bounds_of, owners in self.by_length:
            low, high = index.count(phrases)
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            if not len(hit):
                continue
            rows = np.arange(times.sum()) + np.repeat(low[hit] - (np.cumsum(times) - times), times)
            at = origin[index.locate(rows)]
            text = np.searchsorted(bounds, at, side="right") - 1
            starts.append(at)
            stops.append(at + size)
            # (text, item) pairs, each once
            phrase = np.repeat(hit, times)
            pairs = np.unique(text * len(phrases) + phrase)
            for t, p in zip((pairs // len(phrases)).tolist(), (pairs % len(phrases)).tolist()):
                of.append(t)
                items.append(owners[bounds_of[p] : bounds_of[p + 1]].tolist())
        if not starts:
            return out
        start, stop = np.concatenate(starts), np.concatenate(stops)
        by = np.argsort(start, kind="stable")
        start, stop = start[by], np.maximum.accumulate(stop[by])
        text = np.searchsorted(bounds, start, side="right") - 1
        # stop never reaches beyond its own text, so a text's first span opens a new one, too
        opens = np.ones(len(start), dtype=bool)
        opens[1:] = (start[1:] > stop[:-1]) | (text[1:] != text[:-1])
        closes = np.append(np.flatnonzero(opens)[1:], len(start)) - 1
        for t, a, b in zip(text[opens].tolist(), start[opens].tolist(), stop[closes].tolist()):
            out[t][1].append((a - bounds[t], b - bounds[t]))
        found: dict[int, set[int]] = {}
        for t, own in zip(of, items):
            found.setdefault(t, set()).update(own)
        for t, own in found.items():
            out[t][2].extend(self.owners[k] for k in sorted(own))
        return out


def _shards(parts: Iterator[pa.RecordBatch], words_limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined up to about ``words_limit`` words (taken as six bytes each)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in sliced(parts):
        if held and size + part.nbytes > 6 * words_limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def _blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[Phrases]:
    """The items in blocks of at most ``limit`` words or one window; longer items are parted so that every window is in one part."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    held: list[tuple[str | None, list[bytes]]] = []
    size, most = 0, max(limit, window)
    for item, text in items.toLocalIterator():
        own = words(text.encode())
        for a in range(0, max(1, len(own) - window + 1), most - window + 1):
            part = own[a : a + most]
            if held and size + len(part) > most:
                yield Phrases(held, window)
                held, size = [], 0
            held.append((item, part))
            size += len(part)
    if held:
        yield Phrases(held, window)


def _loaded(blocks: list[Broadcast]) -> Iterator[Phrases]:
    """Each block's phrases; of several blocks none stays in the worker's memory behind its turn."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` followed by ``n_words``, ``spans`` (merged, in words, stop excluded) and ``items`` (sorted).

    Null or empty text has no words and no spans. Rows that repeat, or share a doc_id, are searched each
    for itself; texts may be of any length. Rows of the benchmark that share an item_id are one item with the windows
    of each; rows without an item_id are searched like the others, and stand in no list of items. An empty benchmark, or items without words, find nothing. Columns of those names are replaced.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.drop("n_words", "spans", "items")
    names = docs.columns
    blocks = [context.broadcast(block) for block in _blocks(benchmark, window, block_words)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(parts, shard_words):
            texts = utf8(shard.column("text"))
            found = None
            for phrases in _loaded(blocks):
                more = phrases.search(texts)
                found = more if found is None else [(n, _merged([*a, *spans]) if a and spans else a or spans, sorted({*b, *items}) if b and items else b or items) for (n, a, b), (_, spans, items) in zip(found, more)]
            if found is None:
                found = [(len(words(t)), [], []) for t in texts]
            yield with_columns(
                shard,
                names,
                n_words=pa.array([f[0] for f in found], pa.int64()),
                spans=pa.array([[{"start": a, "stop": b} for a, b in f[1]] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                items=pa.array([f[2] for f in found], pa.list_(pa.string())),
            )

    return docs.mapInArrow(run, f"{fields(docs)}n_words long, spans {SPANS}, items {ITEMS}")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(found: DataFrame) -> DataFrame:
    """The rows of ``find_spans`` with their texts less their spans; ``spans``, ``items`` and ``n_words`` go.

    Texts without spans stay as they are, null ones too. From the first byte of a span's first word to the last of its last word everything is removed.
    """
    names = [c for c in found.columns if c not in ("n_words", "spans", "items")]
    def cut(text: bytes, spans: list[dict]) -> bytes:
        flags = text.translate(WORD_TABLE)
        at, out, place, ends = 0, [], 0, []
        for word in flags.split():
            place = flags.index(word, place)
            ends.append((place, place + len(word)))
            place += len(word)
        for span in spans:
            out.append(text[at : ends[span["start"]][0]])
            at = ends[span["stop"] - 1][1]
        return b"".join([*out, text[at:]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            texts = [cut(t, s) if s else t for t, s in zip(raw, part.column("spans").to_pylist())]
            yield part.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))

    return found.select(*[F.col(f"`{c}`") for c in names], "spans").mapInArrow(run, fields(found, names).rstrip(", "))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_spans(docs.select("doc_id", "text"), benchmark)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS (SELECT r, string_split(w, ' ') AS words FROM (SELECT r, trim(regexp_replace(translate(text,
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS w FROM rows) WHERE w <> ''),
b AS (SELECT item_id, string_split(w, ' ') AS words FROM (SELECT item_id, trim(regexp_replace(translate(text,
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS w FROM benchmark) WHERE w <> ''),
phrases AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[p:p + 9], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS p FROM b)),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT r, n, p, array_to_string(words[p:p + n - 1], ' ') AS phrase
  FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS p FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT r, item_id, p, w.n FROM windows w JOIN phrases USING (n, phrase)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT x.doc_id, coalesce(len(d.words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM rows x LEFT JOIN d USING (r) LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
