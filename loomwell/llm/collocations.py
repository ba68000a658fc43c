"""Phrase collocation mining by best-first branch and bound.

A phrase's score is at most that of its growth: of all that begins with P, nothing scores above
``2000000 f(P) / (f(first word) + f(P))``, since a longer phrase has no more occurrences than P, and what follows the first
word has no fewer occurrences than the phrase. So prefix counts bound whole branches.

Words and pairs are counted for the whole corpus. Then a *wave* takes a threshold for each language, expands the prefixes
whose bound reaches it, and counts their continuations, of three words and then of four. Of what scores at or above the
threshold it also counts what stands in front, so that survival (no longer phrase of 80 % of the occurrences holds it) is
known: one more word at either end decides, as a phrase between two others has no fewer occurrences than the longer. Every
phrase at or above the threshold is then known with all its counts, ties included. A language is settled when so many of
them survive as are wanted, or the threshold is 0; the others' frontier goes on, to thresholds of four times as many phrases.

Counts are exact: a task groups phrases by two hashes, Spark sums them by language and text. Which phrases a wave counts is told
to the tasks as bit sets of hashes, of a size bounded by ``MOST_BITS``; false hits are counted like the rest, and then have no part in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, _power_tables, discard, mix, sliced, stored, utf8

LONGEST = 4
FEWEST = 30
KEEP = 2000
SCALE = 2_000_000
#: A phrase goes if a longer one has so many of a hundred of its occurrences.
COVER = 80
#: The first wave's threshold is the score of this many times ``KEEP``; each further wave's of four times as many.
FIRST_WAVE = 2
#: Phrases that a task holds before it groups them.
HELD = 1 << 20
#: Bits of a set of hashes: 16 for each phrase, up to 64 MB.
MOST_BITS = 29
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, 9]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEY = ["lang", "phrase"]


class Pieces:
    """The words of texts of known languages, with hashes of the phrases that begin at each.

    ``spaced`` holds the words, each followed by one blank; ``first`` and ``size`` say where.
    """

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = LOWER[np.frombuffer(b"\n".join([*texts, b"\0" * 8]), dtype=np.uint8)][:-8]
        kind = _KIND[raw]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[1:] = kind == 0
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.size = ends - starts
        self.first = np.cumsum(self.size + 1) - self.size - 1
        keep = inside[1:].copy()
        keep[ends] = True
        spaced = np.where(inside[1:], raw, 32)[keep]
        self.spaced = spaced.astype(np.uint8)
        self.piece = np.searchsorted(np.flatnonzero(kind == _BREAK), starts)
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        self._word = mix((total[ends] - total[starts]) * inverse[starts])
        # A second, unrelated one: the length with the first and the last eight bytes.
        eight = np.ndarray((len(raw),), "<u8", np.append(raw, np.zeros(8, dtype=np.uint8)).tobytes(), strides=(1,))
        head = eight[starts] & (np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(self.size, 8)).astype(np.uint64)))
        tail = np.where(self.size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
        self._check = mix(mix(head ^ self.size.astype(np.uint64) * _STEP) + tail)
        self.lang = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang in langs], dtype=np.uint64)[self.text] if len(self.text) else np.zeros(0, dtype=np.uint64)
        self._made: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.size)

    def whole(self, k: int) -> np.ndarray:
        """Where k words follow each other within a piece."""
        n = len(self) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)

    def hashes(self, k: int) -> np.ndarray:
        """Hashes of language and k words, for each place that has k words behind it."""
        if k not in self._made:
            self._made[k] = mix(self._word ^ self.lang) if k == 1 else self._chained(self.hashes(k - 1), self._word, k)
        return self._made[k]

    def checks(self, k: int) -> np.ndarray:
        out = self._check
        for i in range(2, k + 1):
            out = self._chained(out, self._check, i)
        return out

    @staticmethod
    def _chained(shorter: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(word) - k + 1)
        return mix(shorter[:n] * _STEP + word[k - 1 : k - 1 + n])


@dataclass
class Wanted:
    """Which phrases to count: both pairs (or words) of hashes ``part`` long in ``frequent``, and the prefix in ``grow`` or the suffix in ``front``; or those in ``just``.

    Sets are bits of hashes; None admits all.
    """

    frequent: np.ndarray | None = None
    part: int = 1
    grow: np.ndarray | None = None
    front: np.ndarray | None = None
    just: np.ndarray | None = None

    def __call__(self, pieces: Pieces, k: int) -> np.ndarray:
        ok = pieces.whole(k)
        n = len(ok)
        if self.just is not None:
            ok &= _has(self.just, pieces.hashes(k))
        if self.frequent is not None:
            held = _has(self.frequent, pieces.hashes(self.part))
            for i in range(k - self.part + 1):
                ok &= held[i : i + n]
        if self.grow is not None:
            shorter = pieces.hashes(k - 1)
            ok &= _has(self.grow, shorter)[:n] | _has(self.front, shorter)[1 : 1 + n]
        return np.flatnonzero(ok)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bit_set(phrases: DataFrame, size: int) -> np.ndarray:
    """The hashes of ``phrases`` (lang, phrase) of ``size`` words as bits. Built by the tasks; the driver gets its words that are not 0."""
    bits = min(MOST_BITS, max(16, (phrases.count() * 16).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "phrase"):
            own = Pieces(utf8(batch.column("phrase")), batch.column("lang").to_pylist())
            at = own.hashes(size)[own.whole(size)] >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((at & np.uint64(63)).astype(np.int32))], ["word", "bit"])

    words = phrases.select(*_KEY).mapInArrow(run, "word int, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


class _Held:
    """Phrases of several runs of texts until they are grouped."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes: list[np.ndarray] = []
        self.n = self.offset = 0
        self.langs: dict[str, int] = {}

    def add(self, own: Pieces, at: np.ndarray, k: int, langs: list[str]) -> None:
        numbers = np.array([self.langs.setdefault(lang, len(self.langs)) for lang in langs], dtype=np.int32)
        last = at + k - 1
        # Counts of the same text are by language: the phrase's hash has it, the check has not.
        self.parts.append((own.hashes(k)[at], own.checks(k)[at], own.first[at] + self.offset, own.first[last] + own.size[last] - own.first[at], numbers[own.text[at]]))
        self.bytes.append(own.spaced)
        self.n += len(at) + len(own)
        self.offset += len(own.spaced)

    def grouped(self) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of what is held, each phrase once."""
        if not self.parts:
            return
        key, check, first, size, lang = (np.concatenate(x) for x in zip(*self.parts))
        raw, names = np.concatenate(self.bytes), np.array(list(self.langs), dtype=object)
        self.__init__()
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        if (same & (check[by][1:] != check[by][:-1])).any():
            by = np.lexsort((check, key))
            same = (key[by][1:] == key[by][:-1]) & (check[by][1:] == check[by][:-1])
        heads = np.flatnonzero(np.append(True, ~same)) if len(by) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(heads, len(by)))
        chosen = by[heads]
        for a in range(0, len(chosen), 1 << 15):
            rows = chosen[a : a + (1 << 15)]
            ends = np.cumsum(size[rows])
            text = raw[np.arange(ends[-1]) + np.repeat(first[rows] - (ends - size[rows]), size[rows])]
            phrase = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(names[lang[rows]].tolist(), pa.string()), phrase.cast(pa.binary()).cast(pa.string()), pa.array(counts[a : a + len(rows)].astype(np.int64))], ["lang", "phrase", "n"])


def count(docs: DataFrame, k: int, wanted: Wanted, total: bool = False) -> DataFrame:
    """(lang, phrase, f) of the wanted phrases of k words of ``docs`` (lang, text); with ``total`` a row of null phrase has a language's words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = _Held(), {}
        for batch in sliced(batches):
            langs = batch.column("lang").to_pylist()
            own = Pieces(utf8(batch.column("text")), langs)
            if total:
                for lang, n in zip(langs, np.bincount(own.text, minlength=len(langs)).tolist()):
                    words[lang] = words.get(lang, 0) + n
            at = shared.value(own, k)
            if len(at):
                held.add(own, at, k, langs)
            if held.n > HELD:
                yield from held.grouped()
            if len(words) > 10_000:
                yield _totals(words)
                words = {}
        yield from held.grouped()
        yield _totals(words)

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy(*_KEY).agg(F.sum("n").alias("f"))


def _totals(words: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "phrase", "n"])


def _words(phrase: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def _floored(a: Column, below: Column) -> Column:
    """floor(SCALE * a / below), exactly: the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * a.cast("decimal(19,0)"), below.cast("decimal(20,0)"))


def score(phrases: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """``phrases`` (lang, phrase, f) of ``size`` words as (lang, phrase, a, l, r, score, bound, missing) by the counts of ``known``.

    A part that is not known counts as often as the phrase, the least that it can, so that the score is at least the true one;
    ``missing`` lists such parts. ``bound`` is at least the score of whatever begins with the phrase.
    """
    cut = range(1, size)
    parts = [F.struct(F.lit(f"{side}{k}").alias("side"), _words(F.col("phrase"), *place).alias("part")) for k in cut for side, place in (("l", (1, k)), ("r", (k + 1, size - k)))]
    each = phrases.select(*_KEY, F.col("f").alias("a"), F.explode(F.array(*parts)).alias("p")).select(*_KEY, "a", "p.side", "p.part")
    joined = each.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"], "left")
    sides = [F.max(F.when(F.col("side") == f"{s}{k}", F.col("f"))).alias(f"{s}{k}") for k in cut for s in "lr"]
    missing = F.collect_set(F.when(F.col("f").isNull(), F.col("part"))).alias("missing")
    wide = joined.groupBy(*_KEY, "a").agg(*sides, missing)
    l, r = (lambda k: F.coalesce(f"l{k}", "a")), (lambda k: F.coalesce(f"r{k}", "a"))  # noqa: E741
    lowest = F.array_min(F.array(*[F.struct(_floored(F.col("a"), l(k) + r(k)).alias("score"), F.lit(k).alias("k"), l(k).alias("l"), r(k).alias("r")) for k in cut]))
    out = wide.withColumn("x", lowest)
    return out.select(*_KEY, "a", "x.l", "x.r", "x.score", _floored(F.col("a"), F.col("a") + F.coalesce("l1", "a")).alias("bound"), "missing")


def _best(phrases: DataFrame, n: int) -> DataFrame:
    """The first ``n`` phrases of each language by score, count and bytes, with their ``rank``; first of 16 parts of each, then of those."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order))
    some = phrases.withColumn("rank", part).where(F.col("rank") <= n)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n)


def _surviving(phrases: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """``phrases`` of ``size`` words less those that a phrase of ``longer`` (one word more) holds and covers."""
    ends = [longer.select("lang", _words(F.col("phrase"), i, size).alias("phrase"), "f") for i in (1, 2)]
    most = ends[0].unionByName(ends[1]).groupBy(*_KEY).agg(F.max("f").alias("most"))
    return phrases.join(most, _KEY, "left").where(~(F.coalesce("most", F.lit(0)) * F.lit(100).cast("decimal(19,0)") >= F.col("a") * F.lit(COVER).cast("decimal(19,0)"))).drop("most")


def _wave(docs: DataFrame, words: DataFrame, pairs: DataFrame, frequent: np.ndarray, thresholds: DataFrame, fewest: int) -> DataFrame:
    """All surviving phrases at or above their language's threshold, for the languages of ``thresholds`` (lang, threshold)."""
    at = F.col("threshold")
    own = stored(pairs.join(thresholds, "lang"))
    grow, front = own.where(F.col("bound") >= at), own.where(F.col("score") >= at)
    enough = F.col("f") >= fewest
    triples = stored(count(docs, 3, Wanted(frequent, 2, bit_set(grow, 2), bit_set(front, 2))).where(enough))
    known = words.unionByName(pairs.select(*_KEY, F.col("a").alias("f")))
    three = stored(score(triples, known, 3).join(thresholds, "lang"))
    grow, tops = three.where(F.col("bound") >= at), three.where(F.col("score") >= at)
    fours = stored(count(docs, 4, Wanted(frequent, 2, bit_set(grow, 3), bit_set(tops, 3))).where(enough))
    known = known.unionByName(triples)
    scored = stored(score(fours, known, 4).join(thresholds, "lang").where(F.col("score") >= at))
    # Suffixes of three words whose own branch was not expanded.
    lacking = stored(scored.select("lang", F.explode("missing").alias("phrase")).distinct())
    four = scored.where(F.size("missing") == 0)
    if not lacking.isEmpty():
        more = stored(count(docs, 3, Wanted(just=bit_set(lacking, 3))).join(lacking, _KEY, "left_semi"))
        again = score(scored.where(F.size("missing") > 0).select(*_KEY, F.col("a").alias("f")), known.unionByName(more), 4)
        four = four.unionByName(again.join(thresholds, "lang").where(F.col("score") >= at))
    found = _surviving(front, triples, 2).unionByName(_surviving(tops, fours, 3)).unionByName(four)
    found = stored(found.drop("missing", "bound", "threshold"))
    discard(own, triples, three, fours, scored, lacking)
    return found


def mine(docs: DataFrame, keep: int = KEEP, fewest: int = FEWEST, first_wave: int = FIRST_WAVE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``keep`` collocations of ``docs`` (text, lang).

    Null text is empty, a null language is ``und`` like the language of that name. Repeated rows count as often as they stand. Texts and pieces may be of any
    length; ties are broken by count, then by bytes. A language without phrases of ``fewest`` occurrences has no rows, and
    no documents give none. Further columns are not read.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    enough = F.col("f") >= fewest
    words = stored(count(own, 1, Wanted(), total=True).where(enough | F.col("phrase").isNull()))
    totals = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    words = words.where("phrase is not null")
    counted = count(own, 2, Wanted(bit_set(words, 1), 1)).where(enough)
    pairs = stored(score(counted, words, 2))
    frequent = bit_set(pairs, 2)
    settled, wave, open_ = None, first_wave * keep, pairs.select("lang").distinct()
    while not open_.isEmpty():
        last = _best(pairs.join(open_, "lang"), wave).where(F.col("rank") == wave).select("lang", F.col("score").alias("threshold"))
        thresholds = stored(open_.join(last, "lang", "left").select("lang", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")))
        found = _wave(own, words, pairs, frequent, thresholds, fewest)
        done = stored(thresholds.join(found.groupBy("lang").agg(F.count("*").alias("k")), "lang", "left").where((F.col("threshold") == 0) | (F.col("k") >= keep)).select("lang"))
        part = found.join(done, "lang", "left_semi")
        settled = part if settled is None else settled.unionByName(part)
        open_ = stored(thresholds.join(done, "lang", "left_anti").select("lang"))
        wave *= 4
    if settled is None:
        settled = pairs.drop("missing", "bound")
    ranked = _best(settled, keep).withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    """The collocations of ``docs``; odd rows count as ``mine`` says."""
    return mine(docs.select("lang", "text"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, k AS size, string_split(phrase, ' ') AS w, phrase, f AS a FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS cut FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(generate_series(1, size - m + 1)) AS i FROM candidates, (VALUES (2), (3)) sizes(m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.most IS NULL OR 100 * i.most < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
