"""Scoring text with Brown class-based bigrams.

    p(text) = product over tokens of p(class | class before) * p(word | class)

Word counts cover every training token and stay a table. Words split by count:

* the *head*, all words seen ``HEAD_COUNT`` times or more, up to ``HEAD_WORDS`` of the commonest; each has one
  of ``CLASSES`` classes. The commonest ``EXCHANGE_WORDS`` are assigned first, by exchange clustering: each
  word in turn goes to the class that raises the likelihood of all class bigrams most, until a pass moves
  few. Then come ``ROUNDS`` jobs over all training text in which every head word, the common ones too,
  goes to its best class: word-by-class bigram counts are summed over the tasks, and each task moves its
  share of the words against the class bigrams of the round before. A round whose classes, counted
  again, are no likelier is taken back, and is the last;
* the *tail*, all other words, seen or not, one class: the back-off. Their counts are joined in, never
  broadcast: only rare words take part, so no key of that join is hot, and the head's words never enter a
  shuffle as tokens.

Texts are split into tokens twice, for the counts and to write each text as numbers of head words; all
other passes read the numbers. Counts of bigrams move as packed arrays, one row for each task and shard.

What is broadcast is the head's table of 64-bit hashes, counts and classes, 18 bytes a word and so 72 MB at
most. Two words of one hash would count as one, which four million words meet with a probability of less than
one in a million.

Emission within the tail discounts every count by D = n1 / (n1 + 2 n2) (n1, n2: words seen once, twice)
and gives the freed share to the one unknown word, in the way that the base score has one unknown type.
Class transitions are smoothed towards the classes' own shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, is_held_out, sliced, stored, utf8, with_columns

#: Rarer words are always tail: the tail's discount and its share of the tokens are learnt from them.
HEAD_COUNT = 4
#: Bound of the broadcast head; words beyond, by count, back off to the tail, with their counts.
HEAD_WORDS = 4_000_000
EXCHANGE_WORDS = 1000
CLASSES = 40
PASSES = 8
#: Jobs in which all head words move.
ROUNDS = 2
#: Keys of bigrams a task holds before it counts them and sends the counts on.
HELD_KEYS = 6_000_000
#: Parts that counts of bigrams are dealt into.
SHARDS = 64
#: Distinct words a task holds before it sends its counts on.
HELD_WORDS = 400_000
#: What stands for the end of a text in the word counts; no word holds a blank.
END = " "
BINS = 8  # count bins to a doubling


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each token occurs in ``docs``, ends of texts included; counted before the shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for part in sliced(parts):
            for text in utf8(part.column("text")):
                held.update(tokens(text))
            held[END.encode()] += part.num_rows
            if len(held) > HELD_WORDS:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, n_classes: int, passes: int = PASSES) -> np.ndarray:
    """Classes of the words 0, 1, ... of a bigram count matrix that maximise the class bigrams' likelihood.

    Words begin in the classes 0, 1, ... in turn; a word moves only if that raises the likelihood, to the
    lowest of equally good classes.
    """
    n = len(bigrams)
    n_classes = min(n_classes, n)
    of = np.arange(n) % n_classes
    one_hot = np.zeros((n, n_classes))
    one_hot[np.arange(n), of] = 1
    counts = one_hot.T @ bigrams @ one_hot
    to_class = bigrams @ one_hot  # from each word to each class
    from_class = (bigrams.T @ one_hot).T  # from each class to each word
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(passes):
        moved = 0
        for w in range(n):
            old, itself = of[w], bigrams[w, w]
            right, left = to_class[w].copy(), from_class[:, w].copy()
            right[old] -= itself
            left[old] -= itself
            counts[old] -= right
            counts[:, old] -= left
            counts[old, old] -= itself
            rows, columns = counts.sum(axis=1), counts.sum(axis=0)
            gain = (f(counts + right) - f(counts)).sum(axis=1) + (f(counts.T + left) - f(counts.T)).sum(axis=1)
            diagonal = np.diag(counts)
            gain += f(diagonal + right + left + itself) + f(diagonal) - f(diagonal + right) - f(diagonal + left)
            out, back = right.sum() + itself, left.sum() + itself
            gain -= f(rows + out) - f(rows) + f(columns + back) - f(columns)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            counts[new] += right
            counts[:, new] += left
            counts[new, new] += itself
            if new != old:
                moved += 1
                of[w] = new
                to_class[:, old] -= bigrams[:, w]
                to_class[:, new] += bigrams[:, w]
                from_class[old] -= bigrams[w]
                from_class[new] += bigrams[w]
        if moved <= n // 200:
            break
    return of


class Index:
    """Words by their hashes: the position of each in the sorted table, -1 for all others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted, as of Spark's xxhash64 without sign
        self.met: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.hashes)

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "met": {}}

    def find(self, words: list[bytes]) -> np.ndarray:
        if not len(self):
            return np.full(len(words), -1, dtype=np.int64)
        if len(self.met) > HELD_WORDS:
            self.met.clear()
        met = self.met
        new = list({w for w in words if w not in met})
        if new:
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
            met.update(zip(new, np.where(self.hashes[at] == h, at, -1).tolist()))
        return np.fromiter(map(met.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    """What scoring needs: a few numbers for each head word, and the classes' transitions."""

    index: Index = field(default_factory=lambda: Index(np.zeros(0, dtype=np.uint64)))  # head words
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int16))  # of head words
    n_states: int = 2
    classes: np.ndarray = field(default_factory=lambda: np.arange(2))  # of states
    log_next: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    class_totals: np.ndarray = field(default_factory=lambda: np.ones(2))
    end_count: int = 0
    total: int = 0  # N
    distinct: int = 0  # V
    tail_total: int = 0
    tail_words: int = 0
    discount: float = 0.5
    head_from: int = 1  # head words have this count bin or a greater one

    #: States: 0 is the end of a text, 1 the tail, then the classes of head words. While the commonest words are
    #: clustered each of them is a state, and the others form states by the power of two of their count.

    def states(self, ids: np.ndarray) -> np.ndarray:
        """States of head words, of the tail (-1) and of ends (-2)."""
        return np.concatenate([self.state, [0, 1]]).astype(np.int64)[ids]

    def emit(self, at: np.ndarray) -> np.ndarray:
        """log10 p(word | class) of head words."""
        return np.log10(self.counts[at] / self.class_totals[self.classes[self.state[at]]])

    @property
    def log_emit(self) -> np.ndarray:
        return self.emit(np.arange(len(self.counts)))


def _bin(n: Column) -> Column:
    return F.floor(F.log2(n) * BINS)


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS) -> Model:
    """A model that knows the words of ``word_counts`` (which should be stored), but no classes yet."""
    words = counts.where(F.col("word") != END)
    total, distinct, end = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    if not total:
        return Model()
    # At most 64 * BINS bins, however many words there are.
    bins = sorted(words.groupBy(_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["bin"])
    held, head_from = 0, None
    for row in bins:
        if held + row["words"] > head_words or row["bin"] < np.log2(HEAD_COUNT) * BINS:
            break
        held, head_from = held + row["words"], row["bin"]
    head_from = (bins[0]["bin"] + 1 if bins else 1) if head_from is None else head_from
    head = words.where(_bin(F.col("n")) >= head_from).select(F.xxhash64("word").alias("hash"), "n").toArrow()
    tail = words.where(_bin(F.col("n")) < head_from)
    tail_total, tail_words, once, twice = tail.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("int")), F.sum((F.col("n") == 2).cast("int"))).first()
    model = Model(total=total, distinct=distinct, end_count=end or 0, tail_total=tail_total or 0, tail_words=tail_words, head_from=int(head_from))
    model.discount = once / (once + 2 * twice) if once and twice else 0.5
    hashes = head.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model.index = Index(hashes[order])
    model.counts = head.column("n").to_numpy()[order]
    model.state = np.ones(len(order), dtype=np.int16)
    return model


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, ..., key, ids, words, times).

    ``ids`` are the text's head words as packed 32-bit numbers, -1 for others, -2 for the end; ``words`` and ``times``
    the distinct others. ``key`` is a digest of id and text.
    """
    names = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model.index)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in sliced(parts):
            keys, ids, rare, times = [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
                words = tokens(text)
                at = index.find(words)
                others = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                keys.append(xxhash.xxh3_128_digest(b"%s|%s" % (str(doc_id).encode(), text)))
                ids.append(np.append(at, -2).astype("<i4").tobytes())
                rare.append(list(others))
                times.append(list(others.values()))
            yield with_columns(
                part, names, key=pa.array(keys, pa.binary()), ids=pa.array(ids, pa.binary()),
                words=pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), times=pa.array(times, pa.list_(pa.int64())),
            )

    return docs.mapInArrow(run, f"{fields(docs, names)}key binary, ids binary, words array<string>, times array<long>")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of packed rows, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<i4"), np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))


def learn(model: Model, encoded: DataFrame, exchange_words: int = EXCHANGE_WORDS, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Give ``model`` classes and their transitions, from the ``encode``d training rows."""
    if not model.total:
        return model
    common = np.argsort(-model.counts, kind="stable")[:exchange_words]
    n = len(common)
    bands = np.floor(np.log2(np.maximum(1, model.counts))).astype(np.int64)
    others = np.ones(len(bands), dtype=bool)
    others[common] = False
    names, band = np.unique(bands[others], return_inverse=True)
    model.state = np.zeros(len(bands), dtype=np.int16)
    model.state[common] = 2 + np.arange(n)
    model.state[others] = 2 + n + band
    model.n_states = 2 + n + len(names)
    bigrams = state_bigrams(encoded, model)
    # Exchange words move between classes; the end, the tail and the bands keep their own.
    own = exchange(bigrams[2 : 2 + n, 2 : 2 + n], classes) if n else np.zeros(0, dtype=np.int64)
    used, own = np.unique(own, return_inverse=True)
    of = np.concatenate([[0, 1], 2 + own, 2 + len(used) + np.arange(len(names))]).astype(np.int64)
    by_class = np.zeros((model.n_states, 2 + len(used) + len(names)))
    by_class[np.arange(model.n_states), of] = 1
    pairs = by_class.T @ bigrams @ by_class
    model.state, model.n_states = of[model.state].astype(np.int16), len(pairs)
    if len(names):
        pairs = cluster(encoded, model, pairs, 2 + len(used), rounds)
    # Classes that have lost all their words go.
    alive = np.unique(np.concatenate([[0, 1], model.state]))
    pairs = pairs[np.ix_(alive, alive)]
    k = model.n_states = len(alive)
    model.state = np.searchsorted(alive, model.state).astype(np.int16)
    model.classes = np.arange(k)
    share = (pairs.sum(axis=0) + 0.1) / (pairs.sum() + 0.1 * k)
    model.log_next = np.log10((pairs + 2.0 * share) / (pairs.sum(axis=1, keepdims=True) + 2.0))
    model.class_totals = np.maximum(1.0, np.bincount(model.state, model.counts, k))
    return model


def likelihood(pairs: np.ndarray) -> float:
    """Of class bigrams, but for what the words' counts alone decide."""
    return float(_f(pairs).sum() - _f(pairs.sum(axis=0)).sum() - _f(pairs.sum(axis=1)).sum())


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def cluster(encoded: DataFrame, model: Model, pairs: np.ndarray, stop: int, rounds: int = ROUNDS) -> np.ndarray:
    """Move all head words between the classes 2, ..., ``stop`` - 1; the class bigrams of the result.

    Words that are in a later class, as all but the commonest are at first, leave it in any case.
    """
    for i in range(rounds):
        before = model.state
        moved = moves(encoded, model, pairs, stop)
        model.state = before.copy()
        model.state[moved.column("id").to_numpy()] = moved.column("class").to_numpy()
        after = state_bigrams(encoded, model)
        if i and likelihood(after) <= likelihood(pairs):
            model.state = before
            break
        pairs = after
        if len(moved) <= len(before) // 200:
            break
    return pairs


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their counts; neighbouring keys differ by little."""
    steps = np.diff(key, prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(steps.astype("<i8").tobytes() + n.astype("<i8").tobytes())


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype="<i8").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    all_keys, all_n = np.concatenate([np.zeros(0, dtype=np.int64), *keys]), np.concatenate([np.zeros(0, dtype=np.int64), *n])
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, dtype=np.int64)
    return all_keys[first], np.add.reduceat(all_n[order], first) if len(first) else all_n


def _counted(encoded: DataFrame, model: Model, keys_of: Callable, group: int, use: Callable, schema: str) -> DataFrame:
    """Counts of ``keys_of(ids, states)`` over all rows; ``use(keys, counts)`` gets each shard's in order and yields batches.

    Keys that agree in ``key // group`` are in one shard. A text begins after an end: the first of ``ids`` is one.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            met, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]), return_counts=True)
            held.clear()
            shard = met // group % SHARDS
            by = np.argsort(shard, kind="stable")
            met, n, shard = met[by], n[by], shard[by]
            names, first = np.unique(shard, return_index=True)
            blobs = [_packed(k, c) for k, c in zip(np.split(met, first[1:]), np.split(n, first[1:]))] if len(met) else []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "cells"])

        for part in sliced(parts, "ids"):
            ids, _ = _ids(part.column("ids"))
            ids = np.concatenate([[-2], ids])
            held.append(keys_of(ids, own.states(ids)))
            size += len(held[-1])
            if size > HELD_KEYS:
                yield from flush()
                size = 0
        yield from flush()

    def reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, n, size = None, [], [], 0
        for part in parts:
            for name, cells in zip(part.column("shard").to_pylist(), part.column("cells").to_pylist()):
                if name != shard and keys:
                    yield from use(shared.value, *_summed(keys, n))
                    keys, n, size = [], [], 0
                shard = name
                key, count = _unpacked(cells)
                keys.append(key)
                n.append(count)
                size += len(key)
                if size > HELD_KEYS:
                    key, count = _summed(keys, n)
                    # What is left counts as nothing, so that each further round of summing has news of that size.
                    keys, n, size = [key], [count], 0
        if keys:
            yield from use(shared.value, *_summed(keys, n))

    cells = encoded.select("ids").mapInArrow(gather, "shard long, cells binary")
    return cells.repartition("shard").sortWithinPartitions("shard").mapInArrow(reduce, schema)


def moves(encoded: DataFrame, model: Model, pairs: np.ndarray, stop: int) -> pa.Table:
    """(id, class) of the head words that are better off in another class than their own.

    The words' bigrams with classes are summed by word; no word has more of them than two for each class.
    """
    k = model.n_states

    def keys_of(ids: np.ndarray, states: np.ndarray) -> np.ndarray:
        ids = ids.astype(np.int64)
        right = ids[:-1] * (2 * k) + states[1:]
        left = ids[1:] * (2 * k) + k + states[:-1]
        return np.concatenate([right[ids[:-1] >= 0], left[ids[1:] >= 0]])

    def choose(own: Model, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = np.unique(key // (2 * k))
        for i in range(0, len(words), 2048):
            ids = words[i : i + 2048]
            a, b = np.searchsorted(key, [ids[0] * 2 * k, (ids[-1] + 1) * 2 * k])
            best = better(key[a:b], n[a:b].astype(np.float64), ids, own.state[ids].astype(np.int64), pairs, stop)
            moved = best != own.state[ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(best[moved], pa.int32())], ["id", "class"])

    return _counted(encoded, model, keys_of, 2 * k, choose, "id long, class int").toArrow()


def better(key: np.ndarray, n: np.ndarray, ids: np.ndarray, state: np.ndarray, pairs: np.ndarray, stop: int) -> np.ndarray:
    """The class of 2, ..., ``stop`` - 1 in which each word's bigrams are likeliest; its own if none is likelier.

    ``key`` is sorted: word * 2k + class for the words' right neighbours, + k for the left ones. All the words
    are judged against the same class bigrams, less their own for the class that they are in.
    """
    k = len(pairs)
    at = np.searchsorted(ids, key // (2 * k))
    cell = key % (2 * k)
    both = np.concatenate([pairs.T, pairs])  # of right neighbours: [c] to class of the word; of left ones: [k + c]
    base = both[cell]
    add = _f(base + n[:, None]) - _f(base)
    rows = np.arange(len(key))
    own = base[rows, state[at]]
    add[rows, state[at]] = _f(own) - _f(np.maximum(0, own - n))
    first = np.searchsorted(at, np.arange(len(ids)))
    gain = np.add.reduceat(add, first, axis=0)
    for totals, side in ((pairs.sum(axis=1), cell < k), (pairs.sum(axis=0), cell >= k)):
        times = np.bincount(at[side], n[side], len(ids))
        less = _f(totals + times[:, None]) - _f(totals)
        own = totals[state]
        less[np.arange(len(ids)), state] = _f(own) - _f(np.maximum(0, own - times))
        gain -= less
    gain[:, :2] = gain[:, stop:] = -np.inf
    best = np.argmax(gain, axis=1)
    words = np.arange(len(ids))
    return np.where(gain[words, best] > gain[words, state] + 1e-9, best, state)


def state_bigrams(encoded: DataFrame, model: Model) -> np.ndarray:
    """How often each state follows each other one; a text begins after an end. The driver gets the sums, ``n_states`` squared at most."""
    k = model.n_states

    def cells(_: Model, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    got = _counted(encoded, model, lambda _, states: states[:-1] * k + states[1:], k, cells, "cell long, n long").toArrow()
    out = np.zeros(k**2)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k, k)


def score(encoded: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Per row of ``encoded``: its columns but those of ``encode``, then n_tokens, n_known, base_score, score.

    Null text is empty: one token, its end. Rows that repeat, or share an id, are scored each for itself.
    Without training rows every token is the unknown one: all scores are 0.
    """
    names = [c for c in encoded.columns if c not in ("ids", "words", "times")]
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        end = np.log10(own.end_count + 0.1)
        base = np.log10(own.counts + 0.1)
        emit = own.log_emit
        for part in sliced(parts, "ids"):
            ids, sizes = _ids(part.column("ids"))
            if not len(sizes):
                continue
            states = own.states(np.concatenate([[-2], ids]))
            head = ids >= 0
            values = np.zeros((3, len(ids)))
            values[0, head] = 1
            values[1, head] = base[ids[head]]
            values[2] = own.log_next[states[:-1], states[1:]]
            values[2, head] += emit[ids[head]]
            known, head_base, head_score = np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=1)
            n_rare = np.fromiter((len(x) for x in part.column("times")), np.int64, len(sizes))
            yield with_columns(
                part, names, n_tokens=pa.array(sizes, pa.int64()), head_known=pa.array(known.astype(np.int64) + (own.end_count > 0)), head_base=pa.array(head_base + end),
                head_score=pa.array(head_score), n_rare=pa.array(n_rare, pa.int64()),
            )

    rows = encoded.select(*names, "ids", "times").mapInArrow(run, f"{fields(encoded, names)}n_tokens long, head_known long, head_base double, head_score double, n_rare long")
    rare = encoded.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    tail = counts.where((F.col("word") != END) & (_bin(F.col("n")) < model.head_from)).select("word", "n")
    unknown = model.discount * model.tail_words / model.tail_total if model.tail_total else 1.0
    n = F.coalesce("n", F.lit(0))
    emit = F.when(n > 0, F.log10((n - model.discount) / float(model.tail_total or 1))).otherwise(float(np.log10(unknown)))
    sums = (
        rare.join(tail, "word", "left")
        .groupBy("key")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.when(n > 0, F.col("t")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("t") * F.log10(n + 0.1)).alias("tail_base"),
            F.sum(F.col("t") * emit).alias("tail_score"),
        )
    )
    # Equal rows (same id, same text) share a key, and each has sent its rare words: take one row's part.
    part = lambda c: F.coalesce(F.col(c) * F.col("n_rare") / F.col("rows"), F.lit(0.0))
    norm = float(np.log10(model.total + 0.1 * (model.distinct + 1)))
    return rows.join(sums, "key", "left").select(
        *[c for c in names if c != "key"],
        "n_tokens",
        (F.col("head_known") + F.round(part("tail_known")).cast("long")).alias("n_known"),
        (F.col("head_base") + part("tail_base") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("head_score") + part("tail_score") if model.total else F.lit(0.0)).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` scored by a model of its training rows; further columns are not read.

    Null text is empty; texts may be of any length; rows that repeat are scored, and learnt from, each for itself;
    rows without an id are scored, never learnt from. No rows give no rows.
    """
    held_out = is_held_out(F.col("doc_id"), 10, 0)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = F.col("doc_id").isNotNull() & ~F.col("held_out")
    counts = stored(word_counts(rows.where(training)))
    model = vocabulary(counts)
    encoded = stored(encode(rows, model))
    learn(model, encoded.where(training))
    scored = score(encoded, counts, model)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
