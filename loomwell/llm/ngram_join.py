"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. *Sketch.* One pass over the texts gives each its set of word n-grams (as 64-bit hashes), a key of
   that set, and ``bands`` hashes of ``rows`` minima each. Bands and rows follow from the threshold and
   the recall wanted of pairs at the threshold.
2. *Classes.* Documents with equal sets are one class, a node with a number of its own; its least id names
   it at the end. From here on only one text of each takes part, so a text copied a million times counts as one.
3. *Candidates.* Nodes are shuffled on their band hashes; a bucket with one member is dropped.
4. *Blocks.* Each node belongs to one block: those that share buckets are kept together by passing the least
   node among a bucket's members around twice, and a group that is too large is dealt into several blocks of
   bounded size. Texts move once, to their block.
5. *Verification.* A block's task compares the pairs that share a band on their whole sets. Two blocks that
   meet in some bucket are compared, too: what moves then is one row for each block, its sets packed over the
   block's distinct n-grams, of which near copies have few. Of a group of G texts that all resemble each other
   come counts of links and for each two blocks at most a tree of links, not all pairs. No pair is left out.
6. *Groups.* Connected components of those links, by alternating stars on the edge table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, fields, mix, sliced, stored, utf8, with_columns

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_BANDS = 32
#: N-grams that all hash functions are applied to at once.
STEP_GRAMS = 1024
#: A block holds about so many n-grams and documents at most.
BLOCK_GRAMS = 250_000
BLOCK_DOCS = 256


def banding(threshold: float, recall: float, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, with which a pair at the threshold
    meets in some band with probability ``recall``: 1 - (1 - threshold ** rows) ** bands."""
    best = (max_bands, 1)
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands <= max_bands:
            best = (bands, rows)
    return best


def gram_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes. A text of fewer words, but not none, is one n-gram."""
    words = Words(texts)
    h = words.hashes()
    out, start = [], 0
    for size in words.per_text.tolist():
        own = h[start : start + size]
        start += size
        k = min(n, size)
        if not k:
            out.append(own)
            continue
        grams = np.zeros(size - k + 1, dtype=np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[j : size - k + 1 + j]
        out.append(np.unique(mix(grams)))
    return out


class Sketcher:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        minima = np.full(len(self.factor), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), STEP_GRAMS):
            hashed = np.multiply.outer(self.factor, x[i : i + STEP_GRAMS])
            hashed += self.shift[:, None]
            np.minimum(minima, hashed.min(axis=1), out=minima)
        h = np.arange(self.bands, dtype=np.uint64) + np.uint64(1)
        for column in minima.astype(np.uint64).reshape(self.bands, self.rows).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h.view(np.int64)


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, set_key, n_grams, bands) of rows with an id; a text without words has its own text as key, and no bands."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(bands, rows)
        for part in sliced(parts):
            texts = utf8(part.column("text"))
            sets = gram_sets(texts, n)
            yield with_columns(
                part,
                ["doc_id", "text_hash"],
                set_key=pa.array([xxhash.xxh3_128_digest(s if len(s) else b"no words:" + t) for s, t in zip(sets, texts)], pa.binary()),
                n_grams=pa.array([len(s) for s in sets], pa.int64()),
                bands=pa.array([sketch(s).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64())),
            )

    return _named(docs).mapInArrow(run, f"{fields(docs, ['doc_id'])}text_hash long, set_key binary, n_grams long, bands array<long>")


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash) of rows with an id; the hash tells rows that share one apart."""
    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def _classes(rows: DataFrame) -> DataFrame:
    """(node, set_key, rep, text_hash, copies, n_grams, bands): one row for each distinct set, numbered."""
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = rows.groupBy("set_key").agg(least, F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    # The numbers hold from here on, because the table is written before anything reads them.
    return stored(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("least.doc_id").alias("rep"), "least.text_hash", "copies", "n_grams", "bands"))


def _blocks(classes: DataFrame) -> DataFrame:
    """(node, bucket, block): the buckets that nodes share, and the block of each."""
    at = classes.select("node", "n_grams", F.explode("bands").alias("bucket"))
    met = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    members = stored(at.join(met, "bucket"))
    # Twice round: the least label among a bucket's members, the least of a member's buckets.
    label = members.groupBy("node").agg(F.min("least").alias("label"))
    again = members.select("node", "bucket").join(label, "node").groupBy("bucket").agg(F.min("label").alias("least"))
    key = members.select("node", "bucket", "n_grams").join(again, "bucket").groupBy("node").agg(F.min("least").alias("key"), F.min("n_grams").alias("n_grams"))
    size = key.groupBy("key").agg(F.greatest(F.ceil(F.sum("n_grams") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_DOCS)).alias("parts"))
    # Blocks whose hashes agree would be one: larger, and as right.
    block = key.join(size, "key").select("node", F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    out = stored(members.select("node", "bucket").join(block, "node"))
    discard(members)
    return out


def _meetings(blocks: DataFrame) -> DataFrame:
    """(one, other): each two blocks that meet in some bucket, once; either may come first, so that no block is always first."""
    at = blocks.select("bucket", F.col("block").alias("low")).distinct()
    # Most buckets lie within one block.
    wide = at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    at = at.join(wide, "bucket")
    pairs = at.join(at.withColumnRenamed("low", "high"), "bucket").where("low < high").select("low", "high").distinct()
    swap = F.xxhash64("low", "high") % 2 == 0
    return pairs.select(F.when(swap, F.col("high")).otherwise(F.col("low")).alias("one"), F.when(swap, F.col("low")).otherwise(F.col("high")).alias("other"))


class Block:
    """Some nodes with their copies, bands (32 bits of each) and sets, these as places in the block's distinct n-grams."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.copies, self.bands = nodes, copies, bands.astype(np.uint32)
        self.values, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.place = place.astype(np.int32)
        self.sizes = np.array([len(s) for s in sets])

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(self, protocol=5))

    @staticmethod
    def unpack(packed: bytes) -> Block:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sets(self) -> list[np.ndarray]:
        return np.split(self.place, np.cumsum(self.sizes)[:-1])


def overlaps(a: Block, b: Block, budget: int = 1 << 24) -> np.ndarray:
    """The sizes of the intersections of each set of ``a`` with each of ``b``, from packed bits over the n-grams that can be in one."""
    if a is b:
        column_a = column_b = np.full(len(a.values), -1)
        shared = np.flatnonzero(np.bincount(a.place, minlength=len(a.values)) > 1)
        column_a[shared] = np.arange(len(shared))
    else:
        shared, at_a, at_b = np.intersect1d(a.values, b.values, assume_unique=True, return_indices=True)
        column_a, column_b = np.full(len(a.values), -1), np.full(len(b.values), -1)
        column_a[at_a] = column_b[at_b] = np.arange(len(shared))
    total = np.zeros((len(a.sizes), len(b.sizes)), dtype=np.int32)
    width = max(64, budget // max(total.shape) // 64 * 64)  # columns at a time

    def bits(block: Block, column: np.ndarray, first: int, n: int) -> np.ndarray:
        at = column[block.place]
        inside = (at >= first) & (at < first + n)
        out = np.zeros((len(block.sizes), -(-n // 64) * 64), dtype=bool)
        out[block.owners()[inside], at[inside] - first] = True
        return np.packbits(out, axis=1).view(np.uint64)

    for first in range(0, len(shared), width):
        n = min(width, len(shared) - first)
        left = bits(a, column_a, first, n)
        right = left if a is b else bits(b, column_b, first, n)
        for i, row in enumerate(left):
            total[i] += np.bitwise_count(right & row).sum(axis=1, dtype=np.int32)
    return total


def verify(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each node of ``a`` and of ``b`` to documents of the other, and links that join all that are linked.

    If both are one block, its pairs count once, and the second array is 0.
    """
    near = np.zeros((len(a.nodes), len(b.nodes)), dtype=bool)
    for left, right in zip(a.bands.T, b.bands.T):
        near |= left[:, None] == right[None, :]
    # Sets whose sizes differ too much cannot reach the threshold.
    near &= np.minimum.outer(a.sizes, b.sizes) >= threshold * np.maximum.outer(a.sizes, b.sizes)
    if a is b:
        np.fill_diagonal(near, False)
    pairs = np.argwhere(np.triu(near) if a is b else near)
    linked = np.zeros_like(near)
    if a is b and len(pairs) <= 2 * len(a.nodes):
        sets = a.sets()
        for i, j in pairs.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked[i, j] = linked[j, i] = both >= threshold * (a.sizes[i] + a.sizes[j] - both)
    elif len(pairs):
        both = overlaps(a, b)
        linked = near & (both >= threshold * (np.add.outer(a.sizes, b.sizes) - both))
    # A tree over each group of links.
    edges: list[tuple[int, int]] = []
    open_b, rows, done = np.ones(len(b.nodes), dtype=bool), np.flatnonzero(linked.any(axis=1)), np.zeros(len(a.nodes), dtype=bool)
    for start in rows.tolist():
        stack = [] if done[start] else [start]
        done[start] = True
        if stack and a is b:
            open_b[start] = False
        while stack:
            i = stack.pop()
            found = np.flatnonzero(linked[i] & open_b)
            open_b[found] = False
            edges += [(int(a.nodes[i]), int(b.nodes[j])) for j in found]
            if a is b:
                new = found[~done[found]]
                done[new] = True
                stack += new.tolist()
                continue
            for j in found.tolist():
                new = np.flatnonzero(linked[:, j] & ~done)
                done[new] = True
                edges += [(int(a.nodes[k]), int(b.nodes[j])) for k in new]
                stack += new.tolist()
    links_b = np.zeros(len(b.nodes), dtype=np.int64) if a is b else linked.T @ a.copies
    return linked @ b.copies, links_b, edges


_FOUND = "a long, b long, links long"


def _found(parts: list[tuple[np.ndarray, np.ndarray]], edges: list[tuple[int, int]]) -> list[pa.Array]:
    """Rows (a, b, links): for a node its links (b null), for a link its ends (links null)."""
    nodes, links = (np.concatenate(x) for x in zip(*parts))
    met = np.flatnonzero(links)
    return [
        pa.array([*nodes[met].tolist(), *(e[0] for e in edges)], pa.int64()),
        pa.array([None] * len(met) + [e[1] for e in edges], pa.int64()),
        pa.array([*links[met].tolist(), *[None] * len(edges)], pa.int64()),
    ]


def _grouped(parts: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows that agree in ``key``, of batches in its order."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        keys = part.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and start < stop and held[-1].column(key)[0].as_py() != keys[start]:
                yield held[-1].column(key)[0].as_py(), pa.Table.from_batches(held)
                held = []
            if start < stop:
                held.append(part.slice(start, stop - start))
    if held:
        yield held[-1].column(key)[0].as_py(), pa.Table.from_batches(held)


def _within(blocks: DataFrame, meetings: DataFrame, classes: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """What the comparison within each block finds, and (block, packed) of blocks that meet others."""
    known = blocks.select("node", "block").distinct().join(classes.select("node", "rep", "text_hash", "copies", "bands"), "node")
    several = meetings.select(F.explode(F.array("one", "other")).alias("block")).distinct().withColumn("meets", F.lit(True))
    known = known.join(several, "block", "left").withColumnRenamed("text_hash", "known_hash")
    # Only texts of some block go on; repeats of a row are one, by the keys that the join has dealt them by.
    wanted = known.select(F.col("rep").alias("doc_id"), F.col("known_hash").alias("text_hash"))
    texts = _named(docs).join(wanted, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    rows = texts.join(known, (texts["doc_id"] == known["rep"]) & (texts["text_hash"] == known["known_hash"]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _grouped(parts, "block"):
            sets: list[np.ndarray] = []
            for batch in sliced(table.select(["text"]).to_batches()):
                sets += gram_sets(utf8(batch.column("text")), n)
            bands = np.array(table.column("bands").to_pylist(), dtype=np.int64).view(np.uint64)
            own = Block(table.column("node").to_numpy(), table.column("copies").to_numpy(), bands, sets)
            links, _, edges = verify(own, own, threshold)
            found = _found([(own.nodes, links)], edges)
            meets = bool(table.column("meets")[0].as_py())
            rest = [None] * len(found[0])
            found = [pa.concat_arrays([pa.nulls(int(meets), pa.int64()), x]) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([block] * meets + rest, pa.int64()), pa.array([own.pack()] * meets + rest, pa.binary()), *found], ["block", "packed", "a", "b", "links"])

    rows = rows.select("block", "node", "copies", "bands", "meets", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(run, f"block long, packed binary, {_FOUND}")


def _across(meetings: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """What the comparison of each two blocks that meet finds."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for one, other in zip(part.column("packed_one"), part.column("packed_other")):
                a, b = Block.unpack(one.as_py()), Block.unpack(other.as_py())
                links_a, links_b, edges = verify(a, b, threshold)
                yield pa.RecordBatch.from_arrays(_found([(a.nodes, links_a), (b.nodes, links_b)], edges), ["a", "b", "links"])

    rows = meetings.join(packed.select(F.col("block").alias("one"), F.col("packed").alias("packed_one")), "one")
    rows = rows.join(packed.select(F.col("block").alias("other"), F.col("packed").alias("packed_other")), "other")
    return rows.select("packed_one", "packed_other").mapInArrow(run, _FOUND)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least id of each node's connected component, for edges (a, b).

    Alternating stars: every node's greater neighbours are tied to its least one, then every node's
    lesser ones, until the edges no longer change. Each round is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Nodes keep the tie to their own least neighbour.
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        earlier, edges = edges, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(earlier)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id (of any type), class_id, copy_of, n_links.

    ``copy_of`` is the least id among the documents with the same n-gram set, ``class_id`` the least
    id of the group that links of at least ``threshold`` connect, ``n_links`` the number of other
    documents linked to this one, its copies included. Words are compared without case and marks.
    Texts without words are copies if they are equal, null being empty, and linked to nothing else. A row
    with a null id is linked to nothing, and its class is null. Rows that repeat count as copies; rows that
    share an id but not a text are documents of their own, each with its links. Texts may be of any length,
    tables empty; columns other than doc_id and text are not read.
    """
    bands, rows = banding(threshold, recall)
    docs = docs.select("doc_id", "text")
    all_rows = stored(sketches(docs, n, bands, rows))
    classes = _classes(all_rows)
    blocks = _blocks(classes)
    meetings = stored(_meetings(blocks))
    within = stored(_within(blocks, meetings, classes, docs, n, threshold))
    across = stored(_across(meetings, within.where("packed is not null"), threshold))
    found = within.where("packed is null").select("a", "b", "links").unionByName(across)
    roots = components(found.where("b is not null"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    names = classes.select("node", "rep")
    root = roots.join(names, "node").groupBy("root").agg(F.min("rep").alias("named"))
    of_node = roots.join(root, "root").select("node", "named")
    of_class = (
        classes.select("node", "set_key", "rep", "copies")
        .join(links, "node", "left")
        .join(of_node, "node", "left")
        .select("set_key", F.col("rep").alias("copy_of"), F.coalesce("named", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    of_class = stored(of_class)
    discard(classes, blocks, meetings, within, across)
    keyed = all_rows.select("doc_id", "set_key").join(of_class, "set_key").select("doc_id", "class_id", "copy_of", "n_links")
    nameless = docs.where("doc_id is null").select("doc_id")
    return keyed.unionByName(nameless.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links")))


def query(docs: DataFrame) -> DataFrame:
    return join(docs)
