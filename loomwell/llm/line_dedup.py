"""Line dedup against levelled sorted runs of line hashes.

The store is a log of *runs* in the shared folder. A run is a table of (hash, documents), bucketed and
sorted by the 128-bit hash of a line, so that joins between a batch and the runs are merges: the runs are
neither shuffled nor sorted again. Adding a batch of documents

1. counts the batch's own line hashes (summed before the shuffle, so that a line that a third of all
   documents hold arrives as one row for each task), dealt and sorted like a run;
2. merge-anti-joins them with the *settled* runs, the hashes already known to be in enough documents:
   for those nothing is left to learn;
3. merges in what the levelled runs know of the rest, and writes it as a new run of level 0; hashes that
   have now reached the threshold count as settled.

When a level holds ``fanout`` runs, they are merged into one run of the next level, and settled runs likewise.

``drop_lines`` joins documents with the settled hashes. Nothing is broadcast by hand and nothing goes
through the driver, so the number of repeated lines is unbounded; a hot hash meets one row of the
settled run, and Spark may split its side of the join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, fields, shared_dir, sliced, stored, utf8, with_columns

#: Stripped at both ends of a line: space and the bytes 9 to 13.
BLANK = b" \t\n\x0b\x0c\r"
#: Hashes of a bucket of a run, about; more hashes take more buckets.
BUCKET_HASHES = 4_000_000
#: Spark's own bound of a table's buckets; beyond, buckets grow.
MOST_BUCKETS = 100_000
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _keys(text: bytes) -> list[bytes]:
    """Each line stripped, with A-Z lower-cased (bytes.lower touches nothing else)."""
    return [line.strip(BLANK) for line in text.lower().split(b"\n")]


_hash = xxhash.xxh3_128_digest


def _characters(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per row of ``docs``: (doc_id, text_key, lines_key, hashes of the distinct line keys of at least ``min_chars``).

    ``text_key`` is the text's digest, ``lines_key`` that of its set of hashes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            rows = []
            for text in utf8(part.column("text")):
                keys = set(_keys(text))
                rows.append(sorted(_hash(k) for k in keys if k and (min_chars < 2 or _characters(k) >= min_chars)))
            own = pa.array([_hash(b"".join(r)) for r in rows], pa.binary())
            yield with_columns(part, ["doc_id", "text_key"], lines_key=own, hashes=pa.array(rows, pa.list_(pa.binary())))

    rows = docs.select("doc_id", "text", _text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, f"{fields(docs, ['doc_id'])}text_key binary, lines_key binary, hashes array<binary>")


class RunStore:
    """Levelled runs of line hashes. ``add`` takes (owner columns, hashes) of one batch; an owner counts once for each hash."""

    def __init__(self, spark: SparkSession, min_documents: int = 10, fanout: int = 4, buckets: int = 8):
        self.spark, self.min_documents, self.fanout, self.buckets = spark, min_documents, fanout, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.tables: list[tuple[str, str]] = []

    def joined(self, hashes: DataFrame) -> DataFrame:
        """(hash, documents, total) of the hashes of a batch that are not settled; ``total`` is with what the runs know."""
        owners = [c for c in hashes.columns if c != "hashes"]
        own = hashes.select(*owners, F.explode("hashes").alias("hash")).distinct().groupBy("hash").agg(F.count("*").alias("documents"))
        own = own.repartition(self.buckets, "hash")
        for run in self.settled:
            own = own.join(run.select("hash").hint("merge"), "hash", "left_anti")
        known = []
        for run in (run for level in self.levels for run in level):
            known.append(f"documents_{len(known)}")
            own = own.join(run.select("hash", F.col("documents").alias(known[-1])).hint("merge"), "hash", "left")
        total = F.col("documents")
        for c in known:
            total = total + F.coalesce(c, F.lit(0))
        return own.select("hash", "documents", total.alias("total"))

    def add(self, hashes: DataFrame) -> None:
        with self._sorted_scans():
            run = self._run(self.joined(hashes))
            self.levels[0].append(run.where(F.col("total") < self.min_documents).select("hash", "documents"))
            self.settled.append(run.where(F.col("total") >= self.min_documents).select("hash", F.col("total").alias("documents")))
            for i, level in enumerate(self.levels):
                if len(level) >= self.fanout:
                    if i + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[i + 1].append(self._merged(level))
                    self.levels[i] = []
            if len(self.settled) >= self.fanout:
                self.settled = [self._merged(self.settled)]

    def finish(self) -> DataFrame:
        """(hash, documents) of the settled hashes, in the shared folder; the runs are deleted."""
        out = self.spark.createDataFrame([], "hash binary, documents long")
        for run in self.settled:
            out = out.unionByName(run)
        out = stored(out)
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE {name}")
            delete_folder(self.spark, path)
        self.levels, self.settled, self.tables = [[]], [], []
        return out

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, merged two at a time: a full outer merge join of sorted buckets."""
        out = runs[0]
        for run in runs[1:]:
            both = out.join(run.select("hash", F.col("documents").alias("more")).hint("merge"), "hash", "full_outer")
            out = self._run(both.select("hash", (F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents")))
        return out

    def _run(self, df: DataFrame) -> DataFrame:
        name, path = f"loomwell_{uuid.uuid4().hex}", shared_dir(self.spark)
        df.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name)

    @contextmanager
    def _sorted_scans(self) -> Iterator[None]:
        """Lets Spark rely on the order within a bucket, which it does not by default."""
        before = self.spark.conf.get(_ORDERED)
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDERED, before)


def drop_lines(docs: DataFrame, hashes: DataFrame, settled: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (the text without the lines whose key is settled), ``n_lines`` and ``n_dropped``.

    The join brings each row the settled hashes among its own, by id and text, so that rows that share an
    id, or have none, are told apart.
    """
    hits = (
        hashes.select("doc_id", "text_key", F.explode("hashes").alias("hash"))
        .join(settled.select("hash"), "hash", "left_semi")
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"))
        .agg(F.collect_set("hash").alias("hits"))
    )
    keyed = docs.withColumn("text_key", _text_key(F.col("text")))
    joined = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits["hit_id"]) & (keyed["text_key"] == hits["hit_key"]), "left")
    names = [c for c in docs.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            kept, n_lines, n_dropped = [], [], []
            for text, hit in zip(utf8(part.column("text")), part.column("hits").to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if hit:
                    bad = set(hit)
                    keep = [line for line, key in zip(lines, _keys(text)) if not key or _hash(key) not in bad]
                    n_dropped.append(len(lines) - len(keep))
                    text = b"\n".join(keep)
                else:
                    n_dropped.append(0)
                kept.append(text)
            yield with_columns(part, names, kept=pa.array(kept, pa.binary()).cast(pa.string()), n_lines=pa.array(n_lines, pa.int64()), n_dropped=pa.array(n_dropped, pa.int64()))

    rows = joined.select(*[F.col(f"`{c}`") for c in names], "hits", "text")
    return rows.mapInArrow(run, f"{fields(docs, names)}kept string, n_lines long, n_dropped long")


def dedup_lines(
    docs: DataFrame, min_documents: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, copies_count: bool = True, groups: DataFrame | None = None
) -> DataFrame:
    """Drop, in every document, the lines whose key at least ``min_documents`` documents of ``docs`` hold.

    The result has the columns of ``docs`` but ``text``, then ``kept``, ``n_lines`` and ``n_dropped``, a row for
    each row. A document is an id, of any type: rows that share one count once for a line. Rows without an id
    count once for each different text. Without ``copies_count`` documents that have the same set of line keys
    count once together, whatever their ids, so that copies of a text alone take no line away.
    ``groups`` (doc_id, group) names documents that count once together; those that it does not name count as before.
    Null or empty text is one empty line, which has no key and stays; so do lines of blanks. Texts and lines may
    be of any length. An empty table gives an empty table; further columns pass through, unless they are named
    like the new ones, which replace them.
    """
    docs = docs.drop("hits", "hit_id", "hit_key", "text_key", "kept", "n_lines", "n_dropped")
    owner = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id").isNull(), F.col("text_key")).alias("key")) if copies_count else F.struct(F.lit(None).cast("string").alias("id"), F.col("lines_key").alias("key"))
    hashes = line_hashes(docs, min_chars)
    if groups is not None:
        # An id may have several rows, and is of one group, the least.
        named = groups.groupBy("doc_id").agg(F.min("group").cast("string").alias("group"))
        hashes = hashes.join(named, "doc_id", "left")
        owner = F.when(F.col("group").isNotNull(), F.struct(F.concat(F.lit("group "), "group").alias("id"), F.lit(None).cast("binary").alias("key"))).otherwise(owner)
    # All rows of what counts as one document are in one batch.
    hashes = hashes.select("doc_id", "text_key", "hashes", owner.alias("owner"))
    hashes = stored(hashes.withColumn("batch", F.pmod(F.xxhash64("owner"), F.lit(batches)).cast("int")), "batch")
    n = hashes.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    store = RunStore(docs.sparkSession, min_documents, fanout, min(MOST_BUCKETS, max(8, -(-n // BUCKET_HASHES))))
    for i in range(batches):
        store.add(hashes.where(F.col("batch") == i).select("owner", "hashes"))
    return drop_lines(docs, hashes, store.finish())


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, coalesce('id ' || CAST(doc_id AS VARCHAR), 'text ' || text) AS document, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT *, string_split(text, chr(10)) AS l FROM rows))),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT document) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.key = f.key
GROUP BY r
"""
