"""Helpers shared by the operators: tables, the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch between Spark and its Python workers: texts are wide.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_batches(spark: SparkSession) -> None:
    """Let the session send whole texts to Python workers in batches of ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: The folder of a local session that names none.
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, where all share one machine, may lack that setting; a temporary folder takes its place.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _own_dir = _own_dir or tempfile.mkdtemp(prefix="loomwell-")
    return f"{base.rstrip('/')}/loomwell-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loomwell_folder = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``stored`` frames that nothing reads any more."""
    for frame in frames:
        delete_folder(frame.sparkSession, frame.loomwell_folder)


def fields(df: DataFrame, names: list[str] | None = None) -> str:
    """The columns of ``df`` (or those named) as the beginning of a DDL schema, in their order and of their types."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if names is None or f.name in names)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def is_held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """True for the fold that is never learnt from; a null id is not held out and never learnt from either."""
    return F.coalesce(crc_mod(doc_id, n) == remainder, F.lit(False))


def is_training(doc_id: Column, n: int, remainder: int) -> Column:
    return F.coalesce(crc_mod(doc_id, n) != remainder, F.lit(False))


def spread(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the id alone, for bounded samples of training rows."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``size`` bytes of text (one row at least). No row is cut."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start, held = [], 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                ends.append((start, i))
                start, held = i, 0
            held += n
        ends.append((start, batch.num_rows))
        for a, b in ends:
            if b > a:
                yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """Each text's bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """A batch of the kept columns followed by new ones."""
    arrays = [batch.column(c) for c in keep] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *columns])


# ---------------------------------------------------------------- words as hashes

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that stand in words: digits, letters and everything beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: The same for bytes.translate: A-Z lower-cased, bytes outside words become blanks.
WORD_TABLE = bytes(int(LOWER[i]) if WORD_BYTE[i] else 32 for i in range(256))

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; what is kept is enough for a slice, a longer text has tables of its own."""
    if len(_powers) == 2 and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, SLICE_BYTES + 4096)
    made = []
    for base in (_P, _P_INV):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if size == SLICE_BYTES + 4096:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a run of texts: bounds in the joined bytes, the text each belongs to, hashes.

    ``hashes(k)`` hashes the first k bytes of each word (all of it by default), in time that does not
    depend on the words' lengths, from one running sum over the joined bytes.
    """

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes)
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(self.raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = WORD_BYTE[self.raw]
        first = np.zeros(n + 1, dtype=bool)  # a text begins here, or ends just before
        first[self.text_ends] = True
        first[self.text_ends - sizes] = True
        here, before = inside[1:], inside[:-1]
        self.starts = np.flatnonzero(here & (~before | first))
        self.ends = np.flatnonzero(before & (~here | first))
        self.text_of = np.searchsorted(self.text_ends, self.starts, side="right")
        self.per_text = np.bincount(self.text_of, minlength=self.n_texts)
        self._sum: np.ndarray | None = None

    def hashes(self, k: int | None = None) -> np.ndarray:
        n = len(self.raw)
        power, inverse = _power_tables(n + 1)
        if self._sum is None:
            self._sum = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((LOWER[self.raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sum[1:])
        ends = self.ends if k is None else np.minimum(self.ends, self.starts + k)
        return mix((self._sum[ends] - self._sum[self.starts]) * inverse[self.starts])


# ---------------------------------------------------------------- bounded samples of labelled rows


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, training: Column, limit: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, label, u, ...) of about ``limit`` labelled training rows, a random choice by ``u``, a hash of the id.

    ``training`` is a condition on doc_id. Labels that are null teach nothing; of several for one id the
    greatest counts. The chosen ids are at most ``limit``, and so may be broadcast; rows that share an id all come.
    """
    known = labels.where(training & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    n = known.count()
    chosen = known.withColumn("u", spread(F.col("doc_id"), 1)).where(F.col("u") < 1.2 * limit / max(1, n)).orderBy("u", "doc_id").limit(limit)
    return docs.select("doc_id", "text", *extra).join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Steps on a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
