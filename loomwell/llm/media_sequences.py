"""Media columns: interleaved documents of text and media references, resolved by digest.

``parse`` turns a page's HTML into one ordered array of parts, text runs and media references, each
with its position and, for media, a caption. A reference names its payload by a digest (``media:<digest>``).
``media_table`` holds every payload once, stored losslessly as the 8-bit samples of an image: a PNG of one
row of RGB pixels, with the length before padding in a text chunk. ``resolve`` joins references and media
by digest and puts what it found into the parts: their order, positions and captions stay, and a reference
whose payload is missing keeps its place with null media.

Payloads are joined or moved once for each distinct digest. What the join fans out to documents that
share a payload is what has been computed from it, not its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fields, shared_dir, sliced, stored, utf8, with_columns

WIDTH = 64
ROW_BYTES = 3 * WIDTH
#: Lines of a document between two references of its page.
RUN_LINES = 16
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTS = "array<struct<pos:int,kind:string,text:string,digest:string,source:string,caption:string>>"
_PART = pa.struct([("pos", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "digest", "source", "caption"))])

# ---------------------------------------------------------------- pages to parts

_SILENT = {"script", "style", "template", "noscript", "head", "nav", "footer"}
_BREAKING = {"p", "br", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "figure", "figcaption"}
_MEDIA = {"img", "video", "audio", "source"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, **fields) -> dict:
        part = {"pos": len(self.parts), "kind": kind, "text": None, "digest": None, "source": None, "caption": None} | fields
        self.parts.append(part)
        return part

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.flush()
            self.silent.append(tag)
        elif self.silent:
            return
        elif tag in _MEDIA:
            known = dict(attrs)
            if known.get("src"):
                self.flush()
                source = known["src"]
                digest = source[6:].lower() if source.startswith("media:") else None
                part = self.add("media", digest=digest, source=source, caption=known.get("alt") or known.get("title"))
                if self.figure is not None:
                    self.figure.append(part)
        elif tag in _BREAKING:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        elif self.silent:
            return
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for part in self.figure or []:
                part["caption"] = caption or part["caption"]
            if not self.figure and caption:
                self.add("text", text=caption)
            self.caption = None
        elif tag in _BREAKING:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def parse_page(html: str) -> list[dict]:
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    return page.parts


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its HTML, followed by ``parts``.

    Null or empty HTML has no parts; pages may be of any length and repeat; no rows give no rows. A column named
    parts is replaced, others pass through.
    """
    pages = pages.drop("parts")
    names = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, html):
            rows = [parse_page(x or "") for x in part.column(html).to_pylist()]
            yield with_columns(part, names, parts=pa.array(rows, pa.list_(_PART)))

    return pages.mapInArrow(run, f"{fields(pages, names)}parts {PARTS}")


# ---------------------------------------------------------------- payloads to stored media


def payload_of(text: Column) -> Column:
    """The text's UTF-8 bytes with blanks appended up to a positive multiple of one row of samples."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    whole = F.greatest(F.lit(1), F.ceil(n / ROW_BYTES)) * ROW_BYTES
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), (whole - n).cast("int")), "UTF-8"))


_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes, n_bytes: int) -> bytes:
    """A PNG of 8-bit RGB samples, which are the payload's bytes; a text chunk keeps the length before padding."""
    head = struct.pack(">IIBBBBB", len(payload) // 3, 1, 8, 2, 0, 0, 0)
    line = b"\0" + payload  # a row begins with its filter: none
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(line, 6)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> tuple[int, np.ndarray]:
    """The length before padding, and the samples, ``WIDTH`` pixels a row, as (rows, WIDTH, 3)."""
    at, chunks = len(_MAGIC), {}
    while media.startswith(_MAGIC) and at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a damaged image")
        chunks[kind] = data
        at += 12 + size
    if chunks.get(b"IHDR", b"")[8:] != bytes([8, 2, 0, 0, 0]):
        raise ValueError("not one of the stored images")
    samples = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), dtype=np.uint8)[1:]
    return int(chunks[b"tEXt"].split(b"\0")[1]), samples.reshape(-1, WIDTH, 3)


def digest_of(text: Column) -> Column:
    """The payload's SHA-256 and the length: texts that differ in trailing blanks only share a payload, not a length."""
    return F.concat_ws("-", F.sha2(payload_of(text), 256), F.coalesce(F.octet_length(text), F.lit(0)))


def media_table(docs: DataFrame) -> DataFrame:
    """(digest, media) for every distinct text of ``docs``; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            media = []
            for raw in utf8(part.column("text")):
                rows = max(1, -(-len(raw) // ROW_BYTES))
                media.append(png_of(raw.ljust(rows * ROW_BYTES, b" "), len(raw)))
            yield with_columns(part, ["digest"], media=pa.array(media, pa.binary()))

    keyed = docs.select("text", digest_of(F.col("text")).alias("digest"))
    return keyed.mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def store_media(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """``media_table`` in the shared folder, written in rounds by the digest; a round's shuffle files go before the next one begins.

    Beside the media themselves the disk so holds one round's share of them, whatever the table's size.
    """
    spark = docs.sparkSession
    path, before = shared_dir(spark), spark.conf.get(_TIDY)
    keyed = docs.select("text").withColumn("round", F.pmod(F.xxhash64(digest_of(F.col("text"))), F.lit(rounds)))
    spark.conf.set(_TIDY, "true")
    try:
        for k in range(rounds):
            media_table(keyed.where(F.col("round") == k)).write.mode("append").parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema("digest string, media binary").parquet(path)
    out.loomwell_folder = path
    return out


def feature_of(samples: np.ndarray) -> str:
    """Size, mean and spread of each channel, and a 64-bit average hash over an 8 x 8 grid."""
    flat = samples.reshape(-1, 3).astype(np.float64)
    mean, spread = flat.mean(axis=0), flat.std(axis=0)
    grey = samples.sum(axis=2).astype(np.float64)
    bands = np.array_split(np.arange(len(grey)), 8)
    grid = np.array([grey[b].mean(axis=0) if len(b) else grey.mean(axis=0) for b in bands]).reshape(8, 8, -1).mean(axis=2)
    bits = "".join("1" if x else "0" for x in (grid > grid.mean()).ravel())
    return f"{samples.shape[0]}x{samples.shape[1]} " + " ".join(f"{m:.3f}/{s:.3f}" for m, s in zip(mean, spread)) + f" {int(bits, 2):016x}"


READ_BACK = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """(digest, ...): what the stored bytes of each row of ``media`` hold, in the columns of ``READ_BACK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "media"):
            rows = []
            for stored_bytes in utf8(part.column("media")):
                n, samples = read_png(stored_bytes)
                payload = samples.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), feature_of(samples)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in READ_BACK.split(", ")]
            yield with_columns(part, ["digest"], **{n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return media.select("digest", "media").mapInArrow(run, f"digest string, {READ_BACK}")


# ---------------------------------------------------------------- digest join


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """``sequences`` whose ``parts`` have a further field ``media``: the columns that ``media`` has for their digest, or null.

    ``parts`` may have any fields besides pos, kind and digest. Each row asks for each of its digests once; rows may
    repeat, and need no id. ``media`` has one row for each digest. Sequences are written to the shared folder with a
    number for each row, which the answers come back to.
    """
    rows = stored(sequences.withColumn("_row", F.monotonically_increasing_id()))
    asked = F.array_distinct(F.transform(F.filter("parts", lambda p: (p["kind"] == "media") & p["digest"].isNotNull()), lambda p: p["digest"]))
    facts = F.struct(*[c for c in media.columns if c != "digest"])
    found = rows.select("_row", F.explode(asked).alias("digest")).join(media.select("digest", facts.alias("media")), "digest")
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("digest", "media"))).alias("_found"))
    put = F.transform("parts", lambda p: p.withField("media", F.try_element_at("_found", p["digest"])))
    joined = rows.join(found, "_row", "left")
    return joined.select(*[put.alias(c) if c == "parts" else F.col(f"`{c}`") for c in sequences.columns])


def page_of(doc_id: object, text: str, digest: str) -> str:
    """A page of the document's own text, ``RUN_LINES`` lines at a time, with a captioned reference to its payload behind each."""
    lines = text.split("\n")
    runs = [escape("\n".join(lines[i : i + RUN_LINES]), quote=False) for i in range(0, len(lines), RUN_LINES)]
    figure = '</p><figure><img src="media:%s"><figcaption>%d of %d</figcaption></figure>'
    body = "".join("<p>" + run + figure % (digest, i + 1, len(runs)) for i, run in enumerate(runs))
    return f"<article><h1>Document {'without id' if doc_id is None else doc_id}</h1>{body}</article>"


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, html) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "digest")))
            yield with_columns(part, ["doc_id"], html=pa.array([page_of(i, t or "", d) for i, t, d in rows], pa.string()))

    return docs.select("doc_id", "text", digest_of(F.col("text")).alias("digest")).mapInArrow(run, f"{fields(docs, ['doc_id'])}html string")


def query(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` what its stored payload holds, and its page's parts in order as JSON, without their texts.

    Null text is empty; texts may be of any length; rows that repeat, share an id or have none are told apart; equal
    texts are stored once and have equal values; no rows give no rows. Columns besides doc_id and text are not read.
    """
    media = store_media(docs)
    found = stored(read_back(media))
    discard(media)
    # What moves from here on is each text part's length, not its text.
    short = F.transform("parts", lambda p: F.struct(p["pos"].alias("pos"), p["kind"].alias("kind"), F.length(p["text"]).alias("chars"), p["digest"].alias("digest"), p["caption"].alias("caption")))
    out = resolve(parse(pages_of(docs)).select("doc_id", short.alias("parts")), found)
    first = F.get(F.filter("parts", lambda p: p["kind"] == "media"), F.lit(0))
    sequence = F.to_json(F.transform("parts", lambda p: p.dropFields("media", "digest")))
    return out.select("doc_id", *[first["media"][x.split()[0]].alias(x.split()[0]) for x in READ_BACK.split(", ")], sequence.alias("sequence"))
