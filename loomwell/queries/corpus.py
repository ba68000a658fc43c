"""Corpus and chunk queries over ``documents``, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.encoders import embed
from ..operators import chunking as C
from ..sources import tables as S

#: Word counts are sparse: neighbouring sentences are seldom more alike than this.
THRESHOLD = 0.2
BUILT = "2025-01-01T00:00:00"


def docs(spark: SparkSession, d: str) -> DataFrame:
    S.narrow_batches(spark)
    path = F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), "text", path.alias("source_path"))


def load_corpus(spark: SparkSession, d: str) -> DataFrame:
    return S.as_pdf_corpus(docs(spark, d)).select("doc_idx", "provider", "title", F.length("text").cast("long").alias("chars"))


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    pdf = S.as_pdf_corpus(rows.where("doc_idx % 5 <> 0"))
    pubmed = S.as_pubmed_corpus(rows.where("doc_idx % 5 = 0").withColumn("pmid", F.col("doc_idx").cast("string")))
    return S.union_corpora(pdf, pubmed).select("doc_idx", "provider", "title", "pmid")


def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    provider = F.when(F.col("doc_idx") % 5 == 0, "PubMed").otherwise("PDF")
    return S.inventory(docs(spark, d).select(provider.alias("provider"), F.octet_length("text").cast("long").alias("length")))


def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of each table of the data folder; only the file system is asked, contents stay unread."""
    name = F.regexp_extract("path", r"/([^/]+)\.parquet(/[^/]*)?$", 1)
    return S.inventory(S.list_files(spark, d, "*.parquet").select(name.alias("provider"), "length"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk(docs(spark, d), threshold=THRESHOLD)


def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.manifest(docs(spark, d), chunks(spark, d), F.lit(BUILT), "hashed-counts-64", "/index/graph")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return C.with_sentences(docs(spark, d)).select("doc_idx", F.posexplode("sentences").alias("pos", "sentence"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    source = T.doc_id(F.col("doc_idx"), F.col("text"))
    return docs(spark, d).select("doc_idx", source.alias("source_doc_id"), T.chunk_id(source, F.lit(0)).alias("chunk_id"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    whole = F.transform(embed(F.col("text")), lambda x: x.cast("long").cast("string"))
    return docs(spark, d).select("doc_idx", F.array_join(whole, ",").alias("embedding"))


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return C.with_similarities(C.with_sentences(docs(spark, d))).select("doc_idx", "similarities", F.size("sentences").alias("n"))


def adjacent_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select("doc_idx", F.posexplode("similarities").alias("pos", "similarity")).withColumn("pos", F.col("pos") + 1)


def _labels(rows: DataFrame, segments: F.Column) -> DataFrame:
    each = rows.where("n > 0").select("doc_idx", F.posexplode(segments).alias("label", "s"))
    return each.select("doc_idx", F.explode(F.sequence("s.first", "s.last")).alias("pos"), "label")


def sentence_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _labels(_similar(spark, d), C.by_similarity(F.col("n"), F.col("similarities"), THRESHOLD))


def sequential_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_sentences(docs(spark, d)).select("doc_idx", F.size("sentences").alias("n"))
    return _labels(rows, C.by_count(F.col("n")))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_idx", "chunk_id", "cluster", "first", "last", "chunk_size", "split", "content")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.stats(docs(spark, d), threshold=THRESHOLD)


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SENTENCES = rf"""
s0 AS (SELECT doc_id AS doc_idx, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
       lambda x: trim(x, {BLANKS})), lambda x: length(x) > 10) AS s FROM documents),
sents AS (SELECT doc_idx, len(s) AS n, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS pos FROM s0)"""
SIMILAR = rf"""{SENTENCES},
tok AS (SELECT doc_idx, pos, unnest(regexp_extract_all(lower(sent), '[\p{{L}}\p{{N}}_]+')) AS t FROM sents),
cnt AS (SELECT doc_idx, pos, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n FROM tok GROUP BY ALL),
nrm AS (SELECT doc_idx, pos, sum(n * n) AS q FROM cnt GROUP BY ALL),
dots AS (SELECT a.doc_idx, a.pos, sum(a.n * b.n) AS dot FROM cnt a JOIN cnt b ON a.doc_idx = b.doc_idx AND a.b = b.b AND b.pos = a.pos - 1 GROUP BY ALL),
sim AS (SELECT x.doc_idx, x.pos, CASE WHEN p.q * q.q > 0 THEN coalesce(dot, 0) / sqrt(p.q * q.q) ELSE 0.0 END AS similarity
  FROM sents x LEFT JOIN nrm p ON p.doc_idx = x.doc_idx AND p.pos = x.pos LEFT JOIN nrm q ON q.doc_idx = x.doc_idx AND q.pos = x.pos - 1
  LEFT JOIN dots ON dots.doc_idx = x.doc_idx AND dots.pos = x.pos WHERE x.pos > 0),
lab AS (SELECT x.doc_idx, x.pos, x.n, CAST(sum(CASE WHEN similarity < {THRESHOLD} THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_idx ORDER BY x.pos) AS INT) AS label
  FROM sents x LEFT JOIN sim ON sim.doc_idx = x.doc_idx AND sim.pos = x.pos)"""
CHUNKS = rf"""{SIMILAR},
cl AS (SELECT doc_idx, label, min(pos) AS f, max(pos) AS l FROM lab WHERE n > 3 GROUP BY ALL),
ch AS (SELECT doc_idx, label, f, l, array_to_string(s[greatest(0, f - 2) + 1 : least(len(s), l + 3)], ' ') AS c,
       'doc_' || doc_idx || '_' || substr(md5(text), 1, 8) || '_chunk_' || label AS id FROM cl JOIN s0 USING (doc_idx)),
cu AS (SELECT *, length(c) // 2 AS m, instr(reverse(left(c, length(c) // 2)), ' .') AS p FROM ch WHERE length(c) >= 150),
un AS (SELECT label AS seg, doc_idx, id AS chunk_id, label AS cluster, CAST(f AS INT) AS first, CAST(l AS INT) AS last, CAST(length(c) AS INT) AS chunk_size, CAST(NULL AS VARCHAR) AS split, c AS content FROM cu WHERE length(c) <= 1200
  UNION ALL SELECT label, doc_idx, NULL, NULL, NULL, NULL, NULL, 'part1', trim(left(c, CASE WHEN p > 0 THEN m - p ELSE m END), {BLANKS}) FROM cu WHERE length(c) > 1200
  UNION ALL SELECT label, doc_idx, NULL, NULL, NULL, NULL, NULL, 'part2', trim(substr(c, 1 + CASE WHEN p > 0 THEN m - p ELSE m END), {BLANKS}) FROM cu WHERE length(c) > 1200
  UNION ALL SELECT 0, doc_idx, NULL, NULL, NULL, NULL, NULL, NULL, text FROM s0 WHERE len(s) <= 3),
chunks AS (SELECT * FROM un WHERE split IS NULL OR length(content) >= 150)"""

QUERIES = {f.__name__: f for f in (
    load_corpus, corpus_union, corpus_inventory, file_inventory, index_manifest, sentence_split, chunk_ids, hash_embed, adjacent_similarity,
    sentence_clusters, sequential_groups, semantic_chunks, chunk_stats,
)}

SQL = {
    "load_corpus": "SELECT doc_id AS doc_idx, 'PDF' AS provider, doc_id || '.pdf' AS title, length(text) AS chars FROM documents",
    "corpus_union": """SELECT doc_id AS doc_idx, CASE WHEN doc_id % 5 = 0 THEN 'PubMed' ELSE 'PDF' END AS provider,
        CASE WHEN doc_id % 5 = 0 THEN 'PubMed Article' ELSE doc_id || '.pdf' END AS title, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) END AS pmid FROM documents""",
    "corpus_inventory": """SELECT CASE WHEN doc_id % 5 = 0 THEN 'PubMed' ELSE 'PDF' END AS provider, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL""",
    "index_manifest": f"""WITH {CHUNKS} SELECT '1.0' AS version, '{BUILT}' AS created_at, (SELECT count(*) FROM documents) AS num_documents,
        (SELECT count(*) FROM chunks) AS num_chunks, 'hashed-counts-64' AS embedding_model, 'parquet' AS index_type, '/index/graph' AS kg_path""",
    "sentence_split": f"WITH {SENTENCES} SELECT doc_idx, CAST(pos AS INT) AS pos, sent AS sentence FROM sents",
    "chunk_ids": """SELECT doc_id AS doc_idx, 'doc_' || doc_id || '_' || substr(md5(text), 1, 8) AS source_doc_id, 'doc_' || doc_id || '_' || substr(md5(text), 1, 8) || '_chunk_0' AS chunk_id FROM documents""",
    "hash_embed": r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents),
        cnt AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM tok GROUP BY ALL),
        grid AS (SELECT doc_id, b FROM documents, range(64) r(b))
        SELECT doc_id AS doc_idx, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b) AS embedding FROM grid LEFT JOIN cnt USING (doc_id, b) GROUP BY doc_id""",
    "adjacent_similarity": f"WITH {SIMILAR} SELECT doc_idx, CAST(pos AS INT) AS pos, similarity FROM sim",
    "sentence_clusters": f"WITH {SIMILAR} SELECT doc_idx, CAST(pos AS INT) AS pos, label FROM lab",
    "sequential_groups": f"WITH {SENTENCES} SELECT doc_idx, CAST(pos AS INT) AS pos, CAST(pos // greatest(3, n // 5) AS INT) AS label FROM sents",
    "semantic_chunks": f"WITH {CHUNKS} SELECT doc_idx, chunk_id, cluster, first, last, chunk_size, split, content FROM chunks",
    "chunk_stats": f"""WITH {CHUNKS} SELECT d.doc_id AS doc_idx, (SELECT count(*) FROM chunks c WHERE c.doc_idx = d.doc_id) AS chunks,
        (SELECT count(*) FROM cl WHERE cl.doc_idx = d.doc_id) AS clusters FROM documents d""",
}
