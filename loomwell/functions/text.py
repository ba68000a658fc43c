"""Text expressions: sentences, ids, query terms, JSON inside of model answers. All built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import STOP_WORDS


# The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space (Unicode's, too) at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


# Results must agree on these patterns.
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BRACED_OBJECT = r"(?s)\{.*\}"


def sentences(text: Column, longer_than: int = 10) -> Column:
    """Sentences of more than ``longer_than`` characters; null text has none."""
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.coalesce(F.filter(parts, lambda s: F.length(s) > longer_than), F.array().cast("array<string>"))


def doc_id(index: Column, text: Column) -> Column:
    """``doc_<index>_<first 8 hex digits of the text's MD5>``."""
    return F.concat(F.lit("doc_"), index.cast("string"), F.lit("_"), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8))


def chunk_id(source: Column, cluster: Column) -> Column:
    return F.concat(source, F.lit("_chunk_"), cluster.cast("string"))


def query_terms(query: Column, stop_words: list[str] = STOP_WORDS, longer_than: int = 3) -> Column:
    """Lower-case words of more than ``longer_than`` characters that are no stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~F.array_contains(stop, w))


def fenced_json(raw: Column) -> Column:
    """The object in the first fenced block, else from the first brace to the last, else the text itself."""
    fenced = F.regexp_extract(raw, FENCED_OBJECT, 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), braced_json(raw))


def braced_json(raw: Column) -> Column:
    """From the first brace to the last, else the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, BRACED_OBJECT, 0), F.lit("")), raw)


def truthy(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def safe_key(identifier: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens of an identifier."""
    return F.regexp_replace(identifier, r"[^\p{L}\p{N}._-]", "")
