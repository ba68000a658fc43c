"""Every query of the library over the tables of a data folder, and its SQL twin."""

from __future__ import annotations

FLAGSHIP = "passage_evidence"

QUERIES: dict = {}
ORACLE_SQL: dict = {}

from .queries import answered, claims, corpus, dialogue, evidence, images, knowledge, streams  # noqa: E402

for _module in (corpus, evidence, knowledge, claims, dialogue, images, answered, streams):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.SQL)
