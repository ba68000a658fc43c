"""Graph and model-output queries over the star schema, ``events`` and ``documents``, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fenced_json
from ..operators import graph as G
from ..operators import parsing
from ..sources import tables as S
from .corpus import BLANKS, docs

ENTITIES = ["the", "that", "this", "and", "are", "was"]


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Brand to supplier (several relations a pair), supplier to nation, nation to region; ``ord`` is a total order."""
    t = lambda name: S.table(spark, d, name)
    supplier, nation, region = t("supplier"), t("nation"), t("region")
    sold = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.groupBy(F.lower("p_brand").alias("subject"), F.lower("s_name").alias("object"), "l_returnflag").agg(F.min("l_orderkey").alias("o"))
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    sold = sold.select("subject", F.concat(F.lit("rel_"), F.lower("l_returnflag")).alias("predicate"), "object", (F.col("o") * 3 + code).alias("ord"))
    based = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lower("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.lower("n_name").alias("object"), (F.col("s_suppkey") + 10**12).alias("ord")
    )
    within = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("subject"), F.lit("located_in").alias("predicate"), F.lower("r_name").alias("object"), (F.col("n_nationkey") + 2 * 10**12).alias("ord")
    )
    rows = sold.unionByName(based).unionByName(within)
    return rows.withColumn("confidence", (F.col("ord") % 10) / 10.0).withColumn("source_doc_id", F.concat(F.lit("doc_"), (F.col("ord") % 1000).cast("string")))


def questions(spark: SparkSession, d: str) -> DataFrame:
    nation, region = S.table(spark, d, "nation"), S.table(spark, d, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    brand = F.concat(F.lit("Brand#"), (1 + F.col("n_nationkey") % 5).cast("string"))
    return rows.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat_ws(" ", brand, F.lit("from"), "n_name", F.lit("in the"), "r_name").alias("query"))


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(triples(spark, d))


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(triples(spark, d))


def kg_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(kg_nodes(spark, d), kg_edges(spark, d))


def entity_linking(spark: SparkSession, d: str) -> DataFrame:
    ontology = S.table(spark, d, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").cast("string").alias("region"))
    return G.link_entities(kg_nodes(spark, d), ontology).select("node", "code", "region")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = S.stored(triples(spark, d))
    return S.stored(G.match_nodes(questions(spark, d), G.nodes(rows))), S.stored(G.edges(rows)), rows


def kg_node_match(spark: SparkSession, d: str) -> DataFrame:
    return G.match_nodes(questions(spark, d), kg_nodes(spark, d))


def kg_multihop(spark: SparkSession, d: str) -> DataFrame:
    matched, edges, _ = _graph(spark, d)
    return G.multi_hop(matched, edges).select("query_id", "path_no", F.array_join("path", " > ").alias("path"), F.array_join("relations", " > ").alias("relations"), "hops")


def kg_related(spark: SparkSession, d: str) -> DataFrame:
    matched, edges, _ = _graph(spark, d)
    return G.related(matched, edges)


def kg_insights(spark: SparkSession, d: str) -> DataFrame:
    matched, edges, _ = _graph(spark, d)
    return G.insights(questions(spark, d), matched, G.multi_hop(matched, edges), G.related(matched, edges))


# ---------------------------------------------------------------- model answers


def wrapped(body: F.Column) -> F.Column:
    """An answer as models write them: in a fence, with text around, bare, or broken."""
    kind = F.col("event_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone {ok}")))
        .when(kind == 1, F.concat(F.lit("Answer: "), body, F.lit(" that is all.")))
        .when(kind == 2, body)
        .otherwise(F.concat(F.lit("no json: "), F.col("props"), F.lit(" {")))
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events")


def llm_json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", fenced_json(wrapped(F.col("props"))).alias("extracted"))


def llm_json_validate(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose required field ``k`` is there are valid; the others are quarantined with what is missing."""
    raw = wrapped(F.when(F.col("event_id") % 5 == 0, F.lit('{"x": 1}')).otherwise(F.col("props")))
    valid, aside = parsing.quarantine(parsing.parse(_events(spark, d).select("event_id", raw.alias("raw")), "struct<k:long>", ["k"]))
    valid = valid.select("event_id", F.col("parsed.k").alias("k"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("missing"))
    return valid.unionByName(aside.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(False).alias("valid"), F.array_join("missing", ", ").alias("missing")))


def triple_parse(spark: SparkSession, d: str) -> DataFrame:
    share = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(', "confidence": '), ((F.col("event_id") % 13) / 10.0).cast("string")))
    first = F.concat(F.lit('{"subject": " '), F.initcap("event_type"), F.lit(' ", "predicate": "Causes", "object": "User '), F.col("user_id").cast("string"), F.lit('"'), share, F.lit("}"))
    second = F.when(F.col("event_id") % 7 == 0, F.lit('{"subject": "a", "object": "b"}')).otherwise(F.lit('{"subject": "A", "predicate": "is_a", "object": "B"}'))
    body = F.concat(F.lit('{"triples": ['), first, F.lit(", "), second, F.lit("]}"))
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Found: "), body, F.lit(" .\n"))).otherwise(F.concat(F.lit("{"), body))
    return G.parse_triples(_events(spark, d).select(F.col("event_id").alias("doc_idx"), raw.alias("raw")))


def triple_rules(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(e,) for e in ENTITIES], "name string")
    return G.rule_triples(docs(spark, d), names, ["with", "from"]).select("doc_idx", "pos", "subject", "predicate", "object")


def phrase_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each word of more than six letters, and each two words, of the test passages: names that may lie inside of others."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(G.WORD), F.lit(1))
    rows = S.table(spark, d, "benchmark").select(words.alias("w")).where("size(w) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return rows.select(F.explode(F.concat(F.filter("w", lambda x: F.length(x) > 6), pairs)).alias("name")).distinct()


def triple_rules_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose entities are names of one or two words, thousands of them."""
    return G.rule_triples(docs(spark, d), phrase_entities(spark, d), ["with", "from", "was"]).select("doc_idx", "pos", "subject", "predicate", "object")


TRIPLES = """sold AS (SELECT lower(p_brand) AS subject, lower(s_name) AS object, l_returnflag AS f, min(l_orderkey) AS o FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
t0 AS (SELECT subject, 'rel_' || lower(f) AS predicate, object, o * 3 + CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ord FROM sold
  UNION ALL SELECT lower(s_name), 'located_in', lower(n_name), s_suppkey + 1000000000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT lower(n_name), 'located_in', lower(r_name), n_nationkey + 2000000000000 FROM nation JOIN region ON n_regionkey = r_regionkey),
triples AS (SELECT *, (ord % 10) / 10.0 AS confidence, 'doc_' || (ord % 1000) AS source_doc_id FROM t0),
edges AS (SELECT subject AS src, object AS dst, arg_max(predicate, ord) AS relation, arg_max(confidence, ord) AS confidence, arg_max(source_doc_id, ord) AS source, min(ord) AS edge_ord FROM triples GROUP BY ALL),
nodes AS (SELECT node, min(place) AS node_ord FROM (SELECT subject AS node, ord * 2 AS place FROM triples UNION ALL SELECT object, ord * 2 + 1 FROM triples) GROUP BY node)"""
MATCHED = rf"""{TRIPLES},
qs AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'Brand#' || (1 + n_nationkey % 5) || ' from ' || n_name || ' in the ' || r_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM qs) WHERE length(term) > 3 AND term <> 'dari'),
matched AS (SELECT DISTINCT query_id, node, node_ord FROM terms JOIN nodes ON contains(node, term) OR contains(term, node))"""
HOPS = f"""{MATCHED},
st AS (SELECT DISTINCT node AS start FROM matched),
h1 AS (SELECT start, dst AS goal, min([start, dst]) AS path, arg_min([relation], [start, dst]) AS rels FROM st JOIN edges ON src = start WHERE dst <> start GROUP BY ALL),
g2 AS (SELECT start, dst AS goal, list_append(path, dst) AS path, list_append(rels, relation) AS rels FROM h1 JOIN edges ON src = goal),
h2 AS (SELECT start, goal, min(path) AS path, arg_min(rels, path) AS rels FROM g2 WHERE goal <> start AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = g2.start AND h1.goal = g2.goal) GROUP BY ALL),
g3 AS (SELECT start, dst AS goal, list_append(path, dst) AS path, list_append(rels, relation) AS rels FROM h2 JOIN edges ON src = goal),
h3 AS (SELECT start, goal, min(path) AS path, arg_min(rels, path) AS rels FROM g3 WHERE goal <> start AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = g3.start AND h1.goal = g3.goal)
  AND NOT EXISTS (SELECT 1 FROM h2 WHERE h2.start = g3.start AND h2.goal = g3.goal) GROUP BY ALL),
hs AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3),
paths AS (SELECT * FROM (SELECT a.query_id, path, rels, CAST(row_number() OVER (PARTITION BY a.query_id ORDER BY a.node_ord, b.node_ord, a.node, b.node) AS INT) AS path_no
  FROM matched a JOIN hs ON hs.start = a.node JOIN matched b ON b.query_id = a.query_id AND b.node = hs.goal WHERE a.node_ord < b.node_ord) WHERE path_no <= 10)"""
RELATED = """ahead AS (SELECT m.query_id, dst AS entity, relation, m.node AS from_node, node_ord, edge_ord FROM matched m JOIN edges ON src = m.node
  WHERE NOT EXISTS (SELECT 1 FROM matched x WHERE x.query_id = m.query_id AND x.node = dst)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY node_ord, edge_ord) AS r FROM ahead) WHERE r = 1),
related AS (SELECT * FROM (SELECT query_id, entity, relation, from_node, CAST(row_number() OVER (PARTITION BY query_id ORDER BY node_ord, edge_ord, entity) AS INT) AS rank FROM firsts) WHERE rank <= 20)"""
_WRAPPED = """CASE event_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || {b} || chr(10) || '```' || chr(10) || 'Done {{ok}}' WHEN 1 THEN 'Answer: ' || {b} || ' that is all.' WHEN 2 THEN {b} ELSE 'no json: ' || props || ' {{' END"""
_BRACED = r"coalesce(nullif(regexp_extract(raw, '(?s)\{.*\}'), ''), raw)"
_FENCED = rf"coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1), ''), {_BRACED})"

QUERIES = {f.__name__: f for f in (
    kg_edges, kg_nodes, kg_stats, entity_linking, kg_node_match, kg_multihop, kg_related, kg_insights, llm_json_extract, llm_json_validate, triple_parse, triple_rules, triple_rules_phrases,
)}

SQL = {
    "kg_edges": f"WITH {TRIPLES} SELECT * FROM edges",
    "kg_nodes": f"WITH {TRIPLES} SELECT * FROM nodes",
    "kg_stats": f"WITH {TRIPLES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges",
    "entity_linking": f"WITH {TRIPLES} SELECT node, CAST(n_nationkey AS VARCHAR) AS code, CAST(n_regionkey AS VARCHAR) AS region FROM nodes LEFT JOIN nation ON lower(n_name) = node",
    "kg_node_match": f"WITH {MATCHED} SELECT * FROM matched",
    "kg_multihop": f"WITH {HOPS} SELECT query_id, path_no, array_to_string(path, ' > ') AS path, array_to_string(rels, ' > ') AS relations, CAST(len(rels) AS INT) AS hops FROM paths",
    "kg_related": f"WITH {MATCHED}, {RELATED} SELECT * FROM related",
    "kg_insights": f"""WITH {HOPS}, {RELATED},
        a AS (SELECT query_id, list(node ORDER BY node_ord, node)[1:5] AS l FROM matched GROUP BY query_id),
        b AS (SELECT query_id, list('Relationship: ' || array_to_string(list_transform(generate_series(1, len(rels)), lambda i: path[i] || ' [' || rels[i] || ']'), ' → ') || ' → ' || path[len(path)] ORDER BY path_no)[1:3] AS l FROM paths GROUP BY query_id),
        c AS (SELECT query_id, list(from_node || ' ' || relation || ' ' || entity ORDER BY rank)[1:5] AS l FROM related GROUP BY query_id)
        SELECT query_id, CASE WHEN a.l IS NULL THEN 'No matching entities found in knowledge graph' ELSE
        concat_ws(chr(10), 'Found entities: ' || array_to_string(a.l, ', '), array_to_string(b.l, chr(10)), 'Related: ' || array_to_string(c.l, '; ')) END AS insights
        FROM qs LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN c USING (query_id)""",
    "llm_json_extract": f"SELECT event_id, {_FENCED} AS extracted FROM (SELECT event_id, {_WRAPPED.format(b='props')} AS raw FROM events)",
    "llm_json_validate": f"""WITH r AS (SELECT event_id, {_FENCED} AS body FROM (SELECT event_id, {_WRAPPED.format(b="(CASE WHEN event_id % 5 = 0 THEN '{{{{\"x\": 1}}}}' ELSE props END)".format())} AS raw FROM events)),
        k AS (SELECT event_id, CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.k') AS BIGINT) END AS k FROM r)
        SELECT event_id, k, k IS NOT NULL AS valid, CASE WHEN k IS NULL THEN 'k' END AS missing FROM k""",
    "triple_parse": """WITH e AS (SELECT event_id AS doc_idx, event_id % 13 / 10.0 AS c, event_id % 11 = 0 AS no_c, event_type, user_id FROM events
          WHERE event_id % 3 < 2 AND event_id % 7 <> 0 AND (event_id % 11 = 0 OR event_id % 13 <= 10))
        SELECT doc_idx, CAST(0 AS INT) AS pos, lower(event_type) AS subject, 'causes' AS predicate, 'user ' || user_id AS object, CASE WHEN no_c THEN 1.0 ELSE CAST(c AS DOUBLE) END AS confidence, 'doc_' || doc_idx AS source_doc_id FROM e
        UNION ALL SELECT doc_idx, 1, 'a', 'is_a', 'b', 1.0, 'doc_' || doc_idx FROM e""",
    "triple_rules": rf"""WITH s0 AS (SELECT doc_id AS doc_idx, list_filter(list_transform(string_split(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {BLANKS})), lambda x: length(x) > 10) AS s FROM documents),
        p AS (SELECT doc_idx, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS pos FROM s0),
        h AS (SELECT doc_idx, pos, regexp_extract(sent, '{(_p := r"(?s)^(.*?)(?:^|[^\p{L}\p{N}_])(with|from)(?:[^\p{L}\p{N}_](.*))?$")}', 1) AS l, regexp_extract(sent, '{_p}', 2) AS predicate, regexp_extract(sent, '{_p}', 3) AS r FROM p WHERE regexp_matches(sent, '{_p}')),
        w AS (SELECT doc_idx, pos, predicate, list_filter(regexp_extract_all(l, '[\p{{L}}\p{{N}}_]+'), lambda x: x IN ('the', 'that', 'this', 'and', 'are', 'was')) AS a,
              list_filter(regexp_extract_all(r, '[\p{{L}}\p{{N}}_]+'), lambda x: x IN ('the', 'that', 'this', 'and', 'are', 'was')) AS b FROM h)
        SELECT doc_idx, CAST(pos AS INT) AS pos, a[len(a)] AS subject, predicate, b[1] AS object FROM w WHERE len(a) > 0 AND len(b) > 0""",
    "triple_rules_phrases": rf"""WITH s0 AS (SELECT doc_id AS doc_idx, list_filter(list_transform(string_split(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {BLANKS})), lambda x: length(x) > 10) AS s FROM documents),
        p AS (SELECT doc_idx, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS pos FROM s0),
        h AS (SELECT doc_idx, pos, regexp_extract(sent, '{(_p := r"(?s)^(.*?)(?:^|[^\p{L}\p{N}_])(with|from|was)(?:[^\p{L}\p{N}_](.*))?$")}', 2) AS predicate,
              regexp_extract_all(regexp_extract(sent, '{_p}', 1), '[\p{{L}}\p{{N}}_]+') AS l, regexp_extract_all(regexp_extract(sent, '{_p}', 3), '[\p{{L}}\p{{N}}_]+') AS r FROM p WHERE regexp_matches(sent, '{_p}')),
        b AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
        names AS (SELECT unnest(list_filter(w, lambda x: length(x) > 6)) AS name FROM b UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM b)),
        spots AS (SELECT doc_idx, pos, predicate, side, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
              FROM (SELECT doc_idx, pos, predicate, 'l' AS side, l AS w FROM h UNION ALL SELECT doc_idx, pos, predicate, 'r', r FROM h), (VALUES (1), (2)) sizes(n) WHERE len(w) >= n),
        hits AS (SELECT doc_idx, pos, predicate, side, n, i, name FROM spots JOIN names ON name = array_to_string(w[i:i + n - 1], ' ')),
        best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_idx, pos, side ORDER BY CASE WHEN side = 'l' THEN -(i + n) ELSE i END, -n) = 1)
        SELECT a.doc_idx, CAST(a.pos AS INT) AS pos, a.name AS subject, a.predicate, b.name AS object FROM best a JOIN best b ON a.doc_idx = b.doc_idx AND a.pos = b.pos AND a.side = 'l' AND b.side = 'r'""",
}
