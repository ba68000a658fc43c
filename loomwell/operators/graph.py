"""A directed knowledge graph as two tables, and questions to it.

``edges(src, dst, relation, confidence, source, edge_ord)`` has one row for each ordered pair of nodes;
``nodes(node, node_ord)`` numbers nodes in the order in which triples name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import braced_json, query_terms, sentences, strip
from ..functions.vocabulary import PREDICATES, TEXTS
from ..sources.tables import stored
from . import containment

TRIPLES = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def parse_triples(answers: DataFrame) -> DataFrame:
    """Rows (doc_idx, pos, subject, predicate, object, confidence, source_doc_id) of model answers (doc_idx, raw).

    An answer with a triple that lacks a part, or whose confidence is null or outside 0 to 1, gives none
    at all, and so does one that is no JSON. A confidence that is left out is 1.
    """
    # Missing and null confidences differ: a map of the raw fields tells them apart.
    body = braced_json(F.col("raw"))
    fields = F.from_json(body, "struct<triples:array<map<string,string>>>")["triples"]
    typed = F.from_json(body, f"struct<triples:{TRIPLES}>")["triples"]
    both = answers.select("doc_idx", F.arrays_zip(fields.alias("f"), typed.alias("t")).alias("zipped"))
    confidence = lambda z: F.when(F.map_contains_key(z["f"], F.lit("confidence")), z["t"]["confidence"]).otherwise(F.lit(1.0))
    good = lambda z: (
        z["t"]["subject"].isNotNull() & z["t"]["predicate"].isNotNull() & z["t"]["object"].isNotNull() & F.coalesce(confidence(z).between(0, 1), F.lit(False))
    )
    # Not a filter of answers: it would be pushed below and parse each of them a second time.
    valid = F.when(F.forall("zipped", good), F.col("zipped"))
    rows = both.select("doc_idx", F.posexplode_outer(valid).alias("pos", "z")).where("pos is not null")
    clean = lambda c: strip(F.lower(c))
    z = F.col("z")
    return rows.select(
        "doc_idx", "pos", clean(z["t"]["subject"]).alias("subject"), clean(z["t"]["predicate"]).alias("predicate"), clean(z["t"]["object"]).alias("object"),
        confidence(z).alias("confidence"), F.concat(F.lit("doc_"), F.col("doc_idx").cast("string")).alias("source_doc_id"),
    )


WORD = r"(?U)(\w+)"


def trie(names: DataFrame) -> DataFrame:
    """The token trie of ``names`` (name) as a table: (node, depth, name).

    A node is the text of its tokens, blanks between; ``name`` is the name that ends there (of several with the same tokens
    the least), null at inner nodes. Names without tokens have no node.
    """
    tokens = names.select("name", F.regexp_extract_all(F.lower("name"), F.lit(WORD), F.lit(1)).alias("t")).where(F.size("t") > 0)
    each = tokens.select("name", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("depth"))
    return each.groupBy(F.array_join(F.slice("t", 1, F.col("depth")), " ").alias("node"), "depth").agg(F.min(F.when(F.col("depth") == F.size("t"), F.col("name"))).alias("name"))


def find_names(texts: DataFrame, names: DataFrame, nearest_end: bool = False) -> DataFrame:
    """``texts`` (with a column ``words``, an array) that hold a name, with ``name``, ``first`` and ``n`` words of it (from 1).

    The occurrence nearest to the beginning, or with ``nearest_end`` to the end, and the longest of those there. The words at each place
    walk down the trie of ``names``, a join by node for each step: a place that leaves the trie is gone, and a place has one
    node at each depth, however many names begin alike. There are as many steps as the longest name has tokens.
    """
    nodes = stored(trie(names))
    depth = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    keys = [c for c in texts.columns if c != "words"]
    ahead = texts.select(*keys, F.posexplode("words").alias("first", "word"), "words")
    at = ahead.select(*keys, (F.col("first") + 1).alias("first"), F.slice("words", F.col("first") + 1, F.lit(max(depth, 1))).alias("rest"))
    place = F.struct(-(F.col("first") + F.col("n")), "first") if nearest_end else F.struct("first", -F.col("n"))
    found = None
    walked = at.withColumn("node", F.lit(""))
    for d in range(1, depth + 1):
        step = walked.where(F.size("rest") >= d).withColumn("node", F.concat_ws(" ", F.nullif("node", F.lit("")), F.element_at("rest", d)))
        walked = step.join(nodes.where(F.col("depth") == d).select("node", "name"), "node")
        ended = walked.where("name is not null").select(*keys, "name", "first", F.lit(d).alias("n"))
        found = ended if found is None else found.unionByName(ended)
        walked = walked.drop("name")
        if d < depth:
            walked = stored(walked)
    if found is None:
        return texts.select(*keys, F.lit(None).cast("string").alias("name"), F.lit(0).alias("first"), F.lit(0).alias("n")).limit(0)
    return found.groupBy(*keys).agg(F.min_by(F.struct("name", "first", "n"), place).alias("x")).select(*keys, "x.*")


def rule_triples(docs: DataFrame, entities: DataFrame, predicates: list[str] = PREDICATES) -> DataFrame:
    """Triples of sentences that name one entity, a predicate and another entity, in that order.

    The default where no model extracts triples. ``entities`` (name) are names of one or more words, of any number.
    Subject and object are those nearest to the predicate, the longest of those that end (begin) at the same word. Underscores of
    predicates stand for blanks, too. Whole texts are read.
    """
    parts = docs.select("doc_idx", F.posexplode(sentences(F.lower("text"))).alias("sentence", "s"))
    wanted = "|".join(p if "_" not in p else f"{p}|{p.replace('_', ' ')}" for p in predicates)
    edge = r"[^\p{L}\p{N}_]"
    pattern = rf"(?s)^(.*?)(?:^|{edge})({wanted})(?:{edge}(.*))?$"
    hit = parts.where(F.col("s").rlike(pattern))
    words = lambda g: F.regexp_extract_all(F.regexp_extract("s", pattern, g), F.lit(WORD), F.lit(1))
    sides = stored(hit.select("doc_idx", "sentence", words(1).alias("l"), F.regexp_replace(F.regexp_extract("s", pattern, 2), " ", "_").alias("predicate"), words(3).alias("r")))
    keys = ["doc_idx", "sentence"]
    subject = find_names(sides.select(*keys, F.col("l").alias("words")), entities, nearest_end=True).select(*keys, F.col("name").alias("subject"))
    object_ = find_names(sides.select(*keys, F.col("r").alias("words")), entities).select(*keys, F.col("name").alias("object"))
    out = sides.select(*keys, "predicate").join(subject, keys).join(object_, keys)
    return out.select("doc_idx", F.col("sentence").alias("pos"), "subject", "predicate", "object", F.lit(1.0).alias("confidence"), F.concat(F.lit("doc_"), F.col("doc_idx").cast("string")).alias("source_doc_id"))


def edges(triples: DataFrame) -> DataFrame:
    """One edge for each (subject, object): what the last triple says (by ``ord``), in the place of the first."""
    last = F.max_by(F.struct("predicate", "confidence", "source_doc_id"), "ord").alias("last")
    grouped = triples.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(last, F.min("ord").alias("edge_ord"))
    return grouped.select("src", "dst", F.col("last.predicate").alias("relation"), F.col("last.confidence").alias("confidence"), F.col("last.source_doc_id").alias("source"), "edge_ord")


def nodes(triples: DataFrame) -> DataFrame:
    """Nodes with the place at which they are first named; a triple's subject comes before its object."""
    ends = triples.select(F.col("subject").alias("node"), (F.col("ord") * 2).alias("at")).unionByName(triples.select(F.col("object").alias("node"), (F.col("ord") * 2 + 1).alias("at")))
    return ends.groupBy("node").agg(F.min("at").alias("node_ord"))


def stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    both = node_table.select(F.lit(1).alias("nodes"), F.lit(0).alias("edges")).unionByName(edge_table.select(F.lit(0).alias("nodes"), F.lit(1).alias("edges")))
    return both.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def link_entities(node_table: DataFrame, ontology: DataFrame) -> DataFrame:
    """Nodes with the codes that ``ontology`` (name, ...) has for exactly their name; unlinked nodes stay, with nulls."""
    return node_table.join(ontology, node_table["node"] == ontology["name"], "left").drop("name")


def entities(node_table: DataFrame, ontology: DataFrame) -> DataFrame:
    """(name, entity_type, aliases, ontology_ids) of the nodes; ids are the columns of ``ontology`` besides the name, unlinked nodes have none.

    Triples tell neither types nor other names: every type is ``unknown``, and no entity has an alias.
    """
    linked = link_entities(node_table.select("node"), ontology)
    ids = F.map_from_arrays(F.array(*[F.lit(c) for c in ontology.columns if c != "name"]), F.array(*[F.col(c).cast("string") for c in ontology.columns if c != "name"]))
    return linked.select(
        F.col("node").alias("name"), F.lit("unknown").alias("entity_type"), F.array().cast("array<string>").alias("aliases"),
        F.map_filter(ids, lambda _, v: v.isNotNull()).alias("ontology_ids"),
    )


def match_nodes(queries: DataFrame, node_table: DataFrame) -> DataFrame:
    """(query_id, node, node_ord) where a term of the query is part of the node's name, or the name of the term.

    Terms have at least four characters; a name that is empty matches nothing. See ``containment`` for how they meet.
    """
    terms = stored(queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term")).distinct())
    words, names = terms.select("term").distinct(), node_table.select("node")
    inside = containment.holding(names, "node", words, "term")
    around = containment.holding(words, "term", names, "node")
    hit = inside.select("term", "node").unionByName(around.select("term", "node"))
    return terms.join(hit, "term").select("query_id", "node").distinct().join(node_table, "node").select("query_id", "node", "node_ord")


def _reach(targets: DataFrame, steps: DataFrame, hops: int) -> list[DataFrame]:
    """(node) tables: the targets, what has an edge into them, into those, ...; a node counts in each table that it has a walk of that length for.

    One step is a semi-join and a distinct, so that a hub is one row however many edges it has.
    """
    out = [targets]
    for _ in range(hops):
        into = steps.join(out[-1].withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        out.append(stored(into))
    return out


def multi_hop(matched: DataFrame, edge_table: DataFrame, max_hops: int = 3, keep: int = 10) -> DataFrame:
    """Shortest directed paths between a query's matched nodes, from an earlier to a later one.

    Rows (query_id, path_no, path, relations, hops). Of equally short paths the least by its nodes'
    names; the first ``keep`` pairs in node order. The search is from both sides and runs once for all queries: backwards
    from the targets it gathers nodes alone, those that reach some target in 1, 2, ... steps; forwards from the starts it
    takes only edges to nodes that still reach a target in the steps that are left, so that the last hop
    adds nothing but targets, and a hub's other successors are never entered. A node already reached from a
    start is not entered again. Each hop is an equi-join of plain exchanges, of which adaptive execution splits a hub's, and is written to the shared folder.
    """
    steps = edge_table.select("src", "dst", "relation")
    # The last node of a query by order starts nothing, and the first is no target.
    ends = matched.groupBy("query_id").agg(F.min("node_ord").alias("low"), F.max("node_ord").alias("high"))
    placed = matched.join(ends, "query_id")
    starts = placed.where("node_ord < high").select(F.col("node").alias("start")).distinct()
    reach = _reach(stored(placed.where("node_ord > low").select("node").distinct()), steps, max_hops - 1)
    frontier = starts.select("start", F.col("start").alias("at"), F.array("start").alias("path"), F.array().cast("array<string>").alias("relations"))
    reached = frontier
    for hop in range(1, max_hops + 1):
        left = max_hops - hop
        useful = reach[0]
        for more in reach[1 : left + 1]:
            useful = useful.unionByName(more)
        open_steps = steps.join(useful.select(F.col("node").alias("dst")), "dst", "left_semi")
        grown = frontier.join(open_steps, frontier["at"] == open_steps["src"]).select(
            "start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array("relation")).alias("relations")
        )
        least = grown.groupBy("start", "at").agg(F.min_by(F.struct("path", "relations"), "path").alias("p")).select("start", "at", "p.path", "p.relations")
        frontier = stored(least.join(reached.select("start", "at"), ["start", "at"], "left_anti"))
        reached = reached.unionByName(frontier)
    a = matched.select("query_id", F.col("node").alias("start"), F.col("node_ord").alias("start_ord"))
    b = matched.select(F.col("query_id").alias("q"), F.col("node").alias("at"), F.col("node_ord").alias("end_ord"))
    # Paths first, then the pairs that matched: pairs of matched nodes are never enumerated.
    found = a.join(reached.where(F.size("relations") > 0), "start").join(b, "at").where((F.col("query_id") == F.col("q")) & (F.col("start_ord") < F.col("end_ord")))
    order = Window.partitionBy("query_id").orderBy("start_ord", "end_ord", "start", "at")
    return found.withColumn("path_no", F.row_number().over(order)).where(F.col("path_no") <= keep).select("query_id", "path_no", "path", "relations", F.size("relations").alias("hops"))


def related(matched: DataFrame, edge_table: DataFrame, keep: int = 20) -> DataFrame:
    """(query_id, entity, relation, from_node, rank): what matched nodes point to, besides matched nodes; each entity once."""
    ahead = matched.join(edge_table, matched["node"] == edge_table["src"]).select("query_id", F.col("dst").alias("entity"), "relation", F.col("node").alias("from_node"), "node_ord", "edge_ord")
    ahead = ahead.join(matched.select("query_id", F.col("node").alias("entity")), ["query_id", "entity"], "left_anti")
    first = ahead.groupBy("query_id", "entity").agg(F.min_by(F.struct("relation", "from_node", "node_ord", "edge_ord"), F.struct("node_ord", "edge_ord")).alias("x")).select("query_id", "entity", "x.*")
    order = Window.partitionBy("query_id").orderBy("node_ord", "edge_ord", "entity")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("query_id", "entity", "relation", "from_node", "rank")


def _ordered(df: DataFrame, order, value: Column, name: str, keep: int) -> DataFrame:
    """The first ``keep`` values of each query. A query's rows are ranked before any list is made."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).where(F.col("_r") <= keep)
    lists = F.array_sort(F.collect_list(F.struct("_r", value.alias("v"))))
    return ranked.groupBy("query_id").agg(F.transform(lists, lambda x: x["v"]).alias(name))


def insights(queries: DataFrame, matched: DataFrame, paths: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(query_id, insights): five matched nodes, three paths and five related entities as lines of text."""
    arrow = F.concat(F.array_join(F.zip_with(F.slice("path", 1, F.size("relations")), "relations", lambda n, r: F.concat(n, F.lit(" ["), r, F.lit("]"))), " → "), F.lit(" → "), F.element_at("path", -1))
    parts = [
        _ordered(matched, ["node_ord", "node"], F.col("node"), "found", 5),
        _ordered(paths, "path_no", F.concat(F.lit("Relationship: "), arrow), "ways", 3),
        _ordered(neighbours, "rank", F.concat_ws(" ", "from_node", "relation", "entity"), "near", 5),
    ]
    joined = queries.select("query_id")
    for part in parts:
        joined = joined.join(part, "query_id", "left")
    text = F.concat_ws("\n", F.concat(F.lit("Found entities: "), F.array_join("found", ", ")), F.array_join("ways", "\n"), F.concat(F.lit("Related: "), F.array_join("near", "; ")))
    return joined.select("query_id", F.when(F.col("found").isNull(), F.lit(TEXTS["no_entities"])).otherwise(text).alias("insights"))
