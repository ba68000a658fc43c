"""Names of several words in texts, paths from both sides, name search by the rarest piece."""

from pyspark.sql import functions as F

from loomwell.functions.vocabulary import ONTOLOGY
from loomwell.operators import containment, graph, retrieval


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def triples(spark, text, names):
    docs = spark.createDataFrame([(1, text)], "doc_idx long, text string")
    return rows(graph.rule_triples(docs, spark.createDataFrame([(n,) for n in names], "name string")), "pos", "subject", "predicate", "object")


def test_every_name_of_the_ontology_can_be_found(spark):
    names = [n for n, *_ in ONTOLOGY] + ["Fluoride", "plaque"]
    text = "Fluoride prevents dental caries. Plaque causes tooth abscess. " + " ".join(f"Some plaque causes {n} soon." for n, *_ in ONTOLOGY)
    got = triples(spark, text, names)
    assert got[:2] == [(0, "Fluoride", "prevents", "dental caries"), (1, "plaque", "causes", "tooth abscess")]
    assert [g[3] for g in got[2:]] == [n for n, *_ in ONTOLOGY]


def test_the_nearest_and_longest_name_counts(spark):
    names = ["caries", "dental caries", "dental", "old tooth decay", "tooth", "decay prone", "!!", ""]
    assert triples(spark, "The tooth and dental caries causes old tooth and tooth decay.", names) == [(0, "dental caries", "causes", "tooth")]
    assert triples(spark, "caries dental causes the old, tooth-decay prone tooth.", names) == [(0, "dental", "causes", "old tooth decay")]
    assert triples(spark, "No name here causes anything at all.", names) == []
    assert triples(spark, "The caries causes decay of a tooth.", []) == []


def test_names_that_begin_alike_do_not_multiply_rows(spark):
    """A place has one node of the trie at each depth, whatever begins there."""
    names = spark.range(3000).select(F.concat(F.lit("tooth part "), F.col("id").cast("string")).alias("name"))
    nodes = graph.trie(names)
    assert rows(nodes.groupBy("depth").count(), "depth", "count") == [(1, 1), (2, 1), (3, 3000)]
    texts = spark.createDataFrame([(1, "my tooth part 17 and tooth part".split())], "id int, words array<string>")
    assert rows(graph.find_names(texts, names), "id", "name", "first", "n") == [(1, "tooth part 17", 2, 3)]


def test_paths_leave_out_what_reaches_no_target(spark):
    """A hub's other successors are not entered; shortest paths and ties by name are as ever."""
    ways = [("a", "hub"), ("hub", "z"), ("hub", "c"), ("c", "z"), ("a", "b"), ("b", "y"), ("b", "z"), ("y", "x"), ("x", "w"), ("z", "a")]
    hub = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("dst"))
    edges = spark.createDataFrame(ways, "src string, dst string").unionByName(hub).withColumn("relation", F.concat("src", F.lit("-"), "dst"))
    matched = spark.createDataFrame([(1, "a", 1), (1, "z", 2), (1, "x", 3), (1, "w", 4), (2, "z", 1), (2, "hub", 2), (3, "a", 1)], "query_id int, node string, node_ord int")
    got = graph.multi_hop(matched, edges)
    assert rows(got, "query_id", "path_no", "path", "hops") == [
        (1, 1, ["a", "b", "z"], 2), (1, 2, ["a", "b", "y", "x"], 3), (1, 3, ["x", "w"], 1), (2, 1, ["z", "a", "hub"], 2)
    ]
    starts = graph._reach(spark.createDataFrame([("z",)], "node string"), edges, 2)
    assert [r.count() for r in starts] == [1, 3, 2]


def test_names_are_looked_up_by_their_rarest_piece(spark):
    common = spark.range(5000).select(F.concat(F.lit("common name "), F.col("id").cast("string")).alias("node"), F.col("id").cast("int").alias("node_ord"))
    odd = spark.createDataFrame([("common zebra", 9001), ("zeb", 9002), ("ra", 9003), ("", 9004), ("mmon", 9005)], "node string, node_ord int")
    queries = spark.createDataFrame([(1, "which commonzebra zebra"), (2, "anything")], "query_id int, query string")
    assert rows(graph.match_nodes(queries, common.unionByName(odd)), "query_id", "node") == [(1, "common zebra"), (1, "mmon"), (1, "ra"), (1, "zeb")]
    # By its first piece the first term met all five thousand names.
    names = common.unionByName(odd)
    index = containment.inverted(names, "node")
    term = spark.createDataFrame([("commonzebra",)], "term string")
    rarest = containment.rarest(term, "term", index.groupBy("piece").agg(F.count("*").alias("df")))
    assert rarest.join(index, "piece").count() <= 1 and index.where("piece = 'comm'").count() == 5001


def test_dictionaries_of_any_size(spark):
    """Phrases of every length, more than are looked through one by one; repeats and none."""
    entries = [(f"phrase number {i}", [f"s{i}"], ["r"], ["m"]) for i in range(12_000)] + [("ab", ["short"], [], []), ("ä", ["letter"], [], []), ("", ["never"], [], [])]
    queries = spark.createDataFrame([(1, "A Phrase Number 11999 here"), (2, "cab Ä"), (3, ""), (4, None), (5, "cab Ä")], "query_id int, query string")
    got = {r["query_id"]: r["synonyms"] for r in retrieval.expand(queries, retrieval.expansion_table(spark, entries)).collect()}
    assert got == {1: ["s1", "s11", "s119", "s1199", "s11999"], 2: ["short", "letter"], 3: [], 4: [], 5: ["short", "letter"]}
