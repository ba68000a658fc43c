"""Golden rows of single rules."""

import math

import pytest
from pyspark.sql import functions as F

from loomwell.functions import text as T
from loomwell.functions.vocabulary import ONTOLOGY, TEXTS
from loomwell.operators import answer, checkpoints, chunking, claims, conversation, graph, retrieval, vision


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_expansion(spark):
    queries = spark.createDataFrame([(1, "sakit gigi"), (2, "halo"), (3, "sakit gigi")], "query_id long, query string")
    got = {r["query_id"]: r for r in retrieval.expand(queries, retrieval.expansion_table(spark)).collect()}
    assert got[1]["synonyms"] == ["toothache", "tooth pain"] and got[1]["related"] == ["pulpitis", "dental abscess"]
    assert got[1]["expanded_query"] == got[3]["expanded_query"] == "sakit gigi OR toothache OR tooth pain OR pulpitis OR dental abscess"
    assert got[2]["expanded_query"] == "halo" and got[2]["synonyms"] == []


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="One short. This one is long enough!  And so is this one? No.") == ["This one is long enough!", "And so is this one?"]
    assert one(spark, T.sentences(F.col("t")), t=None) == []


def test_json_extraction(spark):
    assert one(spark, T.fenced_json(F.col("t")), t='x {0}\n```json\n{"a": 1}\n```\n{2}') == '{"a": 1}'
    assert one(spark, T.fenced_json(F.col("t")), t='so {"a": {"b": 1}} it is') == '{"a": {"b": 1}}'
    assert one(spark, T.fenced_json(F.col("t")), t="nothing") == "nothing"


def test_ontology(spark):
    nodes = spark.createDataFrame([("caries",), ("Caries",), ("plaque",)], "node string")
    got = {r["node"]: r["icd10"] for r in graph.link_entities(nodes, spark.createDataFrame(ONTOLOGY, "name string, icd10 string, snomed string")).collect()}
    assert got == {"caries": "K02", "Caries": None, "plaque": None}


def triples(spark, *rows):
    return spark.createDataFrame([(s, p, o, 1.0, "doc_0", i) for i, (s, p, o) in enumerate(rows)], "subject string, predicate string, object string, confidence double, source_doc_id string, ord long")


def test_edge_keeps_the_last_relation(spark):
    got = graph.edges(triples(spark, ("a", "causes", "b"), ("a", "treats", "b"))).collect()
    assert [(r["relation"], r["edge_ord"]) for r in got] == [("treats", 0)]


def test_paths_run_from_earlier_to_later_nodes(spark):
    query = spark.createDataFrame([(1, "fluoride for tooth pain")], "query_id long, query string")
    for rows, hops in (([("fluoride", "prevents", "caries"), ("caries", "causes", "tooth pain")], [2]), ([("caries", "causes", "tooth pain"), ("fluoride", "prevents", "caries")], [])):
        t = triples(spark, *rows)
        matched = graph.match_nodes(query, graph.nodes(t))
        assert [r["hops"] for r in graph.multi_hop(matched, graph.edges(t)).collect()] == hops


def test_names_inside_of_names(spark):
    query = spark.createDataFrame([(1, "toothache and caries"), (2, "nothing alike")], "query_id long, query string")
    names = ["tooth", "toothache pain", "ache", "car", "a", "caries", "carie", "dental caries", "tootache", "z", ""]
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node string, node_ord long")
    got = {(r["query_id"], r["node"]) for r in graph.match_nodes(query, nodes).collect()}
    terms = {1: ["toothache", "caries"], 2: ["nothing", "alike"]}
    assert got == {(q, n) for q, own in terms.items() for n in names if n and any(t in n or n in t for t in own)}


def test_one_bad_triple_voids_its_document(spark):
    good = '{"subject": " A ", "predicate": "Is_A", "object": "b"}'
    bad = '{"subject": "a", "predicate": "is_a", "object": "b", "confidence": 1.5}'
    null = '{"subject": "a", "predicate": "is_a", "object": "b", "confidence": null}'
    raws = [f'{{"triples": [{good}]}}', f'{{"triples": [{good}, {bad}]}}', f'{{"triples": [{good}, {null}]}}', "no json", None]
    got = graph.parse_triples(spark.createDataFrame(list(enumerate(raws)), "doc_idx long, raw string")).collect()
    assert [(r["doc_idx"], r["subject"], r["predicate"], r["confidence"]) for r in got] == [(0, "a", "is_a", 1.0)]


@pytest.mark.parametrize("pct, level", [(34.9, "low"), (35.0, "medium"), (59.9, "medium"), (60.0, "high")])
def test_risk(spark, pct, level):
    assert one(spark, claims.risk(F.col("p")), p=pct) == level


def test_claim_lists(spark):
    responses = spark.createDataFrame([(1,), (2,), (3,)], "response_id long")
    rows = spark.createDataFrame([(1, 0, "weak"), (1, 1, "strong"), (3, 0, "alone")], "response_id long, claim_idx int, claim_text string")
    given = spark.createDataFrame(
        [(1, 0, 0, True, 0.3, [1], 0), (1, 0, 1, False, 0.1, [1], 0), (1, 0, 1, True, 0.9, [1], 1), (1, 0, 7, True, 0.9, [1], 2)],
        "response_id long, batch int, claim_index int, is_supported boolean, confidence double, supporting_sources array<int>, ord int",
    )
    got = {r["response_id"]: r for r in claims.metrics(responses, claims.with_verdicts(rows, given)).collect()}
    assert got[1]["unsupported"] == ["weak"] and got[1]["well_supported"] == ["strong"] and got[1]["overall_confidence"] == 0.6
    assert (got[2]["overall_confidence"], got[2]["hallucination_risk"], got[2]["recommendations"]) == (0.5, "medium", [TEXTS["no_claims"]])
    assert (got[3]["overall_confidence"], got[3]["recommendations"]) == (0.5, [TEXTS["validation_error"]])


def test_claims_meet_their_verdicts_in_one_sort(spark):
    """No join, and as many tasks as are asked for; claims without a response, claims that stand twice and verdicts without a batch or an order count as by the rules."""
    rows = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (None, 0, "c"), (2, 0, "d"), (2, None, "e"), (3, 0, "f"), (4, 0, "g")], "response_id long, claim_idx int, claim_text string")
    given = spark.createDataFrame(
        [(1, 0, 0, True, 0.3, 0), (1, 0, 1, True, 0.4, 1), (1, 0, 1, False, 0.5, 2), (None, 0, 0, True, 0.6, 0), (2, 0, 0, True, 0.7, 0), (2, None, 0, True, 0.8, 0), (3, 0, 0, True, 0.9, None), (4, 0, 0, True, 1.5, 0), (9, 0, 0, True, 0.5, 0)],
        "response_id long, batch int, claim_index int, is_supported boolean, confidence double, ord int",
    )
    out = claims.with_verdicts(rows, given.withColumn("supporting_sources", F.array("ord")), partitions=7)
    assert out.columns == ["response_id", "claim_idx", "claim_text", "is_supported", "confidence", "supporting_sources", "voided"] and out.schema["claim_idx"].dataType == rows.schema["claim_idx"].dataType
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "hashpartitioning(response_id" in plan and ", 7)" in plan
    got = sorted((r["claim_text"], r["is_supported"], r["confidence"], r["voided"]) for r in out.collect())
    assert got == [("a", True, 0.3, False), ("a", True, 0.3, False), ("b", False, 0.5, False), ("c", True, 0.6, False), ("d", True, 0.7, True), ("e", None, None, True), ("f", None, None, True), ("g", True, 1.5, True)]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")


def test_chunks(spark):
    long = [f"Sentence number {i} is about a word{i} of its own and of nothing else at all." for i in range(12)]
    few = chunking.chunk(docs(spark, "Just one sentence here. And one more of them."))
    assert [(r["chunk_id"], r["content"]) for r in few.collect()] == [(None, "Just one sentence here. And one more of them.")]
    assert chunking.chunk(docs(spark, "Too short one. Too short two. Too short tri. Too short for."), threshold=1.1).count() == 0
    one_segment = chunking.chunk(docs(spark, " ".join(long * 2)), threshold=0.0).collect()
    assert sorted(r["split"] for r in one_segment) == ["part1", "part2"] and all(len(r["content"]) >= 150 and r["chunk_id"] is None for r in one_segment)
    assert {r["content"][-1] for r in one_segment} == {"."}
    windows = chunking.chunk(docs(spark, " ".join(long)), threshold=1.1).orderBy("cluster").collect()
    assert [(r["first"], r["last"]) for r in windows] == [(i, i) for i in range(12)]
    assert windows[5]["content"] == " ".join(long[3:8])
    assert chunking.chunk(docs(spark, None, "")).count() == 2


def test_chunking_needs_no_shuffle(spark):
    plan = chunking.chunk(docs(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_knn_keeps_the_same_rows_in_any_partitioning(spark):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(60, 8)).round(1)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, embedding array<double>")
    asked = rows.where("id < 7").withColumnRenamed("id", "query_id")
    ranks = lambda df: [tuple(r) for r in df.select("query_id", "rank", "id").orderBy("query_id", "rank").collect()]
    whole = ranks(retrieval.knn(asked, rows.repartition(1), 5))
    assert whole == ranks(retrieval.knn(asked, rows.repartition(9), 5, block_bytes=100)) and len(whole) == 35
    assert retrieval.knn(asked, rows.limit(3), 5).count() == 21
    assert retrieval.knn(asked, rows.limit(0), 5).count() == 0


def test_temporal_score(spark):
    score = lambda **kw: one(spark, retrieval.temporal_score(F.lit("2025-01-01 00:00:00"), [F.col(c) for c in ("a", "b")]), a=kw.get("a"), b=kw.get("b"))
    assert score() == 0.5
    assert score(a="2020") == math.exp(-1827 / 1825)
    assert score(a="bad", b="2024-12-31") == math.exp(-1 / 1825) == score(a="2024-12-31T00:00:00")
    assert score(a="20x0", b=None) == 0.5
    assert score(a="2030-01-01") > 1


@pytest.mark.parametrize("odd", ["2030-01-01", "2020-01-01T00:00:00Z"])
def test_one_odd_date_keeps_the_order_of_retrieval(spark, odd):
    none = (None, None, None)
    rows = [(1, 1, 0.1, "2020", *none), (1, 2, 0.9, odd, *none), (2, 1, 0.1, "2020", *none), (2, 2, 0.9, "2020", *none)]
    schema = "query_id long, retrieval_rank int, cos double, published_date string, publication_date string, date string, year string"
    got = retrieval.rerank(spark.createDataFrame(rows, schema), F.lit("2025-01-01 00:00:00")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["retrieval_rank"], r["fallback"]) for r in got] == [(1, 1, True), (1, 2, True), (2, 2, False), (2, 1, False)]


@pytest.mark.parametrize("text, severity, rejected, ready", [("sakit 8/10", 8, False, True), ("skala 11", 11, True, True), ("nothing", None, False, False), ("skala 99999999999", None, True, False)])
def test_severity(spark, text, severity, rejected, ready):
    rows = conversation.extract_symptoms(spark.createDataFrame([(1, text)], "conv_id int, content string"))
    got = conversation.completeness(rows).first()
    assert (got["severity"], got["rejected"], got["ready"]) == (severity, rejected, ready)


def test_character_precedence(spark):
    assert conversation.extract_symptoms(spark.createDataFrame([("a dull but sharp pain",)], "content string")).first()["character"] == "sharp pain"


def test_profile_merge(spark):
    names = ("chief_complaint", *conversation.SCALARS, *conversation.LISTS, "severity")
    row = lambda turn, **kw: (1, turn, *[kw.get(n) for n in names])
    updates = [row(0, site="jaw", associations="b", severity="5", chief_complaint="pain"), row(1, associations="a, b", severity="high"), row(2, site="ear", severity="11"), row(3, onset="")]
    frame = spark.createDataFrame(updates, "conv_id long, turn long, " + ", ".join(f"{n} string" for n in names))
    got = conversation.merge_profiles(frame).first()
    assert (got["site"], got["associations"], got["severity"], got["onset"], got["chief_complaint"]) == ("jaw", ["a", "b"], 5, "", None)


@pytest.mark.parametrize("action, response, node", [("question", "x", "end"), ("question", None, "anamnesis"), ("question", "", "anamnesis"), ("yolo", "x", "vision"), ("??", None, "end"), (None, None, "end")])
def test_triage(spark, action, response, node):
    assert conversation.triage(spark.createDataFrame([(action, response)], "action string, response string")).first()["next_node"] == node


@pytest.mark.parametrize("language, label", [("id", "karies/gigi berlubang"), ("en", "Caries")])
def test_labels(spark, language, label):
    rows = spark.createDataFrame([(1, 0, "caries", 0.0625, language)], "key int, ord int, class_name string, confidence double, language string")
    assert answer.format_detections(rows).first()["detections_text"].endswith(f"1. {label} (confidence: 6.2%)")


def test_detection_threshold(spark):
    rows = spark.createDataFrame([(0.2, None), (0.3, None), (0.2, 0.0), (0.2, 0.1)], "confidence double, t double")
    assert vision.filter_detections(rows, F.col("t")).count() == 2


@pytest.mark.parametrize("share, score", [(0.05, 0.3), (0.10, 0.7), (0.20, 1.0), (0.60, 1.0), (0.61, 0.8)])
def test_focus_bands(spark, share, score):
    row = tuple(dict(zip(vision.STATS, (500.0, 100.0, 60.0, 9.0, 9.0, 9.0, share))).values())
    got = vision.quality_scores(spark.createDataFrame([row], ", ".join(f"{c} double" for c in vision.STATS))).first()
    assert got["dental_focus_score"] == score and got["blur_score"] == got["brightness_score"] == got["color_balance_score"] == 1.0


def test_citation_lines(spark):
    rows = [(1, 2, "T", "PDF", "", "", None, 0, "p"), (1, 1, "T", "PubMed", "A", "7", "u", None, "p")]
    frame = spark.createDataFrame(rows, "query_id int, id int, title string, provider string, authors string, pmid string, url string, page int, source_path string")
    assert answer.format_citations(frame, F.lit("en")).first()["citations_text"] == TEXTS["references_en"] + "[1] T — A (PMID: 7) [Link](u)\n[2] T — p"


def test_checkpoints(spark):
    rows = [("conv_1", "2025-01-01", 1, 1, "{}"), ("conv/_1", "2025-01-02", 2, 1, '{"k": 2}'), ("conv_2", "2024-01-01", 3, 1, "{x"), ("other", "2020-01-01", 4, 1, "{}")]
    log = spark.createDataFrame(rows, "conversation_id string, ts string, seq long, version int, state string").withColumn("ts", F.to_timestamp("ts"))
    current = checkpoints.latest(log)
    assert {r["conversation_id"]: r["seq"] for r in current.collect()} == {"conv_1": 2, "conv_2": 3, "other": 4}
    assert {r["conversation_id"] for r in checkpoints.latest(current).collect()} == {"conv_1", "conv_2", "other"}  # saving again changes nothing
    assert [r["conversation_id"] for r in checkpoints.newest(current, 2).collect()] == ["conv_1"]
    kept = checkpoints.retain(current, F.lit("2025-01-09 00:00:00").cast("timestamp"), 7)
    assert {r["conversation_id"] for r in kept.collect()} == {"conv_1", "other"}
    asked = spark.createDataFrame([(1, "conv_1"), (2, "new"), (3, None)], "request_id int, conversation_id string").withColumn("input", F.lit("hi"))
    assert {r["request_id"]: r["origin"] for r in checkpoints.resume(asked, current).collect()} == {1: "saved", 2: "fresh", 3: "history"}


def test_word_counts_by_bucket(monkeypatch):
    """Equal to a loop over words, however texts are cut into steps and however few words are remembered."""
    import hashlib
    import re

    from loomwell.functions import encoders

    texts = ["", "Zum Ä_1 x", "x " * 5000, "...", "naïve 😀 text\r\nwith lines\t", *(f"word{i} Word{i % 7}, again" for i in range(300))]
    expected = [[0.0] * encoders.DIM for _ in texts]
    for row, text in zip(expected, texts):
        for word in re.findall(r"\w+", text.lower()):
            row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % encoders.DIM] += 1
    for chars, known in ((1 << 22, 200_000), (1, 1), (200, 10)):
        monkeypatch.setattr(encoders, "HELD_CHARS", chars)
        monkeypatch.setattr(encoders, "KNOWN_WORDS", known)
        assert encoders.hashed_counts()(texts).tolist() == expected
    assert encoders.hashed_counts()([]).shape == (0, encoders.DIM)


def test_strip(spark):
    blanks = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    from loomwell.functions.text import strip

    rows = spark.createDataFrame([(f"{blanks}a{blanks}b{blanks}",), (blanks,), ("",), (None,), ("\u200ba",)], "t string")
    assert [r[0] for r in rows.select(strip(F.col("t"))).collect()] == [f"a{blanks}b", "", "", None, "\u200ba"]
