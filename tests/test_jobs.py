"""Sources, sinks, the jobs built from them, images and the streaming twins."""

import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import same_rows
from loomwell.operators import checkpoints, conversation, graph, vision
from loomwell.plans import conversations, ingestion
from loomwell.queries import dialogue
from loomwell.sources import index_store as store
from loomwell.sources import tables as S
from loomwell.streaming import folds


def test_corpus_from_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("one")
    (tmp_path / "a" / "b" / "y.txt").write_text("two\nlines")
    got = {r["title"]: r["text"] for r in S.as_pdf_corpus(S.read_texts(spark, str(tmp_path))).collect()}
    assert got == {"x.txt": "one", "y.txt": "two\nlines"}
    assert S.list_files(spark, str(tmp_path), "*.txt").agg(F.sum("length")).first()[0] == 12
    assert S.union_corpora(spark.range(2), None).count() == 2


def test_index_is_built_once_and_read_again(spark, tmp_path):
    text = " ".join(f"Sentence number {i} is long enough to be kept in a chunk of its own." for i in range(9))
    docs = spark.createDataFrame([(0, text)], "doc_idx long, text string")
    triples = ingestion.ordered(spark.createDataFrame([(0, 0, "caries", "causes", "pain", 1.0, "doc_0")], "doc_idx long, pos int, subject string, predicate string, object string, confidence double, source_doc_id string"))
    folder = str(tmp_path / "index")
    assert store.current(spark, folder) is None and store.read_graph(spark, folder)[0].count() == 0
    chunks, nodes, edges = ingestion.setup(docs, triples, folder, F.lit("2025-01-01"), threshold=0.2)
    n = chunks.count()
    assert n > 0 and nodes.count() == 2 and edges.count() == 1
    assert {r["name"]: (r["entity_type"], r["aliases"], r["ontology_ids"]) for r in store.read_entities(spark, folder).collect()} == {
        "caries": ("unknown", [], {"icd10": "K02", "snomed": "80967001"}), "pain": ("unknown", [], {}),
    }
    again = ingestion.setup(docs.limit(0), triples, folder, F.lit("2025-01-01"))
    assert again[0].count() == n
    assert ingestion.setup(docs.limit(0), triples, folder, F.lit("2025-01-01"), force_rebuild=True)[0].count() == 0
    assert store.manifest(spark, folder, store.current(spark, folder))["num_chunks"] == 0


def test_places_of_large_documents_do_not_meet(spark):
    rows = [(-1, 0), (0, 0), (0, 5_000_000), (1, 0), ((1 << 63) - 2, 2_000_000_000), ((1 << 63) - 1, 0)]
    got = ingestion.ordered(spark.createDataFrame(rows, "doc_idx long, pos int")).orderBy("ord").collect()
    assert [(r["doc_idx"], r["pos"]) for r in got] == rows and len({r["ord"] for r in got}) == len(rows)


def test_chat_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "", "r", None), (2, None, "r", None), (3, "hi", "r", None)], "id long, user_text string, response string, timestamp timestamp")
    for _ in range(2):
        S.append_chat(rows, F.lit("2025-01-01").cast("timestamp"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 6 and got.where("user_input = '(Image query)'").count() == 4


def test_conversations_advance(spark, small):
    out = conversations.advance(dialogue.turns(spark, small), dialogue.log(spark, small), F.lit("2025-01-01"))
    assert out.count() > 0 and out.where("version > 1").count() > 0 and out.where("next_node not in ('rag', 'end')").count() == 0


def png(path, rows):
    """An RGB PNG of 8-bit samples."""
    raw = b"".join(b"\0" + bytes(v for pixel in row for v in pixel) for row in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_quality(spark, tmp_path):
    png(tmp_path / "white.png", [[(250, 250, 250)] * 8] * 8)
    png(tmp_path / "chess.png", [[(0, 0, 0) if (x + y) % 2 else (255, 255, 255) for x in range(8)] for y in range(8)])
    png(tmp_path / "gum.png", [[(200, 100, 100)] * 8] * 8)
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = spark.read.format("image").option("dropInvalid", "false").load(str(tmp_path))
    got = {r["path"].split("/")[-1]: r for r in vision.quality_scores(vision.pixel_stats(images)).collect()}
    assert set(got) == {"white.png", "chess.png", "gum.png"}
    assert got["white.png"]["issues"] == ["Severe blur detected", "Image overexposed", "Low contrast"]
    assert got["white.png"]["oral_share"] == 1.0 and got["gum.png"]["oral_share"] == 1.0
    assert got["chess.png"]["laplacian_var"] > 10_000 and got["chess.png"]["oral_share"] == 0.5 and got["chess.png"]["is_acceptable"]
    assert (got["gum.png"]["mean_b"], got["gum.png"]["mean_r"]) == (100.0, 200.0)


def _stream(spark, frame, folder, parts=3):
    """``frame`` as a stream over ``parts`` files, one to a batch."""
    for i in range(parts):
        frame.where(F.pmod(F.hash(*frame.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _profiles(frame):
    clean = lambda v: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else None if v is None or v != v else v
    return {r["conv_id"]: {k: clean(v) for k, v in r.items()} for r in frame.to_dict("records")}


def _folded(stream, folder, **options):
    """The last profile of each conversation that the stream gives."""
    seen = []
    query = folds.fold_profiles(stream, **options).writeStream.outputMode("update")
    query = query.foreachBatch(lambda batch, n: seen.append((n, batch.toPandas()))).option("checkpointLocation", folder).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = {}
    for _, frame in sorted(seen, key=lambda x: x[0]):
        last |= _profiles(frame)
    return last


def test_streamed_profiles_equal_the_batch(spark, small, tmp_path):
    updates = dialogue.updates(spark, small).withColumn("severity", F.col("severity").cast("string"))
    assert _folded(_stream(spark, updates, str(tmp_path / "in")), str(tmp_path / "c")) == _profiles(conversation.merge_profiles(updates).toPandas())


ODD = ["99999999999", "+-7", "²", " 8 ", "+3", "-1", "0", "11", "7.5", "seven", "", None, "١"]


def _odd_updates(spark):
    """Every odd severity as a late turn, an early one and alone, with lists and nulls."""
    names = ["chief_complaint", *conversation.SCALARS, *conversation.LISTS]
    rows = []
    for i, raw in enumerate(ODD):
        rows += [(i, 2, raw, *[f"{c}{i}" if c != "onset" else None for c in names]), (i, 1, "5", *["" if c == "site" else f"x, {c} ,y" for c in names]), (100 + i, 1, raw, *[None if i % 2 else "a,b" for _ in names])]
    return spark.createDataFrame(rows, "conv_id long, turn long, severity string, " + ", ".join(f"{c} string" for c in names))


def test_odd_severities_and_late_turns_count_alike(spark, tmp_path):
    updates = _odd_updates(spark)
    batch = _profiles(conversation.merge_profiles(updates).toPandas())
    assert _folded(_stream(spark, updates, str(tmp_path / "in"), 4), str(tmp_path / "c")) == batch
    assert [batch[100 + i]["severity"] for i in range(5)] == [None, None, None, 8, 3]


def test_profiles_without_times_fold_in_spark(spark, tmp_path):
    """Nothing is called in Python for each conversation."""
    updates = _odd_updates(spark)
    plan = folds.fold_profiles(_stream(spark, updates, str(tmp_path / "in"), 1))._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "TransformWithState" not in plan


def test_profiles_of_ended_conversations_go(spark, tmp_path):
    """By the stream's clock: one that is silent for a day ends, one that goes on keeps what it had."""
    folder = str(tmp_path / "in")
    rows = _odd_updates(spark).where("conv_id = 3")
    day = lambda d: F.lit(f"2025-01-0{d} 00:00:00").cast("timestamp")
    other = rows.withColumn("conv_id", F.lit(4).cast("long"))
    none = F.lit(None).cast("string")
    for d, frame in enumerate((rows.where("turn = 1").unionByName(other.where("turn = 1")), other.where("turn = 2").withColumn("severity", none), other.where("turn = 2"), rows.where("turn = 2").withColumn("severity", none)), 1):
        frame.withColumn("at", day(2 * d - 1)).coalesce(1).write.mode("append").parquet(folder)
        schema = frame.withColumn("at", day(1)).schema
        got = _folded(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "c"), time="at", silence_ms=3 * 86_400_000, delay="0 seconds")
        if d == 1:
            assert got[3]["severity"] == got[4]["severity"] == 5
        if d == 2:
            assert got[4]["severity"] == 5 and "associations" in got[4]["associations"]
    assert got[3]["severity"] is None and got[3]["associations"] == ["associations3"]


def test_streamed_checkpoints_equal_the_batch(spark, small, tmp_path):
    log = dialogue.log(spark, small).withColumn("conversation_id", F.regexp_replace("conversation_id", "/ ", ""))
    folder = str(tmp_path / "out")
    stream = folds.upsert_checkpoints(_stream(spark, log, str(tmp_path / "in")), folder).option("checkpointLocation", str(tmp_path / "c"))
    assert stream.trigger(availableNow=True).start().awaitTermination(120)
    columns = ["conversation_id", "seq", "state"]
    same_rows(folds.current_checkpoints(spark, folder, log.schema).select(*columns).toPandas(), checkpoints.latest(log).select(*columns).toPandas())


SAVED = "conversation_id string, ts timestamp, seq long, state string"


def _save(spark, source, rows):
    frame = spark.createDataFrame(rows, "conversation_id string, day int, seq long, state string")
    frame.selectExpr("conversation_id", "timestamp'2025-01-01' + make_dt_interval(day) as ts", "seq", "state").coalesce(1).write.mode("append").parquet(source)


def _runs_of(folder):
    """The folders of runs in each bucket."""
    return {b.name: sorted((int(f.name[6:]), int(n.name[6:])) for f in b.iterdir() for n in f.iterdir()) for b in folder.iterdir() if b.name.startswith("bucket=")}


def test_small_batches_leave_large_runs_alone(spark, tmp_path):
    """A batch writes its own rows and merges small runs only; every state is found, late rows lose, and batches may run again."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    _save(spark, source, [(f"conv_{i}", 0, 0, "first") for i in range(400)])
    stream = folds.upsert_checkpoints(spark.readStream.schema(SAVED).parquet(source), folder, 8).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    for rows in ([], [("conv_1", 1, 1, "second")], [("conv_1", 2, 2, "third"), ("conv_1", 2, 1, "tied")], [("conv_1", 1, 3, "late")], [("conv_/ 1", 1, 4, "late, too")]):
        if rows:
            _save(spark, source, rows)
        assert stream.start().awaitTermination(120)
    log = spark.read.schema(SAVED).parquet(source)
    read = lambda: {r["conversation_id"]: r["state"] for r in folds.current_checkpoints(spark, folder, log.schema).collect()}
    assert read() == {r["conversation_id"]: r["state"] for r in checkpoints.latest(log).collect()} and read()["conv_1"] == "third"
    touched = spark.range(1).select(F.lit("conv_1").alias("conversation_id")).select(folds.bucket_of(8)).first()[0]
    # The bucket's large run of the first batch is still there; what came after it is merged into small ones.
    runs = _runs_of(tmp_path / "out")
    assert (0, 0) in runs[f"bucket={touched}"] and sum(r == [(0, 0)] for r in runs.values()) >= len(runs) - 2
    large = (tmp_path / "out" / f"bucket={touched}" / "first=0" / "batch=0").stat().st_mtime_ns
    before = spark.read.parquet(folder).where("batch > 0").count()
    assert before <= 6 and large < max((tmp_path / "out").rglob("*.parquet"), key=lambda p: p.stat().st_mtime_ns).stat().st_mtime_ns
    # A batch that is run again, here from a stream that has forgotten it, gives the same runs and states.
    states = read()
    again = folds.upsert_checkpoints(spark.readStream.schema(SAVED).option("maxFilesPerTrigger", 1).parquet(source), folder, 8)
    assert again.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert read() == states


def test_runs_grow_geometrically(spark, tmp_path):
    """Of one bucket with many equal batches a logarithm of runs is live, and each row is written few times."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(12):
        _save(spark, source, [(f"conv_{n}_{i}", n, n, "s") for i in range(5)])
    stream = folds.upsert_checkpoints(spark.readStream.schema(SAVED).option("maxFilesPerTrigger", 1).parquet(source), folder, 1)
    assert stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    rows = spark.read.schema(SAVED + ", bucket int, first long, batch long").parquet(folder)
    live, dead = folds._runs(rows)
    assert sum(n for _, _, n in live[0]) == 60 and len(live[0]) <= 4
    # What the last merge left behind is all that is dead; older ones are deleted.
    assert len(dead) <= 4 and folds.current_checkpoints(spark, folder, spark.read.parquet(source).schema).count() == 60


def test_resumption_reads_the_asked_buckets(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    _save(spark, source, [(f"conv_{i}", 0, 0, f"state {i}") for i in range(100)])
    log = spark.read.schema(SAVED).parquet(source)
    stream = folds.upsert_checkpoints(spark.readStream.schema(SAVED).parquet(source), folder, 16).option("checkpointLocation", str(tmp_path / "c"))
    assert stream.trigger(availableNow=True).start().awaitTermination(120)
    requests = spark.createDataFrame([(1, "conv_7", "a"), (2, "conv_none", "b"), (3, None, "c")], "request_id int, conversation_id string, input string")
    out = folds.resume_streamed(requests, folder, log.schema, 16)
    assert {r["request_id"]: (r["origin"], r["state"]) for r in out.collect()} == {1: ("saved", "state 7"), 2: ("fresh", None), 3: ("history", None)}
    few = {r["conversation_id"] for r in folds.current_checkpoints(spark, folder, log.schema, [3]).collect()}
    assert few == {r["conversation_id"] for r in log.where(folds.bucket_of(16) == 3).collect()}


def test_files_of_the_tables(spark, small):
    from pathlib import Path

    from loomwell import registry

    expected = {}
    for p in Path(small).rglob("*.parquet"):
        if p.is_file():
            name = p.relative_to(small).parts[0].removesuffix(".parquet")
            files, size = expected.get(name, (0, 0))
            expected[name] = files + 1, size + p.stat().st_size
    got = {r["provider"]: (r["files"], r["bytes"]) for r in registry.QUERIES["file_inventory"](spark, small).collect()}
    assert got == expected and len(got) == 14


def test_answers_are_quarantined(spark):
    from loomwell.operators import parsing

    raws = ['Sure:\n```json\n{"a": 1, "b": "x"}\n```', '{"a": 2}', '{"a": "no number", "b": "y"}', "nothing", None]
    rows = parsing.parse(spark.createDataFrame(list(enumerate(raws)), "id int, raw string"), "struct<a:long,b:string>", ["a", "b"])
    valid, aside = parsing.quarantine(rows)
    assert [(r["id"], r["parsed"]["a"], r["parsed"]["b"]) for r in valid.collect()] == [(0, 1, "x")]
    got = {r["id"]: (r["raw"], r["missing"]) for r in aside.collect()}
    assert {i: m for i, (_, m) in got.items()} == {1: ["b"], 2: ["a"], 3: ["a", "b"], 4: ["a", "b"]} and got[3][0] == "nothing"


def test_streamed_expiry(spark, tmp_path):
    """A conversation that is saved again in time stays; what is older than seven days behind the newest goes, once."""
    day = lambda n: f"2025-01-{n:02d} 00:00:00"
    files = [[("conv_a", day(1)), ("conv_b", day(1)), ("x", day(1))], [("conv_b", day(7)), ("conv_c", day(8))], [("conv_d", day(10))], [("conv_d", day(11))]]
    folder = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, "conversation_id string, at string").select("conversation_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    gone = []
    query = folds.expire(spark.readStream.schema("conversation_id string, ts timestamp").parquet(folder)).writeStream.outputMode("append")
    query = query.foreachBatch(lambda batch, n: gone.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "c"))
    for rows in ([], [("conv_e", day(12))], [("conv_e", day(20))]):
        if rows:
            spark.createDataFrame(rows, "conversation_id string, at string").select("conversation_id", F.col("at").cast("timestamp").alias("ts")).write.mode("append").parquet(folder)
        assert query.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r[0] for r in gone) == ["conv_a", "conv_b", "conv_c", "conv_d"] and {r[0]: str(r[1])[:10] for r in gone}["conv_b"] == "2025-01-07"


def test_streamed_expiry_of_many_conversations_in_a_bucket(spark, tmp_path):
    """What goes and when is as by a loop over batches, for any number of buckets; saves without a time count for nothing."""
    days = [
        [("conv_a", 1), ("conv_b", 1), ("conv_c", 2), ("conv_d", 3), ("conv_n", None)],
        [("conv_a", 9), ("conv_a", 4), ("conv_e", 10)],
        [("conv_b", 12), ("conv_c", 11), ("conv_n", None)],
        [("conv_c", 25), ("conv_f", 18)],
        [("conv_e", 26), ("conv_g", 40), ("conv_g", 31)],
    ]
    folder = str(tmp_path / "in")
    time = lambda n: None if n is None else str(pd.Timestamp("2025-01-01") + pd.Timedelta(days=n))
    for rows in days:
        frame = spark.createDataFrame([(c, time(n)) for c, n in rows], "conversation_id string, at string")
        frame.select("conversation_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    held, expected, clock = {}, [], pd.Timestamp(0)
    for rows in [*days, []]:
        fresh = [(c, pd.Timestamp(time(n))) for c, n in rows if n is not None]
        for c, at in fresh:
            held[c] = max(at, held.get(c, at))
        for c in [c for c, at in held.items() if at + pd.Timedelta(days=7) < clock]:
            expected.append((c, str(held.pop(c))))
        clock = max([clock, *(at for _, at in fresh)])
    for buckets in (1, 3):
        gone = []
        stream = spark.readStream.schema("conversation_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        query = folds.expire(stream, buckets=buckets).writeStream.outputMode("append").foreachBatch(lambda batch, n, to=gone: to.extend((r[0], str(r[1])) for r in batch.collect()))
        assert query.option("checkpointLocation", str(tmp_path / f"c{buckets}")).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(gone) == sorted(expected) and len(gone) > 5


def test_chunks_where_the_encoder_fails(spark):
    """A document that the encoder fails on stays whole; one whose similarities are no numbers is cut by counts."""
    import numpy as np

    from loomwell.functions.encoders import hashed_counts
    from loomwell.operators import chunking

    def encoder(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no vector")
        out = hashed_counts()(texts)
        out[[i for i, t in enumerate(texts) if "strange" in t]] = np.nan
        return out

    text = lambda word: " ".join(f"Sentence number {i} of the {word} text is long enough to be a part of a chunk." for i in range(9))
    docs = spark.createDataFrame([(0, text("plain")), (1, text("broken")), (2, text("strange"))], "doc_idx long, text string")
    got = {}
    for r in chunking.chunk(docs, 0.2, encoder=encoder).collect():
        got.setdefault(r["doc_idx"], []).append((r["first"], r["last"], r["content"]))
    assert got[1] == [(None, None, text("broken"))] and len(got[0]) == 1 and got[0][0][:2] == (0, 8)
    assert sorted(x[:2] for x in got[2]) == [(0, 2), (3, 5), (6, 8)]


def test_a_failing_encoder_fails_the_queries(spark, small, monkeypatch):
    """Where the default encoder fails, no query takes a document for a single cluster, for one without pairs or for a whole chunk."""
    from pyspark.errors import PythonException

    from loomwell import registry
    from loomwell.functions import encoders

    def broken(texts):
        raise MemoryError("no room for the words")

    monkeypatch.setattr(encoders, "hashed_counts", lambda: broken)
    for query in ("sentence_clusters", "adjacent_similarity", "semantic_chunks", "chunk_stats", "index_manifest"):
        with pytest.raises(PythonException, match="no room for the words"):
            registry.QUERIES[query](spark, small).collect()


def test_an_encoder_without_a_row_for_each_text_fails(spark):
    from pyspark.errors import PythonException

    from loomwell.functions import encoders
    from loomwell.operators import chunking

    text = lambda word: " ".join(f"Sentence number {i} of the {word} text is long enough." for i in range(5))
    docs = chunking.with_sentences(spark.createDataFrame([(0, text("plain")), (1, text("strange"))], "doc_idx long, text string"))

    def short(texts):
        """One row too few for the strange document."""
        return encoders.hashed_counts()([t for t in texts if "strange" not in t or "number 3" not in t])

    with pytest.raises(PythonException, match="for 5 texts"):
        chunking.with_similarities(docs, short).collect()
    got = {r["doc_idx"]: r["similarities"] for r in chunking.with_similarities(docs, short, failed_as_null=True).collect()}
    assert len(got[0]) == 4 and got[1] is None


def test_an_encoder_that_fails_on_many_rows_is_given_each_alone(spark):
    """Rows, empty ones and null sentences among them, have the similarities that they have in one batch."""
    from loomwell.functions import encoders

    def narrow(texts):
        if not 0 < len(texts) <= 3:
            raise MemoryError("no room for the texts")
        return encoders.hashed_counts()(texts)

    rows = spark.createDataFrame([(0, ["a b", "a c", None]), (1, []), (2, ["x"]), (3, ["a b", "a b"]), (4, None)], "id long, s array<string>").coalesce(1)
    alone, whole = (rows.select("id", encoders.neighbour_similarity(F.col("s"), e).alias("x")).orderBy("id").collect() for e in (narrow, None))
    assert alone == whole and [[round(x, 6) for x in r["x"] or []] for r in whole] == [[0.5, 0.0], [], [], [1.0], []]


def test_similarities_are_worked_out_once(spark, small):
    from loomwell import registry

    plan = str(registry.QUERIES["adjacent_similarity"](spark, small)._jdf.queryExecution().executedPlan())
    assert plan.count("ArrowEvalPython") == 1


def test_statistics_chunk_once(spark, small):
    """One encoding in the plan; documents without text or sentences count, too, and agree with their chunks."""
    from loomwell import registry
    from loomwell.operators import chunking

    plan = str(registry.QUERIES["chunk_stats"](spark, small)._jdf.queryExecution().executedPlan())
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    long = " ".join(f"Sentence number {i} is long enough to be a part of a chunk of its own. And {i} more." for i in range(60))
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "short"), (3, long), (4, "A small one. " * 9)], "doc_idx long, text string")
    got = {r["doc_idx"]: r["chunks"] for r in chunking.stats(docs, 0.2).collect()}
    made = {r["doc_idx"]: r["count"] for r in chunking.chunk(docs, 0.2).groupBy("doc_idx").count().collect()}
    assert got == {i: made.get(i, 0) for i in range(5)} and got[3] > 0


def test_images_made_of_documents(spark, small):
    from loomwell import registry

    texts = {f"doc_{r['doc_id']}": r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"] is not None}
    got = registry.QUERIES["image_quality"](spark, small).collect()
    assert {r["image_id"] for r in got} == set(texts)
    for r in got[:20]:
        raw = texts[r["image_id"]].encode()
        raw = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        b, g, red = (sum(raw[i::3]) / (len(raw) // 3) for i in range(3))
        assert (r["mean_b"], r["mean_g"], r["mean_r"]) == (round(b, 6), round(g, 6), round(red, 6)) or max(abs(r["mean_b"] - b), abs(r["mean_g"] - g), abs(r["mean_r"] - red)) < 1e-6
        assert abs(r["color_balance_score"] - (1 - (abs(b - g) + abs(g - red) + abs(red - b)) / 765)) < 1e-6


def test_images_in_strips(monkeypatch):
    """Strips of any height give the same numbers, exact ones, and the memory of a large image doesn't grow with it."""
    import tracemalloc

    import numpy as np

    def plain(image):
        n, (b, g, r) = image[:, :, 0].size, (image[:, :, [0, 1, 2] if image.shape[2] > 1 else [0, 0, 0]].astype(float).transpose(2, 0, 1))
        gray = np.rint(0.114 * b + 0.587 * g + 0.299 * r)
        edge = np.pad(gray, 1, mode="reflect")
        edge = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * gray
        moments = lambda x: (int(x.sum()), int((x * x).sum()))
        (e1, e2), (g1, g2) = moments(edge), moments(gray)
        return ((n * e2 - e1 * e1) / (n * n), g1 / n, ((n * g2 - g1 * g1) / (n * n)) ** 0.5, b.mean(), g.mean(), r.mean())

    noise = np.random.default_rng(3)
    for shape in ((1, 1, 3), (1, 9, 1), (9, 1, 4), (2, 5, 3), (33, 64, 3)):
        image = noise.integers(0, 256, shape, dtype=np.uint8)
        found = set()
        for strip in (1, 64, 150, 1 << 16):
            monkeypatch.setattr(vision, "STRIP", strip)
            found.add(vision._stats(image))
        assert len(found) == 1 and found.pop()[:6] == pytest.approx(plain(image), abs=1e-9)
    image = noise.integers(0, 256, (50_000, 64, 3), dtype=np.uint8)
    tracemalloc.start()
    vision._stats(image)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * image.nbytes


def test_rule_triples(spark):
    docs = spark.createDataFrame([(0, "Fluoride prevents caries. A filling treats the cavity. Nothing here at all.")], "doc_idx long, text string")
    names = spark.createDataFrame([("fluoride",), ("caries",), ("filling",), ("cavity",)], "name string")
    got = graph.rule_triples(docs, names).orderBy("pos").collect()
    assert [(r["subject"], r["predicate"], r["object"]) for r in got] == [("fluoride", "prevents", "caries"), ("filling", "treats", "cavity")]
