"""Media sequences, BPE, line dedup, decontamination, chat formatting."""

import hashlib
import json
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from checks import same_rows
from loomwell.llm import byte_bpe, chat_format, decontamination, line_dedup, media_sequences, registry
from loomwell.llm.common import Words
from loomwell.llm.fm_index import FMIndex, suffix_array


@pytest.fixture(scope="module")
def rows(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, small, duck, name):
    same_rows(registry.QUERIES[name](spark, small).toPandas(), duck(small, registry.ORACLE_SQL[name]))


# ---------------------------------------------------------------- media


def media_facts(text):
    raw = (text or "").encode()
    payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def plain_feature(payload):
    """Size, channel means and spreads, and the bits of an 8 x 8 grid of grey means, by loops over samples."""
    pixels = [payload[i : i + 3] for i in range(0, len(payload), 3)]
    rows = [pixels[i : i + 64] for i in range(0, len(pixels), 64)]
    out = [f"{len(rows)}x64"]
    for c in range(3):
        own = [p[c] for p in pixels]
        mean = sum(own) / len(own)
        out.append(f"{mean:.3f}/{(sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5:.3f}")
    sizes = [len(rows) // 8 + (k < len(rows) % 8) for k in range(8)]
    cells, at = [], 0
    for size in sizes:
        own = rows[at : at + size] or rows
        at += size
        cells += [sum(sum(p) for row in own for p in row[8 * k : 8 * k + 8]) / len(own) / 8 for k in range(8)]
    mean = sum(cells) / 64
    return " ".join(out) + f" {int(''.join('1' if c > mean else '0' for c in cells), 2):016x}"


def test_media_round_trip(spark, small, odd, odd_rows, rows):
    for frame, expected in ((odd, [r[:2] for r in odd_rows]), (spark.read.parquet(f"{small}/documents.parquet"), rows)):
        got = media_sequences.query(frame).collect()
        facts = lambda r: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, facts(r)) for r in got)) == sorted((i is None, i or 0, media_facts(t)) for i, t in expected)
        by_facts = {media_facts(t): t or "" for _, t in expected}
        for r in got:
            text = by_facts[facts(r)]
            payload = text.encode().ljust(r["payload_bytes"], b" ")
            media = media_sequences.png_of(payload, r["n_bytes"])
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
            assert len(payload) > 20_000 or r["feature"] == plain_feature(payload)
            parts, lines = json.loads(r["sequence"]), text.split("\n")
            runs = -(-len(lines) // 16)
            assert [p["pos"] for p in parts] == list(range(len(parts))) and [p["caption"] for p in parts if p["kind"] == "media"] == [f"{k + 1} of {runs}" for k in range(runs)]
            # A run of lines, if it is not blank, stands before its reference; the heading before all.
            shown = [len(" ".join("\n".join(lines[k * 16 : k * 16 + 16]).split())) for k in range(runs)]
            assert [p.get("chars") for p in parts[1:]] == [x for n in shown for x in ([n] if n else []) + [None]]


def test_media_store_is_lossless(spark):
    texts = ["", "a" * 192, "a" * 193, "trailing  ", "trailing   "]
    stored = media_sequences.media_table(spark.createDataFrame([(t,) for t in [*texts, texts[1]]], "text string")).collect()
    got = sorted((n, s.tobytes()[:n].decode()) for n, s in (media_sequences.read_png(bytes(r["media"])) for r in stored))
    assert got == sorted((len(t), t) for t in texts)
    with pytest.raises(ValueError):
        media_sequences.read_png(bytes(stored[0]["media"])[:-20] + b"x" * 20)


def test_pages_become_interleaved_parts(spark):
    html = (
        "<html><head><title>no</title></head><body><nav>no</nav><p>One &amp; <b>two</b><img src='media:AB' alt='first'>after</p><script>no</script>"
        "<figure><img src='http://x/y.png'><figcaption>shown <i>here</i></figcaption></figure><p></p><img alt='no source'>end"
    )
    parts = media_sequences.parse_page(html)
    assert [p["pos"] for p in parts] == list(range(len(parts)))
    assert [(p["kind"], p["text"] or p["source"], p["digest"], p["caption"]) for p in parts] == [
        ("text", "One & two", None, None), ("media", "media:AB", "ab", "first"), ("text", "after", None, None), ("media", "http://x/y.png", None, "shown here"), ("text", "end", None, None)
    ]
    pages = spark.createDataFrame([(1, html, "k"), (2, None, "k"), (3, "", "k")], "page_id int, html string, parts string")
    media = spark.createDataFrame([("ab", b"123", 3)], "digest string, media binary, n int")
    got = {r["page_id"]: r["parts"] for r in media_sequences.resolve(media_sequences.parse(pages), media).collect()}
    assert [(p["pos"], p["text"], p["caption"], p["media"] and (bytes(p["media"]["media"]), p["media"]["n"])) for p in got[1]] == [
        (0, "One & two", None, None), (1, None, "first", (b"123", 3)), (2, "after", None, None), (3, None, "shown here", None), (4, "end", None, None)
    ]
    assert got[2] == got[3] == []


def test_real_pages_parse_and_resolve(spark, small):
    """The table of raw pages through the same path; their images are in no media table."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    parsed = media_sequences.parse(pages)
    assert parsed.where(F.size("parts") == 0).count() == 0 and "html" not in parsed.columns
    media = spark.createDataFrame([], "digest string, n int")
    got = media_sequences.resolve(parsed, media)
    assert got.columns == parsed.columns and got.count() == pages.count()
    assert got.where(F.exists("parts", lambda p: p["media"].isNotNull())).count() == 0
    assert got.select("page_id", F.transform("parts", lambda p: p.dropFields("media")).alias("parts")).exceptAll(parsed.select("page_id", "parts")).count() == 0


# ---------------------------------------------------------------- BPE


def test_ids_are_those_of_the_rank_library(spark, small, odd, odd_rows, rows, reference):
    for frame, expected in ((odd, [r[:2] for r in odd_rows]), (spark.read.parquet(f"{small}/documents.parquet"), rows)):
        want = []
        for i, t in expected:
            ids = reference.encode_ordinary(t or "")
            want.append((i is None, i or 0, len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(t or "")))
        got = [(r[0] is None, r[0] or 0, *tuple(r)[1:]) for r in byte_bpe.query(frame).collect()]
        assert sorted(got) == sorted(want)


def test_bpe_memory_is_bounded_by_characters(reference, monkeypatch):
    """Long pieces, which few of fill the memory, and a text that is larger than it: equal ids, and no more is held than the bound or the text that was learnt last."""
    monkeypatch.setattr(byte_bpe, "CACHE_CHARS", 3000)
    own = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY))
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice((5, 900, 4000)))) + " and more" for _ in range(60)]
    texts += [" ".join(texts), "", *texts[:9]]
    for text in texts:
        before = set(own.cache)
        ids = own.encode([text])[0]
        assert np.frombuffer(ids, dtype="<u4").tolist() == reference.encode_ordinary(text)
        assert own.held == sum(map(len, own.cache))
        if set(own.cache) != before:  # a text whose pieces are all known changes nothing
            assert own.held <= max(3000, len(text))


def test_long_pieces_and_ids_that_are_texts(spark, reference):
    texts = ["x" * 20_000, " " * 5000, "é" * 3000, "\n" * 4000, "a1" * 3000, "!?" * 3000]
    got = byte_bpe.query(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")).collect()
    for r in got:
        text = texts[int(r["doc_id"][1:])]
        ids = reference.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(text))


def test_offsets_and_split_characters(spark, reference):
    random.seed(3)
    texts = ["aé😀x", "", "日本語 ñandú", "".join(chr(random.choice([97, 32, 10, 0xE9, 0x1F600, 0x4E2D, 0x301, 0x3000])) for _ in range(300))]
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    encoded = byte_bpe.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"), path, offsets=True)
    for r in byte_bpe.decode(encoded, path).collect():
        text = texts[r["k"]]
        assert list(r["ids"]) == reference.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
        for token, a, b in zip(r["ids"], r["starts"], r["stops"]):
            # A token's bytes lie within the characters that its offsets name, and touch the first and last of them.
            assert reference.decode_single_token_bytes(token) in text[a:b].encode() and b > a
        assert not text or (r["starts"][0], r["stops"][-1]) == (0, len(text))


# ---------------------------------------------------------------- lines


def line_rows(odd_rows):
    """Shared lines; a line of ten rows of one id; one of ten rows without an id, of which nine are equal."""
    many = [(100 + i, f"{'Same  ' if i % 2 else ' same'}\nunique {i}\n\nÉcole") for i in range(10)] + [(200, "same\nSAME\nécole"), (201, "same")]
    many += [(300, f"of one id\nrow {i}") for i in range(10)] + [(None, "of none")] * 9 + [(None, "of none\nand more")] + [(None, f"nameless\n{i}") for i in range(10)]
    return [*many, *[r[:2] for r in odd_rows]]


def test_lines(spark, odd_rows):
    rows = line_rows(odd_rows)
    want = [(i is None, i or 0, n, d, brute.sha(k)) for (i, _), (n, d, k) in zip(rows, brute.kept_lines(rows))]
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_lines_of_repeated_rows_equal_sql(spark, odd_rows):
    import duckdb

    rows = line_rows(odd_rows)
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    documents = frame.toArrow()  # noqa: F841  DuckDB reads it by its name
    same_rows(line_dedup.query(frame).toPandas(), con.execute(line_dedup.ORACLE_SQL).df())


@pytest.mark.parametrize("batches, fanout, copies_count", [(1, 2, True), (5, 2, False), (7, 3, True)])
def test_runs_agree_however_they_are_compacted(spark, rows, batches, fanout, copies_count):
    rows = rows + [(f"{i}x", rows[3][1]) for i in range(5)]
    rows = [(str(i), t) for i, t in rows]  # ids of any type
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = line_dedup.dedup_lines(docs, 3, batches=batches, fanout=fanout, copies_count=copies_count)
    want = brute.kept_lines(rows, 3, copies_count)
    assert sorted((r["doc_id"], r["n_dropped"], r["kept"]) for r in got.collect()) == sorted((i, d, k) for (i, _), (_, d, k) in zip(rows, want))


def test_runs_are_neither_shuffled_nor_sorted_again(spark):
    store = line_dedup.RunStore(spark, 3, fanout=9, buckets=4)
    batch = lambda k: spark.createDataFrame([(i, [b"%d" % (i % 7), b"%d %d" % (k, i)]) for i in range(20)], "doc_id long, hashes array<binary>")
    store.add(batch(0))
    store.add(batch(1))
    with store._sorted_scans():
        plan = store.joined(batch(2))._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "FileScan parquet" in line and "Bucketed: true" in line]
    assert len(scans) == 4
    for before, i in zip([scans[0] - 4, *scans], scans):  # joins are left-deep: before a run's scan stands its own branch alone
        branch = [line for line in plan[max(before + 1, i - 3) : i] if "SortMergeJoin" not in line]
        assert not any("Exchange" in line or "Sort " in line for line in branch), branch
    assert len([line for line in plan if "SortMergeJoin" in line]) == 4
    store.finish()


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("n, k", [(1, 3), (60, 2), (500, 3), (2000, 40)])
def test_fm_index(n, k):
    s = np.random.default_rng(n).integers(1, k + 1, n)
    s = np.tile(s[:100], n // 100) if n >= 1000 else s
    text = [*s.tolist(), 0]
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    index = FMIndex(s, 4)
    phrases = np.array([*[s[i : i + 3] for i in range(0, max(0, n - 3), 11)], [k + 5, 1, 1], [1, k + 1, 1], [1, 1, 1]])
    for p, low, high in zip(phrases.tolist(), *index.count(phrases)):
        assert sorted(index.locate(np.arange(low, high)).tolist()) == [i for i in range(n - 2) if text[i : i + 3] == p]


@pytest.mark.parametrize("block_words, shard_words", [(100_000, 1 << 20), (7, 1 << 20), (12, 20)])
def test_spans(spark, odd, odd_rows, block_words, shard_words):
    items = {1: "one two three", 2: "b c d e f g h i j k l m", 3: "...", 4: "two three four", 10: "a", 5: None, 6: ""}
    texts = ["x One-two, THREE four b", "b c d e f g h i j k l m n b c d e f g h i j", "c d e f g h i j k l m", "a a", "b c d e f g h i j z k l m"]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd, allowMissingColumns=True)
    rows = [*[(100 + i, t) for i, t in enumerate(texts)], *[r[:2] for r in odd_rows]]
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontamination.find_spans(docs, benchmark, block_words=block_words, shard_words=shard_words)
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1  # one pass, however many blocks
    got, cut = found.collect(), {}
    for r, c in zip(got, decontamination.cut_spans(found).collect()):
        own, hit, names = brute.spans(r["text"], {k: v for k, v in items.items() if v})
        assert (r["n_words"], r["items"]) == (len(own), names)
        assert {p for s in r["spans"] for p in range(s["start"], s["stop"])} == hit
        assert c["text"] == (brute.cut(r["text"], hit) if hit else r["text"])
    assert len(got) == len(rows) and not cut


def test_long_and_repeated_items_are_parted(spark):
    item = [f"w{i}" for i in range(300)]
    benchmark = spark.createDataFrame([(1, " ".join(item[:200])), (1, " ".join(item[150:]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[95:105])), (3, " ".join(item[95:104]))], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in decontamination.find_spans(docs, benchmark, block_words=20).collect()}
    assert got == {1: [(0, 300)], 2: [(0, 10)], 3: []}


def test_nothing_to_find(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.query(odd, none).where("contaminated or n_items > 0").count() == 0
    assert decontamination.query(empty, none).count() == 0


# ---------------------------------------------------------------- chats


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string, pos string")


def turn(conv, n, text, role="user"):
    return (conv, n, role, text, "own", "own")


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_TURNS", 3)
    long = [turn(1, i, f"t{i}") for i in range(7)]
    snapshots = [turn(k, i + 5, f"t{i}") for k in (2, 3, 4) for i in range(k)]  # other turn numbers, the same turns
    copy = [turn(9, i, f"t{i}") for i in range(7)] + [turn(9, 3, "t3")]  # and a repeated row
    other = [turn(5, 0, "t0"), turn(5, 1, "different"), turn(6, 0, "t0", "assistant"), turn(7, 0, None), turn(8, None, "t0"), turn(8, 0, None), (None, 0, None, None, "", "")]
    # Without an id each row is a conversation: one that others begin with goes, of equal ones one stays.
    other += [turn(None, 0, "t0")] + [turn(None, i, f"alone {i % 3}") for i in range(9)]
    got = chat_format.query(chats(spark, [*long, *snapshots, *copy, *other])).collect()
    assert {(r["conv_id"], r["segment"], r["n_turns"]) for r in got} == {(1, 0, 7), (1, 1, 7), (1, 2, 7), (5, 0, 2), (6, 0, 1), (7, 0, 1), (8, 0, 2), (None, 0, 1)}
    assert sorted(r["text"] for r in got if r["conv_id"] is None) == ["<|user|>\nalone 0\n<|end|>\n", "<|user|>\nalone 1\n<|end|>\n", "<|user|>\nalone 2\n<|end|>\n", "<||>\n\n<|end|>\n"]
    text = {(r["conv_id"], r["segment"]): r["text"] for r in got}
    assert text[1, 0] + text[1, 1] + text[1, 2] == "".join(f"<|user|>\nt{i}\n<|end|>\n" for i in range(7))
    assert text[8, 0] == "<|user|>\nt0\n<|end|>\n<|user|>\n\n<|end|>\n"


def test_chats_of_odd_rows_equal_sql(spark):
    """A conversation of many turns without numbers, one of one number, rows without ids, copies; dealt into many ranges."""
    import duckdb

    rows = [turn(1, None, f"x{i}") for i in range(300)] + [turn(2, 7, f"y{i}") for i in range(300)] + [turn(None, i % 5, f"z{i % 20}") for i in range(400)]
    rows += [turn(3, i, f"t{i}") for i in range(6)] + [turn(4, i, f"t{i}") for i in range(4)] + [turn(5, i, f"t{i}") for i in range(6)] + [turn(6, 0, "z1"), turn(6, 1, "z2")]
    frame = chats(spark, rows)
    conversations = frame.toArrow()  # noqa: F841  DuckDB reads it by its name
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat_format._blocks(frame)
        assert turns.where("conv = 'id 1'").select("block").distinct().count() > 2
        same_rows(chat_format.query(frame).toPandas(), duckdb.connect().execute(chat_format.ORACLE_SQL).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_chats(spark):
    assert chat_format.query(chats(spark, [])).count() == 0


def test_chat_plan_has_no_python(spark, small):
    plan = registry.QUERIES["op4_chat_format"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


@pytest.mark.parametrize("name", ["op1_media_sequences", "op2_byte_bpe", "op10_line_dedup"])
def test_empty_tables(spark, empty, name):
    module = {"op1_media_sequences": media_sequences, "op2_byte_bpe": byte_bpe, "op10_line_dedup": line_dedup}[name]
    assert module.query(empty).count() == 0


def test_word_hashes_do_not_depend_on_their_place():
    words = Words([b"Hello w\xc3\xb6rld, abc", b"x" * 5000 + b" abc HELLO", b"", b"abc!"])
    h = words.hashes()
    assert words.per_text.tolist() == [3, 3, 0, 1] and h[2] == h[4] == h[6] and h[0] == h[5] and len(set(h.tolist())) == 4
    assert words.hashes(4)[0] == Words([b"hell"]).hashes()[0]


def test_decontamination_equals_sql_on_odd_rows(spark, odd_rows):
    """Items without an id are searched and stand in no list; ids that repeat, of documents and of items."""
    import duckdb

    items = [(None, "one two three four five six seven"), ("a", "naïve 😀 text"), ("a", "another text under one id"), ("b", None), (None, ""), (None, None), ("c", "ONE two")]
    # The very long text is left to the brute-force tests: SQL's windows over it are quadratic.
    short = [r for r in odd_rows if len(r[1] or "") < 10_000]
    docs = spark.createDataFrame(short, "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.query(docs, benchmark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", benchmark.toArrow())
    same_rows(got.toPandas(), con.execute(decontamination.ORACLE_SQL).df())
    hit = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in got.where("contaminated").collect()}
    assert {(5, 7, 1), (6, 7, 1), (8, 3, 1), (6, 5, 1)} <= hit
