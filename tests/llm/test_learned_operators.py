"""Near duplicates, class n-grams, language ID, quality, toxicity and the pipeline."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwell.llm import class_ngrams, language_id, ngram_join, quality, toxicity
from loomwell.llm.common import is_training, stored


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def more(spark):
    """A larger table, for models."""
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


# ---------------------------------------------------------------- n-gram join


def near_copies(n, size=60, seed=5):
    """A group of near copies of one text, another of exact copies, and texts of their own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    rows = []
    for i in range(n):
        own = list(base)
        own[rng.randrange(size)] = f"changed{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "Exact copies, of one text! with seven words") for i in range(7)] + [(1100, "exact copies of one text with SEVEN words")]
    return rows + [(2000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(20))) for i in range(10)]


@pytest.mark.parametrize("block_docs", [2048, 6])
def test_links_and_groups(spark, monkeypatch, documents, block_docs):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block_docs)
    rows = near_copies(40) + [(10_000 + r["doc_id"], r["text"]) for r in documents.collect()]
    links, groups = brute.linked(dict(rows))
    got = ngram_join.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == {i: (links[i], groups[i]) for i, _ in rows} and len(got) == len(rows)


def test_odd_rows_join(spark, odd, odd_rows, empty):
    got = sorted((tuple(r) for r in ngram_join.query(odd).collect()), key=str)
    assert len(got) == len(odd_rows)
    by_id = {r[0]: r[1:] for r in got}
    # Rows 5 come three times, and row 6 has the same words.
    assert by_id[5] == (5, 5, 3) and (6, 5, 5, 3) in got and (6, 6, 6, 0) in got and by_id[0] == (0, 0, 1) and by_id[1] == (0, 0, 1) and by_id[3] == (3, 3, 0) and by_id[None] == (None, None, 0)
    assert ngram_join.query(empty).count() == 0


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.999), (0.5, 0.95), (0.95, 0.9999)])
def test_banding_reaches_its_recall(threshold, recall):
    bands, rows = ngram_join.banding(threshold, recall)
    assert bands <= ngram_join.MAX_BANDS and 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(600, 640)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_keep_their_links(spark):
    """Two texts under one id, each with a near copy of its own; ids may be texts."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [("1", one), ("1", two), ("2", f"{one} more"), ("3", f"{two} more"), ("4", "something else"), ("1", two)]
    got = sorted(tuple(r) for r in ngram_join.query(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("1", "1", "1", 1), ("1", "1", "1", 2), ("1", "1", "1", 2), ("2", "1", "2", 1), ("3", "1", "3", 2), ("4", "4", "4", 0)]


def test_set_overlaps():
    rng = np.random.default_rng(0)
    made = []
    for n in (17, 5):
        sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(n)]
        made.append((sets, ngram_join.Block(np.arange(n), np.ones(n, dtype=np.int64), np.zeros((n, 1)), sets)))
    for (left, a), (right, b) in ((made[0], made[0]), (made[0], made[1])):
        b = ngram_join.Block.unpack(b.pack()) if a is not b else b
        for budget in (1, 1 << 25):
            for i, sizes in enumerate(ngram_join.overlaps(a, b, budget)):
                assert [x for j, x in enumerate(sizes.tolist()) if a is not b or i != j] == [len(np.intersect1d(left[i], s)) for j, s in enumerate(right) if a is not b or i != j]


# ---------------------------------------------------------------- class n-grams


def test_base_scores(spark, documents, odd, odd_rows):
    rows = [*((r["doc_id"] + 100, r["text"]) for r in documents.collect()), *(r[:2] for r in odd_rows)]
    want, n = brute.base_scores(rows)
    got = class_ngrams.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda i, r: (i is None, i or 0, r[0], round(r[2], 6))
    got = sorted(key(r["doc_id"], (r["n_tokens"], 0, r["base_score"])) + (r["n_known"], r["train_tokens"]) for r in got)
    want = sorted(key(i, w) + (w[1], n) for (i, _), w in zip(rows, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4:] == b[4:] and math.isclose(a[3], b[3], abs_tol=1e-5)


def test_model_beats_the_base_and_sums_to_one(spark, more):
    docs, _ = more
    got = class_ngrams.query(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    training = docs.where(is_training(F.col("doc_id"), 10, 0))
    counts = stored(class_ngrams.word_counts(training))
    model = class_ngrams.vocabulary(counts, head_words=500)
    encoded = stored(class_ngrams.encode(training.select("doc_id", "text"), model))
    class_ngrams.learn(model, encoded, exchange_words=80, classes=9)
    assert np.allclose((10.0**model.log_next).sum(axis=1), 1)
    emitted = np.bincount(model.classes[model.state], 10.0**model.log_emit, model.log_next.shape[0])
    assert np.allclose(emitted[2:], 1)
    assert 0 < model.discount < 1 and len(model.index) <= 500
    # The tail: what known words keep and the unknown one gets.
    n = counts.where((F.col("word") != class_ngrams.END) & (class_ngrams._bin(F.col("n")) < model.head_from)).agg(F.sum(F.col("n") - model.discount)).first()[0]
    assert math.isclose(n / model.tail_total + model.discount * model.tail_words / model.tail_total, 1)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    true = rng.integers(0, 4, 60)
    after = rng.dirichlet(np.ones(4) * 0.3, 4)
    counts = rng.poisson(20 * after[true][:, true]).astype(float)

    def likelihood(of):
        one = np.zeros((60, 4))
        one[np.arange(60), of] = 1
        c = one.T @ counts @ one
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0).sum()
        return f(c) - f(c.sum(axis=0)) - f(c.sum(axis=1))

    of = class_ngrams.exchange(counts, 4)
    assert likelihood(of) >= likelihood(true) - 1e-6
    for w in range(60):
        for k in range(4):
            other = of.copy()
            other[w] = k
            assert likelihood(other) <= likelihood(of) + 1e-6


def test_words_beyond_the_commonest_get_classes_by_what_surrounds_them(spark, monkeypatch):
    """Two kinds of words in turn, of equal counts: all of a kind share classes, not only the few that are clustered first."""
    monkeypatch.setattr(class_ngrams, "HELD_KEYS", 500)
    rng = random.Random(3)
    kinds = [[f"{kind}{i}" for i in range(150)] for kind in ("noun", "verb")]
    rows = [(i, " ".join(rng.choice(kinds[j % 2]) for j in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = class_ngrams.vocabulary(stored(class_ngrams.word_counts(docs)))
    class_ngrams.learn(model, stored(class_ngrams.encode(docs, model)), exchange_words=20, classes=2)
    assert len(model.index) == 300 and model.n_states == 4
    of = [set(model.states(model.index.find([w.encode() for w in kind])).tolist()) for kind in kinds]
    assert sorted(map(len, of)) == [1, 1] and not of[0] & of[1] and not {0, 1} & (of[0] | of[1])
    assert np.allclose(np.bincount(model.state, 10.0**model.log_emit, 4)[2:], 1)


def test_every_round_is_likelier(spark, more):
    docs = more[0].select("doc_id", "text").limit(300)
    counts = stored(class_ngrams.word_counts(docs))
    model = class_ngrams.vocabulary(counts)
    encoded = stored(class_ngrams.encode(docs, model))
    found = []
    for rounds in (1, 2, 3, 4):
        class_ngrams.learn(model, encoded, exchange_words=100, classes=8, rounds=rounds)
        found.append(class_ngrams.likelihood(class_ngrams.state_bigrams(encoded, model)))
    assert found == sorted(found) and found[1] > found[0]


def test_scores_equal_brute_force(spark, documents, odd_rows):
    rows = [*((r["doc_id"] + 100, r["text"]) for r in documents.collect()), *(r[:2] for r in odd_rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = stored(class_ngrams.word_counts(docs))
    model = class_ngrams.vocabulary(counts)
    encoded = stored(class_ngrams.encode(docs, model))
    class_ngrams.learn(model, encoded, exchange_words=50, classes=6)
    known = [r["word"] for r in counts.where("n >= 4").collect() if r["word"] != class_ngrams.END]
    classes = dict(zip(known, model.states(model.index.find([w.encode() for w in known])).tolist()))
    assert len(known) == len(model.index) and not {0, 1} & set(classes.values())
    got = [r["score"] for r in class_ngrams.score(encoded, counts, model).orderBy("doc_id", "n_tokens", "score").collect()]
    want = brute.class_scores(rows, classes)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, len((rows[i][1] or "").split()), want[i]))
    assert np.allclose(got, [want[i] for i in order], rtol=1e-9, atol=1e-6)


def test_nothing_to_score(spark, empty):
    assert class_ngrams.query(empty).count() == 0
    untrained = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {(r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in class_ngrams.query(untrained).collect()} == {(3, 0, 0.0, 0.0, 0), (1, 0, 0.0, 0.0, 0)}


# ---------------------------------------------------------------- language


def test_languages(spark, more):
    docs, _ = more
    got = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.98
    assert sum(r["rejected"] for r in got) / len(got) < 0.02 and all(0 <= r["score"] <= 1 for r in got)


def test_languages_equal_brute_force(spark, documents, odd_rows):
    rows = [*((r["doc_id"] + 100, r["text"]) for r in documents.collect()), *(r[:2] for r in odd_rows), (900, "Haus"), (901, "é" * 5000)]
    dictionaries = language_id.learn(documents, is_training(F.col("doc_id"), 4, 2))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), dictionaries).collect()
    assert len(got) == len(rows)
    for r in got:
        name, margin = brute.language(r["text"], dictionaries)
        assert (r["lang_pred"], r["rejected"]) == (name, name == "und" or margin <= 0 or margin < language_id.MIN_MARGIN)
        assert math.isclose(r["margin"], margin)


def test_odd_rows_language(spark, odd, empty):
    judged = language_id.query(odd).collect()
    assert {r["lang_pred"] for r in judged} <= {"en", "de", "und"}
    assert [r["rejected"] for r in judged if r["doc_id"] in (0, 1, 3, 7)] == [True] * 4
    assert language_id.query(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_dictionaries_are_bounded(more):
    learnt = language_id.learn(more[0], is_training(F.col("doc_id"), 4, 2), sample_docs=5, dictionary_bytes=4000)
    assert set(learnt) == {"de", "en", "es", "fr"} and all(0 < len(d) <= 4000 for d in learnt.values())


def test_languages_of_long_texts_are_learnt(spark):
    """A language that has nothing but long texts; one whose rows all share an id; a text with letters in one place only."""
    words = {"xx": "drommen vinterhav fjell", "yy": "kalamo senpila hundo"}
    rows = [(i, " ".join(f"{w}{'abcdefgh'[j % 8]}" for j in range(900) for w in words["xx"].split()), "xx") for i in range(40)]
    rows += [(7, f"{words['yy']} {'pqrs'[i % 4]}", "yy") for i in range(3000)] + [(9, "1 " * 20_000 + "zzz" + " 1" * 20_000, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language_id.learn(docs, F.lit(True))
    assert set(learnt) == {"xx", "yy", "zz"} and all(learnt.values()) and b"vinterhav" in learnt["xx"] and b"zzz" in learnt["zz"]
    assert max(map(len, learnt.values())) <= language_id.DICTIONARY_BYTES
    judge = language_id.Judge(learnt)
    assert [judge(t)[0] for t in words.values()] == ["xx", "yy"]


def test_more_languages_than_a_block_holds(spark):
    rows = [(i, f"{chr(97 + i // 26) * 3}{chr(97 + i % 26) * 3} wort", f"l{i}") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language_id.learn(docs, F.lit(True))
    assert set(learnt) == {r[2] for r in rows}
    texts = [r[1] for r in rows[::90]]
    assert language_id.Judge(learnt, block=100).judge(texts) == language_id.Judge(learnt, block=1000).judge(texts)
    assert language_id.identify(docs.limit(5), learnt).count() == 5


# ---------------------------------------------------------------- quality, toxicity


@pytest.mark.parametrize("module, target, least", [(quality, "quality", 0.98), (toxicity, "toxic", 0.96)])
def test_held_out_rows_are_told_apart(spark, module, target, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = module.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert brute.auc([r["score"] for r in got], [r[target] for r in got]) > least
    assert sum(r["predicted"] == r[target] for r in got) / len(got) > 0.96


@pytest.mark.parametrize("module, target", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_scores(spark, odd, empty, odd_rows, module, target):
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, None), (None, 1), (99, 1), (0, 1), (9, 0), (9, 1)], f"doc_id long, {target} int")
    got = module.query(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert module.query(empty, labels).count() == 0
    assert module.query(odd, labels.limit(0)).count() == len(odd_rows)


def test_one_risk_term_is_never_negative():
    """With a prior that is too high the unlabelled risk would fall below zero; the fit stays finite and ordered."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 4)), rng.normal(-1, 1, (300, 4))
    web = np.concatenate([good[:150], bad[:150]])
    model = quality.Model(4, 8).fit(good, web, 0.5, steps=400)
    assert brute.auc(model.logit(np.concatenate([good, bad])), [1] * 300 + [0] * 300) > 0.95
    assert np.isfinite(quality.Model(4, 8).fit(good[:5], web, 0.95, steps=400).logit(web)).all()


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_and_fit_without_bad_rows_equal_a_fit_with_them(share):
    """The estimated prior is near the true share, and the classes those of plain logistic regression on true labels."""
    rng = np.random.default_rng(1)
    n = 3000
    is_good = rng.random(n) < share
    web = np.where(is_good[:, None], rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (n, 4)))
    trusted = rng.normal(1.5, 1, (1000, 4))
    prior = quality.estimate_prior(trusted, web)
    assert abs(prior - share) < 0.06
    model = quality.Model(4, 8).fit(trusted, web, prior)
    w, c = np.zeros(4), 0.0
    for _ in range(500):
        slope = 1 / (1 + np.exp(-(web @ w + c))) - is_good
        w, c = w - 0.5 * web.T @ slope / n, c - 0.5 * slope.mean()
    assert np.mean((model.logit(web) > 0) == (web @ w + c > 0)) > 0.97


def test_quality_reads_no_label_of_bad_rows(more):
    docs, labels = more
    got = {r["doc_id"]: r for r in quality.query(docs.drop("lang"), labels).collect()}
    other = {r["doc_id"]: r for r in quality.query(docs, labels.where("quality = 1")).collect()}
    assert got == other
    truth = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.where("quality is not null").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in truth) / len(truth) >= 0.94


def hashed(text):
    return toxicity.rows_of(toxicity.Words([text.encode()]))


def test_word_order_is_told_by_wide_filters_alone(monkeypatch):
    def texts(seed, n):
        rng, out = random.Random(seed), []
        for i in range(n):
            words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(6, 20))]
            at = rng.randrange(len(words))
            words[at:at] = ["you", "worthless"] if i % 2 else ["worthless", "you"]
            out.append(" ".join(words))
        return out, np.arange(n) % 2

    (seen, y), (unseen, truth) = texts(0, 2500), texts(1, 400)
    found = {}
    for widths in ((1, 2, 3), (1,)):
        monkeypatch.setattr(toxicity, "WIDTHS", widths)
        network = toxicity.Network().fit([hashed(t) for t in seen], y, [None] * len(seen))
        found[widths] = brute.auc(network([t.encode() for t in unseen])[0], truth)
    assert found[1, 2, 3] > 0.95 and found[1,] < 0.6


def test_scores_and_slopes_of_the_network_are_those_of_a_loop_over_words():
    network = toxicity.Network(1)
    network.table = network.table.astype(np.float64) * 8
    network.bias, network.out, network.out_bias = [b.astype(np.float64) + 0.1 for b in network.bias], network.out.astype(np.float64), network.out_bias.astype(np.float64)
    network.filters = [f.astype(np.float64) for f in network.filters]
    texts = ["one two three four", "", "five", "six seven one one two nine"]
    rows = [hashed(t) for t in texts]
    batch = toxicity.Batch(np.concatenate(rows), np.array([len(r) for r in rows]))

    def loop():
        out = []
        for own in rows:
            v = np.concatenate([network.table[own].sum(axis=1), np.zeros((6, 8))])  # blanks behind the last word
            total = network.out_bias[0]
            for k, w in enumerate(toxicity.WIDTHS):
                for j in range(toxicity.FILTERS):
                    best = max(sum(v[p + i] @ network.filters[k][i][:, j] for i in range(w)) for p in range(len(own) + 3))
                    total += max(0, best + network.bias[k][j]) * network.out[k * toxicity.FILTERS + j]
            out.append(total)
        return np.array(out)

    assert np.allclose(network.logit(batch), loop(), atol=1e-4)
    y, weight = np.array([1, 0, 0, 1]), np.array([2.0, 1.0, 1.0, 2.0])
    loss = lambda: float((weight * (np.logaddexp(0, loop()) - y * loop())).mean())

    def numeric(flat, i):
        before = flat[i]
        flat[i] = before + 1e-5
        up = loss()
        flat[i] = before - 1e-5
        down = loss()
        flat[i] = before
        return (up - down) / 2e-5

    dense, d_own = network.gradients(batch, y, weight)
    for array, slope in zip([*network.filters, *network.bias, network.out, network.out_bias], dense):
        for i in range(0, array.size, 7):
            assert math.isclose(numeric(array.reshape(-1), i), slope.reshape(-1)[i], rel_tol=1e-3, abs_tol=1e-4)
    by_row = np.zeros_like(network.table)  # of the table, from those of the words' vectors
    np.add.at(by_row, batch.rows.ravel(), np.repeat(d_own, batch.rows.shape[1], axis=0))
    for at in batch.rows[:, -1].tolist():
        assert math.isclose(numeric(network.table[at], 2), by_row[at, 2], rel_tol=1e-3, abs_tol=1e-4)


def test_the_sample_is_bounded_in_characters_and_loses_no_row(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, rows, labels, langs: drawn.append(sorted(len(r) for r in rows)) or self)
    docs = spark.createDataFrame([(i, "wort " * 100, "de") for i in range(50)] + [(99, "long " * 20_000, "en"), (98, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(50), 98, 99]], "doc_id long, toxic int")
    # All as they are; the long text alone is cut; so are all others, to one length.
    for limit, longest, others in ((10**7, 20_000, 100), (30_000, 1000, 100), (5100, 20, 20)):
        toxicity.learn(docs, labels, F.lit(True), sample_chars=limit)
        assert len(drawn[-1]) == 52 and drawn[-1][0] == 0
        assert abs(drawn[-1][-1] - longest) <= 1 and all(abs(n - others) <= 1 for n in drawn[-1][1:-1])


def test_one_long_text_leaves_the_classifier_as_good(spark):
    """A labelled text of more characters than the sample may have, first in the order of draws or not."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = docs.join(labels.where("toxic is not null"), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").select("doc_id", "text", "toxic")
    many = F.expr("repeat('viele normale Worte ohne Belang ', 60000)")
    first = labels.where("toxic = 0 and crc32(cast(doc_id as string)) % 4 <> 2").orderBy(F.expr("pmod(xxhash64(doc_id, 1), 1 << 30)")).first()["doc_id"]
    auc = []
    for rows in (docs, docs.withColumn("text", F.when(F.col("doc_id") == first, many).otherwise(F.col("text")))):
        network = toxicity.learn(rows, labels, is_training(F.col("doc_id"), 4, 2), sample_chars=1 << 20)
        got = toxicity.score(held, network).select("score", "toxic").toPandas()
        bad, good = got[got["toxic"] == 1]["score"].to_numpy(), got[got["toxic"] == 0]["score"].to_numpy()
        auc.append(((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2))
    assert auc[1] > auc[0] - 0.03


def test_fair_length():
    for sizes, total, want in (([5, 1, 9], 15, 9), ([5, 1, 9], 10, 4), ([7], 3, 3), ([2, 2, 2], 3, 1), ([0, 0], 5, 0), ([1, 100, 100], 101, 50)):
        assert toxicity.fair_length(np.array(sizes), total) == want


def test_languages_are_guessed_by_words_of_the_sample():
    texts = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("", "fr"), ("le chien", None)]
    known = toxicity.Languages([hashed(t) for t, _ in texts], [x for _, x in texts])
    words = toxicity.Words([b"the cat", b"die katze", b"", b"zzz"])
    assert known.names == ["de", "en"] and len(known.gain) == 5 + 4
    got = known.guess(toxicity.rows_of(words), words.text_of, words.per_text)
    assert got[:3] == ["en", "de", None] and got[3] in ("de", "en")


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force(spark, small, documents):
    """Only the dictionaries are the operator's own: what they decide is worked out anew."""
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    dictionaries = language_id.learn(documents, is_training(F.col("doc_id"), 4, 2))
    texts = {i: t for i, t in docs.items() if (v := brute.language(t, dictionaries))[0] != "und" and v[1] > 0 and v[1] >= language_id.MIN_MARGIN}
    links, groups = brute.linked(texts)
    near = {i: groups[i] for i in texts if links[i]}
    texts = {i: k for i, (_, _, k) in zip(texts, brute.kept_lines(list(texts.items()), copies_count=False, groups=near))}
    _, groups = brute.linked(texts)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    left = {}
    for i, t in texts.items():
        own, hit, _ = brute.spans(t, items)
        if not hit or len(hit) < len(own):
            left[i] = brute.cut(t, hit) if hit else t
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: brute.sha(t) for i, t in left.items()}


def test_stages_keep_columns_and_take_odd_rows(spark, small, odd, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd.select(*columns, "score", "kept"), empty.select(*columns)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, small))
            assert docs.columns == start.columns, name
            assert docs.where("n_chars > 0 and n_chars <> length(text)").count() == 0
            assert "score" not in docs.columns or docs.where("score <> 'own' or kept <> 'own'").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_lines_that_many_documents_share_go_but_their_documents_stay(spark, small):
    rows = [(i, f"shared line\nbody of document {i}", "en", "s", 30) for i in range(12)] + [(50, "shared line", "en", "s", 11), (51, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, small).collect()}
    assert got == {i: f"body of document {i}" for i in range(12)} | {50: "", 51: ""}


def test_one_full_near_copy_of_an_article_survives(spark, small):
    """Ten copies, each with a footer of its own: their lines count once, so that the next stage finds them whole."""
    article = "\n\n".join(f"Paragraph {i} of an article that many sites repeat in full, word {i * 7} for word." for i in range(30))
    rows = [(i, f"{article}\nfooter of site number {i}", "en", "s", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = stored(corpus_pipeline.dedup_lines(spark, docs, small))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {r[0]: r[1] for r in rows}
    assert [r["text"] for r in corpus_pipeline.dedup_documents(spark, lines, small).collect()] == [rows[0][1]]


def test_a_local_session_without_shared_folder(spark, monkeypatch):
    """The setting cannot be changed in a running session: the library keeps a folder of its own."""
    from loomwell.llm import common

    conf = spark.conf
    monkeypatch.setattr(type(conf), "get", lambda self, key, *default: None if key == "spark.checkpoint.dir" else conf._jconf.get(key, *default))
    assert stored(spark.range(3)).count() == 3
    assert common._own_dir and common.shared_dir(spark).startswith(common._own_dir)


def test_one_full_copy_of_a_repeated_article_survives(spark, small):
    article = "\n\n".join(f"Paragraph {i} of an article that many sites repeat in full, word {i * 7} for word." for i in range(30))
    rows = [(i, article if i % 2 else f"{article}  ", "en", "s", 0) for i in range(10)] + [(20 + i, f"A footer on many pages\npage {i} itself", "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.dedup_lines(spark, docs, small)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_documents(spark, stored(lines), small).collect()}
    assert [i for i in got if i < 20] == [0] and got[0].rstrip() == article
    assert {t for i, t in got.items() if i >= 20} == {f"page {i} itself" for i in range(12)}
