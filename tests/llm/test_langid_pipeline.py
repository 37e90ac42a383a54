"""Language ID by held-out accuracy and by its own algebra; the pipeline by its stages."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import langid

from .helpers import awkward, documents, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")), sample=100)
    rows = langid.predict(docs, model).withColumn("h", langid.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in rows if r.h} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    held = [r for r in rows if r.h]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    shuffled = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 7})
    assert sorted((r.lang_pred, r.score) for r in langid.predict(shuffled, model).collect()) == sorted((r.lang_pred, r.score) for r in rows)


def test_awkward_rows(spark):
    train = documents(spark, [(i, t, lang) for i in range(40) for t, lang in (("the house of the bird", "en"), ("das haus und der vogel", "de"))])
    model = langid.train(train, F.lit(True))
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(awkward(spark), model).collect()}
    assert got[2, None] == got[3, ""] == got[4, " \t\n"] == got[14, "12 34 !!"] == ("und", 0.0)
    assert all(v[0] in ("en", "de") for k, v in got.items() if k[1] and any(map(str.isalpha, k[1])))
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.train(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(train, None).collect()} == {"und"}
    again = langid.train(train.repartition(7), F.lit(True))
    assert np.array_equal(again.weights, model.weights)


def test_code_switched_words(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in (("the thing of their other whether with", "en"), ("der nicht und auch eine schön mich", "de"))]
    model = langid.train(documents(spark, rows), F.lit(True))
    labels = langid.label_words(["the other whether nicht auch eine with their"], model)[0]
    assert [x for _, x, _ in labels] == ["en", "en", "en", "de", "de", "de", "en", "en"]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    moves, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    chains = [rng.normal(size=(n, 3)) for n in (4, 3, 3, 1)]
    flat = np.concatenate([np.stack([c[t] for c in chains if len(c) > t]) for t in range(4)])
    got = langid.marginals(flat, np.array([len(c) for c in chains]), moves, first)
    at = 0
    for t in range(4):
        for c in (c for c in chains if len(c) > t):
            weight = np.zeros(3)
            for y in itertools.product(range(3), repeat=len(c)):
                s = first[y[0]] + sum(c[i][y[i]] for i in range(len(c))) + sum(moves[a, b] for a, b in zip(y, y[1:]))
                weight[y[t]] += np.exp(s)
            assert np.allclose(got[at], weight / weight.sum())
            at += 1


def test_gradient_of_transitions():
    """Expected transitions are the derivative of the log-partition function."""
    rng = np.random.default_rng(2)
    size, n = 3, 2
    scores = rng.normal(size=(langid.SEQUENCE * n, size))
    model = langid.Model(list("abc"), np.zeros((1, size)), rng.normal(size=(size, size)), rng.normal(size=size))

    def partition(moves):
        total = 0.0
        for c in range(n):
            a = model.first + scores[c]
            for t in range(1, langid.SEQUENCE):
                a = np.logaddexp.reduce(a[:, None] + moves, axis=0) + scores[t * n + c]
            total += np.logaddexp.reduce(a)
        return total

    post = langid.marginals(scores, np.full(n, langid.SEQUENCE), model.moves, model.first)
    got = langid._expected(scores, post, n, model)
    for i in range(size):
        for j in range(size):
            step = np.zeros((size, size))
            step[i, j] = 1e-5
            assert abs((partition(model.moves + step) - partition(model.moves - step)) / 2e-5 - got[i, j]) < 1e-4


def test_words_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(langid, "CACHE", 5)
    model = langid.fit([("en", ["the", "bird"]), ("de", ["der", "vogel"])] * 30)
    labeller = langid.Labeller(model)
    texts = ["the bird " * 3, " ".join(f"the{i}" for i in range(30)), "der vogel"]
    one = [next(iter(langid.Labeller(model).label([t]))) for t in texts]
    assert list(labeller.label(texts)) == one


def test_long_chains_in_pieces(monkeypatch):
    """Messages are carried over the cuts: pieces change no marginal."""
    rng = np.random.default_rng(4)
    model = langid.Model(list("abc"), np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    texts = [rng.normal(size=(n, 3)) for n in (40, 1, 0, 17, 8)]
    whole = langid.Labeller(model).posteriors(texts)
    monkeypatch.setattr(langid, "CHAIN", 8)
    for a, b in zip(whole, langid.Labeller(model).posteriors(texts)):
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-12)


def test_many_labels(spark):
    docs = documents(spark, [(i, f"w{i % 230}q v{i % 230}q", f"l{i % 230:03}") for i in range(460)])
    model = langid.train(docs, F.lit(True))
    assert len(model.labels) == 230
    found = langid.predict(docs.limit(40), model).collect()
    assert all(r.lang_pred in model.labels and 0 <= r.score <= 1 for r in found)


def test_no_language(spark):
    """Texts that share their words out over the languages go, clean ones stay."""
    import corpus_pipeline as pipeline

    words = {"en": "the house of every bird with their", "de": "das haus und jeder vogel mit ihren", "fr": "la maison avec leurs oiseaux et toujours", "es": "una casa con los pajaros y siempre"}
    rows = [(i, t, lang) for i in range(1, 90) for lang, t in words.items()]
    mixture = " ".join(w for four in zip(*(t.split() for t in words.values())) for w in four)
    docs = documents(spark, [*rows, (1000, mixture, None), (1001, "12 34", "en"), (1002, None, "en"), (1003, words["fr"] + " " + words["fr"], None)])
    kept = {r.doc_id for r in pipeline.language(spark, docs, "").collect()}
    assert kept >= set(range(1, 90)) | {1003} and not kept & {1001, 1002}


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    counts = [held.count()]
    for name, stage in pipeline.STAGES:
        held = pipeline.scratch.materialise(stage(spark, held, SF), "test")
        counts.append(held.count())
        if name != pipeline.STAGES[-1][0]:
            assert held.columns == pipeline.COLUMNS
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
    assert counts[1] > 0.95 * counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(held.columns)


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline as pipeline

    for docs in (awkward(spark), empty(spark)):
        held = docs
        for _, stage in pipeline.STAGES:
            held = pipeline.scratch.materialise(stage(spark, held, SF), "test")
        assert held.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
        got = [(r.doc_id, r.piece, r.start) for r in held.collect()]
        if docs.isEmpty():
            assert got == []
        else:
            ids = {d for d, _, _ in got}
            assert ids <= {r.doc_id for r in docs.collect()} and not ids & {2, 3, 4, 14} and {p for _, p, _ in got} >= {0}


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.near_duplicates(spark, docs, SF).collect()
    texts = {r.text for r in kept}
    assert len(texts) == len(kept)  # no exact copies
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    sets = [shingles(r.text) for r in kept]
    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = {}
    for own in index.values():
        for a, b in itertools.combinations(own, 2):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    close = [p for p, n in pairs.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8]
    assert not close
    everything = {r.doc_id: shingles(r.text) for r in docs.collect()}
    keep = {r.doc_id for r in kept}
    for d in set(everything) - keep:  # whoever went has a similar text
        assert max(len(everything[d] & o) / len(everything[d] | o) for e, o in everything.items() if e != d) >= 0.8
