"""Operators whose results are approximate: recall and held-out accuracy."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strokeloom.llm import neighbours, toxicity
from tests.llm.conftest import rows_of


def brute_neighbours(rows, k=5):
    out = {}
    for q, v in rows:
        if q % 50:
            continue
        a = np.array(v, float)
        scored = sorted({(-float(a @ np.array(w, float)) / float(np.linalg.norm(a) * np.linalg.norm(w)), i) for i, w in rows if i != q})
        out[q] = [i for _, i in scored[:k]]
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=24).astype(np.float32).tolist()) for k in range(1500)]
    valid = neighbours.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    index = neighbours.build_index(valid, least_rows=400)
    assert index.count() >= 3 and index.agg(F.sum("n")).first()[0] == 1500
    found = neighbours.search_index(index, valid.where("vec_id % 50 = 0"), pass_bytes=5 * 24 * 8).toPandas()
    exact = brute_neighbours(rows)
    hits = sum(len(set(exact[q]) & set(g["vec_id"])) for q, g in found.groupby("query_id"))
    assert hits / (5 * len(exact)) >= 0.95
    for _, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and (g["score"].diff().dropna() <= 0).all()


def test_ties_copies_and_invalid_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0]) for k in range(40)] + [(50, [2.0, 0.0]), (51, [0.0, 1.0]), (100, [0.0, 0.0]), (150, None), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (350, []), (400, [1.0, 1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("v", F.lit("x"))
    valid = neighbours.valid_vectors(df)
    found = neighbours.search_index(neighbours.build_index(valid), valid.where("vec_id % 50 = 0"))
    assert rows_of(found, "query_id", "rank", "vec_id") == [(0, r, r) for r in range(1, 6)] + [(50, r, r - 1) for r in range(1, 6)]
    empty = neighbours.valid_vectors(df.limit(0))
    assert neighbours.search_index(neighbours.build_index(empty), empty).count() == 0


def test_query_finds_what_brute_force_finds(spark, sf_dir):
    found = neighbours.op4_nearest_neighbours(spark, sf_dir).toPandas()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    exact, vectors = brute_neighbours(rows), dict(rows)
    assert set(found["query_id"]) == set(exact) and (found.groupby("query_id").size() == 5).all()
    hits = sum(len(set(exact[q]) & set(g["vec_id"])) for q, g in found.groupby("query_id"))
    assert hits / (5 * len(exact)) >= 0.95
    for r in found.itertuples():
        a, b = (np.array(vectors[x], float) for x in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)), rel=1e-14)


def test_cosines_of_huge_and_tiny_vectors():
    a = np.array([[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0]])
    near = np.stack([[[1.0, 1.0], [1e-300, 0.0]]] * 3)
    want = [[1.0, 0.5**0.5], [0.5**0.5, 1.0], [7 / (5 * 2**0.5), 0.6]]
    assert neighbours.cosines(a, near) == pytest.approx(np.array(want))


def test_graph_edges_are_diverse():
    rng = np.random.default_rng(1)
    points = neighbours.unit(rng.normal(size=(300, 8)))
    graph, entry = neighbours.build_graph(points, degree=8, beam=24)
    assert graph.shape == (301, 8) and graph.max() <= 300 and 0 <= entry < 300
    for p in range(300):
        kept = [x for x in graph[p] if x < 300]
        assert p not in kept and len(set(kept)) == len(kept) and kept


def toxic_tables(n=900):
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = rng.choice(names, 60).tolist()
        toxic = k % 6 == 0
        if toxic:
            words[int(rng.integers(0, 60))] = str(rng.choice(["grumbo", "snarfle", "blathe"]))
        rows.append((k, " ".join(words), "en" if k % 2 else "fr"))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = toxic_tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, labels, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(spark, trained):
    docs, labels, model = trained
    scored = toxicity.with_scores(docs, model).withColumn("held", toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).toPandas()
    scored = scored.merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]), on="doc_id")
    held = scored[scored["held"]]
    assert len(held) > 100 and ((held["_score"] >= 0.5) == held["toxic"].astype(bool)).mean() > 0.95


def test_scores_of_awkward_texts(docs_of, awkward, trained):
    model = trained[2]
    scored = toxicity.with_scores(docs_of(awkward, True), model).toPandas()
    assert len(scored) == len(awkward) and scored["_score"].between(0, 1).all()
    scorer = toxicity.Scorer(model)
    texts = [t for _, t in awkward]
    alone = [toxicity.Scorer(model).scores([t])[0] for t in texts]
    assert scorer.scores(texts) == pytest.approx(alone) and scorer.scores(texts) == pytest.approx(alone)


def test_long_texts_in_blocks(trained, monkeypatch):
    text = " ".join(f"w{k % 300}" for k in range(1000)) + " grumbo tail"
    whole = toxicity.Scorer(trained[2]).scores([text, "w1"])
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    monkeypatch.setattr(toxicity, "KNOWN", 10)
    assert toxicity.Scorer(trained[2]).scores([text, "w1"]) == pytest.approx(whole)


def test_labels_of_one_class_or_none(spark, docs_of, awkward):
    docs = docs_of(awkward, True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    nulls = spark.createDataFrame([(1, None), (None, 1), (4, 0), (5, 0), (6, 0)], "doc_id long, toxic int")
    for labels in (none, nulls):
        model = toxicity.train(docs, labels)
        assert {r._score for r in toxicity.with_scores(docs, model).collect()} == {0.0}


def test_fit_takes_more_than_6000_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, labels, langs: seen.append(len(sample.ends)))
    ids = spark.range(9000).withColumnRenamed("id", "doc_id")
    toxicity.train(ids.selectExpr("doc_id", "'some text' as text", "'en' as lang"), ids.selectExpr("doc_id", "doc_id % 2 as toxic"))
    assert seen == [ids.where(toxicity.fold(ids.doc_id) != toxicity.HELD_OUT).count()] and seen[0] > 6000 and toxicity.EPOCHS == 5


def plain_score(model, text):
    """The classifier word by word, window by window."""
    words, f = toxicity.words_of(text), toxicity.FILTERS
    vectors = [np.mean([model.table[x] for x in toxicity.rows_of(w)], axis=0) for w in words]
    vectors += [np.zeros(toxicity.DIM)] * (2 if words else 3)
    logit, column = model.offset, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for j in range(f):
            weights = [model.filters[:, column + step * f + j] for step in range(width)]
            top = max(sum(float(v @ w) for v, w in zip(vectors[i:], weights, strict=False)) for i in range(max(1, len(words))))
            logit += max(0.0, top + model.bias[k * f + j]) * model.out[k * f + j]
        column += width * f
    return 1 / (1 + np.exp(-(model.scale * logit + model.shift)))


def test_scores_equal_a_plain_forward_pass(trained, awkward):
    texts = [t for _, t in awkward if not t or len(t) < 3000] + [r.text for r in trained[0].limit(40).collect()] + ["a", "a b", "a b c"]
    assert toxicity.Scorer(trained[2]).scores(texts) == pytest.approx([plain_score(trained[2], t) for t in texts], abs=1e-4)


def test_pooled_of_the_fit_is_that_of_the_scorer(trained, monkeypatch):
    model, texts = trained[2], ["w1 w2 grumbo w3 w1", None, "", "w7", "w7 w8 " + " ".join(f"w{k}" for k in range(90))]
    maker = toxicity.SampleMaker()
    for t in texts:
        maker.add(t)
    sample, want = maker.made(), toxicity.Scorer(model).logits(texts)
    for block in (toxicity.BLOCK, 7):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        pooled = toxicity._pooled(model, sample, np.arange(5))[0]
        assert pooled @ model.out + model.offset == pytest.approx(want, abs=1e-4)


def test_sample_is_bounded_in_bytes_and_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, labels, langs: seen.append((len(sample.ends), len(sample.ids))))
    ids = spark.range(300).withColumnRenamed("id", "doc_id")
    docs = ids.selectExpr("doc_id", "if(doc_id = 7, repeat('long ', 1000), 'four words of text') as text", "'en' as lang")
    labels = ids.selectExpr("doc_id", "doc_id % 2 as toxic")
    toxicity.train(docs, labels, max_train=50)
    toxicity.train(docs, labels, max_bytes=18 * 60)
    assert seen == [(50, 49 * 4 + 1000), (60, 240)]  # the long text is no part of the small sample


def test_toxicity_query(spark, sf_dir):
    rows = toxicity.op7_toxicity(spark, sf_dir).toPandas()
    docs, labels = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"]) and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert rows["held_out"].tolist() == [zlib.crc32(str(k).encode()) % 5 == 0 for k in rows["doc_id"]]
    again = toxicity.op7_toxicity(spark, sf_dir).toPandas().set_index("doc_id")["score"]
    assert (again[rows["doc_id"]].to_numpy() == rows["score"].to_numpy()).all()
    assert toxicity.with_scores(spark.createDataFrame([], "doc_id long, text string"), toxicity.fit(toxicity.SampleMaker().made(), [], [])).count() == 0
    assert labels["toxic"].sum() > 0
