"""The pipeline's stages, each on its own input."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from strokeloom.llm import jaccard
from tests.llm import brute
from tests.llm.conftest import SENTENCE

STAGE = dict(corpus_pipeline.STAGES)


def test_stages_on_awkward_rows(spark, docs_of, awkward, sf_dir):
    docs = docs_of([(i, t) for i, t in awkward] * 2, True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    odd = docs.withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.col("doc_id")), "v": F.parse_json(F.lit('{"x": [1, null]}')), "b`t": F.array(F.lit("q")), "_h1": F.lit("h"), "_rest": F.lit(2), "_w1": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert [c for c in out.columns if c not in corpus_pipeline.ADDED] == [c for c in odd.columns if c not in corpus_pipeline.ADDED], name
        assert sorted(r[0] or -1 for r in out.select("doc_id").collect()) == sorted(r[0] or -1 for r in stage(spark, docs, sf_dir).select("doc_id").collect()), name
        assert {tuple(r) for r in out.selectExpr("`a.b`", "m is not null", "cast(v as string)", "`b``t`[0]").collect()} == {(1, True, '{"x":[1,null]}', "q")}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and {"shard", "slot", "size"} <= set(last.columns)


def test_one_document_of_each_group_stays(spark, docs_of, sf_dir):
    base = [(k, f"{SENTENCE} {k} " * 3) for k in range(30)]
    given = base + [(100 + k, t) for k, t in base] + base
    out = STAGE["simhash_near_dedup"](spark, docs_of(given, True), sf_dir)
    groups = {c for _, _, c in brute.simhash(given)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(groups)


def test_near_copies_on_five_words(spark, docs_of, sf_dir):
    words = [f"w{k}" for k in range(104)]  # 100 shingles, of which a changed word alters five
    changed = lambda *at: " ".join("new" if k in at else w for k, w in enumerate(words))
    given = [(1, changed()), (2, changed(50)), (3, changed(10, 50, 90)), (4, changed(50).upper()), (None, None), (5, " ")]
    given += [(6 + k, " ".join(words[:60] + [f"x{k}y{n}" for n in range(44)])) for k in range(3)] + [(20, changed(50, 70)), (21, changed(20, 40, 60, 80))]
    out = STAGE["simhash_near_dedup"](spark, docs_of(given, True), sf_dir)

    def alike(a, b):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").lower().split() for t in (a, b)))
        return x == y or len(x & y) >= 0.8 * len(x | y)

    group = list(range(len(given)))
    for i, (_, a) in enumerate(given):
        for j, (_, b) in enumerate(given[:i]):
            if alike(a, b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((given[k][0] is None, given[k][0] or 0) for k in range(len(given)) if group[k] == g)[1] for g in group}
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())
    assert 1 in least.values() and 2 not in least.values() and {6, 7, 8} <= set(least.values())


def test_a_large_group_of_near_copies_costs_few_pairs(spark, docs_of, sf_dir, monkeypatch):
    """Copies of three changed words are near the plain text, not near each other; those of five, near none."""
    rng, plain, tried = np.random.default_rng(6), [f"w{k}" for k in range(150)], []

    def copy(k, changes):
        at = set(rng.choice(np.arange(5, 145, 7), changes, replace=False))
        return (k, " ".join(f"new{k}x{n}" if n in at else w for n, w in enumerate(plain)))

    given = [copy(k, 3) for k in range(150)] + [copy(k, 5) for k in range(200, 240)] + [copy(300, 0)]
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (tried.append(pairs.count()), verified(pairs, *rest))[1])
    out = STAGE["simhash_near_dedup"](spark, docs_of(given, True), sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == [0, *range(200, 240)]
    assert sum(tried) < 60 * len(given), tried


def test_far_apart_bits_never_part_near_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 63, 64, 65, 300, 3000):
        a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        assert not jaccard.far_apart(jaccard.odd_bits(a), jaccard.odd_bits(a), len(a), len(a))
        for lost in (0.1, 0.19, 0.5):
            b = np.unique(np.concatenate([a[int(len(a) * lost) :], rng.integers(-(1 << 63), (1 << 63) - 1, int(len(a) * lost / 8))]))
            far = jaccard.far_apart(jaccard.odd_bits(a), jaccard.odd_bits(b), len(a), len(b))
            shared = len(np.intersect1d(a, b))
            if 9 * shared >= 4 * (len(a) + len(b)):
                assert not far
        c = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        assert n < 60 or jaccard.far_apart(jaccard.odd_bits(a), jaccard.odd_bits(c), len(a), len(c))


def test_leaks_go_and_clean_documents_stay(spark, docs_of, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = docs_of([(1, SENTENCE), (2, f"{SENTENCE} {item} {SENTENCE}"), (3, None), (2, item), (None, item), (None, SENTENCE)], True)
    out = STAGE["benchmark_decontamination"](spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


def test_short_items_go_as_well(spark, docs_of, tmp_path):
    spark.createDataFrame([("b1", "zweb orn"), ("b2", SENTENCE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of([(1, "some words zweb orn others"), (2, "zweb and orn"), (3, f"x {SENTENCE}"), (4, " ".join(SENTENCE.split()[:9]))], True)
    out = STAGE["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [2, 4]


def test_mix_takes_documents_by_target(spark, docs_of, sf_dir):
    docs = docs_of([(k, SENTENCE) for k in range(400)], True)
    out = STAGE["mixing_sources"](spark, docs, sf_dir)
    sizes = {f"s{k}" if k else None: 100 * len(SENTENCE.split()) for k in range(4)}
    aims = brute.targets(sizes)
    got = {r.source: r.n for r in out.groupBy("source").agg((F.count(F.lit(1)) * len(SENTENCE.split())).alias("n")).collect()}
    for source, aim in aims.items():
        assert abs(got.get(source, 0) - aim) <= 2 * len(SENTENCE.split())


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(out) > 50 and out["shard"].value_counts().max() - out["shard"].value_counts().min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out["size"] == out["text"].map(lambda t: len(t.encode()) + 1)).all()
