"""Operators against plain versions, on awkward rows and on the smallest tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strokeloom.llm import decontaminate, mixing, secrets, sharding, simhash, substrings, suffixes, tokens
from strokeloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.llm.conftest import LONG, SENTENCE, rows_of

ITEMS = [(1, SENTENCE), (2, "two words"), (3, None), (4, ""), (5, SENTENCE + " more"), (6, "!!!"), (7, " ".join(LONG.split()[500:530]))]


def table(sf_dir, name):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def pairs(sf_dir, *columns):
    return [tuple(r) for r in table(sf_dir, "documents")[["doc_id", "text", *columns]].itertuples(index=False, name=None)]


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontaminate_awkward(spark, docs_of, awkward, extra, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.decontaminate(docs_of(awkward, extra), items, max_broadcast=most)
    got = rows_of(found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256), F.col("n_hit") > 0), "*")
    assert got == brute.decontaminate(awkward, ITEMS)


def test_decontaminate_empty(spark, docs_of, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.decontaminate(docs_of(awkward), none).collect()
    assert len(found) == len(awkward) and not any(r.n_hit for r in found)
    assert decontaminate.decontaminate(docs_of([]), none).count() == 0


def test_decontaminate_query(spark, sf_dir):
    got = rows_of(QUERIES["op2_benchmark_decontamination"](spark, sf_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.decontaminate(pairs(sf_dir), [tuple(r) for r in table(sf_dir, "benchmark")[["item_id", "text"]].itertuples(index=False)])


@pytest.mark.parametrize("extra", [False, True])
def test_simhash_awkward(docs_of, awkward, extra):
    many = [(100 + k, SENTENCE.replace("quick", f"quick{k}")) for k in range(60)]
    rows = awkward + many
    found = simhash.near_duplicates(docs_of(rows, extra), radius=2)
    got = rows_of(found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")), "component_id"), "*")
    assert got == brute.simhash(rows)


def test_simhash_small_tiles_find_the_same_groups(spark, docs_of):
    rows = [(k, f"{SENTENCE} {k % 7} {SENTENCE} {k}") for k in range(120)]
    printed = simhash.with_fingerprints(docs_of(rows))
    prints = printed.select(F.col("_fp").alias("fp")).distinct()
    from strokeloom.llm.graph import components

    roots = {tile: {(r.node, r.root) for r in components(simhash.links(prints, 2, tile, chunk)).collect()} for tile, chunk in ((2, 6), (512, 16_384))}
    assert roots[2] == roots[512]


def test_chunks_give_the_links_of_all_pairs():
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    left = np.unique(np.concatenate([base, base ^ np.uint64(1 << 40), base ^ np.uint64(3)]))
    right = np.unique(np.concatenate([base ^ np.uint64(5 << 20), base ^ np.uint64(1 << 63)]))

    def groups(nodes, found):
        root = {int(x): int(x) for x in nodes}
        for _ in range(len(root)):
            for a, b in found:
                root[a] = root[b] = min(root[a], root[b])
        return root

    def all_pairs(x, y):
        return [(int(a), int(b)) for a in x for b in y if a != b and (int(a) ^ int(b)).bit_count() <= 2]

    for x, y, same in ((left, left, True), (left, right, False)):
        found = [(int(p), int(q)) for a, b in simhash.compare_chunks(x, y, 2, same, 7) for p, q in zip(a, b, strict=True)]
        nodes = np.concatenate([x, y])
        assert groups(nodes, found) == groups(nodes, all_pairs(x, y))


def test_hot_keys_are_broadcast(spark, docs_of, monkeypatch):
    from strokeloom.llm import common
    from strokeloom.llm.graph import components

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    star = [(k, 1000) for k in range(60)] + [(k, k + 1) for k in range(2000, 2006)]
    found = {r.node: r.root for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in [*range(1, 60), 1000]) and all(found[k] == 2000 for k in range(2001, 2007))
    rows = [(k, None) for k in range(50)] + [(100 + k, SENTENCE) for k in range(50)] + [(200 + k, f"{SENTENCE} {k}") for k in range(20)]
    got = simhash.near_duplicates(docs_of(rows))
    assert rows_of(got.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")), "component_id"), "*") == brute.simhash(rows)
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_simhash_query(spark, sf_dir):
    assert rows_of(QUERIES["op1_simhash_near_dedup"](spark, sf_dir), "doc_id", "fingerprint", "component_id") == brute.simhash(pairs(sf_dir))


def test_components_on_a_path(spark):
    from strokeloom.llm.graph import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert all(found[k] == 0 for k in range(1, 41)) and found[101] == 100


def test_components_of_random_links(spark, monkeypatch):
    import random

    from strokeloom.llm import graph

    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    root = list(range(400))
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    touched = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    for held in (graph.HELD, 3):
        monkeypatch.setattr(graph, "HELD", held)
        assert {(r.node, r.root) for r in graph.components(df).collect()} == {(x, root[x]) for x in touched if root[x] != x}
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_substrings_awkward(docs_of, awkward, extra):
    rows = [r for r in awkward if r[0] is not None or r[1] is None]
    rows = [(i, t) for k, (i, t) in enumerate(rows) if (i, t) not in rows[:k] and not any(i == j for j, _ in rows[:k])]
    rows += [(20, LONG[1000:3000] + "é" + LONG[:500]), (21, "ab" * 400), (22, LONG[1050:1149]), (23, LONG[1050:1150])]
    found = suffixes.dedup_substrings(docs_of(rows, extra))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(rows)


@pytest.mark.parametrize("texts", [suffixes.TEXTS, 16])
def test_substrings_shared_by_many(docs_of, monkeypatch, texts):
    """A passage, and parts of it, in many contexts: hot grams, edges at any offset, texts that repeat themselves."""
    import random

    monkeypatch.setattr(suffixes, "TEXTS", texts)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = LONG[:260]
    rows = []
    for k in range(150):
        cut = rng.randrange(0, 140)
        rows.append((k, noise(rng.randrange(0, 150)) + passage[cut : cut + rng.randrange(90, 260)] + noise(rng.randrange(0, 150))))
    rows += [(1000, passage * 9), (1001, "x" + passage * 5 + noise(7) + passage[50:]), (1002, ("é" + passage[:70]) * 12), (1003, LONG * 3)]
    found = suffixes.dedup_substrings(docs_of(rows))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(rows)


def test_ranks_drop_what_is_alone(spark):
    rows = spark.createDataFrame([(5, 1, 1), (3, 1, 1), (9, 1, 2), (7, 2, 2), (8, 2, 2)], "p long, a long, b long")
    assert rows_of(suffixes.reranked(rows, "ranks"), "p", "rank") == [(3, 3), (5, 3), (7, 7), (8, 7)]


def test_substrings_copies_and_empty(docs_of):
    twice = [(1, LONG[:300]), (1, LONG[:300]), (None, LONG[:300]), (2, "short"), (2, "short")]
    got = rows_of(suffixes.dedup_substrings(docs_of(twice), keep_bytes=True), "doc_id", "n_removed", "n_spans", "kept")
    assert [r[:3] for r in got] == [(1, 0, 0), (1, 300, 1), (2, 0, 0), (2, 0, 0), (None, 300, 1)]
    assert suffixes.dedup_substrings(docs_of([])).count() == 0


def test_substrings_long_text_in_segments(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    data = (LONG[:700] + LONG[200:500]).encode()
    import numpy as np

    parts = []
    for base in range(0, len(data) - 99, 64):
        k, first, n, o = suffixes.anchor_runs(np.frombuffer(data[base : base + 64 + 99], np.uint8))
        parts += [(base + f, c) for f, c in zip(first.tolist(), n.tolist(), strict=True)]
    assert sum(c for _, c in parts) == len(data) - 99


def test_substrings_query(spark, sf_dir):
    got = rows_of(QUERIES["op3_suffix_array_dedup"](spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substrings(pairs(sf_dir))


@pytest.mark.parametrize("extra", [False, True])
def test_mixing(docs_of, awkward, extra):
    rows = [*awkward, *((200 + k, SENTENCE * (k % 9)) for k in range(300))]
    docs = docs_of(rows, True) if extra else docs_of(rows, True).select("doc_id", "text", "source")
    found = mixing.mix_sources(docs, rows_per_bucket=16).toPandas()
    sizes = [len(brute.words_of(t)) for _, t in rows]
    sources = [f"s{k % 4}" if k % 4 else None for k in range(len(rows))]
    by = {s: sum(n for n, x in zip(sizes, sources, strict=True) if x == s) for s in set(sources)}
    aims = brute.targets(by)
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all()
    for s, g in found.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert g["target"].iloc[0] == pytest.approx(aims[s]) and g["source_size"].iloc[0] == by[s]
        assert g["taken"].sum() == int(aims[s])
    assert found["position"].dropna().between(0, 1).all() and (found["position"].isna() == (found["first"] == 0)).all()
    again = mixing.mix_sources(docs, rows_per_bucket=16).toPandas()
    key = ["source", "doc_id", "size", "taken"]
    assert sorted(map(str, found[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mixing_targets_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 70}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute.targets(sizes))
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_spreads_copies(docs_of, spark):
    rows = [(None, None, None)] * 40 + [(1, SENTENCE, "a")] * 90 + [(k, f"{SENTENCE} {k}", "b") for k in range(70)] + [(None, SENTENCE, "a")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, rows_per_bucket=8)
    got = sorted(((r.doc_id, r.size, r.taken, r.position and round(r.position, 9), r.position_again and round(r.position_again, 9)) for r in found.collect()), key=str)
    assert got == brute.mix(rows)


def test_mixing_position_inverts_the_schedule(spark):
    row = spark.range(11).select((F.col("id") / 10).alias("share")).withColumn("t", mixing.demand_time(F.col("share"), F.lit(0.5)))
    for r in row.collect():
        assert 1.5 * r.t - 0.5 * r.t**2 == pytest.approx(r.share)


@pytest.mark.parametrize("extra", [False, True])
def test_secrets_awkward(docs_of, awkward, extra):
    rows = [*awkward, (30, "secret:token :abcdefgh api-key='QWERTY' apikey  =  a.b.c-d"), (31, "AKIA" + "Z" * 15 + " AKIAAKIA" + "0" * 20), (32, "f" * 23 + "g" + "f" * 24)]
    rows += [(500 + 4 * k, f"x token=onlyoneowner{k < 24} ü secret: many{k % 3}many") for k in range(30)] + [(700, "é token=abcdef;" * 300)]
    docs = docs_of(rows, True).withColumn("source", F.when(F.col("doc_id") >= 500, "one").otherwise(F.col("source")))
    owners = ["one" if (rows[k][0] or 0) >= 500 else f"s{k % 4}" if k % 4 else None for k in range(len(rows))]
    found = secrets.scan_secrets(docs if extra else docs.select("doc_id", "text", "source"))
    got = rows_of(found.select("doc_id", secrets._joined(F.col("base")), secrets._joined(F.col("spans"))), "*")
    assert got == brute.secrets([(i, t, o) for (i, t), o in zip(rows, owners, strict=True)])
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secrets_query(spark, sf_dir):
    got = rows_of(QUERIES["op8_secret_scans"](spark, sf_dir), "doc_id", "base_sha256", "spans")
    exp = brute.secrets(pairs(sf_dir, "source"))
    assert got == sorted(((i, brute.sha(base), spans) for i, base, spans in exp), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, sf_dir, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, rel = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows_of(df, *columns) == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_sharding(docs_of, awkward, extra):
    rows = awkward + [(7, "same")] * 500
    found = sharding.placed_records(docs_of(rows, extra).withColumn("a.b", F.lit(1)), bucket_rows=50).toPandas()
    assert sorted(map(str, zip(found["doc_id"].astype("Int64").astype(object), found["text"], strict=True))) == sorted(
        map(str, ((pd.NA if i is None else i, t) for i, t in rows))
    )
    check_shards(found)
    # No bucket, and so no shard, gets all copies of one row.
    assert len(found[found["text"] == "same"]["shard"].value_counts()) == 8


def check_shards(found):
    counts = found["shard"].value_counts().reindex(range(8), fill_value=0)
    assert counts.max() - counts.min() <= 1 and set(found["shard"]) <= set(range(8))
    for _, g in found.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_places_equal_a_plain_shuffle(spark, sf_dir):
    """Pass by pass: numbers as Spark gives them, then buckets, swaps and slices in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").coalesce(1)
    given = [tuple(r) for r in docs.collect()]
    got = {(r.doc_id, r.shard, r.slot) for r in sharding.placed_records(docs, bucket_bytes=40_000).collect()}
    size = sum(len((t or "").encode()) + 1 for _, t in given)
    buckets: dict[int, list] = {}
    n_buckets = -(-size // 40_000)
    assert n_buckets > 5
    for k, (doc, _) in enumerate(given):
        key = brute.spark_hash(sharding.SEED, (k, "q"))
        buckets.setdefault(brute.spark_hash(sharding.SEED + 1, (key, "q")) % n_buckets, []).append((key, doc))
    line = []
    for b in sorted(buckets):
        order = sorted(buckets[b])
        line += [order[k][1] for k in sharding.fisher_yates(len(order), (sharding.SEED << 20) + b).tolist()]
    firsts = [-(-s * len(line) // 8) for s in range(9)]
    want = {(doc, s, k - firsts[s]) for k, doc in enumerate(line) for s in [8 * k // len(line)]}
    assert got == want


def test_sharding_query_writes_whole_records(spark, sf_dir):
    import zlib

    found = QUERIES["op10_sharding"](spark, sf_dir).toPandas()
    texts = dict(pairs(sf_dir))
    assert {(r.doc_id, r.size, r.text_crc32) for r in found.itertuples()} == {(k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items()}
    check_shards(found)
    again = QUERIES["op10_sharding"](spark, sf_dir).toPandas()
    assert set(found[["doc_id", "shard", "slot"]].itertuples(index=False, name=None)) == set(again[["doc_id", "shard", "slot"]].itertuples(index=False, name=None))


def test_sharding_edges(spark, docs_of, tmp_path):
    big = (1 << 60) + 1
    placed = sharding.placed_records(docs_of([(big, "a"), (None, None), (2, "")]))
    written = sharding.write_shards(placed, f"{tmp_path}/shards")
    assert sorted(((r.doc_id, r.text) for r in written.collect()), key=str) == sorted([(big, "a"), (None, None), (2, "")], key=str)
    docs_of([(1, None), (2, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in sharding.op10_sharding(spark, str(tmp_path)).collect()} == {(1, 1, 0, "rows", None), (2, 1, 0, "rows", None)}
    assert sharding.write_shards(sharding.placed_records(docs_of([])), f"{tmp_path}/none").count() == 0


def test_fisher_yates_is_a_permutation():
    for n in (0, 1, 2, 100):
        assert sorted(sharding.fisher_yates(n, 3).tolist()) == list(range(n))
    assert len({tuple(sharding.fisher_yates(3, s)) for s in range(200)}) == 6


def test_token_counts_equal_a_unigram_tokenizer(docs_of, awkward, sf_dir):
    tk = pytest.importorskip("tokenizers")
    pieces = tokens.read_pieces(tokens.VOCABULARY)
    scores = tokens.scores_of(pieces)
    vocabulary = [("<unk>", min(scores.values()) - tokens.UNKNOWN), *scores.items(), *((f"<0x{b:02X}>", -1e4) for b in range(256))]
    unigram = tk.Tokenizer(tk.models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = tk.pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    texts = [t for _, t in pairs(sf_dir)] + [t for _, t in awkward] + ["日本 語\n\n x  y", "a" * 5000]
    got = tokens.TextCounter(scores).count(texts)
    # The pre-tokenizer leaves a leading space alone; the mark before the text is written out here.
    assert got == [len(unigram.encode(" " + t, add_special_tokens=False).ids) if t else 0 for t in texts]
    rows = docs_of(awkward, True)
    assert tokens.with_token_counts(rows, pieces).count() == len(awkward)


def test_token_counts_query(spark, sf_dir, docs_of, tmp_path):
    pieces = tokens.read_pieces(tokens.VOCABULARY)
    texts = dict(pairs(sf_dir))
    counts = dict(zip(texts, tokens.TextCounter(tokens.scores_of(pieces)).count(list(texts.values())), strict=True))
    got = {(r.doc_id, r.n_chars, r.n_tokens) for r in QUERIES["op5_token_counts"](spark, sf_dir).collect()}
    assert got == {(k, len(t), counts[k]) for k, t in texts.items()}
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op5_token_counts"](spark, str(tmp_path)).count() == 0


def test_token_counts_forget_without_loss(monkeypatch):
    scores = tokens.scores_of(["a", "b", "ab", tokens.MARK, tokens.MARK + "a"])
    monkeypatch.setattr(tokens, "KNOWN", 3)
    counter = tokens.TextCounter(scores)
    texts = ["a b ab", "ab ab b", "q", None, "", "abab"]
    assert [counter.count([t])[0] for t in texts] == tokens.TextCounter(scores).count(texts)


@pytest.mark.parametrize("unit", list(substrings.UNITS))
def test_units_keep_offsets(unit):
    text = "First one is here now, really.  Second one! \n\n third   LINE of the text. Fourth"
    found = list(substrings.units_of(text, unit, 1, 1))
    assert found and all(text[s:e].strip() == text[s:e] and text[s:e] for _, s, e, _, _ in found)
    assert {w for _, s, e, _, _ in found for w in text[s:e].split()} == set(text.split())


def test_repeated_units(docs_of, awkward):
    line = "This sentence has quite enough words to be looked at closely."
    rows = [*awkward, (40, f"a b.\n{line}"), (41, f"Before. {line.upper()} After."), (42, f"{line}  {line}"), (None, line), (43, f"x {line}")]
    got = rows_of(substrings.repeated_units(docs_of(rows, True), "sentence").where("doc_id >= 40 or doc_id is null"), "doc_id", "start", "first_doc_id")
    assert [r for r in got if r[2] == 40] == [(41, 8, 40), (42, 0, 40), (42, len(line) + 2, 40), (None, 0, 40)]
    assert substrings.repeated_units(docs_of([])).count() == 0


def test_remove_repeats(docs_of, awkward):
    line = "This sentence has quite enough words to be looked at closely."
    rows = [(1, f"a. {line} Then."), (2, f"b. {line} Last."), (2, f"b. {line} Last."), (3, None), (None, line)]
    out = substrings.remove_repeats(docs_of(rows), unit="sentence")
    assert rows_of(out, "doc_id", "text") == sorted([(1, f"a. {line} Then."), (2, "b.  Last."), (2, "b.  Last."), (3, None), (None, "")], key=str)
    assert substrings.remove_repeats(docs_of(awkward, True)).count() == len(awkward)


def test_repeated_units_query(spark, sf_dir):
    got = rows_of(QUERIES["op9_substring_dedup"](spark, sf_dir), "doc_id", "kind", "start", "end", "first_doc_id", "first_start")
    assert got == brute.repeated_units(pairs(sf_dir))


def test_repeated_units_of_awkward_texts(spark, tmp_path, docs_of, monkeypatch):
    from strokeloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    line = "This sentence has quite enough words to be looked at closely."
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, f"{line}\n{line}\n\n{line}"), (5, f"a.\n{line} b. c!  {line}"), (None, f"{line}\n\n\nx"), (6, "é ü? " * 200), (7, "é ü? " * 200)]
    rows += [(10 + k, f"{k}\nAll rights reserved.\n\n  {line.upper()}  \nend {k}!") for k in range(120)] + [(200, LONG), (201, f"{LONG}\n{SENTENCE}. {LONG}")]
    docs_of(rows).withColumns({"a.b": F.lit(1), "level": F.lit("z")}).write.parquet(f"{tmp_path}/documents.parquet")
    found = substrings.op9_substring_dedup(spark, str(tmp_path))
    assert rows_of(found, "doc_id", "kind", "start", "end", "first_doc_id", "first_start") == brute.repeated_units(rows)


def test_lines_of_any_length_by_default(docs_of):
    rows = [(1, "a b\nOf.\nc"), (2, "Of.\nother\n\nA  B"), (3, "of. x")]
    docs = docs_of(rows).withColumn("a.b", F.lit(1))
    assert rows_of(substrings.repeated_units(docs), "doc_id", "start", "end", "first_doc_id") == [(2, 0, 3, 1), (2, 11, 15, 1)]
    assert rows_of(substrings.remove_repeats(docs), "doc_id", "text") == [(1, "a b\nOf.\nc"), (2, "\nother\n\n"), (3, "of. x")]
    assert rows_of(substrings.repeated_units(docs, "paragraph"), "doc_id") == []


def test_repeated_lines_of_short_sentences(spark, tmp_path, docs_of, awkward):
    line, short = "This sentence has quite enough words to be looked at closely.", "Yes. No. We do. Who knows. Not me. Some day it ends. So be it. Good."
    rows = [
        (1, f"{short}\nOne.\nAll rights reserved."), (2, f"Two.\n{short.upper()}\nAll  rights reserved."), (3, f"{line} {short} {line[5:]}"), (4, f"x {line} {short}"),
        (5, "a b\nc d e\n\nother"), (6, "a b c\nd e\n \n\nnone"), (7, f"{line} Good."),
    ]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(substrings.op9_substring_dedup(spark, str(tmp_path)), "doc_id", "kind", "start", "end", "first_doc_id")
    at = len(f"x {line} ")
    assert got == [
        (2, "line", 5, 5 + len(short), 1), (2, "line", 6 + len(short), len(rows[1][1]), 1), (3, "sentence", len(line) + 1, len(line) + 1 + len(short), 1),
        (4, "sentence", at, at + len(short), 1), (6, "paragraph", 0, 9, 5), (7, "sentence", 0, len(line), 3),
    ]
    twice = [(1, short), (1, short), (None, short), (2, None), (3, f"{line}\n{short}\n{line}")]
    out = substrings.remove_repeats(docs_of(twice), unit=substrings.NESTED)
    assert rows_of(out, "doc_id", "text") == sorted([(1, short), (1, ""), (None, ""), (2, None), (3, f"{line}\n\n")], key=str)
    assert substrings.remove_repeats(docs_of(awkward, True), unit=substrings.NESTED).count() == len(awkward)


def test_mixing_query_takes_and_places_like_a_plain_version(spark, sf_dir):
    rows = QUERIES["op6_mixing_sources"](spark, sf_dir).collect()
    got = sorted(((r.doc_id, r.size, r.taken, r.position and round(r.position, 9), r.position_again and round(r.position_again, 9)) for r in rows), key=str)
    assert got == brute.mix(pairs(sf_dir, "source"))
    twice = [r for r in rows if r.second]
    assert twice and all(r.position_again is not None and r.position_again >= r.position for r in twice)
    assert all(r.position_again is None for r in rows if not r.second) and all(r.first + r.second == r.taken for r in rows)
