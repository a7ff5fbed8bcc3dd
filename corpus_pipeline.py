"""A training corpus from raw documents: toxic documents go, one document of each group of near
copies stays, documents with benchmark passages go, the rest is mixed to the sources' targets and
dealt into shards.

Each stage takes (spark, docs, sf_dir) and returns the columns of docs; the last adds `size`,
`shard` and `slot` (they replace columns of these names). Stages keep null ids and texts, repeated
rows and extra columns of any name and type, maps and variants too; on an empty table each returns
an empty table. A document of an empty text, or of none, is one without words: near copies of it are
the others without words.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom.llm import decontaminate, jaccard, mixing, sharding, toxicity
from strokeloom.llm.common import kept, materialize, quoted, scratch
from strokeloom.shared import new_folder

LAST = (1 << 63) - 1


#: Columns that stages read; all others travel in one struct, so that no name can clash.
MAIN = ("doc_id", "text", "lang", "source")


def _stage(run, added: tuple[str, ...] = ()):
    @wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in MAIN]
        rest = F.struct(*quoted(others)) if others else F.struct(F.lit(0).alias("none"))
        out = run(spark, docs.select(*MAIN, rest.alias("_rest")), sf_dir)
        given = [F.col(c) if c in MAIN else F.col("_rest").getField(c).alias(c) for c in docs.columns if c not in added]
        return out.select(*given, *added)

    return wrapped


def _keyed(docs: DataFrame, one: str, two: str) -> DataFrame:
    """docs and two digests of whole rows; the other columns count as JSON, as maps and variants have no hash."""
    whole = (*MAIN, F.to_json("_rest"))
    return docs.withColumns({one: F.xxhash64(*whole), two: F.xxhash64(F.lit(1), *whole)})


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score at or over their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text", "lang"), labels)
    scored = toxicity.with_scores(docs, model, name="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.threshold_of(model, F.col("lang"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (a similarity of 0.8 or more on five words):
    the one of least id (null last), then of least digests."""
    keyed = _keyed(docs, "_w1", "_w2").withColumns({"_rank": F.coalesce("doc_id", F.lit(LAST)), "_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
    texts = keyed.select("_rank", "_h1", "_h2", "text")
    with scratch(spark):
        common = jaccard.common_hashes(texts)
        placed = materialize(jaccard.with_sets(texts, common), "shingles")
        roots = jaccard.groups(texts, placed, common)
        # The first of each set, then of each group: partial sums, so that no group is a task of its own.
        first = placed.groupBy("set").agg(F.min(F.struct("_rank", "_h1", "_h2")).alias("k"))
        named = first.join(roots, "set", "left").withColumn("_root", F.coalesce("root", "set"))
        chosen = kept(named.groupBy("_root").agg(F.min("k").alias("k")).select("k.*"), "chosen")
    keys = ["_rank", "_h1", "_h2"]
    hits = keyed.join(chosen, keys, "left_semi")
    whole = hits.groupBy(*keys).agg(F.min(F.struct("_w1", "_w2")).alias("w")).select(*keys, "w.*")
    return hits.join(whole, [*keys, "_w1", "_w2"], "left_semi").dropDuplicates(keys).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window of the full size, or a whole shorter item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), items).where(F.col("n_hit") > 0)
    hit = found.select(F.coalesce("doc_id", F.lit(LAST)).alias("_rank"), "_dh1", "_dh2").distinct()
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    keyed = docs.withColumns({"_rank": F.coalesce("doc_id", F.lit(LAST)), "_dh1": one, "_dh2": two})
    return keyed.join(hit, ["_rank", "_dh1", "_dh2"], "left_anti").select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's runs take words of it: never, once or twice."""
    keys = ["_w1", "_w2"]
    keyed = _keyed(docs, *keys)
    taken = [F.when(F.col(run) > 0, 1).otherwise(0) for run in ("first", "second")]
    times = mixing.mix_sources(keyed, carry=tuple(keys)).groupBy(*keys).agg(F.sum(sum(taken[1:], taken[0])).alias("_times"))
    # Rows alike in all columns are one row here, given back as often as the mix takes any of them.
    one = keyed.dropDuplicates(keys).join(times.where("_times > 0"), keys)
    return one.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(*docs.columns)


ADDED = ("size", "shard", "slot")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, written to its shard, with its slot there."""
    written = sharding.write_shards(sharding.placed_records(docs), new_folder(spark, "shards"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return written.select(*docs.columns, size.alias("size"), "shard", "slot")


STAGES = [
    ("toxicity", _stage(toxicity_filter)),
    ("simhash_near_dedup", _stage(near_dedup)),
    ("benchmark_decontamination", _stage(decontamination)),
    ("mixing_sources", _stage(mixing_sources)),
    ("sharding", _stage(shards, ADDED)),
]
#: The classifier, the fingerprints and the seeded shuffle are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
