"""Benchmark decontamination as a prefix-filtered containment join. DataFrame functions only.

Item windows of `window` consecutive words (an item of fewer words is one window) are the sets to
find. The tokens of a window are ordered by their frequency over the whole corpus. Full containment
needs every token, so a prefix of one token, the rarest, is enough: a document word that equals it
gives one candidate start, kept if the whole window fits between the document's ends (positional
and length bounds), and verified word by word.

The windows are broadcast only if their measured size is under MAX_BROADCAST_BYTES; beyond it the
same join runs as a shuffle of document words without texts, and verification joins the candidates
to their documents.

Defined cases: null or empty texts have no words and are never hit; an item without words has no
window; windows that several items share count for each of them; documents that repeat stay rows
of their own; of windows that tie in rarity the one of the least word is the prefix; a very long text
is split once and its words travel one by one; an empty table of documents gives no rows, one of
items no hits; extra columns are not read and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import ascii_words, documents, materialize

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
#: Stands after a document's last word; no word is empty.
END = ""


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, len, item_ids): each distinct window with the ids, as strings, of its items."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), ascii_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    grouped = each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return grouped.withColumn("len", F.size("words")).withColumn("window_id", F.xxhash64("words"))


KEY = ("doc_id", "_dh1", "_dh2")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id", F.xxhash64(text).alias("_dh1"), F.xxhash64(F.lit(1), text).alias("_dh2"),
        F.concat(ascii_words(text), F.array(F.lit(END))).alias("words"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs: (doc_id, text), items: (item_id, text). One row per row of docs: doc_id, the text's two
    digests, n_words, n_hit and item_ids (sorted strings).

    Rows alike in id and text are one key, found once and given back as often as they occur.
    """
    windows = materialize(item_windows(items, window), "windows")
    held = windows.agg(F.sum(F.octet_length(F.to_json(F.struct("words", "item_ids"))) * 2 + 64)).first()[0] or 0
    small = held <= max_broadcast
    fit = F.broadcast if small else (lambda df: df)
    tokens = _keyed(docs)

    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    seen = tokens.select(F.explode("words").alias("word")).join(fit(vocabulary), "word", "left_semi")
    frequency = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        windows.select("window_id", F.posexplode("words").alias("offset", "word"))
        .join(frequency, "word")
        .groupBy("window_id")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word", "offset")).alias("r"))
    )
    # A window with a word that the corpus lacks occurs nowhere.
    sought = windows.join(rarest, "window_id").where("known = len").select(
        F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "len", F.col("words").alias("window"), "item_ids"
    )
    end = docs.sparkSession.createDataFrame([(END, 0, 0, None, [])], sought.schema)
    sought = materialize(sought.unionByName(end) if small else sought, "prefixes")

    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") < F.size("words"))
    verified = inside & (F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len")) == F.col("window"))
    each = tokens.select(*KEY, "words", F.posexplode("words").alias("pos", "word"))
    at_end = F.col("window").isNull()
    if small:
        found = each.join(F.broadcast(sought), "word").where(at_end | verified)
        found = found.select(*KEY, start.alias("start"), "len", "item_ids", at_end.alias("at_end"))
    else:
        candidates = each.select(*KEY, "pos", "word").join(sought, "word").where(start >= 0).distinct().alias("c")
        texts = tokens.dropDuplicates(KEY).alias("t")
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in KEY]
        hits = candidates.join(texts, same).where(verified).select(*(f"c.{k}" for k in KEY), start.alias("start"), "len", "item_ids", F.lit(False).alias("at_end"))
        ends = tokens.select(
            *KEY, (F.size("words") - 1).alias("start"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("item_ids"), F.lit(True).alias("at_end")
        )
        found = hits.unionByName(ends)
    # What starts at one place of one key, then what each place covers beyond all before it.
    placed = found.groupBy(*KEY, "start", "at_end").agg(
        F.max("len").alias("len"), F.count(F.lit(1)).alias("copies"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items")
    )
    before = Window.partitionBy(*KEY).orderBy("start", "at_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("len")).over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", reach))
    found = placed.withColumn("new", new).groupBy(*KEY).agg(
        F.max(F.when(F.col("at_end"), F.col("start"))).cast("long").alias("n_words"),
        F.max(F.when(F.col("at_end"), F.col("copies"))).alias("copies"),
        F.sum("new").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"),
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
