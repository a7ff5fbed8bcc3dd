"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Every text is split by each pattern; running sums of the lengths of pieces and matches, by a window
over a text's few pieces, give exact spans in code points in one pass over the text and linear time.
The value of each kept span is hashed, and the hashes are aggregated over the corpus by distinct
repositories and owners. A value that several owners hold, or that one owner holds in more than
MAX_REPOSITORIES repositories, is widely copied: an example or a default. What is left is specific to
an owner: a live-looking credential, whose value gets a span of kind `live`.

Defined cases: a null or empty text has no spans; rows that repeat, also whole ones, stay rows of
their own (of one repository); a null owner or repository is one more owner or repository; spans
that start together stand in the order of kinds; a very long text costs time and memory in
proportion to its matches; an empty table gives no rows; extra columns are not read and may bear
any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import documents, joined, materialize, quoted

# The patterns of the contract, in its order of kinds.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MIN_VALUE = 6  # characters of an assigned value
MAX_OWNERS = 1  # a value with more owners is widely copied
MAX_REPOSITORIES = 5  # so is one in more repositories, whoever owns them
#: Cheap tests that every text with a match passes.
HINTS = {"assign": r"(?i)passw|secret|token|api", "access": "AKIA", "hex": r"[0-9a-f]{24}"}


def _pieces(text: Column, kind: str, order: int) -> Column:
    """Array of (k, gap, whole, value): each match, with the length of the text between it and the one before."""
    pattern = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda w: F.char_length(w)).alias("whole"), value.alias("value"))
    rows = F.filter(rows, lambda r: r["whole"].isNotNull())  # the last piece has no match after it
    shaped = F.transform(rows, lambda r: F.struct(F.lit(order).alias("k"), r["gap"].alias("gap"), r["whole"].alias("whole"), r["value"].alias("value")))
    none = F.array().cast("array<struct<k:int,gap:int,whole:int,value:string>>")
    return F.when(text.rlike(HINTS[kind]), shaped).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """rows: (_row, ..., _pieces). One row per base span: rows' other columns, start, k, kind, end,
    value_start, value."""
    # A match's number is its place in its text and kind; places of one kind follow one another.
    each = rows.select(*(c for c in rows.columns if c != "_pieces"), F.posexplode("_pieces").alias("_at", "p"))
    upto = Window.partitionBy("_row", "p.k").orderBy("_at")
    end = F.sum((F.col("p.gap") + F.col("p.whole")).cast("long")).over(upto)
    length = F.char_length("p.value")
    spans = each.withColumn("end", end).select(
        *(c for c in rows.columns if c != "_pieces"), (F.col("end") - F.col("p.whole")).alias("start"), F.col("p.k").alias("k"),
        F.element_at(F.array(*map(F.lit, PATTERNS)), F.col("p.k") + 1).alias("kind"), "end", (F.col("end") - length).alias("value_start"), F.col("p.value").alias("value"),
    )
    return spans.where((F.col("kind") != "assign") | (F.char_length("value") >= MIN_VALUE))


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source",
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of docs: doc_id, base spans and all spans, counts of live and copied values.

    The matches, without texts, go to the shared folder with a row number, which later stages group
    by. Ownership is counted in two steps, by (value, owner) and then by value, each with partial
    sums before its shuffle, so a value that a third of all rows hold stays a few rows per task.
    """
    column = lambda c: quoted([c])[0]
    source = F.coalesce(column(text), F.lit(""))
    pieces = reduce(F.concat, [_pieces(source, kind, k) for k, kind in enumerate(PATTERNS)])
    own = docs.select(
        column(doc_id).alias("doc_id"), column(repository).cast("string").alias("_repository"), column(owner).cast("string").alias("_owner"), pieces.alias("_pieces"),
    )
    # The row number is fixed by writing it.
    rows = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    spans = base_spans(rows.where(F.size("_pieces") > 0).drop("doc_id")).withColumn("_hash", F.sha2("value", 256)).drop("value")
    spans = materialize(spans, "spans")
    by_repository = spans.groupBy("_hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    ownership = by_owner.groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    held = joined(spans, materialize(ownership, "ownership"), "_hash", "n")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    span = lambda start, k, kind: F.struct(start.alias("start"), k.alias("k"), kind.alias("kind"), F.col("end").alias("end"))
    per_row = held.groupBy("_row").agg(
        F.array_sort(F.collect_list(span(F.col("start"), F.col("k"), F.col("kind")))).alias("base"),
        F.collect_set(F.when(live, span(F.col("value_start"), F.lit(len(PATTERNS)), F.lit("live")))).alias("_live"),
        F.sum(F.when(live, 0).otherwise(1)).alias("n_copied"),
        F.max("owners").alias("max_owners"),
        F.max("repositories").alias("max_repositories"),
    )
    none = F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint>>")
    return rows.select("_row", "doc_id").join(per_row, "_row", "left").select(
        "doc_id",
        F.coalesce("base", none).alias("base"),
        F.coalesce(F.array_sort(F.concat("base", "_live")), none).alias("spans"),
        F.coalesce(F.size("_live"), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"),
        F.coalesce("max_repositories", F.lit(0)).cast("long").alias("max_repositories"),
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in PATTERNS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
        "max_owners",
        "max_repositories",
    )
