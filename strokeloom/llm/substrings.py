"""Substring dedup by line and paragraph hashing.

Texts are cut into units: lines (the default) or paragraphs, of any length; or (`nested`, as op9 does)
paragraphs, lines and, as an extension, sentences inside lines that stay. Of sentences only those of
at least MIN_WORDS words and MIN_CHARS letters count, or runs of shorter ones, which are one unit. A
unit that lies in a removed one is not named again. A unit is normalised (lower case, white space
collapsed) and hashed to 128 bits. Digests are grouped over the corpus, each kind by itself; the
occurrence of least (doc_id, start) is kept, all others are removed; a kept paragraph or line may
lose smaller units to earlier places. Offsets are those of the original text, in code points.

Only digests that occur more than once are joined back, so the join is as large as the repeats.
Sums per digest are partial before their shuffle; digests that a large share of the units have are
broadcast to them.

Defined cases: null and empty texts, and lines without words, have no units; null ids rank last; rows
of one id are in the order of their texts' hashes; rows alike in id and text are one document whose
second and later copies lose all their units; a very long text is read once, in time in proportion to
its length, and its units travel like others; empty tables give no rows; extra columns are not read
by repeated_units and kept by remove_repeats, and may bear any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import documents, joined, materialize, quoted

MIN_WORDS = 6
MIN_CHARS = 40
UNITS = {
    "sentence": re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)"),
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\s*\n))+"),
}
NESTED = "nested"
KINDS = ("paragraph", "line", "sentence")  # from the largest; a unit's level is its place here
LAST = (1 << 63) - 1
SCHEMA = "doc_id long, h1 long, h2 long, level int, unit int, start int, end int, n_words int, d1 long, d2 long"


def units_of(text: str | None, unit: str = "line", min_words: int = 1, min_chars: int = 1):
    """(number, start, end, words, digest) of each unit of the least size."""
    for k, m in enumerate(UNITS[unit].finditer(text or "")):
        raw = m[0]
        words = raw.lower().split()
        if len(words) < min_words:
            continue
        plain = " ".join(words)
        if len(plain) < min_chars:
            continue
        start = m.start() + len(raw) - len(raw.lstrip())
        yield k, start, m.start() + len(raw.rstrip()), len(words), _digest(plain)


def _digest(plain: str) -> bytes:
    return xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))


def nested_units(text: str | None, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS):
    """(level, number, start, end, words, digest) of each paragraph and line, whatever its size, and of
    each sentence, or run of smaller sentences of a line, of the least size."""
    text, counts = text or "", [0, 0, 0]

    def unit(level: int, parts: list[tuple[int, int, int, str]]):
        number, counts[level] = counts[level], counts[level] + 1
        return level, number, parts[0][0], parts[-1][1], sum(p[2] for p in parts), _digest(" ".join(p[3] for p in parts))

    def large(parts: list[tuple[int, int, int, str]]) -> bool:
        return sum(p[2] for p in parts) >= min_words and sum(len(p[3]) + 1 for p in parts) > min_chars

    paragraph: list[tuple[int, int, int, str]] = []
    before = 0
    for m in UNITS["line"].finditer(text):
        line = []
        for s in UNITS["sentence"].finditer(text, m.start(), m.end()):
            raw = s[0]
            if words := raw.lower().split():
                line.append((s.start() + len(raw) - len(raw.lstrip()), s.start() + len(raw.rstrip()), len(words), " ".join(words)))
        if paragraph and (not line or m.start() > before + 1):  # a blank line
            yield unit(0, paragraph)
            paragraph = []
        before = m.end()
        if not line:
            continue
        yield unit(1, line)
        paragraph += line
        run: list[tuple[int, int, int, str]] = []
        for part in line:
            if large([part]):
                if large(run):
                    yield unit(2, run)
                yield unit(2, [part])
                run = []
            else:
                run.append(part)
        if large(run):
            yield unit(2, run)
    if paragraph:
        yield unit(0, paragraph)


def _units(text: str | None, unit: str, min_words: int, min_chars: int):
    """nested_units, or those of one kind in the same form. The bounds are of sentences."""
    if unit == NESTED:
        return nested_units(text, min_words, min_chars)
    bounds = (min_words, min_chars) if unit == "sentence" else (1, 1)
    return ((KINDS.index(unit), *u) for u in units_of(text, unit, *bounds))


def find_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs: (doc_id, text). Units of the least size with two digests of their text and of themselves."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, one, two, texts = (batch.column(k) for k in range(4))
            for at in range(0, len(texts), 256):
                rows = [(at + k, *u) for k, t in enumerate(texts.slice(at, 256).to_pylist()) for u in _units(t, unit, min_words, min_chars)]
                if not rows:
                    continue
                row, level, number, start, end, words, digests = zip(*rows, strict=True)
                row = pa.array(row)
                halves = [[int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests] for k in (0, 8)]
                ints = (pa.array(x, pa.int32()) for x in (level, number, start, end, words))
                longs = (pa.array(x, pa.int64()) for x in halves)
                yield pa.RecordBatch.from_arrays([ids.take(row), one.take(row), two.take(row), *ints, *longs], SCHEMA_NAMES)

    return keyed.mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per removed unit: doc_id, h1, h2, copy, level, unit, start, end, n_words, first_doc_id, first_start."""
    units = materialize(find_units(docs, unit, min_words, min_chars), "units")
    rank = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "h1", "h2", "start", "doc_id")
    repeats = units.groupBy("level", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1")
    # A key of 64 bits for the join; both digests and the level are compared after it.
    repeats = materialize(repeats, "repeats")
    key = F.xxhash64("level", "d1", "d2")
    keys = materialize(repeats.groupBy(key.alias("_key")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "d1", "d2", "first")).alias("_of")), "keys")
    hits = joined(units.withColumn("_key", key), keys, "_key", "n").withColumn("_hit", F.explode("_of"))
    same_unit = [F.col(f"_hit.{c}") == F.col(c) for c in ("level", "d1", "d2")]
    hits = hits.where(same_unit[0] & same_unit[1] & same_unit[2]).withColumn("first", F.col("_hit.first")).drop("_of", "_hit", "_key")
    # Rows alike in id and text have the same units: copy 1 keeps first occurrences, others nothing.
    same = hits.groupBy("doc_id", "h1", "h2", "level", "unit", "start", "end", "n_words", "first").agg(F.count(F.lit(1)).alias("copies"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    mine = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "h1", "h2", "start", "doc_id")
    first = (mine["rank"] == F.col("first.rank")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2")) & (F.col("start") == F.col("first.start"))
    gone = each.where(~(first & (F.col("copy") == 1)))
    if unit == NESTED:
        # Units either nest or lie apart, so one reaches no farther than those before it only inside of them.
        whole = Window.partitionBy("doc_id", "h1", "h2", "copy").orderBy("start", F.desc("end"), "level").rowsBetween(Window.unboundedPreceding, -1)
        gone = gone.withColumn("reached", F.max("end").over(whole)).where("reached is null or end > reached")
    return gone.select(
        "doc_id", "h1", "h2", "copy", "level", "unit", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")
    )


def remove_repeats(docs: DataFrame, text: str = "text", unit: str = "line", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated units cut out of their texts and `removed`: the spans in the original."""
    column = quoted([text])[0]
    named = docs.select("doc_id", column.alias("text"))
    gone = repeated_units(named, unit, min_words, min_chars).groupBy("doc_id", "h1", "h2", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    gone = gone.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("copy").alias("_copy"), "removed")
    keys = {"_id": F.coalesce("doc_id", F.lit(LAST)), "_h1": F.xxhash64(column), "_h2": F.xxhash64(F.lit(1), column)}
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("_row"), *(c.alias(k) for k, c in keys.items()))
    copy = F.row_number().over(Window.partitionBy("_id", "_h1", "_h2").orderBy(F.lit(1))).cast("long")
    own = [F.col("_row").getField(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)]
    whole = rows.withColumn("_copy", copy).join(gone, ["_id", "_h1", "_h2", "_copy"], "left").select(*own, "removed")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for found, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    ends = [0, *(x for s in spans for x in (s["start"], s["end"])), len(found)]
                    found = "".join(found[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                kept.append(found)
            columns = [*batch.columns]
            columns[place] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return whole.mapInArrow(run, whole.schema).toDF(*docs.columns, "removed")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_units(documents(spark, sf_dir).select("doc_id", "text"), NESTED)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("level") + 1)
    return found.select("doc_id", "copy", kind.alias("kind"), "unit", "start", "end", "n_words", "first_doc_id", "first_start")
