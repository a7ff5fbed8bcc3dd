"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of THRESHOLD bytes over it also starts earlier. Ranking every position of
the corpus would move many times the input, so the positions that can matter are found first, with
no loss:

1. In every window of THRESHOLD bytes the least hashed GRAM (the leftmost, on ties) is its anchor,
   a function of the window's bytes. Consecutive windows with one anchor are a run. Equal windows
   have equal anchors at the same offset, so a window whose anchor's gram occurs in one run is new.
2. Runs alike in all their bytes and in the anchor's place are a class, ranked by place: all but the
   earliest repeat wholly. Tasks keep only the earliest run of a class among the rows of one batch for
   this; the others are known to repeat and are dealt out evenly. Runs of a gram that is frequent
   within a batch are dealt by their whole class, and count as doubtful, so that a passage in a third
   of all texts is a few rows a task.
3. What is left are the earliest runs of classes that share a gram with another class. The windows of
   a run whose anchors lie at like offsets (GRID of them) share a region; if no other run has the
   region, none of them repeats. If another run has all that they cover, they are a class in turn.

The windows that remain are ranked by prefix doubling. A position's
first rank is the hash of its GRAM; then Spark groups the pairs (rank at p, rank at p + h) at growing
offsets h, and the least position of a pair becomes its rank over twice the length, until THRESHOLD
bytes are ranked (the last offset is clipped). Positions alone with their pair drop out after each
round. In the end all but the least position of a rank repeat. Pairs that very many positions have
are summed partially and broadcast back.

First ranks and the names of runs and regions are 64-bit hashes.

Defined cases: a null text is empty; texts under THRESHOLD bytes stay whole; null ids rank last;
rows of one id are in the order of their texts' hashes; rows alike in id and text are copies, of
which the first is judged and the others repeat it wholly; a very long text is cut in segments, and
its spans are merged run by run; tables may be empty; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import arrow_batches, documents, joined, kept, materialize, release, scratch

THRESHOLD = 100
GRAM = 32  # a power of two
GRID = 9  # offsets of a region
TEXTS = 512  # texts that move to Python at once
HOT_RUNS = 4  # of one gram in a batch; more are dealt by their class
SEGMENT = 1 << 22  # window starts of a long text handled at once
LAST = (1 << 63) - 1
_BYTES = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed polynomial hash of each run of `gram` bytes, by doubling its length."""
    h, power, size = _BYTES[data], _MIX[1], 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        h = (h ^ (h >> np.uint64(29))) * _MIX[0]
    return h ^ (h >> np.uint64(32))


def anchor_runs(data: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, windows, anchor's offset in the first window) of each run."""
    hashes = gram_hashes(data, gram)
    low = np.uint64(24)
    keyed = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    width, size = threshold - gram + 1, 1
    while size * 2 <= width:
        keyed = np.minimum(keyed[:-size], keyed[size:])
        size *= 2
    if rest := width - size:
        keyed = np.minimum(keyed[:-rest], keyed[rest:])
    at = (keyed & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    anchors = at[first]
    return hashes[anchors].view(np.int64), first, np.diff(np.append(first, len(at))), anchors - first


RUNS = "k long, ctx long, doc_id long, h1 long, st int, n int, o int, dup boolean, hot boolean"


def find_runs(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Runs of all texts. k is what they are dealt by: the gram's hash, that of gram and class for a
    gram that is hot in its batch, or a number at random for runs known to repeat. A row without
    windows (n = 0) tells those who look up a hot gram by itself that it has more classes."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.col("text").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                yield from runs(batch.slice(at, TEXTS))

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digest, parts, rows, contexts = xxhash.xxh3_64_intdigest, [], [], []
        for row, value in enumerate(batch.column(2)):
            raw = value.as_py() or b""
            for base in range(0, len(raw) - threshold + 1, SEGMENT):
                piece = raw[base : base + SEGMENT + threshold - 1]
                k, first, n, o = anchor_runs(np.frombuffer(piece, np.uint8), threshold)
                each = (digest(piece[s : s + c + threshold - 1], p) for s, c, p in zip(first.tolist(), n.tolist(), o.tolist(), strict=True))
                contexts.append(np.fromiter(each, np.uint64, len(k)))
                parts.append((k, first + base, n, o))
                rows.append(np.full(len(k), row))
        if not parts:
            return
        k, st, n, o = (np.concatenate(x) for x in zip(*parts, strict=True))
        row, ctx = np.concatenate(rows), np.concatenate(contexts).view(np.int64)
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)[row]
        h1 = batch.column(1).to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((st, h1, ids, ctx, k))
        k_, c_ = k[order], ctx[order]
        repeats = np.zeros(len(k), bool)
        repeats[order[1:]] = (k_[1:] == k_[:-1]) & (c_[1:] == c_[:-1])
        # A second run of the same rows as the first of its class is a copy of the row, not a repeat.
        with np.errstate(over="ignore"):
            dealt = (k.view(np.uint64) * _MIX[1]) ^ (ids.view(np.uint64) * _MIX[0]) ^ (st.astype(np.uint64) * _MIX[1] * _MIX[0])
            dealt = (dealt ^ (dealt >> np.uint64(31))) * _MIX[0]
            by_class = ((k.view(np.uint64) * _MIX[0]) ^ ctx.view(np.uint64)) * _MIX[1]
        same = np.zeros(len(k), bool)
        i, s, h = ids[order], st[order], h1[order]
        leader = np.maximum.accumulate(np.where(repeats[order], 0, np.arange(len(k))))
        same[order] = (i == i[leader]) & (s == s[leader]) & (h == h[leader])
        dup = repeats & ~same
        grams, place, many = np.unique(k, return_inverse=True, return_counts=True)
        firsts = np.bincount(place[~repeats], minlength=len(grams))
        hot = (firsts > HOT_RUNS)[place] & ~dup
        key = np.where(dup, dealt.view(np.int64), np.where(hot, by_class.view(np.int64), k))
        told = grams[firsts > HOT_RUNS]
        none, zeros = np.zeros(len(told), bool), np.zeros(len(told), np.int32)
        longs = [np.concatenate(x) for x in ((key, told), (ctx, ~told))]
        ints = [np.concatenate([x.astype(np.int32), zeros]) for x in (st, n, o)]
        flags = [np.concatenate([x, none]) for x in (dup, hot)]
        whose = pa.array(np.concatenate([row, zeros]))
        columns = [*map(pa.array, longs), batch.column(0).take(whose), batch.column(1).take(whose), *map(pa.array, ints), *map(pa.array, flags)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUNS.split(", ")])

    return keyed.mapInArrow(run, RUNS)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, z): z, the text's bytes with zstd, is what a shuffle of texts moves."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.col("text").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([pack(x.as_py() or b"") for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["doc_id", "h1", "z"])

    return keyed.mapInArrow(run, "doc_id long, h1 long, z binary")


def _join_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """packed docs with the lists of their keys; ids may be null."""
    texts = packed(docs).withColumn("rank", F.coalesce("doc_id", F.lit(LAST)))
    right = lists.withColumn("rank", F.coalesce("doc_id", F.lit(LAST))).drop("doc_id")
    return texts.join(right, ["rank", "h1"], how)


PARTS = 2  # in which the first round is done, one after the other: half the disk
SHIFT = 7  # a run has fewer than 1 << SHIFT bytes that a rank starts at


def doubtful_runs(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(runs that repeat wholly: doc_id, h1, st, n; earliest runs of classes that share a gram:
    run, doc_id, h1, st, n, o). `run` numbers rise with (doc_id, h1, st), null ids last."""
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "h1", F.col("st").alias("at"))
    classes, grams = Window.partitionBy("k", "ctx"), Window.partitionBy("k")
    runs = find_runs(docs, threshold).repartition("k")
    runs = runs.withColumn("least", F.min(place).over(classes)).withColumn("several", F.col("hot") | (F.min("ctx").over(grams) != F.max("ctx").over(grams)))
    runs = runs.where("n > 0").withColumn("gone", F.col("dup") | (F.col("least") != place)).where(F.col("gone") | F.col("several"))
    with arrow_batches(docs.sparkSession, TEXTS):
        marks = materialize(runs.select("doc_id", "h1", "st", "n", F.when(~F.col("gone"), F.col("o")).alias("o"), "gone"), "runs")
    release(docs.sparkSession)
    ordered = [F.coalesce("doc_id", F.lit(LAST)), F.col("h1"), F.col("st")]
    doubt = marks.where(~F.col("gone")).drop("gone").distinct().repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    return marks.where("gone").drop("gone", "o"), materialize(doubt.withColumn("run", F.monotonically_increasing_id()), "doubt")


def with_bytes(docs: DataFrame, doubt: DataFrame, threshold: int) -> DataFrame:
    """(run, n, o, data): the bytes of all windows of each run."""
    lists = doubt.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("run", "st", "n", "o")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z, runs in zip(batch.column(0), batch.column(1), strict=True):
                data, runs = unpack(z.as_py()), runs.as_py()
                for at in range(0, len(runs), 8192):
                    part = runs[at : at + 8192]
                    columns = [pa.array([r[c] for r in part], t) for c, t in (("run", pa.int64()), ("n", pa.int32()), ("o", pa.int32()))]
                    pieces = pa.array([data[r["st"] : r["st"] + r["n"] + threshold - 1] for r in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([*columns, pieces], ["run", "n", "o", "data"])

    return _join_texts(docs, lists, "inner").select("z", "runs").mapInArrow(cut, "run long, n int, o int, data binary")


def judged_regions(slices: DataFrame, threshold: int, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """slices, written. (windows that repeat together with all others of their GRID of offsets: run, st,
    en, the first and the last start in the run; slices and `mask`, a bit for each GRID in doubt)."""
    c = F.col
    last = threshold - gram
    each = slices.select("run", "n", "o", "data", F.explode(F.sequence(F.lit(0), F.lit(last // GRID))).alias("j"))
    low, high = c("j") * GRID, F.least((c("j") + 1) * GRID - 1, F.lit(last))
    # What all windows of the grid share, and what they cover; of the cover only this run's own windows count.
    first, final = F.greatest(low, c("o") - c("n") + 1), F.least(high, c("o"))
    shared = F.xxhash64("j", F.substring("data", c("o") - low + 1, low + threshold - high))
    cover = F.xxhash64("j", first, final, F.substring("data", c("o") - final + 1, final + threshold - first))
    regions = each.where((first <= final) & (low <= c("o")))
    regions = regions.select("run", "j", shared.alias("region"), cover.alias("cover"), (c("o") - final).alias("st"), (c("o") - first).alias("en"))
    regions = materialize(regions, "regions")
    covers = materialize(regions.groupBy("region", "cover").agg(F.min("run").alias("least"), F.count(F.lit(1)).alias("met")), "covers")
    kinds = materialize(covers.groupBy("region").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.lit(1)).alias("rows")), "kinds")
    told = materialize(joined(covers, kinds, "region", "rows").where("kinds > 1 or met > 1"), "told")
    told = materialize(joined(regions, told, ["region", "cover"], "met"), "judged")
    alive = told.where("run = least and kinds > 1").groupBy("run").agg(F.sum(F.expr("shiftleft(1, j)")).cast("int").alias("mask"))
    return told.where("run <> least").select("run", "st", "en"), slices.join(alive, "run")


def first_ranks(slices: DataFrame, threshold: int, gram: int = GRAM, part: int = 0, parts: int = 1) -> DataFrame:
    """(p, a, b, starts, halves): positions that doubling looks at, p in the order of places, with the
    first ranks at p and p + gram. starts: a window starts there; halves: one starts `tail` before.
    Of several parts, by the rank at p, only one."""
    tail = threshold - 2 * gram  # the second round's offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, o, mask = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("run", "n", "o", "mask"))
            pieces = batch.column(batch.schema.get_field_index("data"))
            data = b"".join(x.as_py() for x in pieces)
            size = n + threshold - 1
            base = np.cumsum(size) - size
            names = gram_hashes(np.frombuffer(data, np.uint8), gram).view(np.int64)
            who = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            alive = (mask[who] >> ((o[who] - i) // GRID)) & 1 > 0
            who, i = who[alive], i[alive]
            at = np.concatenate([who * (1 << SHIFT) + i, who * (1 << SHIFT) + i + tail])
            at, place = np.unique(at, return_inverse=True)
            starts, halves = np.zeros(len(at), bool), np.zeros(len(at), bool)
            starts[place[: len(i)]], halves[place[len(i) :]] = True, True
            mine = names[base[at >> SHIFT] + (at & ((1 << SHIFT) - 1))] % parts == part
            at, starts, halves = at[mine], starts[mine], halves[mine]
            who, i = at >> SHIFT, at & ((1 << SHIFT) - 1)
            spot = base[who] + i
            columns = (ids[who] * (1 << SHIFT) + i, names[spot], names[spot + gram], starts, halves)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["p", "a", "b", "starts", "halves"])

    return slices.select("run", "n", "o", "mask", "data").mapInArrow(run, "p long, a long, b long, starts boolean, halves boolean")


def reranked(pairs: DataFrame, name: str) -> DataFrame:
    """pairs: (p, a, b, ...). Those that are not alone with (a, b), and `rank`: the pair's least p."""
    ranks = pairs.groupBy("a", "b").agg(F.min("p").alias("rank"), F.count(F.lit(1)).alias("met")).where("met > 1")
    ranks = materialize(ranks, name)
    release(pairs.sparkSession)
    return joined(pairs, ranks, ["a", "b"], "met").drop("a", "b")


def repeated_windows(slices: DataFrame, threshold: int, gram: int = GRAM) -> DataFrame:
    """slices: of judged_regions, written. (run, spans): the windows that start earlier as well, as
    spans (st, en) of window starts in the run, both inclusive."""
    tail = threshold - 2 * gram
    if not 0 <= tail <= 2 * gram or threshold - gram + tail >= 1 << SHIFT:
        raise ValueError("two rounds rank 2 * gram to 4 * gram bytes")
    spark, parts = slices.sparkSession, []
    for part in range(PARTS):  # equal pairs lie in one part; each gives up its shuffles before the next
        with scratch(spark):
            parts.append(kept(reranked(first_ranks(slices, threshold, gram, part, PARTS), "ranks"), "halves"))
    halves = reduce(DataFrame.unionByName, parts)
    # A window is the pair of the ranks at its start and `tail` after it; together they span it.
    sides = F.array(
        F.when(F.col("starts"), F.struct("p", F.col("rank").alias("a"), F.lit(None).cast("long").alias("b"))),
        F.when(F.col("halves"), F.struct((F.col("p") - tail).alias("p"), F.lit(None).cast("long").alias("a"), F.col("rank").alias("b"))),
    )
    each = halves.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select("s.*")
    pairs = each.groupBy("p").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a is not null and b is not null")
    pairs = materialize(pairs, "pairs")
    release(spark)
    found = reranked(pairs, "windows").where("p <> rank")
    low = (1 << SHIFT) - 1
    each = found.groupBy(F.shiftright("p", SHIFT).alias("run")).agg(F.sort_array(F.collect_list(F.col("p").bitwiseAND(F.lit(low)).cast("int"))).alias("at"))
    edges = lambda step: F.filter("at", lambda x: ~F.array_contains("at", x + step))
    return each.select("run", F.arrays_zip(edges(-1).alias("st"), edges(1).alias("en")).alias("spans"))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs: (doc_id, text). (doc_id, h1, spans): overlapping spans (st, en) of bytes to remove."""
    spark = docs.sparkSession
    gone, doubt = doubtful_runs(docs, threshold)
    release(spark)
    with scratch(spark):
        with scratch(spark), arrow_batches(spark, TEXTS):
            whole_grids, slices = judged_regions(materialize(with_bytes(docs, doubt, threshold), "slices"), threshold)
            whole_grids, slices = kept(whole_grids, "grids"), kept(slices, "masked")
        with arrow_batches(spark, 16 * TEXTS):
            found = kept(repeated_windows(slices, threshold), "repeated")
        starts = kept(found.select("run", F.inline("spans")).unionByName(whole_grids), "starts")
    each = doubt.select("run", "doc_id", "h1", F.col("st").alias("from")).join(starts, "run")
    windows = each.select("doc_id", "h1", (F.col("from") + F.col("st")).alias("st"), (F.col("from") + F.col("en") + threshold).alias("en"))
    whole = gone.select("doc_id", "h1", "st", (F.col("st") + F.col("n") + threshold - 1).alias("en"))
    return whole.unionByName(windows).groupBy("doc_id", "h1").agg(F.collect_list(F.struct("st", "en")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans; those that touch are one."""
    out: list[tuple[int, int]] = []
    for st, en in sorted((s["st"], s["en"]) for s in spans or ()):
        if out and st <= out[-1][1]:
            if en > out[-1][1]:
                out[-1] = (out[-1][0], en)
        else:
            out.append((st, en))
    return out


KEPT = "doc_id long, h1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(docs: DataFrame, threshold: int = THRESHOLD, keep_bytes: bool = False) -> DataFrame:
    """One row per row of docs: KEPT, spans (maximal), and the remaining bytes with keep_bytes."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for i, h, z, found in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "h1", "z", "spans")), strict=True):
                    data, gone = unpack(z), merged(found)
                    ends = [0, *(x for s in gone for x in s), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                    flat = [{"st": a, "en": b} for a, b in gone]
                    out.append((i, h, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), flat, kept if keep_bytes else None))
                span = pa.list_(pa.struct([("st", pa.int32()), ("en", pa.int32())]))
                types = (*[pa.int64()] * 5, pa.string(), span, pa.binary())
                arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*(c.split()[0] for c in KEPT.split(", ")), "spans", "kept"])

    with scratch(docs.sparkSession):
        spans = repeated_spans(docs, threshold)
        judged = _join_texts(docs, spans, "left").select("doc_id", "h1", "z", "spans")
        judged = judged.mapInArrow(apply, f"{KEPT}, spans array<struct<st:int,en:int>>, kept binary")
        with arrow_batches(docs.sparkSession, TEXTS):
            judged = kept(judged, "judged")
    counted = judged.groupBy(*judged.columns).agg(F.count(F.lit(1)).alias("copies"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    all_gone = (F.col("copy") > 1) & (F.col("n_bytes") >= threshold)
    whole = F.array(F.struct(F.lit(0).alias("st"), F.col("n_bytes").cast("int").alias("en")))
    return each.select(
        "doc_id", "h1", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(all_gone, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(all_gone & F.lit(keep_bytes), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("kept")).alias("kept"),
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
