"""Near-duplicates by SimHash with an exact check: Jaccard similarity of 0.8 or more on five words.

A text's set holds the XXH64 hashes of its five-word shingles; the majority of their bits is its
fingerprint. Tiled comparison (`simhash.links`) proposes links between fingerprints within RADIUS.
Pairs of that similarity may lie up to some 14 bits apart, where tiles skip nothing, so an exact way
finds the rest: two sets of similarity 0.8 share one of their first n - ceil(0.8 n) + 1 hashes in any
common order (prefix filter), and only pairs that meet there, with sizes and places that leave room
for 0.8, are candidates. Common hashes, counted on one document in 16, stand last in the order, and
those that many prefixes still hold are put off once more, before them, so they seldom bring unlike
sets together; the order is free, so nothing is lost.

Every candidate is verified, first on a bitmap of a bit or more for each hash, in which a bit tells
whether an odd number of hashes fell there: bits that differ between two sets are no more than
hashes that differ. What passes is verified on whole sets. This goes in rounds: one set of each
meeting is tried with all others there that are not yet in its group, and leaves the meeting, all
its pairs there being decided. So a round makes no more pairs than there are rows, and a large group
of near copies soon is one group, whose pairs need no trial. Once the pairs left are few, or rounds
find no links, all of them are tried. Sets that are many, all unlike, and share most hashes still
cost all their pairs: nothing tells them apart but a trial.

Defined cases: texts without words are alike; a text of under five words is one shingle; equal sets
are one node, named by a 64-bit digest; an empty table gives no groups; rows that repeat, and null
ids, are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeloom.llm.common import joined, kept, materialize, scratch
from strokeloom.llm.graph import components
from strokeloom.llm.simhash import BLOCK, majority
from strokeloom.llm.simhash import links as simhash_links

SHINGLE = 5
SEED = 42
RADIUS = 3  # of the fingerprints that propose links
SAMPLE = 16  # one document of so many tells which hashes are common
COMMON = 4  # in so many documents of the sample
MAX_COMMON = 200_000  # hashes sent to all tasks; the order is free, so this bounds memory and loses nothing
CROWD_SAMPLE = 4  # one set of so many tells which hashes too many prefixes hold
CROWD = 4  # of the sampled prefixes; more are too many
MAX_CROWDED = 1 << 20  # as MAX_COMMON


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    each = map(b" ".join, zip(*(islice(words, k, None) for k in range(min(shingle, len(words)))), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(SEED)), np.uint64).view(np.int64))


def odd_bits(found: np.ndarray) -> bytes:
    """For each of n to 2 n cells (a power of two, 64 at least), whether an odd number of hashes fell there."""
    cells = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    return np.packbits(np.bincount(found & (cells - 1), minlength=cells) & 1, bitorder="little").tobytes()


def far_apart(one: bytes, two: bytes, n: int, m: int) -> bool:
    """True only if sets of n and m hashes with these bits can't have a similarity of 0.8."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)), key=len)
    while len(y) > len(x):  # cells of the smaller table are those of the larger one, laid upon each other
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) > n + m


def prefix(found: np.ndarray, common: np.ndarray, crowded: np.ndarray | None = None) -> np.ndarray:
    """The hashes by which a set meets all sets of similarity 0.8 or more, in the common order: by
    value, then the crowded, then the common ones (both sorted)."""
    n = len(found)
    for later in (crowded, common):
        if later is not None and len(later):
            at = np.minimum(np.searchsorted(later, found), len(later) - 1)
            late = later[at] == found
            found = np.concatenate([found[~late], found[late]])
    return found[: n - (4 * n + 4) // 5 + 1]


TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _mapped(docs: DataFrame, keys: list[str], row, schema: str) -> DataFrame:
    """keys of docs and row(text) for each row; schema: of what row returns."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [TYPES[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            for at in range(0, len(texts), 256):
                found = [row(t.as_py()) for t in texts.slice(at, 256)]
                made = [pa.array(list(x), t) for x, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 256) for k in range(len(keys))), *made], keys + names)

    given = ", ".join(f"{k} long" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{given}, {schema}")


def common_hashes(docs: DataFrame) -> np.ndarray:
    """docs: (_h1, text). Sorted hashes that many documents hold, as a sample tells."""
    sample = docs.where(F.pmod("_h1", F.lit(SAMPLE)) == 0)
    each = _mapped(sample, ["_h1"], lambda t: (shingles(t),), "grams array<long>").select(F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "gram").limit(MAX_COMMON).select("gram").toArrow()["gram"].to_numpy())


def with_sets(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """docs: (_rank, _h1, _h2, text). Each row's keys, `set`, its size n, its fingerprint, bits and prefix."""
    common = docs.sparkSession.sparkContext.broadcast(common)

    def row(text: str | None):
        found = shingles(text)
        blocks = (found[at : at + BLOCK].view(np.uint64) for at in range(0, len(found), BLOCK))
        return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63), len(found), majority(blocks), odd_bits(found), prefix(found, common.value)

    return _mapped(docs, ["_rank", "_h1", "_h2"], row, "set long, n int, fp long, odd binary, grams array<long>")


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(set, text) of the asked sets' first documents; rows alike repeat."""
    return docs.join(nodes.select("set", "_rank", "_h1", "_h2").join(asked, "set"), ["_rank", "_h1", "_h2"])


def put_off(docs: DataFrame, nodes: DataFrame, common: np.ndarray) -> DataFrame:
    """nodes, whose prefixes are in the order of common, in one where hashes that many prefixes hold
    stand right before the common ones. A prefix without such hashes is the same in both orders."""
    spark = docs.sparkSession
    sample = nodes.where(F.pmod("set", F.lit(CROWD_SAMPLE)) == 0).select(F.explode("grams").alias("gram"))
    counts = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowded = counts.orderBy(F.desc("n"), "gram").limit(MAX_CROWDED).select("gram").toArrow()["gram"].to_numpy()
    crowded = np.setdiff1d(crowded, common)
    if not len(crowded):
        return nodes
    crowd = spark.createDataFrame(pa.table({"gram": crowded}))
    asked = nodes.select("set", F.explode("grams").alias("gram")).join(F.broadcast(crowd), "gram", "left_semi").select("set").distinct()
    order = spark.sparkContext.broadcast((common, crowded))
    anew = _mapped(_texts(docs, nodes, asked), ["set"], lambda t: (prefix(shingles(t), *order.value),), "anew array<long>")
    anew = materialize(anew.dropDuplicates(["set"]), "anew")
    return nodes.join(anew, "set", "left").withColumn("grams", F.coalesce("anew", "grams")).drop("anew")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more: by their bits, then counted on their whole sets."""
    side = lambda name: nodes.select(F.col("set").alias(name), F.struct("n", "odd").alias(f"of_{name}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a.n", "of_a.odd", F.col("of_b.n").alias("m"), F.col("of_b.odd").alias("odd2"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, m, two = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [not far_apart(*x) for x in zip(one, two, n, m, strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).columns), ["a", "b"])

    pairs = materialize(both.mapInArrow(near, "a long, b long"), "candidates")
    asked = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    texts = _texts(docs, nodes, asked).dropDuplicates(["set"])
    sets = materialize(_mapped(texts, ["set"], lambda t: (shingles(t),), "grams array<long>"), "sets")
    left, right = sets.select(F.col("set").alias("a"), F.col("grams").alias("left")), sets.select(F.col("set").alias("b"), F.col("grams").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    return pairs.join(left, "a").join(right, "b").where(9 * shared >= 4 * (F.size("left") + F.size("right"))).select("a", "b")


MAX_BROADCAST_GRAMS = 1 << 20  # of 16 bytes: hashes that several sets share; more are joined by a shuffle


def _proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are alike, or within RADIUS by way of the tiles."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("set").alias("least"), F.max("set").alias("most")), "prints")
    near = simhash_links(prints.select("fp"), RADIUS)
    least = lambda name: prints.select(F.col("fp").alias(name), F.col("least").alias(f"of_{name}"))
    linked = near.join(least("a"), "a").join(least("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    alike = nodes.join(prints.where("least <> most"), "fp").where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b"))
    return linked.union(alike)


ROUNDS = 8  # of one set of each meeting with all others


def _room(of: str, other: str) -> Column:
    """Whether the first hash that two sets share in the common order, at these places, leaves room for 4/9 of both sizes."""
    n, place, m, spot = F.col(f"{of}n"), F.col(f"{of}place"), F.col(f"{other}n"), F.col(f"{other}place")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - place, m - spot) >= 4 * (n + m))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("set", "o_set").alias("a"), F.greatest("set", "o_set").alias("b"))


def _meetings(nodes: DataFrame) -> DataFrame:
    """(gram, set, n, place) of each prefix's hashes that other prefixes hold, too."""
    prefixes = nodes.select("set", "n", F.posexplode("grams").alias("place", "gram"))
    often = materialize(prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "often")
    if often.count() <= MAX_BROADCAST_GRAMS:
        return prefixes.join(F.broadcast(often.select("gram")), "gram", "left_semi")
    return joined(prefixes, often, "gram", "met")


def _open(meetings: DataFrame) -> tuple[DataFrame, int]:
    """meetings: (gram, set, n, place, root). Of each meeting of several groups: how many rows it has,
    their least size, and the one whose turn it is, with the fewest rare hashes: a copy of few changes
    is near the most others. And how many pairs of different groups are left in all."""
    each = meetings.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.min(F.struct("place", F.xxhash64("set").alias("draw"), "set", "n", "root")).alias("o"))
    whole = each.groupBy("gram").agg(F.sum("k").alias("met"), F.sum(F.col("k").cast("double") ** 2).alias("alike"), F.min("least").alias("o_least"), F.min("o").alias("o"), F.count(F.lit(1)).alias("groups"))
    whole = whole.where("groups > 1").withColumn("left", (F.col("met").cast("double") ** 2 - F.col("alike")) / 2)
    table = materialize(whole.select("gram", "met", "left", "o_least", *(F.col(f"o.{k}").alias(f"o_{k}") for k in ("set", "n", "place", "root"))), "turn")
    return table.drop("left"), int(table.agg(F.sum("left")).first()[0] or 0)


def groups(docs: DataFrame, placed: DataFrame, common: np.ndarray) -> DataFrame:
    """docs as for with_sets, placed: its result, written. (set, root) of each set in a group of several."""
    c = F.col
    spark = docs.sparkSession
    with scratch(spark):
        with scratch(spark):
            nodes = kept(put_off(docs, materialize(placed.dropDuplicates(["set"]), "nodes"), common), "nodes")
        with scratch(spark):
            meetings = kept(_meetings(nodes).withColumn("root", c("set")), "meetings")
        few = meetings.count()  # rows of meetings
        links, fresh = None, -1
        for turn in range(ROUNDS + 1):
            with scratch(spark):
                table, left = _open(meetings)
                if not left and links is not None:
                    break
                met = joined(meetings, table, "gram", "met")
                # The last round, when no more pairs than rows are left, tries all; the first has the tiles' links, too.
                last = links is not None and (left <= few or not fresh or turn == ROUNDS)
                if last:
                    met = materialize(met.select("gram", "set", "n", "place", "root"), "open")
                    other = met.select("gram", *(c(k).alias(f"o_{k}") for k in ("set", "n", "place", "root")))
                    tried = _pairs(met.join(other, "gram").where((c("set") < c("o_set")) & (c("root") != c("o_root")) & _room("", "o_")))
                else:
                    tried = _pairs(met.where((c("root") != c("o_root")) & _room("", "o_")))
                if links is None:
                    tried = tried.union(_proposed(nodes))
                more = kept(_verified(tried, docs, nodes), "verified")
                fresh = more.count()
                links = more if links is None else links.union(more)
                if not last:
                    # Whose turn it was has been tried with all in the meeting but its own group: it may leave,
                    # and so may a set whose first shared hash comes too late for even the smallest one.
                    roots = components(links).select(c("node").alias("set"), c("root").alias("found"))
                    rest = met.where((c("set") != c("o_set")) & (9 * (c("n") - c("place")) >= 4 * (c("n") + c("o_least")))).drop("root", "o_least", *(f"o_{k}" for k in ("set", "n", "place", "root")))
                    meetings = kept(rest.join(roots, "set", "left").select("gram", "set", "n", "place", F.coalesce("found", "set").alias("root")), "meetings")
            if last:
                break
        out = components(links).select(c("node").alias("set"), "root")
        return kept(out, "near")
