"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the majority, bit by bit, of the XXH64 hashes of a text's three-word shingles.
Distinct fingerprints are laid into cells by the population counts of four 16-bit parts; each cell
is cut into chunks, and these into tiles, of bounded size. Two fingerprints within the radius have
counts that differ by no more than the radius in all parts together, so tiles of cells farther apart
are skipped, without loss. All other tile pairs are compared whole, with numpy exclusive-or and bit
counts. A pair of tiles gives a spanning forest of its links, never all pairs. Pairs of chunks are
dealt to tasks evenly; a fingerprint or a group that many rows share is broadcast to them.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; a text of one or two words is one shingle; a very long text is hashed in blocks; rows that
repeat stay rows; a null doc_id takes part, and a group of such rows alone has a null component_id;
an empty table gives no rows; extra columns are not read and may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strokeloom.llm.common import documents, joined, materialize, quoted
from strokeloom.llm.graph import components, forest

SHINGLE = 3
SEED = 42
RADIUS = 2
TILE = 512  # fingerprints of a tile
CHUNK = 16_384  # of what is dealt to tasks: a whole number of tiles
PARTS = 4
BASE = 24  # over 16 + 2 * RADIUS: steps between cells never carry over
BLOCK = 1 << 16  # hashes of a text held at once


def majority(blocks: Iterator[np.ndarray]) -> int:
    """Of blocks of 64-bit hashes, the bits set in over half of them all, as a signed integer; none: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for block in blocks:
        n += len(block)
        bits = np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64)
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    each = map(b" ".join, zip(*(islice(words, k, None) for k in range(size)), strict=False))
    hashes, n = map(xxhash.xxh64_intdigest, each, repeat(SEED)), len(words) - size + 1
    return majority(np.fromiter(islice(hashes, BLOCK), np.uint64, min(BLOCK, n - at)) for at in range(0, n, BLOCK))


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """docs and a column of 64-bit fingerprints, as signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = pa.array([fingerprint(x.as_py()) for x in batch.column(at)], pa.int64())
            yield batch.append_column(name, found)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def compare_tiles(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles, or within one, as pairs of fingerprints."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i) <= 2:
        return left[i], right[j]
    both = np.concatenate([left, right])
    if same:
        node, root = forest(len(left), i, j)
    else:
        node, root = forest(len(both), i, j + len(left))
    return both[node], both[root]


def compare_chunks(left: np.ndarray, right: np.ndarray, radius: int, same: bool, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """compare_tiles for all tiles of two chunks, or of one. A chunk stands in order of population
    counts, so a tile is a range of them, and tile pairs whose ranges lie apart are skipped."""
    out, sides = [], []
    for x in (left, right):
        x = x[np.argsort(np.bitwise_count(x), kind="stable")]
        cuts = [x[k : k + tile] for k in range(0, len(x), tile)]
        sides.append([(c, int(np.bitwise_count(c[0])), int(np.bitwise_count(c[-1]))) for c in cuts])
    for i, (a, a_least, a_most) in enumerate(sides[0]):
        for j, (b, b_least, b_most) in enumerate(sides[1]):
            if a_least - b_most > radius or b_least - a_most > radius or (same and j < i):
                continue
            found = compare_tiles(a, b, radius, same and i == j)
            if len(found[0]):
                out.append(found)
    return out


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """prints: distinct (fp). Links (a, b) that span every group of fingerprints within the radius."""
    width = 64 // PARTS
    if 2 * radius + width >= BASE:
        raise ValueError("radius too large for the cells")
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1)))
    code = lambda steps: sum(s * BASE**k for k, s in enumerate(steps))
    cell = sum((part(k) + radius).cast("long") * BASE**k for k in range(PARTS))
    placed = prints.select("fp", cell.alias("cell"))
    # At most 17^4 rows of two numbers, whatever the input: small enough to broadcast.
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    chunked = placed.join(F.broadcast(cells), "cell").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    tiles = materialize(chunked.groupBy("cell", "chunk").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")

    # Pairs of chunks are dealt first, as rows of numbers; a task then gets whole pairs, evenly.
    ahead = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius and s[::-1] >= (0,) * PARTS]
    steps = F.explode(F.array(*(F.lit(code(s)).cast("long") for s in ahead)))
    here = tiles.select(F.col("cell").alias("from"), F.col("chunk").alias("from_chunk"), F.col("fps").alias("left"))
    asks = tiles.select(F.col("cell").alias("from"), F.col("chunk").alias("from_chunk"), steps.alias("step"))
    asks = asks.withColumn("cell", F.col("from") + F.col("step")).join(F.broadcast(cells), "cell")
    asks = asks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("step <> 0 or from_chunk <= chunk")
    pairs = asks.join(here, ["from", "from_chunk"]).join(tiles, ["cell", "chunk"])
    pairs = pairs.select("left", F.col("fps").alias("right"), F.expr("step = 0 and from_chunk = chunk").alias("same"))
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.sparkSession.sparkContext.defaultParallelism * 2)
    pairs = pairs.repartition(tasks, F.xxhash64("left"), F.xxhash64("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sides = []
            for name in ("left", "right"):
                column = batch.column(batch.schema.get_field_index(name))
                values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
                sides.append((values, column.offsets.to_numpy()))
            (lv, lo), (rv, ro) = sides
            same = batch.column(batch.schema.get_field_index("same")).to_pylist()
            for k, alone in enumerate(same):
                found += compare_chunks(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], radius, alone, tile)
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicate_groups(printed: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """printed: rows with `_fp`. Returns (_fp, _root, component_id, n): a fingerprint that names the
    group, the group's least doc_id, and how many rows have the fingerprint."""
    prints = materialize(printed.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    roots = components(links(prints.select("fp"), radius))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    named = joined(placed, materialize(least, "roots"), "root", "prints")
    return named.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), "component_id", "n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, _fp, component_id."""
    printed = materialize(with_fingerprints(docs.select(*(c.alias(n) for c, n in zip(quoted([doc_id, text]), ("doc_id", "text"), strict=True)))).select("doc_id", "_fp"), "simhash")
    groups = materialize(near_duplicate_groups(printed, "doc_id", radius).drop("_root"), "groups")
    return joined(printed, groups, "_fp", "n")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
