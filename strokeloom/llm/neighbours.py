"""Approximate nearest neighbours by cosine, on robust-pruned directed graphs.

Distinct vectors are dealt by hash into shards of SHARD_BYTES. Each shard is one graph: points are
inserted in batches, a greedy search from the entry point proposes their neighbours, and robust
pruning keeps an edge only if no kept, nearer neighbour is closer to its target by the factor ALPHA.
Edges back are added and pruned alike. A query's beam search runs on every shard; what the beams
find is scored again in double precision on the original vectors, and the best of all shards are
kept.

Graphs never move once built: a task reads the shards that lie in its files, and queries come to it
as one block, broadcast under a bound of PASS_BYTES; more queries are more passes. A task merges what
its shards find, so k rows of a query leave a task, whatever the number of its shards.

Equal vectors are one point that carries its k + 1 least ids: more of them can't be among the k
nearest of any query. Every row is thus indexed.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part; vectors of different length are never compared; rows alike in id and vector count once; a
query meets no row of its own id; equal scores stand in order of ids; fewer candidates than k give
fewer rows, an empty table none; where norms overflow or vanish in double precision, vectors are
scaled by their largest component first; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom.llm.common import arrow_batches, materialize

K = 5
EVERY = 50
SHARD_BYTES = 32 << 20  # of a shard's vectors, as doubles; a graph adds a fifth
LEAST_ROWS = 4096  # small tables are cut into shards of so many rows, up to LEAST_SHARDS of them
LEAST_SHARDS = 16
PASS_BYTES = 16 << 20  # of the query vectors that are broadcast at once
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 128
EXPAND = 4  # beam entries expanded at once
ALPHA = 1.2
BATCH = 512
RESCORED = 24


def beam_search(queries: np.ndarray, points: np.ndarray, graph: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query: ids (-1: none) and dot products, best first."""
    b, n = len(queries), len(points)
    ids = np.full((b, beam), -1)
    sims = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, queries @ points[entry], True
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no point
    seen[:, [entry, n]] = True
    live = np.arange(b)
    while len(live):
        at = np.arange(len(live))[:, None]
        # The best open entries; the beam is in order, so they are its first ones.
        first = np.argsort(~open_[live], axis=1, kind="stable")[:, :EXPAND]
        use = open_[live][at, first]
        picked = np.where(use, ids[live][at, first], n)
        open_[live[:, None], first] = False
        near = np.sort(graph[picked].reshape(len(live), -1), axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        sim = np.einsum("bd,brd->br", queries[live], points[np.where(fresh, near, 0)], optimize=False)
        sim = np.where(fresh, sim, -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_sims = np.concatenate([sims[live], sim], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live], open_[live] = all_ids[at, order], all_sims[at, order], all_open[at, order]
        live = live[open_[live].any(axis=1)]
    return ids, sims


def robust_prune(of: np.ndarray, candidates: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Kept neighbours (n: none) of the points `of` from rows of candidate ids (n: none)."""
    n = len(points)
    candidates = np.sort(candidates, axis=1)
    bad = (candidates == n) | (candidates == of[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    held = points[np.where(bad, 0, candidates)]
    away = np.where(bad, np.inf, 1 - np.einsum("bd,bcd->bc", points[of], held, optimize=False))
    order = np.argsort(away, axis=1, kind="stable")
    at = np.arange(len(of))[:, None]
    candidates, away, held = candidates[at, order], away[at, order], held[at, order]
    between = 1 - held @ held.transpose(0, 2, 1)
    alive = np.isfinite(away)
    out = np.full((len(of), degree), n)
    rows = np.arange(len(of))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, k] = candidates[some, pick[some]]
        alive &= ~(some[:, None] & (alpha * between[rows, pick] <= away))
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """points: unit vectors. The graph, n + 1 rows of neighbour ids (n: none), and its entry point."""
    n = len(points)
    rng = np.random.default_rng(seed)
    graph = np.full((n + 1, degree), n)
    if n > 1:
        graph[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    entry = int((points @ points.mean(axis=0)).argmax())
    order = rng.permutation(n)
    for start in range(0, n, BATCH):
        batch = order[start : start + BATCH]
        ids, _ = beam_search(points[batch], points, graph, entry, beam)
        proposed = np.concatenate([np.where(ids < 0, n, ids), graph[batch]], axis=1)
        graph[batch] = robust_prune(batch, proposed, points, degree, alpha)
        # Edges back, a target at a time; targets with too many are pruned, those with most last.
        kept = graph[batch]
        to, back = kept.ravel(), np.repeat(batch, degree)
        to, back = to[to < n], back[to < n]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        by = np.argsort(counts, kind="stable")
        targets, first, counts = targets[by], first[by], counts[by]
        at = 0
        while at < len(targets):
            most = int(counts[min(at + 255, len(targets) - 1)])
            upto = at + max(1, min(256, (1 << 22) // (degree + most) ** 2))
            t, f, c = targets[at:upto], first[at:upto], counts[at:upto]
            width = int(c.max())
            add = np.minimum(f[:, None] + np.arange(width), len(back) - 1)
            add = np.where(np.arange(width) < c[:, None], back[add], n)
            both = np.concatenate([graph[t], add], axis=1)
            ordered = np.sort(both, axis=1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = n
            ordered = np.sort(ordered, axis=1)
            over = (ordered < n).sum(axis=1) > degree
            graph[t[~over]] = ordered[~over][:, :degree]
            if over.any():
                graph[t[over]] = robust_prune(t[over], ordered[over], points, degree, alpha)
            at = upto
    return graph.astype(np.int32), entry


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles scaled by nothing; rows alike once."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite).where(some).distinct()


INDEX = "dim int, shard long, n int, ids binary, vectors binary, graph binary, entry int"


def build_index(rows: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """rows of valid_vectors. One row per shard, written to the shared folder; ids holds k + 1 of each
    point, -1 where it has fewer."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points.withColumn("dim", F.size("v")), "points")
    n, held = points.agg(F.count(F.lit(1)), F.sum(F.col("dim").cast("long") * 8)).first()
    shards = max(1, -(-(held or 0) // shard_bytes), min(LEAST_SHARDS, -(-n // least_rows)))
    placed = points.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(shards)))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[x[0] for x in rows["ids"]]).sort_values("first", kind="stable")
        vectors = np.stack(rows["v"].to_list()).astype(np.float64)
        ids = np.full((len(rows), k + 1), -1)
        for at, x in enumerate(rows["ids"]):
            ids[at, : len(x)] = x
        graph, entry = build_graph(unit(_scaled(vectors)))
        row = (int(key[0]), int(key[1]), len(vectors), ids.tobytes(), vectors.tobytes(), graph.tobytes(), entry)
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return materialize(placed.groupBy("dim", "shard").applyInPandas(build, INDEX), "graphs")


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component: no norm overflows or vanishes."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def cosines(asked: np.ndarray, near: np.ndarray) -> np.ndarray:
    """asked: b x d, near: b x c x d. Cosines of the vectors as they are; scaled ones only where a
    square is beyond double precision."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        squares = np.einsum("bd,bd->b", asked, asked, optimize=False)[:, None], np.einsum("bcd,bcd->bc", near, near, optimize=False)
        found = np.einsum("bd,bcd->bc", asked, near, optimize=False) / (np.sqrt(squares[0]) * np.sqrt(squares[1]))
    bad = (squares[0] < 1e-290) | (squares[1] < 1e-290) | (squares[0] > 1e290) | (squares[1] > 1e290)
    if bad.any():
        i, j = np.nonzero(bad)
        x, y = _scaled(asked[i]), _scaled(near[i, j])
        found[i, j] = np.einsum("rd,rd->r", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    return found


FOUND = "query_id long, q long, vec_id long, score double"


class Best:
    """The k nearest found so far of each query of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found, self.scores = np.full((len(ids), k), -1), np.full((len(ids), k), -np.inf)

    def search(self, ids: np.ndarray, raw: np.ndarray, graph: np.ndarray, entry: int, beam: int) -> None:
        """Looks through one shard. ids: n x (k + 1), raw: its vectors."""
        points = unit(_scaled(raw))
        for at in range(0, len(self.ids), BATCH):
            mine = slice(at, at + BATCH)
            asked = self.vectors[mine]
            near, _ = beam_search(unit(_scaled(asked)), points, graph, entry, beam)
            near = near[:, :RESCORED]
            scores = cosines(asked, raw[np.where(near < 0, 0, near)])
            found = np.where(near[:, :, None] < 0, -1, ids[near])
            found = np.where(found == self.ids[mine][:, None, None], -1, found).reshape(len(asked), -1)
            scores = np.where(found < 0, -np.inf, np.repeat(scores, ids.shape[1], axis=1))
            found, scores = np.hstack([self.found[mine], found]), np.hstack([self.scores[mine], scores])
            first = np.lexsort((found, -scores), axis=1)[:, : self.k]
            self.found[mine], self.scores[mine] = np.take_along_axis(found, first, 1), np.take_along_axis(scores, first, 1)


def search_index(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """queries: (vec_id, v). (query_id, rank, vec_id, score) of the k best found."""
    spark = queries.sparkSession
    asked = materialize(queries.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("q")), "queries")
    held = asked.agg(F.sum(F.col("dim").cast("long") * 8 + 16)).first()[0] or 0
    passes = -(-held // pass_bytes)
    found = spark.createDataFrame([], FOUND)
    for one in range(passes):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(passes)) == one).toArrow()
        by_dim = {}
        for dim in sorted(set(block["dim"].to_pylist())):
            part = block.filter(pa.compute.equal(block["dim"], dim))
            vectors = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            by_dim[dim] = (part["vec_id"].to_numpy(), part["q"].to_numpy(), vectors)
        found = found.unionByName(_search_pass(index, spark.sparkContext.broadcast(by_dim), k, beam))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    with arrow_batches(spark, 1):  # a shard at a time
        return materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def _search_pass(index: DataFrame, asked, k: int, beam: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(ids, vectors, k) for dim, (ids, _, vectors) in asked.value.items()}
        for batch in batches:
            for dim, _, n, ids, vectors, graph, entry in zip(*(batch.column(c) for c in range(7)), strict=True):
                if (mine := best.get(dim.as_py())) is not None:
                    flat = lambda x, kind, n=n.as_py(): np.frombuffer(x.as_buffer(), kind).reshape(n, -1)
                    mine.search(flat(ids, np.int64), flat(vectors, np.float64), np.frombuffer(graph.as_buffer(), np.int32).reshape(n.as_py() + 1, -1), entry.as_py(), beam)
        for dim, mine in best.items():
            some, place = np.nonzero(mine.found >= 0)
            columns = (mine.ids[some], asked.value[dim][1][some], mine.found[some, place], mine.scores[some, place])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return search_index(build_index(rows), rows.where(F.col("vec_id") % EVERY == 0))
