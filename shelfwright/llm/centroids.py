"""Lloyd's clustering of integer vectors with ns-bounds (operator 11).

Every centroid of every round is kept. A vector stores an upper bound of the distance to its own centroid and a lower bound for each other one,
each with the round in which it was evaluated. Later the bound is loosened by the norm of the centroid's displacement between that round
and now - never more than the sum of its drifts round by round. Where the loosened bounds don't prove that the own centroid is still the
nearest, the centroids in question are scanned again, in exact integers, so that the result is that of plain Lloyd rounds.

The vectors never leave their tasks. A round is one pass over a written table; tasks give partial sums, and the driver gets k rows of sums and
holds (rounds + 1) * k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, save

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components are below this, so that squared distances fit in 63 bits.
MOST = 2**27
#: Bounds are floating-point numbers; they are trusted up to this share of their size.
SLACK = 1e-9


def distances(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    diff = q - centroid
    return np.einsum("ij,ij->i", diff, diff)


class Bounds:
    """What is known of some vectors: cluster, upper bound and its round, lower bounds and their rounds."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, since: np.ndarray, low: np.ndarray, low_since: np.ndarray):
        self.cluster, self.upper, self.since, self.low, self.low_since = cluster, upper, since, low, low_since
        self.scanned = 0


def first_scan(q: np.ndarray, centroids: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """Bounds from all distances, which are returned as the nearest ones."""
    d = np.stack([distances(q, c) for c in centroids], 1)
    cluster = d.argmin(1).astype(np.int32)
    own = d[np.arange(len(q)), cluster]
    bounds = Bounds(cluster, np.sqrt(own), np.zeros(len(q), np.int16), np.sqrt(d), np.zeros(d.shape, np.int16))
    bounds.scanned = d.size
    return bounds, own


def reassign(q: np.ndarray, b: Bounds, history: list[np.ndarray], exact: bool) -> np.ndarray | None:
    """Move each vector to its nearest centroid of the last round in history (ties: the smaller number). exact: return its squared distance."""
    now = len(history) - 1
    moved = np.stack([np.sqrt(((history[now] - old).astype(np.float64) ** 2).sum(1)) for old in history])  # (round, centroid)
    k, rows = len(history[now]), np.arange(len(q))
    gone = moved[b.low_since, np.arange(k)]
    low = b.low - gone
    low -= SLACK * (b.low + gone)
    far = moved[b.since, b.cluster]
    upper = b.upper + far
    upper += SLACK * (upper + far)
    low[rows, b.cluster] = np.inf
    fails = np.flatnonzero((low <= upper[:, None]).any(1))
    own = np.full(len(q), -1, np.int64)
    # the own distance first: with it, most failures are settled
    for j in range(k):
        at = (rows if exact else fails)[b.cluster[rows if exact else fails] == j]
        own[at] = distances(q[at], history[now][j])
        b.scanned += len(at)
    at = np.flatnonzero(own >= 0)
    b.upper[at], b.since[at] = np.sqrt(own[at]), now
    b.low[at, b.cluster[at]], b.low_since[at, b.cluster[at]] = b.upper[at], now
    best, cluster = own.copy(), b.cluster.copy()
    for j in range(k):
        at = fails[low[fails, j] <= b.upper[fails] * (1 + SLACK)]
        if not len(at):
            continue
        d = distances(q[at], history[now][j])
        b.scanned += len(at)
        b.low[at, j], b.low_since[at, j] = np.sqrt(d), now
        nearer = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        best[at[nearer]], cluster[at[nearer]] = d[nearer], j
    changed = np.flatnonzero(cluster != b.cluster)
    b.cluster = cluster
    b.upper[changed], b.since[changed] = np.sqrt(best[changed]), now
    return best if exact else None


def kept_vectors(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, q): vectors of exactly `dims` components that are all finite numbers, as integers floor(scale * x)."""
    rows = pick(embeddings, "vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where((F.size("embedding") == dims) & finite)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def integers(column) -> np.ndarray:
    q = np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 0), np.int64)
    if q.size and max(-int(q.min()), int(q.max())) >= MOST:
        raise ValueError(f"components are below {MOST} in size after scaling")
    return q.astype(np.int64)


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of exactly `dims` finite components.

    Centroids start as the k vectors with the smallest sha256 of '<seed>:<vec_id>', in that order (equal ids by their components; rows without
    vec_id last). Each of `rounds` rounds assigns all vectors and then moves each non-empty centroid to the floored mean; then all are
    assigned once more. Fewer than k vectors make fewer clusters; none give no rows. Null vectors, those of another length and those with
    nulls or numbers that are not finite are left out. Repeated rows count each; other columns are not read. A component of 2^27 or more
    after scaling is an error, since distances would not fit in a long.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    vectors = save(kept_vectors(embeddings, dims, scale))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(place.asc_nulls_last(), "q").limit(k).collect()  # k rows
    if not chosen:
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).limit(0)
    history = [np.array([r["q"] for r in chosen], np.int64)]
    k = len(chosen)
    state = save(map_arrow(vectors, _first(history), f"vec_id {kind}, {STATE}"))
    for _ in range(rounds):
        history.append(moved_centroids(state, history[-1]))
        last = len(history) == rounds + 1
        step = map_arrow(state, _next(history, last), f"vec_id {kind}, cluster int, distance long" if last else f"vec_id {kind}, {STATE}")
        state = save(step)
    if not rounds:
        state = save(map_arrow(state, _next(history, True), f"vec_id {kind}, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(j, sums.get(j, 0), sum(sums.values()), digest(history[-1][j])) for j in range(k)]
    told = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


STATE = "q array<long>, cluster int, upper double, since short, low array<double>, low_since array<short>"


def _batch(vec_id, q, b: Bounds) -> pa.RecordBatch:
    width = b.low.shape[1]
    lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n, dtype=np.int32)), pa.array(x.reshape(-1)))
    columns = [vec_id, q, pa.array(b.cluster, pa.int32()), pa.array(b.upper), pa.array(b.since, pa.int16()), lists(b.low, width), lists(b.low_since, width)]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "q", "cluster", "upper", "since", "low", "low_since"])


def _first(history: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(batch.column("vec_id"), batch.column("q"), first_scan(integers(batch.column("q")), history[0])[0])

    return run


def _next(history: list[np.ndarray], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = integers(batch.column("q"))
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).copy()
            many = lambda c: np.stack(batch.column(c).to_numpy(zero_copy_only=False))
            bounds = Bounds(number("cluster"), number("upper"), number("since"), many("low"), many("low_since"))
            own = reassign(q, bounds, history, last)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(bounds.cluster, pa.int32()), pa.array(own, pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                yield _batch(batch.column("vec_id"), batch.column("q"), bounds)

    return run


def moved_centroids(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of its vectors; one without vectors stays. Tasks give k rows of sums each; the driver gets k rows for each component."""
    k, dims = before.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                at = batch.column("cluster").to_numpy(zero_copy_only=False)
                np.add.at(total, at, integers(batch.column("q")))
                count += np.bincount(at, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims)), pa.array(np.tile(np.arange(dims), len(some))), pa.array(total[some].reshape(-1)), pa.array(np.repeat(count[some], dims))], ["c", "i", "s", "n"])

    sums = map_arrow(state.select("q", "cluster"), run, "c long, i long, s long, n long").groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    after = before.copy()
    for r in sums.collect():  # k * dims rows
        after[r["c"], r["i"]] = r["s"] // r["n"]
    return after
