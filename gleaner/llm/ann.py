"""Operator 4: largest inner products by collision-counting, query-aware hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors in a block of the index, and queries that meet it at a time.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Projections, the share of them that must collide, and the share of a block to verify at least.
PROJECTIONS, THRESHOLD, VERIFY = 64, 0.62, 0.4
#: Half widths of the windows, step by step, in units of the largest norm.
RADII = (0.12, 0.25, 0.5, 0.8, 0.92, 1.05, 1.2, 1.6, 2.4, 4.0, 8.0)
#: Norms within a range of the index differ by this factor at most; ranges of fewer vectors are verified whole.
NORM_RANGE, WHOLE = 1.05, 512


class CollisionIndex:
    """Sorted single projections of a block of vectors; inner products become distances by one more coordinate.

    A query puts its own projections in the centre of windows that widen step by step (virtual rehashing: a wider window
    is the bucket of a larger radius, and nothing is hashed again). Each step counts collisions only for what the
    windows newly take in. Vectors with enough collisions are verified by their exact inner product. The search stops
    when k verified ones lie within the radius that the windows stand for, or when a fixed share has been verified.
    """

    def __init__(self, vectors: np.ndarray, norm: float, verify: float = VERIFY, seed: int = 11, projections: int = PROJECTIONS) -> None:
        self.exact = vectors.astype(np.float64)
        self.norm, self.verify = norm, verify
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections)).astype(np.float32)
        more = np.sqrt(np.maximum(norm * norm - (self.exact**2).sum(axis=1), 0.0))
        values = np.column_stack([self.exact, more]).astype(np.float32) @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(values, axis=0).T.copy()

    def windows(self, queries: np.ndarray) -> np.ndarray:
        """The ends of all windows of all queries: query, step (the centre first), low or high, projection."""
        centres = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32) @ self.axes
        half = np.append(0.0, np.array(RADII) * self.norm).astype(np.float32)
        out = np.empty((len(queries), len(half), 2, len(self.sorted)), np.int32)
        for m, row in enumerate(self.sorted):
            out[:, :, 0, m] = np.searchsorted(row, centres[:, m : m + 1] - half)
            out[:, :, 1, m] = np.searchsorted(row, centres[:, m : m + 1] + half, "right")
        out[:, 0, 1] = out[:, 0, 0]
        return out

    def search(self, query: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of verified vectors, the k best and ties with the last among them."""
        n, exact = len(self.exact), query.astype(np.float64)
        enough, need = min(n, k + int(self.verify * n)), max(1, int(THRESHOLD * len(self.order)))
        counts, known, square = np.zeros(n, np.int64), np.zeros(n, bool), self.norm**2 + float(exact @ exact)
        places, scores = np.empty(0, np.int64), np.empty(0)
        for step, radius in enumerate(RADII):
            (low, high), (lo, hi) = ends[step].tolist(), ends[step + 1].tolist()
            taken = [row[a:b] for row, a, b in zip(self.order, lo, low, strict=True) if a < b]
            taken += [row[a:b] for row, a, b in zip(self.order, high, hi, strict=True) if a < b]
            if taken:
                counts += np.bincount(np.concatenate(taken), minlength=n)
            new = np.nonzero((counts >= need) & ~known)[0]
            known[new] = True
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.exact[new] @ exact])
            if len(places) >= enough:
                break
            # windows of half width r take in THRESHOLD of the projections of what lies at distance r / 0.88
            if len(places) >= k and square - 2 * np.partition(scores, -k)[-k] <= (0.8 * radius * self.norm) ** 2:
                break
        else:
            rest = np.nonzero(~known)[0]
            places, scores = np.concatenate([places, rest]), np.concatenate([scores, self.exact[rest] @ exact])
        if len(places) > k:
            places = places[scores >= np.partition(scores, -k)[-k] - 1e-9]
        return places, (self.exact[places] * exact).sum(axis=1)  # row by row: equal pairs have equal scores anywhere


class NormRanges:
    """A block of vectors in ranges of about equal norm, each with an index of its own, the longest vectors first.

    Within a range the extra coordinate is small, so that projections tell near vectors from far ones. A query meets the
    ranges until no vector of the next one can reach its k-th score, as an inner product is at most the product of norms.
    """

    def __init__(self, vectors: np.ndarray, verify: float = VERIFY) -> None:
        self.exact = vectors.astype(np.float64)
        norms = np.sqrt((self.exact**2).sum(axis=1))
        order, self.ranges, at = np.argsort(-norms, kind="stable"), [], 0
        while at < len(order):
            largest = float(norms[order[at]])
            end = max(at + 1, int(np.searchsorted(-norms[order], -largest / NORM_RANGE, "right")))
            places = order[at:end]
            self.ranges.append((largest, places, CollisionIndex(vectors[places], largest, verify) if len(places) >= WHOLE and verify < 1 else None))
            at = end

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) for each query, the k best of all ranges among them."""
        exact = queries.astype(np.float64)
        lengths = np.sqrt((exact**2).sum(axis=1))
        out = [(np.empty(0, np.int64), np.empty(0)) for _ in exact]
        for largest, members, index in self.ranges:
            bound = lambda j: len(out[j][1]) < k or lengths[j] * largest >= np.partition(out[j][1], -k)[-k] - 1e-9  # noqa: B023, E731
            open_ = [j for j in range(len(exact)) if bound(j)]
            scaled = exact[open_] * (largest / lengths[open_])[:, None]  # the order of inner products stays
            windows = index.windows(scaled) if index and open_ else [None] * len(open_)
            for j, q, ends in zip(open_, scaled, windows, strict=True):
                places = members if index is None else members[index.search(q, ends, k)[0]]
                scores = (self.exact[places] * exact[j]).sum(axis=1)  # row by row: equal pairs have equal scores anywhere
                places, scores = np.concatenate([out[j][0], places]), np.concatenate([out[j][1], scores])
                if len(scores) > k:
                    best = scores >= np.partition(scores, -k)[-k] - 1e-9
                    places, scores = places[best], scores[best]
                out[j] = (places, scores)
        return out


def valid(vector: str) -> Column:
    """Neither null nor empty nor all zero, and every component a finite number."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, verify: float = VERIFY) -> DataFrame:
    """The k nearest rows of `vectors` (vec_id, embedding) for each of `queries` (the same columns), by inner product.

    Equal vectors are one entry of the index, with their k + 1 smallest ids, so a hot vector costs one place and loses
    nothing. The entries are dealt into blocks by hash; every block of the index meets every block of queries once, and
    the best of all blocks are ranked: nearest first, ties to the smaller id, rows of the query's own id left out. All
    rows are indexed; the search is approximate with a measured recall above 0.9, and exact where there are few rows. `verify`
    is the share of a block that is verified unless the search is over before; 1 verifies all, so that nothing is missed.

    Vectors that are null, zero or hold null or non-finite components take no part, as queries or as candidates. Rows of
    a null id are left out. Vectors of another length than most have are left out, as no inner product is defined.
    Repeated rows count once, and so does a query's own id however often it is there; an id with several vectors is a
    candidate by each of them, and as a query it has the best of all of them in one ranking. An empty table gives no rows. Returns query_id, rank, vec_id, score (double precision, on
    the original vectors).
    """
    spark = vectors.sparkSession
    good = lambda df: df.select(F.col("vec_id").cast("long"), "embedding").filter(valid("embedding") & F.col("vec_id").isNotNull())
    rows = good(vectors)
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    rows = rows.withColumn("_n", F.dense_rank().over(by_vector)).filter(F.col("_n") <= k + 1)
    rows = rows.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    rows = materialize(rows.withColumn("hash", F.xxhash64("embedding", F.lit(3))), "ann-index")
    lengths = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, blocks = found["size"], -(-found["n"] // block)
    asked = materialize(good(queries).filter(F.size("embedding") == size).dropDuplicates(["vec_id", "embedding"]), "ann-queries")
    query_blocks = max(1, -(-asked.count() // query_block))
    both = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.filter(F.size("embedding") == size).select(
        F.pmod("hash", F.lit(blocks)).cast("int").alias("b"), both(query_blocks).alias("qb"), "embedding", "ids"
    )
    asked = asked.select(
        both(blocks).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), "vec_id", "embedding"
    )

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            entries, ids = matrix(left.column("embedding")), left.column("ids").to_pylist()
            hashed = NormRanges(entries, verify)
            asked, vectors = right.column("vec_id").to_pylist(), matrix(right.column("embedding"))
            found = [f for at in range(0, len(vectors), 512) for f in hashed.search(vectors[at : at + 512], k + 1)]
            for query, (places, scores) in zip(asked, found, strict=True):
                pairs = sorted((-s, i) for p, s in zip(places, scores, strict=True) for i in ids[p] if i != query)[:k]
                out["query_id"] += [query] * len(pairs)
                out["vec_id"] += [i for _, i in pairs]
                out["score"] += [float(-s) for s, _ in pairs]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    pairs = index.groupBy("b", "qb").cogroup(asked.groupBy("b", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)
