"""Exact top-k inner products by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

QUERY_ROWS, SHARD_ROWS = 512, 4096
# Integers up to here are exact in float64, so a matrix product of doubles is an exact integer product.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
FAN = 16

TILES = "dim int, rows int, ids binary, values binary"


#: Bytes of vectors that one task meets the queries with.
SLOT_BYTES = 64 << 20


def _tiler(size: int, scale: float):
    """Pack rows into tiles of at most ``size`` vectors of one dimension, each sorted by id."""

    def pack(held: list[tuple[np.ndarray, np.ndarray]], dim: int) -> tuple[int, int, bytes, bytes]:
        ids = np.concatenate([i for i, _ in held])
        values = np.concatenate([v for _, v in held])
        order = np.argsort(ids, kind="stable")
        return dim, len(ids), ids[order].tobytes(), values[order].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tiles: dict[int, list] = {}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["dim", "rows", "ids", "values"])
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("vector")
            offsets = lists.offsets.to_numpy()
            flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                values = flat[(offsets[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                for at in range(0, len(rows), size):
                    held = open_tiles.setdefault(dim, [])
                    held.append((ids[rows[at : at + size]], values[at : at + size]))
                    if sum(len(i) for i, _ in held) >= size:
                        yield give([pack(open_tiles.pop(dim), dim)])
        for dim, held in sorted(open_tiles.items()):
            yield give([pack(held, dim)])

    return run


def _product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products: by float64 where that is exact, else by Python integers, held in the range of a long."""
    dim = queries.shape[1]
    top = lambda x: np.abs(x).max(initial=0.0)
    if dim * max(top(queries), 1.0) * max(top(shard), 1.0) < EXACT:
        return queries @ shard.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(whole(queries) @ whole(shard).T, -LONG - 1, LONG)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, score and id of each row's k highest scores; the columns are in id order, so ties go to the left.

    Entries that are minus infinity are no candidates.
    """
    if scores.dtype == object:
        pick = [sorted((j for j, s in enumerate(row) if s != -np.inf), key=lambda j: (-row[j], j))[:k] for row in scores]
        rows = np.repeat(np.arange(len(scores)), [len(p) for p in pick])
        cols = np.array([j for p in pick for j in p], dtype=np.int64)
        return rows, scores[rows, cols], ids[cols]
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above = scores > edge
        # Scores equal to the k-th highest fill what is left, from the left.
        tied = scores == edge
        room = k - above.sum(axis=1)
        over = np.flatnonzero(tied.sum(axis=1) > room)
        tied[over] &= np.cumsum(tied[over], axis=1) <= room[over][:, None]
        keep = (above | tied) & (scores != -np.inf)
    else:
        keep = scores != -np.inf
    rows, cols = np.nonzero(keep)
    return rows, scores[rows, cols], ids[cols]


def _multiply(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "query_id", "vec_id", "score"]
        tile, slot, held = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            # The lists of one query tile over neighbouring shards are merged before they leave the task.
            query, ids, score = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ids, [-s for s in score] if score.dtype == object else -score, query))
            query, ids, score = query[order], ids[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            keep = place < k
            cols = [pa.array(np.full(keep.sum(), slot, np.int64)), pa.array(query[keep]), pa.array(ids[keep])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([int(s) for s in score[keep]], pa.int64())], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["q_ids"] != tile or row["slot"] != slot):
                    yield from flush()
                    held = []
                tile, slot = row["q_ids"], row["slot"]
                q_ids, s_ids = np.frombuffer(tile, np.int64), np.frombuffer(row["ids"], np.int64)
                queries = np.frombuffer(row["q_values"], np.float64).reshape(len(q_ids), row["dim"])
                shard = np.frombuffer(row["values"], np.float64).reshape(len(s_ids), row["dim"])
                scores = _product(queries, shard)
                scores[q_ids[:, None] == s_ids[None, :]] = -np.inf
                rows, score, ids = best_of(scores, s_ids, k)
                if len(rows):
                    held.append((q_ids[rows], ids, score))
        if held:
            yield from flush()

    return run


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For every query row the ``k`` rows of highest integer inner product: ``query_id, rank, vec_id, score``.

    A component x counts as ``floor(scale * x)``.  Ties go to the smaller id.  Queries and
    shards are packed into tiles; every query tile meets every shard tile once, the task keeps
    the k best per query over neighbouring shards, and lists of k are merged level by level.
    Nothing is compared row by row and no list is longer than k.

    Null ids, null vectors and vectors with a null or non-finite component take no part.
    Vectors of different length are not compared; empty vectors score 0 with each other.  A row
    with the query's id is the query's own.  Rows that repeat another id each count as a
    candidate; a query id that occurs on several rows asks once, with the smallest vector.  Scores
    beyond the range of a long stop at its ends.  An empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    shards = materialize(rows.select("id", "vector").mapInArrow(_tiler(SHARD_ROWS, scale), TILES), "shards")
    asked = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    queries = materialize(asked.mapInArrow(_tiler(QUERY_ROWS, scale), TILES), "query-tiles")

    # As many slots of shards as the cluster runs tasks a few times over, and more where one would hold too
    # many bytes for a task: a query tile is sent once to each.
    tiles, size = shards.agg(F.count(F.lit(1)), F.sum(F.octet_length("values"))).first()
    slots = max(4 * vectors.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // SLOT_BYTES))
    slots = max(1, min(tiles, slots))
    placed = shards.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)))
    sent = queries.select(
        F.col("dim"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")
    )
    pairs = sent.join(placed.hint("shuffle_hash"), ["slot", "dim"])
    found = pairs.mapInArrow(_multiply(k), "slot long, query_id long, vec_id long, score long")

    best = lambda keys: W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    groups = slots
    while groups > FAN:
        groups = -(-groups // FAN)
        found = found.withColumn("slot", F.col("slot") % groups)
        found = found.withColumn("rank", F.row_number().over(best(["query_id", "slot"]))).where(F.col("rank") <= k)
    found = found.drop("rank").withColumn("rank", F.row_number().over(best(["query_id"]))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
