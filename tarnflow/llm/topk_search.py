"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are turned into integers, a vector's dimensions being its terms. Candidates are packed into
blocks of consecutive rows; a block keeps, per term, its greatest and least weight, and a forward
index (its rows' weights). For a query the sum over terms of the greatest possible product bounds
every score in the block. Blocks are taken in the order of that bound and scored through their
forward index until the next bound falls below the query's k-th score; an equal bound is still
scored, as ties go to the smaller id.

Queries are a stated set. They are packed into blocks too. Before a block of queries is sent anywhere,
the k-th score of each query among its own block is a floor of its k-th score in the end, and the terms'
maxima and minima of each whole shard bound what the shard can give: a shard gets those queries alone
whose bound reaches the floor, with the floor to start from. In a task a shard comes first, then its
query blocks one after the other, so a shard's rows are sent once and are held by one task at a time.
The k best of each shard are merged at the end with a partial ranking.

The shards' maxima and minima go to the workers if they have BOUND_BYTES at most; beyond, every block of
queries goes to every shard. A shard has about LEAST_SHARD rows while there are fewer shards than SHARDS,
then more, up to MOST_SHARD. Neither changes a result.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id.
An empty vector takes part with score 0. Vectors of unlike lengths are as if filled with zeros. A query
never finds its own row; repeated ids count as different rows unless they are the query's id. Equal
scores go to the smaller id. Scores are exact integers, held at the ends of 64 bits. An empty table, or
one without queries, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.common import ship, store

#: Rows in a block of candidates, and queries in a block.
BLOCK_ROWS, QUERY_ROWS = 256, 512
#: Rows of a shard: few while there are fewer shards than SHARDS, so that all cores have some; then
#: more, as every block of queries is sent to every shard.
LEAST_SHARD, MOST_SHARD, SHARDS = 8_192, 65_536, 512
#: Bytes of the shards' maxima and minima up to which they are sent to the workers.
BOUND_BYTES = 1 << 26
SCALE = 256
#: Stands for no score; scores are above it, and it can be negated.
_NONE = -(2**63) + 1


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component as double; null if the vector takes no part."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return F.when(vector.isNotNull() & fine, wide)


def _packed(rows: DataFrame, group: Column) -> DataFrame:
    """One row per group of a bounded number of rows: ids, all weights as bytes, and per term the most and least."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        weights = np.zeros((len(pdf), max(map(len, pdf["v"]))), np.int64)
        for i, v in enumerate(pdf["v"]):
            weights[i, : len(v)] = v
        return pd.DataFrame([(key[0], pdf["id"].to_numpy(np.int64).tobytes(), *_written(weights), weights.max(0).tobytes(), weights.min(0).tobytes())], columns=["number", "ids", "rows", "type", "most", "least"])

    return rows.groupBy(group.alias("number")).applyInPandas(pack, "number long, ids binary, rows binary, type string, most binary, least binary")


def _written(weights: np.ndarray) -> tuple[bytes, str]:
    kind = _least_type(weights)
    return weights.astype(kind).tobytes(), kind


def _top(weights: np.ndarray) -> int:
    """The greatest absolute value; that of -2**63 has no place in 64 bits."""
    return max(int(weights.max(initial=0)), -int(weights.min(initial=0)))


def _least_type(weights: np.ndarray) -> str:
    top = _top(weights)
    return "int16" if top < 2**15 else "int32" if top < 2**31 else "int64"


def _matrix(data: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, -1) if data else np.zeros((rows, 0), np.int64)


def _dot(*pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact sums of the products of integer rows; doubles hold them where no sum passes 2**53."""
    pairs = tuple((a[:, : b.shape[1]], b[:, : a.shape[1]]) for a, b in pairs)
    if sum(_top(a) * _top(b) * a.shape[1] for a, b in pairs) < 2**53:
        return sum(a.astype(np.float64) @ b.astype(np.float64).T for a, b in pairs).astype(np.int64)
    exact = sum((a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)) for a, b in pairs)
    return np.clip(exact, _NONE + 1, 2**63 - 1).astype(np.int64)


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What no score of a query in a block passes: per query and block, from the blocks' maxima and minima.

    A term that a candidate lacks counts zero, which the maxima and minima of zero-filled rows hold.
    """
    return _dot((np.maximum(queries, 0), most), (np.minimum(queries, 0), least))


def floors(ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the others of its block; _NONE where there aren't so many."""
    score = np.where(ids[:, None] == ids[None, :], _NONE, _dot((queries, queries)))
    return np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(ids), _NONE)


class Shard:
    """Blocks of candidates with term maxima and minima."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, block_rows: int):
        # like vectors side by side make tight bounds: order by the leading direction of the shard
        if len(weights) > block_rows and weights.shape[1]:
            w = weights.astype(np.float64)
            lead = w[0] + 1e-9
            for _ in range(3):
                lead = w.T @ (w @ lead)
                lead /= np.linalg.norm(lead) or 1.0
            order = np.lexsort((ids, w @ lead))
            ids, weights = ids[order], weights[order]
        cuts = np.arange(0, len(ids), block_rows)
        self.ids = [ids[i : i + block_rows] for i in cuts]
        self.rows = [weights[i : i + block_rows] for i in cuts]
        self.most = np.array([r.max(0) for r in self.rows])
        self.least = np.array([r.min(0) for r in self.rows])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of each query's k best here; below ``floor`` some may be missing."""
        n = len(query_ids)
        floor = np.full(n, _NONE) if floor is None else floor
        bound = bounds(queries, self.most, self.least)
        order = np.argsort(-bound, axis=1, kind="stable")
        best_s = np.full((n, k), _NONE)
        best_i = np.full((n, k), np.iinfo(np.int64).max)
        count = np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(bound.shape[1]):
            block = order[live, step]
            least = np.where(count[live] < k, floor[live], np.maximum(floor[live], best_s[live, k - 1]))
            live = live[bound[live, block] >= least]
            block = order[live, step]
            if not len(live):
                break
            for b in np.unique(block):
                rows = live[block == b]
                score = _dot((queries[rows], self.rows[b]))
                ids = np.broadcast_to(self.ids[b], score.shape)
                own = ids == query_ids[rows][:, None]
                score = np.where(own, _NONE, score)
                ids = np.where(own, np.iinfo(np.int64).max, ids)
                all_s = np.concatenate([best_s[rows], score], axis=1)
                all_i = np.concatenate([best_i[rows], ids], axis=1)
                wide = all_s.shape[1]
                if wide > 8 * k:  # only what reaches the k-th score needs an order
                    kth = np.partition(all_s, wide - k, axis=1)[:, wide - k]
                    most = int((all_s >= kth[:, None]).sum(1).max())
                    if most < wide:
                        pick = np.argpartition(all_s, wide - most, axis=1)[:, wide - most :]
                        all_s, all_i = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
                top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best_s[rows], best_i[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
                count[rows] = np.minimum(k, count[rows] + score.shape[1] - own.sum(1))
        taken = np.arange(k)[None, :] < count[:, None]
        return np.nonzero(taken)[0], best_i[taken], best_s[taken]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, row_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(row_id).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), is_query.alias("q")).where("v IS NOT NULL AND id IS NOT NULL")
    total, asked, widest = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, min(math.ceil(total / LEAST_SHARD), max(SHARDS, math.ceil(total / MOST_SHARD))))
    blocks = max(1, math.ceil(asked / QUERY_ROWS))
    packed = store(_packed(rows.select("id", "v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards))))
    queries = _packed(rows.where("q").select("id", "v"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)))
    limits = None
    if shards * widest * 16 <= BOUND_BYTES:
        limits = rows.sparkSession.sparkContext.broadcast([(r.number, bytes(r.most), bytes(r.least)) for r in packed.select("number", "most", "least").collect()])

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block of queries once for each shard that some of them can win in."""
        known = [(number, np.frombuffer(m, np.int64)[None, :], np.frombuffer(n, np.int64)[None, :]) for number, m, n in limits.value] if limits else [(number, None, None) for number in range(shards)]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                weights = _matrix(r.rows, r.type, len(ids))
                floor = floors(ids, weights, k)
                for shard, most, least in known:
                    live = bounds(weights, most, least)[:, 0] >= floor if most is not None else np.ones(len(ids), bool)
                    if live.any():
                        yield pd.DataFrame([(shard, r.number, ids[live].tobytes(), weights[live].tobytes(), r.type, floor[live].tobytes())], columns=["shard", "block", "ids", "rows", "type", "floor"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                weights = _matrix(r.rows, r.type, len(ids))
                if r.block < 0:
                    held = Shard(ids, weights, block_rows)
                    continue
                at, found, scores = held.search(ids, weights, k, np.frombuffer(r.floor, np.int64))
                yield pd.DataFrame({"query_id": ids[at], "vec_id": found, "score": scores})

    sent = queries.mapInPandas(aim, "shard long, block long, ids binary, rows binary, type string, floor binary")
    first = packed.select(F.col("number").alias("shard"), F.lit(-1).cast("long").alias("block"), "ids", "rows", "type", F.lit(None).cast("binary").alias("floor"))
    part = first.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "block").mapInPandas(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
