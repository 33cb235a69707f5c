"""Exact top-k search by inner product with columnar branch-and-bound.

Vectors are quantised to whole numbers, floor(scale * x), and packed in blocks in vertical layout: dimension by dimension.
A block of queries meets a block of candidates in one task. Scores accumulate over blocks of dimensions; before each, the
bound score + |rest of query| * |rest of candidate| is compared with the query's k-th best score so far, and candidates
that no query of a small group can still use are compacted away. The k best of each query carry over from block to block
of candidates within a task, and tasks send k rows a query to the merge.

All queries meet all rows: that is the search itself, in blocks. Nothing is broadcast. Blocks of queries are dealt to groups
and blocks of candidates to slices, whose numbers grow with the table; a task holds one group and one slice at a time.

Defined cases: null vectors and such with null or non-finite components take no part; vectors of other lengths are not
compared with each other; an empty vector takes no part; a query's own row is every row of its id; repeated rows count
separately (ties to the smaller id); a null id takes no part; scores are exact as long as they fit a long (doubles below 2**53).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix

#: Numbers in a group of queries and in a slice of candidates, about (which bounds a task's memory).
QUERY_VALUES, CANDIDATE_VALUES = 1 << 20, 1 << 22
_PACKED = "_block int, _slice int, _dim int, _ids binary, _values binary"


def quantised(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(_id, _v array<double> of whole numbers), without vectors that take no part."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(usable).select(F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("_v"))


def packed(rows: DataFrame, block: int, slices: int) -> DataFrame:
    """Blocks of up to `block` vectors of one length in vertical layout."""

    def pack(it):
        held: dict[int, list] = {}

        def put(dim):
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for at in range(0, len(ids), block):
                i, v = ids[at : at + block], values[at : at + block]
                number = int(mix(i[:1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))[0]) & 0x7FFFFFFF
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([number % slices], pa.int32()), pa.array([dim], pa.int32()), pa.array([i.tobytes()]), pa.array([np.ascontiguousarray(v.T).tobytes()])], names=["_block", "_slice", "_dim", "_ids", "_values"])

        for b in it:
            ids, v = np.asarray(b.column("_id")), b.column("_v")
            sizes = np.diff(np.asarray(v.offsets))
            flat = np.asarray(v.flatten())
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[own], flat[first[own][:, None] + np.arange(dim)]))
                if sum(len(x[0]) for x in held[dim]) >= block:
                    yield from put(dim)
        for dim in list(held):
            yield from put(dim)

    return rows.mapInArrow(pack, _PACKED)


def rest_norms(x: np.ndarray, step: int) -> np.ndarray:
    """Norm of what is left from each block of dimensions on; x is vertical."""
    squares = np.add.reduceat(x * x, np.arange(0, len(x), step), axis=0)
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1]) * (1 + 1e-12)


def best(q_ids, q, c_ids, c, least, k: int, step: int, group: int):
    """For each query the candidates that reach its `least` score: branch-and-bound over blocks of dimensions.

    Yields (query number, ids, scores), k at most; equal scores with the smaller id are kept."""
    c_rest, q_rest = rest_norms(c, step), rest_norms(q, step)
    for at in range(0, len(q_ids), group):
        own = slice(at, at + group)
        ids, limit = c_ids, least[own]
        live, scores = None, np.zeros((len(q_ids[own]), len(c_ids)))
        for n, d in enumerate(range(0, len(q), step)):
            if n:
                bound = q_rest[n, own][:, None] * (c_rest[n] if live is None else c_rest[n][live])
                bound += scores
                stay = (bound >= limit[:, None]).any(0)
                if stay.sum() < 0.8 * len(stay):  # compact what survives
                    live = np.flatnonzero(stay) if live is None else live[stay]
                    scores, ids = scores[:, stay], ids[stay]
            block = c[d : d + step] if live is None else c[d : d + step][:, live]
            scores += q[d : d + step, own].T @ block
        for r in range(len(scores)):
            fit = np.flatnonzero((scores[r] >= limit[r]) & (ids != q_ids[at + r]))
            if len(fit) > 4 * k:
                s = scores[r, fit]
                fit = fit[s >= np.partition(s, -k)[-k]]
            order = np.lexsort((ids[fit], -scores[r, fit]))[:k]
            yield at + r, ids[fit[order]], scores[r, fit[order]]


def dealt(vectors: DataFrame, is_query: Column, scale: float, block: int, query_block: int, slices: int | None, groups: int | None, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Packed queries and candidates with the keys (_group, _slice) by which each block of queries meets each block of candidates once."""
    n = F.greatest(F.coalesce(F.size(vector_col), F.lit(0)), F.lit(0)).cast("long")
    all_values, query_values = vectors.agg(F.sum(n), F.sum(F.when(is_query, n))).first()
    slices = slices or max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(all_values or 0) // CANDIDATE_VALUES))
    groups = groups or max(1, -(-(query_values or 0) // QUERY_VALUES))
    candidates = packed(quantised(vectors, scale, id_col, vector_col), block, slices)
    queries = packed(quantised(vectors.filter(is_query), scale, id_col, vector_col).repartition(max(1, slices // 8), "_id"), query_block, groups)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = queries.select(F.col("_slice").alias("_group"), numbers(slices).alias("_slice"), F.col("_dim").alias("_q_dim"), F.col("_ids").alias("_q_ids"), F.col("_values").alias("_q_values"))
    return queries, candidates.select(numbers(groups).alias("_group"), "_slice", "_dim", "_ids", "_values")


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, block: int = 4096, query_block: int = 1024, slices: int | None = None, step: int = 8, group: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with all other rows."""
    queries, candidates = dealt(vectors, is_query, scale, block, query_block, slices, groups, id_col, vector_col)

    def met(key, left, right):
        dims = set(left.column("_q_dim").to_pylist()) & set(right.column("_dim").to_pylist())
        out = []

        def cells(t, dim, kind, ids, values):
            buffer = lambda c, r: t.column(c)[r].as_buffer()
            for r in np.flatnonzero(t.column(kind).to_numpy() == dim).tolist():
                yield np.frombuffer(buffer(ids, r), np.int64), np.frombuffer(buffer(values, r)).reshape(dim, -1)

        for dim in dims:
            blocks = lambda: cells(right, dim, "_dim", "_ids", "_values")  # noqa: B023, E731
            for q_ids, q in cells(left, dim, "_q_dim", "_q_ids", "_q_values"):
                top = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q_ids]
                least = np.full(len(q_ids), -np.inf)
                for c_ids, c in blocks():
                    for r, ids, scores in best(q_ids, q, c_ids, c, least, k, step, group):
                        i, s = np.concatenate([top[r][0], ids]), np.concatenate([top[r][1], scores])
                        order = np.lexsort((i, -s))[:k]
                        top[r] = i[order], s[order]
                        if len(order) == k:
                            least[r] = s[order[-1]]
                # a repeated query row would report its neighbours again
                out += [(i, *x) for i, x in dict(zip(q_ids.tolist(), top)).items()]
        n = [len(x[1]) for x in out]
        return pa.table({"query_id": pa.array(np.repeat(np.array([x[0] for x in out], np.int64), n)), "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)])), "score": pa.array(np.concatenate([np.zeros(0), *(x[2] for x in out)]).astype(np.int64))})

    found = queries.groupBy("_group", "_slice").cogroup(candidates.groupBy("_group", "_slice")).applyInArrow(met, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
