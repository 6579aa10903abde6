"""Exact top-k by inner product with a three-phase uniform threshold.

Components are floor(scale * x). A vector's score is the sum of its partial scores over `lists` equal
cuts of the components. Queries come in blocks of a bounded number; for each block:

1. every task gathers, for each query and list, the k candidates of highest partial score; the few that
   lead a list are scored in full, and the k-th best of these, t, is a safe lower bound of the k-th score;
2. t is broadcast; every task collects the parts of t / lists or more. A candidate without one scores less
   than t and can't be in the result. As a candidate's parts lie in one row, its collected parts and the
   bound of the others (a missing part is below t / lists) are summed in the task, which leaves few pairs;
3. only these pairs are resolved: the task multiplies their whole vectors, those that reach t leave it, and
   they are ranked. Parts that were not collected are never moved or added up for any other pair.

Of candidates with equal components only the k + 1 of smallest id can be in any result (ties go to the
smaller id, and a query leaves out at most itself), so the others are set aside before.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without
id, take no part; shorter vectors count as padded with 0; rows that repeat an id are candidates and queries
of their own, so a query leaves out its own row only; scores beyond 64 bits raise an OverflowError; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.llm.common import in_batches, materialize

#: Queries whose vectors are broadcast together.
QUERY_BLOCK = 16_384
#: Queries and candidates whose scores are held at once in a task.
QUERY_STEP, ROW_STEP = 512, 1024
#: Pairs whose vectors are multiplied at once in the last phase.
PAIR_STEP = 16_384


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *more: Column) -> DataFrame:
    """vec_id, v (array of long) and more columns, for the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    sound = (F.size(vec_col) > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col), x.alias("x"), *more).filter(F.col("vec_id").isNotNull() & sound)
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"), *rows.columns[3:])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with 0 to a width."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; floats where these are exact, as BLAS is fast."""
    most = int(np.abs(q).max()) * int(np.abs(v).max()) * q.shape[1] if q.size and v.size else 0
    if most < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return q @ v.T
    whole = q.astype(object) @ v.T.astype(object)
    if any(abs(x) >= 2**63 for x in whole.flat):
        raise OverflowError("a score is beyond 64 bits")
    return whole.astype(np.int64)


def _scan(block, lists: int, width: int, k: int):
    """Phase 1: the leaders of each list, for each query, among a task's candidates (row, v)."""
    cuts = np.linspace(0, width, lists + 1).astype(int)
    low = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_rows, queries = block.value
        n = len(query_rows)
        lead = np.full((lists, n, k), low, dtype=np.int64)
        lead_rows = np.full((lists, n, k), -1, dtype=np.int64)
        for rows, v, mine, own in _steps(batches, query_rows, width):
            for c in range(lists):
                part = _products(queries[mine, cuts[c] : cuts[c + 1]], v[:, cuts[c] : cuts[c + 1]])
                part[own] = low
                both = np.concatenate([lead[c, mine], part], axis=1)
                both_rows = np.concatenate([lead_rows[c, mine], np.broadcast_to(rows, part.shape)], axis=1)
                best = np.argpartition(both, both.shape[1] - k, axis=1)[:, -k:]
                lead[c, mine], lead_rows[c, mine] = np.take_along_axis(both, best, 1), np.take_along_axis(both_rows, best, 1)
        for c in range(lists):
            a, b = np.nonzero(lead[c] > low)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(query_rows[a]), pa.array(np.full(len(a), c, dtype=np.int32)), pa.array(lead_rows[c, a, b]), pa.array(lead[c, a, b])], names=["query", "list", "row", "part"])

    return run


def _steps(batches: Iterator[pa.RecordBatch], query_rows: np.ndarray, width: int):
    """Candidates (rows, components) and a slice of the queries at a time, and which pairs are a query and itself."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROW_STEP):
            part = batch.slice(begin, ROW_STEP)
            rows, v = part.column("row").to_numpy(), _matrix(part.column("v"), width)
            for lo in range(0, len(query_rows), QUERY_STEP):
                mine = slice(lo, lo + QUERY_STEP)
                yield rows, v, mine, query_rows[mine, None] == rows


def _resolved(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows."""
    most = int(np.abs(q).max()) * int(np.abs(v).max()) * q.shape[1] if q.size else 0
    if most < 2**63:
        return np.einsum("ij,ij->i", q, v)
    whole = (q.astype(object) * v.astype(object)).sum(axis=1)
    if any(abs(x) >= 2**63 for x in whole):
        raise OverflowError("a score is beyond 64 bits")
    return whole.astype(np.int64)


def _collect(block, lists: int, width: int, cutoff: np.ndarray, known_k: np.ndarray, resolved=None):
    """Phases 2 and 3: pairs that can reach their query's cutoff by their collected parts, and do by their whole score."""
    cuts = np.linspace(0, width, lists + 1).astype(int)
    at_least = -((-cutoff) // lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_rows, queries = block.value
        for rows, v, mine, own in _steps(batches, query_rows, width):
            known, n = np.zeros(own.shape, dtype=np.int64), np.zeros(own.shape, dtype=np.int32)
            for c in range(lists):
                part = _products(queries[mine, cuts[c] : cuts[c + 1]], v[:, cuts[c] : cuts[c + 1]])
                on = (part >= at_least[mine, None]) | ~known_k[mine, None]
                known += np.where(on, part, 0)
                n += on
            bound = known + (lists - n) * (at_least[mine, None] - 1)
            collected = (n > 0) & (bound >= cutoff[mine, None]) | ~known_k[mine, None]
            a, b = np.nonzero(collected & ~own)
            if resolved is not None:
                resolved.add(len(a))
            for lo in range(0, len(a), PAIR_STEP):
                x, y = a[lo : lo + PAIR_STEP], b[lo : lo + PAIR_STEP]
                score = _resolved(queries[mine][x], v[y])
                on = ~known_k[mine][x] | (score >= cutoff[mine][x])
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(query_rows[mine][x[on]]), pa.array(rows[y[on]]), pa.array(score[on])], names=["query", "row", "score"])

    return run


def _dot(a: str, b: str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)


def _scored(pairs: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    both = pairs.join(candidates, "row").join(queries, "query")
    return both.select("query", "row", _dot("q", "v").alias("score"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, lists: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", resolved=None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, itself left out.

    is_query is a condition on vec_id. Every other row, queries too, is a candidate. resolved, if given, is an
    accumulator that counts the pairs whose whole vectors the last phase multiplies.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    candidates = materialize(rows.withColumn("copy", first).filter(F.col("copy") <= k + 1).drop("copy"), "candidates")
    queries = rows.filter(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count_if(is_query).alias("n")).first()
    width, blocks = facts["width"] or 1, max(1, -(-facts["n"] // QUERY_BLOCK))
    found = []
    for number in range(blocks):
        mine = materialize(queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number), "queries")
        table = mine.select("query", "q").toArrow().combine_chunks()
        matrix = _matrix(table["q"].combine_chunks(), width) if table.num_rows else np.zeros((0, width), dtype=np.int64)
        query_rows = table["query"].to_numpy()
        block = spark.sparkContext.broadcast((query_rows, matrix))
        heads = in_batches(candidates.select("row", "v"), _scan(block, lists, width, k), "query long, list int, row long, part long")
        place = F.row_number().over(Window.partitionBy("query", "list").orderBy(F.desc("part"), "row"))
        gathered = heads.withColumn("place", place).filter(F.col("place") <= k).select("query", "row").distinct()
        ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
        cutoff = _scored(gathered, candidates, mine).withColumn("r", ranked).filter(F.col("r") == k).select("query", F.col("score").alias("t"))
        t = dict(cutoff.toPandas().itertuples(index=False))  # at most QUERY_BLOCK rows
        # a query of fewer than k candidates has no cutoff: all are collected
        at, known = (np.array([f(q) for q in query_rows.tolist()], dtype=d) for f, d in ((lambda q: t.get(q, 0), np.int64), (lambda q: q in t, bool)))
        scored = in_batches(candidates.select("row", "v"), _collect(block, lists, width, at, known, resolved), "query long, row long, score long")
        named = scored.join(candidates.select("row", "vec_id"), "row").join(mine.select("query", "query_id"), "query")
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
        best = named.withColumn("rank", order).filter(F.col("rank") <= k)
        found.append(materialize(best.select("query_id", "rank", "vec_id", "score"), "top"))
        block.unpersist()
    return reduce(DataFrame.unionByName, found)
