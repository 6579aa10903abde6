"""Hard-negative mining by one-dimensional distance keys.

Components are floor(scale * x); scores are integer inner products. A vector x is augmented by the component
sqrt(M^2 - |x|^2), M being the largest norm, and an anchor by 0: then dist^2 = M^2 + |anchor|^2 - 2 * score, so
high scores are small distances and a range of scores is a shell around the anchor. Pivots are centres of a
bounded sample; each vector's key is (nearest pivot, distance to it), and the index is a table sorted by key.

A search asks for the best rows with a score between two bounds. By the triangle inequality a row in the shell
[a, b] around an anchor at distance d from a pivot has its key between the least |d - r|, a <= r <= b, and d + b.
Each round scans these intervals of all pivots (pushed to the table's reader, and met again by every run of
rows in key order, so that anchors whose interval misses the run are not multiplied with it) for the next shell
outwards, whose outer bound comes from the sample's scores. An anchor is done when its shells so far hold k
rows, as every row beyond them scores less, or when the last shell was scanned; so the result is exact, and the
sample decides about effort only. Shells of rounds do not overlap.

Anchors come in blocks of a bounded number; of each the driver holds the vectors, the positives' scores and
how many rows were found, while what was found stays in tables.

Defined results: rows without id or label, and vectors that are null, empty or hold null or non-finite
components take no part; shorter vectors count as padded with 0; rows that repeat an id are rows of their own,
and an anchor leaves out its own row only; of equal scores the smaller id comes first; an anchor without
positives, and a positive without negatives, gives no rows; scores beyond 64 bits raise an OverflowError; other
columns are ignored, whatever their names; an empty table gives an empty result. Of rows with equal vector and
label only so many of smallest id as a result can hold are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.llm.common import in_batches, materialize
from prismflow.llm.topk import _matrix, _products, quantized

#: Anchors of a block; vectors and components of the sample; pivots; rows of a run; found pairs that a task holds before it cuts them.
ANCHOR_BLOCK, SAMPLE, SAMPLE_COMPONENTS, PIVOTS, RUN, HELD = 4096, 4096, 1 << 21, 64, 512, 200_000
#: Widening of key intervals against rounding, as a share of the largest norm.
SLACK = 1e-6
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of the sample's vectors, by a few rounds of Lloyd's method."""
    if not len(sample):
        return sample
    centres = sample[np.random.default_rng(7).choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(4):
        near = _distances(sample, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(1, sizes), centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def _augmented(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that gives all the same norm."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))[:, None]], axis=1)


@dataclass
class DistanceIndex:
    """Rows (row, vec_id, label, v) stored in the order of (pivot, distance), and what a search needs to know of them."""

    table: DataFrame
    n: int
    width: int
    most: float  # the largest squared norm
    pivots: np.ndarray
    sample_rows: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray


def build_index(rows: DataFrame, alike: int) -> DistanceIndex:
    """Index rows (row, vec_id, label, v), of rows with equal vector and label the `alike` of smallest id."""
    order = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id", "row"))
    rows = materialize(rows.withColumn("copy", order).filter(F.col("copy") <= alike).drop("copy"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("most")).first()
    width, most = facts["width"] or 1, facts["most"] or 0.0
    few = rows.orderBy(F.xxhash64("row"), "row").limit(max(16, min(SAMPLE, SAMPLE_COMPONENTS // width))).select("row", "label", "v").toArrow().combine_chunks()
    sample = _matrix(few["v"].combine_chunks(), width) if few.num_rows else np.zeros((0, width), dtype=np.int64)
    pivots = _pivots(_augmented(sample, most), max(1, min(PIVOTS, len(sample) // 8)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_augmented(_matrix(batch.column("v"), width), most), pivots)
                near = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], names=[*batch.schema.names, "pivot", "distance"])

    keys = in_batches(rows.select("row", "vec_id", "label", "v"), keyed, "row long, vec_id long, label long, v array<long>, pivot int, distance double")
    table = materialize(keys.repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance"), "distance-index")
    return DistanceIndex(table, facts["n"], width, most, pivots, few["row"].to_numpy(), few["label"].to_numpy(), sample)


@dataclass
class Anchors:
    """A block of anchors: their rows, labels, vectors, and distances to the pivots."""

    rows: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    square: np.ndarray
    away: np.ndarray

    @staticmethod
    def of(table: pa.Table, index: DistanceIndex) -> Anchors:
        v = _matrix(table["v"].combine_chunks(), index.width)
        x = np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1)
        return Anchors(table["row"].to_numpy(), table["label"].to_numpy(), v, (x**2).sum(axis=1), _distances(x, index.pivots))


@dataclass
class Wanted:
    """What a search looks for: for each item the number of its anchor in the block, and the least and highest score."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of any other


def _intervals(anchors: Anchors, wanted: Wanted, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest key of each item at each pivot."""
    room = np.sqrt(most) * SLACK + 1e-9
    at = lambda score: np.sqrt(np.maximum(0, most + anchors.square[wanted.anchor] - 2 * score.astype(np.float64)))[:, None]
    near, far, d = at(wanted.high), at(wanted.low), anchors.away[wanted.anchor]
    least = np.maximum(0, np.maximum(near - d, d - far))
    return least - room, d + far + room


def _first(item: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k first rows: by score descending, id, row."""
    order = np.lexsort((row, vec_id, -score, item))
    begins = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - begins < k]


def _scan(shared, k: int, width: int, most: float, pairs=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, wanted = shared.value
        least, greatest = _intervals(anchors, wanted, most)
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def cut() -> list[tuple[np.ndarray, ...]]:
            every = tuple(np.concatenate(x) for x in zip(*held))
            stay = _first(*every, k)
            return [tuple(x[stay] for x in every)]

        for batch in batches:
            pivot, distance = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
            turns = np.flatnonzero(np.diff(pivot) != 0) + 1
            begins = np.unique(np.concatenate([np.arange(0, batch.num_rows, RUN), turns]).astype(np.int64))
            for lo, hi in zip(begins, [*begins[1:], batch.num_rows]):
                p = pivot[lo]
                items = np.flatnonzero((least[:, p] <= distance[lo:hi].max()) & (greatest[:, p] >= distance[lo:hi].min()))
                if not len(items):
                    continue
                part = batch.slice(lo, hi - lo)
                rows, ids, labels = (part.column(c).to_numpy() for c in ("row", "vec_id", "label"))
                mine, place = np.unique(wanted.anchor[items], return_inverse=True)
                if pairs is not None:
                    pairs.add(len(mine) * (hi - lo))
                scores = _products(anchors.v[mine], _matrix(part.column("v"), width))
                fits = ((anchors.labels[mine][:, None] == labels) == wanted.same) & (anchors.rows[mine][:, None] != rows)
                for at in range(0, len(items), 512):
                    some = slice(at, at + 512)
                    s = scores[place[some]]
                    a, b = np.nonzero(fits[place[some]] & (s >= wanted.low[items[some], None]) & (s <= wanted.high[items[some], None]))
                    if len(a):
                        held.append((items[some][a], s[a, b], ids[b], rows[b]))
                        n += len(a)
                        if n > HELD + len(wanted.anchor) * k:
                            held = cut()
                            n = len(held[0][0])
        if held:
            item, score, ids, rows = cut()[0]
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(score), pa.array(ids), pa.array(rows)], names=["item", "score", "vec_id", "row"])

    return run


FOUND = "item int, score long, vec_id long, row long"


def _bounds(index: DistanceIndex, anchors: Anchors, wanted: Wanted, k: int) -> list[np.ndarray]:
    """Least scores of the rounds' shells, outwards; the last are those wanted.

    First the score that as many of the sample reach as stand for 2 k rows, then the one that k of the sample
    reach, which as many rows reach for certain.
    """
    out = [np.empty(len(wanted.anchor), dtype=np.int64) for _ in range(2)]
    expected = max(1, -(-2 * k * len(index.sample) // max(1, index.n)))
    for lo in range(0, len(wanted.anchor), 1024):
        part = slice(lo, lo + 1024)
        mine, place = np.unique(wanted.anchor[part], return_inverse=True)
        scores = _products(anchors.v[mine], index.sample)[place]
        fits = ((anchors.labels[wanted.anchor[part]][:, None] == index.sample_labels) == wanted.same) & (anchors.rows[wanted.anchor[part]][:, None] != index.sample_rows)
        fits &= (scores >= wanted.low[part, None]) & (scores <= wanted.high[part, None])
        best = -np.sort(-np.where(fits, scores, LOW + 1), axis=1)
        for o, rank in zip(out, (expected, k)):
            o[part] = np.maximum(best[:, rank - 1], wanted.low[part]) if rank <= best.shape[1] else wanted.low[part]
    return [np.maximum(out[0], out[1]), out[1], wanted.low]


def search(index: DistanceIndex, anchors: Anchors, wanted: Wanted, k: int, pairs=None) -> DataFrame:
    """item, score, vec_id, row, rank: the k first rows of each item. pairs: an accumulator of multiplied pairs."""
    spark = index.table.sparkSession
    found, short, high = [], np.arange(len(wanted.anchor)), wanted.high.copy()
    numbers = np.zeros(len(wanted.anchor), dtype=np.int64)
    for low in _bounds(index, anchors, wanted, k):
        short = short[(numbers[short] < k) & (low[short] <= high[short])]
        if not len(short):
            continue
        now = Wanted(wanted.anchor[short], low[short], high[short], wanted.same)
        least, greatest = _intervals(anchors, now, index.most)
        near = [(F.col("pivot") == p) & F.col("distance").between(float(a), float(b)) for p, (a, b) in enumerate(zip(least.min(axis=0), greatest.max(axis=0)))]
        block = spark.sparkContext.broadcast((anchors, now))
        got = in_batches(index.table.filter(reduce(Column.__or__, near)), _scan(block, k, index.width, index.most, pairs), FOUND)
        best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "vec_id", "row"))
        got = got.withColumn("place", best).filter(F.col("place") <= k).drop("place")
        names = spark.sparkContext.broadcast(short)
        got = materialize(in_batches(got, _renamed(names), FOUND), "found")
        for item, n in got.groupBy("item").count().toPandas().itertuples(index=False):  # at most the block's items
            numbers[item] += n
        found.append(got)
        high[short] = low[short] - 1
        block.unpersist()
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "vec_id", "row"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)


def _renamed(names):
    """Items of a round by their numbers in the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(names.value[b.column("item").to_numpy()].astype(np.int32)), *b.columns[1:]], names=b.schema.names)

    return run


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent * score / 100, rounded up or down, without leaving 64 bits."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + (-(-rest * percent // 100) if up else rest * percent // 100)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", pairs=None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on vec_id; label an expression on the table's columns. Each anchor's positives are the
    best other rows of its label; each positive's negatives the best rows of another label whose score is between
    the two shares of the positive's score. pairs, if given, is an accumulator that counts multiplied pairs.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vec_col, scale, label.alias("label")).filter("label is not null")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "labelled-vectors")
    codes = materialize(rows.select("label").distinct().withColumn("code", F.monotonically_increasing_id()), "labels")
    rows = materialize(rows.join(codes, "label").select("row", "vec_id", F.col("code").alias("label"), "v"), "coded-vectors")
    index = build_index(rows, max(positives + 1, negatives))
    n = rows.filter(is_anchor).count()
    blocks, out = -(-n // ANCHOR_BLOCK), []
    for number in range(blocks):
        mine = rows.filter(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == number)).select("row", "label", "v", F.col("vec_id").alias("anchor_id"))
        table = mine.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        anchors = Anchors.of(table, index)
        every = np.arange(len(anchors.rows))
        near = search(index, anchors, Wanted(every, np.full(len(every), LOW), np.full(len(every), HIGH), True), positives, pairs)
        near = materialize(near.select(F.col("item").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives")
        pair = near.select("anchor", "place", "positive_score").toArrow()
        anchor, score = pair["anchor"].to_numpy().astype(np.int64), pair["positive_score"].to_numpy()
        wanted = Wanted(anchor, share(score, least_percent, True), share(score, most_percent, False), False)
        far = search(index, anchors, wanted, negatives, pairs)
        # a block's items and anchors by number: two tables of bounded size
        items = spark.createDataFrame(pa.table([pa.array(np.arange(len(anchor), dtype=np.int32)), pair["anchor"], pair["place"]], names=["item", "anchor", "place"]))
        ids = spark.createDataFrame(pa.table([pa.array(every.astype(np.int32)), table["anchor_id"]], names=["anchor", "anchor_id"]))
        named = far.join(items, "item").join(near, ["anchor", "place"]).join(ids, "anchor")
        out.append(materialize(named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], OUT)
