"""MinHash near-dedup with sequential Bayesian verification.

1. Every whole text gives its set of word shingles (64-bit hashes), a signature of PERMS minima and an
   order-free 128-bit digest of the set. Documents of equal sets form a class, which goes on as one node.
2. Signatures are banded. Only buckets with two classes or more go on.
3. Candidates are compared a batch of minima at a time and left as soon as the posterior probability
   (uniform prior) that their similarity reaches the threshold is below `miss`; survivors are verified
   exactly on full sets. What is asked for are components, so members of one need no comparison:
   a. each class meets the smallest node of its buckets,
   b. in buckets that still hold several components every class meets the bucket's smallest node,
   c. in buckets that then still do, all pairs across components are compared, in blocks of bounded size
      joined two by two; blocks of the bucket's largest component are not compared with each other. Each
      pair is handled in its first common band, and a block pair gives at most a spanning forest of links.
   So links are found as if all pairs of each bucket were compared. Step c grows with the square of the
   members that lie outside a bucket's largest component; a and b leave few of these.

A pair of similarity s shares no bucket with probability (1 - s^ROWS)^BANDS: 5e-7 at 0.8.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a
text of fewer words than a shingle has one shingle, the whole sequence; rows that repeat an id are documents
of their own; null ids are documents too, whose component has the smallest id there is, or none; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.llm.common import bitmap_of, fitting_bits, hashed_words, hit, in_batches, materialize, mix, rolled, slices, without_rows
from prismflow.llm.components import components

BANDS, ROWS = 48, 6
PERMS = BANDS * ROWS
#: Minima compared at once, and the chance at which a true pair may be left.
BATCH, MISS = 48, 1e-9
#: Members and bytes of sets of a block in step c; a set that is larger itself is a block of its own, on average.
GROUP, GROUP_BYTES = 128, 2 << 20

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 2**31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, PERMS, dtype=np.uint32)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and the number of each."""
    words, counts = hashed_words(texts, lower=True)
    runs = rolled(words, width, 1)
    out, sizes, at = [], np.zeros(len(counts), dtype=np.int64), 0
    for k, n in enumerate(counts.tolist()):
        if n >= width:
            own = np.sort(runs[at : at + n - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            own = rolled(words[at : at + n], n, 100 + n) if n else runs[:0]
        out.append(own)
        sizes[k] = len(own)
        at += n
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """PERMS 16-bit minima for each of the sets, none of them empty."""
    starts = np.cumsum(sizes) - sizes
    low = (mix(sets, 5) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sizes), PERMS), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for p in range(PERMS):
            out[:, p] = np.minimum.reduceat(low * _A[p] + _B[p], starts) >> np.uint32(8)  # the top bits of a minimum say little
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band; its low 6 bits are the band."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r], r + 1)
    return (key & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def fewest(threshold: float, miss: float = MISS) -> list[int]:
    """The fewest equal minima with which a pair goes on, after each batch.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, PERMS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signatures (rows of a and b) are left by no batch."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for step, bound in enumerate(least):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        equal = equal + (a[alive, cut] == b[alive, cut]).sum(axis=1)
        on = equal >= bound
        alive, equal = alive[on], equal[on]
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _binary_rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def digests(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set; 0 for empty ones."""
    full = sizes > 0
    one, two = np.zeros(len(sizes), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        one[full], two[full] = np.add.reduceat(mix(sets, 11), starts), np.add.reduceat(mix(sets, 23), starts)
    return one.view(np.int64), two.view(np.int64)


DESCRIBED = "doc_id long, tag long, n_shingles long, d1 long, d2 long, sig binary"


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, sizes = shingles(part.column("text"), width)
            full = sizes > 0
            sig: list[bytes | None] = [None] * len(sizes)
            if full.any():
                for k, s in zip(np.flatnonzero(full).tolist(), signatures(sets, sizes[full])):
                    sig[k] = s.tobytes()
            columns = [part.column("doc_id"), part.column("tag"), pa.array(sizes), *map(pa.array, digests(sets, sizes)), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DESCRIBED.split(", ")])

    return run


def _banded(bitmap=None):
    """Buckets and nodes of signatures; with a bitmap, of buckets that may hold several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_binary_rows(batch.column("sig"), np.uint16, PERMS)).reshape(-1)
                nodes = np.repeat(batch.column("id").to_numpy(), BANDS)
                if bitmap is not None:
                    on = hit(bitmap.value, keys)
                    keys, nodes = keys[on], nodes[on]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], names=["bucket", "id"])

    return run


def _sets_of(width: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.filter(pa.array(hit(bitmap.value, part.column("tag").to_numpy())))
            if not part.num_rows:
                continue
            sets, sizes = shingles(part.column("text"), width)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
            items = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(sets)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), items], names=["doc_id", "tag", "items"])

    return run


def _pruned(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_binary_rows(batch.column(c), np.uint16, PERMS) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).take(pa.array(survive(a, b, least)))

    return run


def _set(items: pa.Scalar) -> np.ndarray:
    return np.frombuffer(items.as_buffer(), dtype=np.uint64)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(_set(a), _set(b), percent) for a, b in zip(batch.column("ia"), batch.column("ib"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _block_links(percent: int, least: list[int]):
    """Links between components in pairs of blocks of one bucket."""

    def unpack(blocks: pa.ListArray, row: int) -> tuple:
        members = blocks[row].values
        sig, items = _binary_rows(members.field("sig"), np.uint16, PERMS), members.field("items")
        return members.field("id").to_numpy(), members.field("component").to_numpy(), sig, items, band_keys(sig)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                band = batch.column("bucket")[row].as_py() & 63
                left = unpack(batch.column("left"), row)
                alone = not batch.column("right")[row].is_valid
                right = left if alone else unpack(batch.column("right"), row)
                fresh = left[1][:, None] != right[1]
                for earlier in range(band):
                    fresh &= left[4][:, earlier, None] != right[4][:, earlier]
                if alone:
                    fresh = np.triu(fresh, 1)
                i, j = np.nonzero(fresh)
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for lo in range(0, len(i), 20_000):
                    a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
                    for k in survive(left[2][a], right[2][b], least).tolist():
                        p, q = int(a[k]), int(b[k])
                        x, y = find(int(left[1][p])), find(int(right[1][q]))
                        if x != y and linked(_set(left[3][p]), _set(right[3][q]), percent):
                            root[max(x, y)] = min(x, y)
                            found.append((int(left[0][p]), int(right[0][q])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


class _Verifier:
    """Links among candidate pairs: signatures first, then full sets of the survivors."""

    def __init__(self, sigs: DataFrame, sets: DataFrame, percent: int):
        self.sigs, self.sets, self.percent = sigs, sets, percent
        self.least = fewest(percent / 100)

    def _beside(self, pairs: DataFrame, table: DataFrame, column: str, out: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(table.select(F.col("id").alias(end), F.col(column).alias(f"{out}{end}")), end)
        return pairs

    def links(self, pairs: DataFrame) -> DataFrame:
        left = in_batches(self._beside(pairs, self.sigs, "sig", "s").select("a", "b", "sa", "sb"), _pruned(self.least), "a long, b long")
        full = self._beside(materialize(left, "survivors"), self.sets, "items", "i").select("a", "b", "ia", "ib")
        return materialize(in_batches(full, _verified(self.percent), "a long, b long"), "links")


def _mixed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (bucket, id, first, component) of buckets that hold several components."""
    label = components(edges).select(F.col("node").alias("id"), "component")
    known = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    return materialize(known.join(several, "bucket").select("bucket", "id", "first", "component"), "mixed")


def _blocks(mixed: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of blocks (bucket, left, right) that together compare all members across components; right is null for a block with itself."""
    sizes = mixed.join(sigs.select("id", "n_shingles"), "id").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    facts = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "component", "s")).alias("top"))
    # blocks by members and by the bytes of their sets
    blocks = lambda n, s: F.greatest(F.ceil(n / GROUP), F.ceil(s * 8 / GROUP_BYTES)).cast("int")
    minors, majors = blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")), blocks(F.col("top.n"), F.col("top.s"))
    facts = facts.filter("n > 2").select("bucket", F.col("top.component").alias("major"), minors.alias("minors"), majors.alias("majors"))
    rows = mixed.join(facts, "bucket")
    minor = F.col("component") != F.col("major")
    place = lambda n: F.pmod(F.xxhash64("id", "bucket"), n).cast("int")
    # blocks of smaller components come first, 0 to minors - 1, those of the largest after them
    rows = rows.withColumn("block", F.when(minor, place(F.col("minors"))).otherwise(F.col("minors") + place(F.col("majors"))))
    full = rows.select("bucket", "block", "minors", "majors", "id", "component").join(sigs.select("id", "sig"), "id").join(sets, "id")
    packed = full.groupBy("bucket", "block", "minors", "majors").agg(F.collect_list(F.struct("id", "component", "sig", "items")).alias("left"))
    packed = materialize(packed, "blocks")
    first = packed.filter("block < minors")
    alone = first.select("bucket", "left", F.lit(None).cast(packed.schema["left"].dataType).alias("right"))
    partner = F.sequence(F.col("block") + 1, F.col("minors") + F.col("majors") - 1)
    two = first.select("bucket", "left", F.explode(F.when(F.col("block") + 1 < F.col("minors") + F.col("majors"), partner)).alias("block"))
    return alone.unionByName(two.join(packed.select("bucket", "block", F.col("left").alias("right")), ["bucket", "block"]).select("bucket", "left", "right"))


def _text_tag(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: doc_id, tag, n_shingles, component_id, and keep: whether it is the one that stays."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_tag(text_col).alias("tag"))
    described = in_batches(texts, _described(width), DESCRIBED).withColumn("node", F.monotonically_increasing_id())
    described = materialize(described, "signatures")
    # equal sets have equal signatures; a class is the node of one of its rows, and its first document stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tag")).alias("first")
    classes = described.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("node").alias("id"), first, F.any_value("sig").alias("sig"))
    classes = materialize(classes.select("id", "first", "d1", "d2", "n_shingles", "sig"), "classes")
    banded = in_batches(classes.select("id", "sig"), _banded(), "bucket long, id long")
    shared = materialize(banded.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "first"), "shared")
    bitmap = spark.sparkContext.broadcast(bitmap_of(shared, F.col("bucket"), fitting_bits(shared.count())))
    members = in_batches(classes.select("id", "sig"), _banded(bitmap), "bucket long, id long")
    members = materialize(members.join(shared, "bucket"), "buckets")
    sigs = materialize(classes.join(members.select("id").distinct(), "id", "left_semi"), "active")
    bitmap = spark.sparkContext.broadcast(bitmap_of(sigs, F.col("first.tag"), fitting_bits(sigs.count())))
    wanted = sigs.select("id", F.col("first.doc_id").alias("of"), F.col("first.tag").alias("of_tag"))
    sets = in_batches(texts, _sets_of(width, bitmap), "doc_id long, tag long, items binary")
    sets = sets.join(wanted, sets["doc_id"].eqNullSafe(wanted["of"]) & (sets["tag"] == wanted["of_tag"])).select("id", "items")
    sets = materialize(sets.dropDuplicates(["id"]), "sets")  # repeated rows
    verifier = _Verifier(sigs, sets, percent)
    nearest = members.groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a")).filter("a <> b")
    edges = verifier.links(nearest.select("a", "b"))
    mixed = _mixed(members, edges)
    of_first = mixed.filter("id = first").select("bucket", F.col("component").alias("c"))
    again = mixed.join(of_first, "bucket").filter("component <> c").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    edges = edges.unionByName(verifier.links(again))
    mixed = _mixed(mixed.drop("component"), edges)
    rest = in_batches(_blocks(mixed, sigs, sets), _block_links(percent, verifier.least), "a long, b long")
    edges = edges.unionByName(materialize(rest, "links"))
    label = components(edges).select(F.col("node").alias("id"), "component")
    whole = classes.select("id", "first", "d1", "d2", "n_shingles").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # stored apart, so that the join deals its rows out anew and a large component can be split
    leaders = materialize(whole.groupBy("component").agg(F.min("first").alias("leader")), "leaders")
    whole = materialize(whole.join(leaders, "component").select("d1", "d2", "n_shingles", "leader"), "labels")
    rows = described.drop("sig", "node")
    found = rows.filter("n_shingles > 0").join(whole, ["d1", "d2", "n_shingles"])
    keep = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("tag") == F.col("leader.tag"))
    found = found.select("doc_id", "tag", "n_shingles", F.col("leader.doc_id").alias("component_id"), keep.alias("keep"))
    return found.unionByName(rows.filter("n_shingles = 0").select("doc_id", "tag", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keep")))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    return _grouped(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", F.col("keep").alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one document left of each group: the one of smallest id (null last), then of least text hash.

    Rows that repeat its id and text stay with it; exact dedup takes care of these.
    """
    gone = _grouped(docs, width, percent, id_col, text_col).filter("not keep").select("doc_id", "tag").distinct()
    return without_rows(docs, gone, [F.col(id_col).cast("long"), _text_tag(text_col)])
