"""Centroid clustering in whole numbers, by heap-ordered bounds: exactly what assigning every vector to its nearest centroid in each
round gives, with few distances worked out after the first.

Vectors lie in blocks, dealt once to buckets. Each cluster of a block keeps a heap of its vectors by the gap between the lower
bound of the distance to any other centroid and the upper bound of the distance to its own, plus what centroids had drifted when
the vector was put there. After each round the drift a cluster has accumulated (its centroid's and the farthest of the others')
grows; only vectors whose key it has passed are popped, compared with all centroids and pushed again, and only their sums move.

Each round is one pass over the blocks, joined with their heaps by bucket without an exchange, and writes the new heaps with the
sums to the shared folder; the driver sees one sum of each component of each cluster. Blocks keep their vectors' sums as whole
numbers, so that centroids are exact.

Vectors of another size, or null, or with a null or non-finite component don't take part. Rows with a null id do, but never start a
cluster; repeated rows and ids count each; equal distances go to the smaller number; with fewer vectors than clusters there are as
many clusters as vectors with an id; without any, an empty table. A component that scales to more than 2 ** 27 is an error, since
distances would pass what a long holds. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm._common import materialise, small_batches
from framewright.shared import fresh_path

#: Vectors of a block; blocks of a bucket, about; largest scaled component.
BLOCK, BUCKET, MOST = 1024, 64, 1 << 27
_STATE = "block long, sizes array<int>, keys binary, places binary, sums binary, moved array<long>"


def kept(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and v, the components as whole numbers, of vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    plain = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select("vec_id", x.alias("x")).filter((F.size("x") == size) & F.forall("x", plain))
    whole = F.transform("x", lambda c: F.when(F.abs(scale * c) <= MOST, F.floor(scale * c).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int")))
    return rows.select("vec_id", whole.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Vectors (vec_id, v) as blocks of BLOCK rows."""
    number, held, n = TaskContext.get().partitionId() << 32, [], 0

    def block(table: pa.Table) -> pa.RecordBatch:
        v = np.asarray(table.column("v").combine_chunks().flatten(), np.int32)
        ids = table.column("vec_id").combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([v.tobytes()], pa.binary())], names=["block", "ids", "v"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= BLOCK:
            rows, whole = pa.concat_tables(held), n - n % BLOCK
            for at in range(0, whole, BLOCK):
                yield block(rows.slice(at, BLOCK))
                number += 1
            held, n = [rows.slice(whole)], n - whole
    if n:
        yield block(pa.concat_tables(held))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors (rows) and centroids (columns)."""
    v, c = v.astype(np.int64), centroids.astype(np.int64)
    own = (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :]
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most * most * v.shape[1] < 1 << 52:  # doubles hold all products and their sums
        return own - 2 * (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return ((v[:, None, :] - c[None, :, :]) ** 2).sum(2) if len(v) <= 64 else np.concatenate([squared(v[i : i + 64], c) for i in range(0, len(v), 64)])


class Heaps:
    """A block's vectors by cluster: heaps of (key, place in the block), and the sums of the vectors of each cluster."""

    def __init__(self, clusters: int, size: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        self.sums = np.zeros((clusters, size), np.int64)

    @classmethod
    def read(cls, sizes: list[int], keys: bytes, places: bytes, sums: bytes) -> Heaps:
        out = cls(len(sizes), 0)
        pairs = list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(places, "<i4").tolist(), strict=True))
        ends = np.cumsum([0, *sizes]).tolist()
        out.heaps = [pairs[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        out.sums = np.frombuffer(sums, "<i8").reshape(len(sizes), -1).copy()
        return out

    def written(self) -> tuple[list[int], bytes, bytes, bytes]:
        pairs = [p for h in self.heaps for p in h]
        return [len(h) for h in self.heaps], np.array([k for k, _ in pairs], "<f8").tobytes(), np.array([i for _, i in pairs], "<i4").tobytes(), self.sums.astype("<i8").tobytes()

    def expired(self, drift: list[float]) -> tuple[list[int], list[int]]:
        """Pops whatever's gap may be used up: places, and the clusters they were in."""
        places, clusters = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                places.append(heapq.heappop(heap)[1])
                clusters.append(c)
        return places, clusters

    def push(self, places: list[int], before: list[int], v: np.ndarray, centroids: np.ndarray, drift: list[float]) -> int:
        """Compares vectors with all centroids and puts them where they belong; before: the clusters they were in, -1 for none.
        Returns how many moved."""
        if not places:
            return 0
        rows = v[places].astype(np.int64)
        d = squared(rows, centroids)
        nearest = d.argmin(1)  # the first of equal ones
        upper = np.sqrt(d[np.arange(len(d)), nearest].astype(np.float64))
        if d.shape[1] > 1:
            d[np.arange(len(d)), nearest] = np.iinfo(np.int64).max
            lower = np.sqrt(d.min(1).astype(np.float64))
        else:
            lower = np.full(len(d), np.inf)
        at = np.array(drift)[nearest]
        keys = lower - upper + at - 1e-9 * (1 + upper + at)  # a little early rather than late
        before = np.array(before)
        moved = nearest != before
        np.add.at(self.sums, nearest[moved], rows[moved])
        left = moved & (before >= 0)
        np.subtract.at(self.sums, before[left], rows[left])
        for key, place, c in zip(keys.tolist(), places, nearest.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, place))
        return int(moved.sum())

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for c, heap in enumerate(self.heaps):
            out[[i for _, i in heap]] = c
        return out


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: list[float], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Heaps of each block after centroids drifted; in the last round the sum of distances of each cluster stands for its sums."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row in batch.to_pylist():
            v = np.frombuffer(row["v"], "<i4").reshape(-1, centroids.shape[1])
            if first:
                heaps = Heaps(*centroids.shape)
                places, before = list(range(len(v))), [-1] * len(v)
            else:
                heaps = Heaps.read(row["sizes"], row["keys"], row["places"], row["sums"])
                places, before = heaps.expired(drift)
            moved = heaps.push(places, before, v, centroids, drift)
            sizes, keys, held, sums = heaps.written()
            if last:
                own = heaps.clusters(len(v))
                inertia = np.zeros(len(centroids), np.int64)
                np.add.at(inertia, own, ((v.astype(np.int64) - centroids[own]) ** 2).sum(1))
                sums = inertia.astype("<i8").tobytes()
            for column, value in zip(out, (row["block"], sizes, keys, held, sums, [len(places), moved]), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["block", "sizes", "keys", "places", "sums", "moved"])


class _Buckets:
    """Tables of blocks in the shared folder, dealt to the same buckets, so that joining them by block moves no row."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, deal: bool = False) -> tuple[str, str]:
        """Name and path of a table of df; it is dealt out first if asked for, else has been by block."""
        name, path = f"blocks_{uuid.uuid4().hex}", fresh_path(self.spark, "blocks")
        df = df.repartition(self.buckets, "block") if deal else df
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", path).option("parquet.block.size", 16 << 20).option("compression", "zstd").saveAsTable(name)
        self.names.append(name)
        return name, path

    def forget(self) -> None:
        """The catalog's entries go; the files stay, as results are read from them later."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _totals(states: DataFrame, clusters: int, size: int) -> np.ndarray:
    """Sums over all blocks, exact: a row for each task and cluster, then one for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            for sums, sizes in zip(batch.column("sums").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                total += np.frombuffer(sums, "<i8").reshape(clusters, size)
                n += np.array(sizes)
        cells = np.concatenate([total, n[:, None]], 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "total"])

    rows = states.select("sums", "sizes").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # clusters * (size + 1) rows
    out = np.zeros(clusters * (size + 1), np.int64)
    for r in rows:
        out[r.cell] = r.total
    return out.reshape(clusters, size + 1)


def starts(rows: DataFrame, clusters: int, key: Column) -> np.ndarray:
    """The vectors with the least key."""
    first = rows.filter("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64)


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> tuple[DataFrame, dict]:
    """A row for each vector (vec_id, embedding) that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256; and the centroids with how many vectors each round compared and moved.

    Centroids start as the vectors with the least SHA-256 of 'seed:vec_id', move to the floor of their vectors' mean in each of
    the rounds and stay where they are without any; then vectors are assigned once more."""
    spark = vectors.sparkSession
    small_batches(spark, 64)
    rows = kept(vectors, size, scale)
    c = starts(rows, clusters, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(c):
        nothing = spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return nothing, {"centroids": c, "compared": [], "moved": []}
    k = len(c)
    blocks = materialise(rows.mapInArrow(lambda batches: _blocks(batches, size), f"block long, ids array<{kind}>, v binary"), "vectors")
    tables = _Buckets(spark, min(100_000, max(1, math.ceil(blocks.count() / BUCKET))))
    held, _ = tables.write(blocks, deal=True)
    drift, states, compared, moved = [0.0] * k, None, [], []
    for r in range(rounds + 1):
        joined = spark.table(held).select("block", "v")
        if states is not None:
            joined = joined.join(spark.table(states).select("block", "sizes", "keys", "places", "sums").hint("shuffle_hash"), "block")
        last = r == rounds
        step = lambda batches, c=c, drift=drift, first=states is None, last=last: _round(batches, c, drift, first, last)
        states, path = tables.write(joined.mapInArrow(step, _STATE))
        written = spark.read.schema(_STATE).parquet(path)
        told = written.agg(F.sum(F.col("moved")[0]), F.sum(F.col("moved")[1])).first()
        compared.append(told[0])
        moved.append(told[1])
        totals = _totals(written, k, 1 if last else size)
        if not last:
            following = np.array([[s // n for s in sums] if n else old for (*sums, n), old in zip(totals.tolist(), c.tolist(), strict=True)], np.int64)
            shift = [math.sqrt(sum(x * x for x in a)) * (1 + 1e-9) for a in (following - c).tolist()]
            drift = [d + shift[i] + max([0.0, *shift[:i], *shift[i + 1 :]]) for i, d in enumerate(drift)]
            c = following
    own = totals[:, 0].tolist()
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]

    def told_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["v", "sizes", "keys", "places"]).to_pylist()):
                v = np.frombuffer(row["v"], "<i4").reshape(-1, size)
                at = Heaps.read(row["sizes"], row["keys"], row["places"], b"").clusters(len(v))
                d = ((v.astype(np.int64) - c[at]) ** 2).sum(1)
                told = [pa.array(np.array(own)[at]), pa.array(np.full(len(v), sum(own))), pa.array([digests[x] for x in at], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(at), pa.array(d), *told], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    final = spark.table(held).join(spark.table(states).select("block", "sizes", "keys", "places").hint("shuffle_hash"), "block").select("ids", "v", "sizes", "keys", "places")
    out = final.mapInArrow(told_of, f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    tables.forget()
    return out, {"centroids": c, "compared": compared, "moved": moved}
