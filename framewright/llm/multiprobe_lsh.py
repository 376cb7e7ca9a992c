"""Approximate nearest neighbours by multiprobe p-stable hashing (Euclidean distance).

Each of `tables` tables hashes a vector by `projections` random Gaussian projections, floor((a.x + b) / width); its bucket
is the tuple of these values. A query doesn't look at its own bucket only: the difference of two vectors' projections is
normal with their distance as deviation, so the chance that a neighbour at distance R fell into a bucket is known from
where the query lies in its own. Buckets are visited in falling order of that chance until the chances add up to what
gives all tables together the success asked for. Candidates of all tables are merged by exact distances in double
precision.

The number of projections doesn't follow the table, so that a query's probes don't either: buckets grow instead, and are
joined in blocks of `block` vectors by `block` queries, dealt by hashes of their ids. R is each query's own distance of
its k-th neighbour, carried on from its distances to a bounded sample of `sample` vectors (chosen by a hash of their ids),
so that a large group of near copies doesn't shorten the reach of others. The k-th distance found is never below the true
one: where it is over R, or fewer than k were found, the query probes a second time with it. The sample also bounds what
is sent on; it gives no results. Every vector is indexed. A query that would need over `MOST` buckets of a table (one far
from all vectors, or a radius far over the width) is compared with all vectors, in blocks.

Edge cases: vectors that are null, zero, hold null or non-finite components or have another dimension than the sample's
first vector take no part; ties go to the smaller id; with fewer candidates than k all are returned; equal vectors
of different ids are neighbours at distance 0; repeated rows of one id count once; other columns, whatever their names,
are ignored; a table of k vectors or fewer is compared in full; very long vectors only make rows longer; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm._common import materialise

#: Buckets of a table that a query visits at most, and cells to either side; beyond it is compared with all vectors.
MOST, REACH = 4096, 16
#: The table that stands for blocks of all vectors.
ALL = -1


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x < 0, tail / 2, 1 - tail / 2)


class Tables:
    """The hash functions of all tables."""

    def __init__(self, dim: int, tables: int, k: int, width: float, seed: int):
        draw = np.random.default_rng(seed)
        self.a, self.b = draw.standard_normal((tables, k, dim)), draw.uniform(0, width, (tables, k))
        self.k, self.tables, self.width = k, tables, width
        self.code = draw.integers(1, 1 << 62, (tables, k)) * 2 + 1  # a bucket's key: its values' scalar product with these

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T + self.b[t]) / self.width

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.code[t]).sum(-1)

    def probes(self, x: np.ndarray, t: int, radius: np.ndarray, success: float) -> list[np.ndarray | None]:
        """For each query the keys of buckets in falling order of chance, until `success` is reached; None where that takes
        too many. radius: one a query."""
        out: list[np.ndarray | None] = [None] * len(x)
        reach = np.maximum(1, np.ceil(3 * radius / self.width))
        todo = np.flatnonzero(reach <= REACH)
        for most in (MOST >> 4, MOST):
            if not len(todo):
                break
            shifts = np.arange(-reach[todo].max(), reach[todo].max() + 1)
            at = self.places(x[todo], t)
            cell = np.floor(at)
            unit = self.width / radius[todo, None, None]
            low = (cell[:, :, None] + shifts - at[:, :, None]) * unit
            chance = _normal(low + unit) - _normal(low)  # query x projection x shift
            p, cells = np.ones((len(todo), 1)), np.zeros((len(todo), 1, 0))
            for i in range(self.k):  # the most likely beginnings hold the beginnings of the most likely buckets
                both = (p[:, :, None] * chance[:, None, i]).reshape(len(todo), -1)
                best = np.argsort(-both, 1, kind="stable")[:, :most]
                p = np.take_along_axis(both, best, 1)
                head, tail = best // len(shifts), shifts[best % len(shifts)] + cell[:, i][:, None]
                cells = np.concatenate([np.take_along_axis(cells, head[:, :, None], 1), tail[:, :, None]], 2)
            total = np.cumsum(p, 1)
            done = (total[:, -1] >= success) | (p.shape[1] == len(shifts) ** self.k)
            for n in np.flatnonzero(done):
                out[todo[n]] = self.keys(cells[n, : int(np.searchsorted(total[n], success)) + 1], t)
            todo = todo[~done]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bucket_counts(tables):
    """How many vectors of a batch are in each bucket."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t in range(tables.value.tables if len(x) else 0):
                keys, n = np.unique(tables.value.keys(np.floor(tables.value.places(x, t)), t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(n)], names=["t", "key", "n"])

    return run


def _indexed(tables):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t in range(tables.value.tables if len(x) else 0):
                keys = tables.value.keys(np.floor(tables.value.places(x, t)), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(keys), batch.column("id"), batch.column("vec")], names=["t", "key", "id", "vec"])

    return run


def _expected(d: np.ndarray, k: int, total: int) -> float:
    """The k-th of `total` distances, from the sorted ones of a sample: carried on by how they grow with their rank."""
    rank = k * len(d) / max(total, len(d))
    if rank >= k / 2:
        return float(d[min(math.ceil(rank), len(d)) - 1])
    t = min(len(d), 100)
    h = max(1, t // 4)
    if d[h - 1] <= 0 or t == h:
        return float(d[h - 1])
    return float(d[t - 1] * math.exp(math.log(rank / t) * math.log(d[t - 1] / d[h - 1]) / math.log(t / h)))


def _asked(tables, sample, k: int, total: int, success: float, again: bool):
    """For each query and table its probes, with the bound of what is sent on. again: only queries whose k-th distance found (null
    where fewer were) is over what they first probed with."""

    def run(batches):
        ids, vecs = sample.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                x, own, reach = _matrix(batch.column("vec")), np.array(batch.column("id")), batch.column("reach").to_pylist()
                radius, bounds = np.zeros(len(x)), np.zeros(len(x))
                for i in range(len(x)):
                    d = np.sort(np.sqrt(((vecs - x[i]) ** 2).sum(1))[ids != own[i]])
                    most = max(k, math.ceil(3 * k * len(d) / total))  # about 3k vectors of the table lie within
                    bounds[i] = d[most - 1] if len(d) >= most else math.inf
                    farthest = min(bounds[i], float(d[-1]) if len(d) else 1.0)
                    radius[i] = min(farthest, 1.05 * _expected(d, k, total)) if len(d) else farthest
                    if again:
                        found = farthest if reach[i] is None else reach[i]
                        bounds[i] = bounds[i] if reach[i] is None else reach[i]
                        radius[i] = found if reach[i] is None or found > radius[i] else -1
                radius = np.where(radius >= 0, np.maximum(radius, 1e-9), -1)
                asks = np.flatnonzero(radius > 0)
                if not len(asks):
                    continue
                found = [tables.value.probes(x[asks], t, radius[asks], success) for t in range(tables.value.tables)]
                rows = [(i, ALL, np.empty(0, np.int64)) if any(f[n] is None for f in found) else (i, t, found[t][n]) for n, i in enumerate(asks) for t in range(1 if any(f[n] is None for f in found) else len(found))]
                at = np.array([r[0] for r in rows])
                columns = [pa.array(own[at]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array(bounds[at]), batch.column("vec").take(pa.array(at))]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "t", "keys", "bound", "qvec"])

    return run


def _all_pairs(sample):
    """A query's distances to all of a few vectors."""

    def run(batches):
        ids, vecs = sample.value
        for batch in batches:
            for own, x in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                other = ids != own
                d = np.sqrt(((vecs[other] - np.array(x)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), own)), pa.array(ids[other]), pa.array(d)], names=["q", "id", "d"])

    return run


def _nearest(k: int):
    """Within a block of a bucket: the k nearest of each query of a block within the query's bound."""

    def run(key, left, right):
        empty = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        x, ids = _matrix(right.column("vec").combine_chunks()), np.array(right.column("id"))
        qs, qv, bounds = np.array(left.column("q")), _matrix(left.column("qvec").combine_chunks()), np.array(left.column("bound"))
        square, out = (x**2).sum(1), []
        for lo in range(0, len(qs), 256):
            part = qv[lo : lo + 256]
            own = (part**2).sum(1)
            rough = own[:, None] + square[None] - 2 * part @ x.T  # picks those whose distance is then worked out exactly
            slack = 1e-9 * (own[:, None] + square.max())
            rough[ids[None] == qs[lo : lo + 256, None]] = np.inf
            last = np.partition(rough, k - 1, 1)[:, k - 1 : k] if rough.shape[1] > k else np.full((len(part), 1), np.inf)
            i, j = np.nonzero((rough <= last + slack) & (rough <= bounds[lo : lo + 256, None] ** 2 + slack) & (rough < np.inf))
            d = np.sqrt(((x[j] - part[i]) ** 2).sum(1))
            by = np.lexsort((ids[j], d, i))
            i, j, d = i[by], j[by], d[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = (place < k) & (d <= bounds[lo + i])
            out.append(pa.table({"q": qs[lo + i[kept]], "id": ids[j[kept]], "d": d[kept]}))
        return pa.concat_tables(out)

    return run


def search(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, tables: int = 4, projections: int = 3, success: float = 0.95, block: int = 2048, sample: int = 4096, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), id_col, score (the distance). is_query: a condition on the rows of vectors."""
    spark = vectors.sparkSession
    schema = f"query_id bigint, rank int, {id_col} bigint, score double"
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    x = F.col(vec_col).cast(f"array<{kind}>")
    fit_to_use = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    good = vectors.filter(fit_to_use & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), x.alias("vec"), is_query.alias("asks"))
    total = good.count()
    if not total:
        return spark.createDataFrame([], schema)
    share = int((1 << 30) * min(1.0, 1.2 * sample / total))
    drawn = good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share).select("id", "vec").limit(sample).collect()
    if not drawn:
        drawn = good.select("id", "vec").limit(sample).collect()
    dim = len(drawn[0].vec)
    drawn = list({r.id: r for r in drawn if len(r.vec) == dim}.values())
    ids, vecs = np.array([r.id for r in drawn]), np.array([r.vec for r in drawn])
    good = good.filter(F.size("vec") == dim)
    width = max(float(np.sqrt(vecs.var(0).sum())) if len(vecs) > 1 else 1.0, 1e-9)
    shared, first = spark.sparkContext.broadcast(Tables(dim, tables, projections, width, seed)), spark.sparkContext.broadcast((ids, vecs))
    each = 1 - (1 - success) ** (1 / tables)

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("q", "id").agg(F.min("d").alias("d"))
        return best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "id"))).filter(F.col("rank") <= k)

    pairs = "q bigint, id bigint, d double"
    queries = good.filter("asks").select("id", "vec")
    if total <= sample and len(ids) <= k:
        nearest = ranked(queries.mapInArrow(_all_pairs(first), pairs))
        return nearest.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), F.col("d").alias("score"))

    rows = good.select("id", "vec")
    held = materialise(rows.mapInArrow(_bucket_counts(shared), "t int, key bigint, n bigint").groupBy("t", "key").agg(F.sum("n").alias("n")), "buckets")
    blocks = math.ceil(total / block)
    place = lambda c, parts: F.pmod(F.xxhash64(c), parts).cast("int")

    def asked(of: DataFrame, again: bool) -> DataFrame:
        return materialise(of.select("id", "vec", "reach").mapInArrow(_asked(shared, first, k, total, each, again), f"q bigint, t int, keys array<bigint>, bound double, qvec array<{kind}>"), "probes")

    def found(probes: DataFrame) -> DataFrame:
        index = rows.mapInArrow(_indexed(shared), f"t int, key bigint, id bigint, vec array<{kind}>")
        sizes = held
        if not probes.filter(F.col("t") == ALL).isEmpty():
            every = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
            probes = probes.withColumn("keys", F.when(F.col("t") == ALL, every).otherwise(F.col("keys")))
            index = index.unionByName(rows.select(F.lit(ALL).alias("t"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("key"), "id", "vec"))
            sizes = held.unionByName(spark.range(blocks).select(F.lit(ALL).alias("t"), F.col("id").alias("key"), F.lit(block).cast("bigint").alias("n")))
        asks = probes.select("q", "t", F.explode("keys").alias("key"), "bound", "qvec")
        visits = probes.select("t", F.explode("keys").alias("key")).groupBy("t", "key").agg(F.ceil(F.count("*") / block).alias("q_parts"))
        parts = sizes.select("t", "key", F.ceil(F.col("n") / block).alias("parts")).join(visits, ["t", "key"])
        asks = asks.join(parts, ["t", "key"]).select("q", "t", "key", "bound", "qvec", place("q", F.col("q_parts")).alias("q_part"), F.explode(F.expr("sequence(0, int(parts) - 1)")).alias("part"))
        met = index.join(parts, ["t", "key"]).select("t", "key", "id", "vec", place("id", F.col("parts")).alias("part"), F.explode(F.expr("sequence(0, int(q_parts) - 1)")).alias("q_part"))
        key = ["t", "key", "part", "q_part"]
        return asks.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_nearest(k), pairs)

    once = materialise(ranked(found(asked(queries.withColumn("reach", F.lit(None).cast("double")), False))).select("q", "id", "d"), "neighbours")
    last = once.groupBy(F.col("q").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).alias("reach"))
    more = asked(queries.join(last, "id", "left"), True)
    nearest = ranked(once if more.isEmpty() else once.unionByName(found(more)))
    return nearest.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), F.col("d").alias("score"))
