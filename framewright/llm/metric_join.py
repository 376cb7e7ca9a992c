"""Exact Jaccard join of documents as a metric-space join.

A document is its set of k-word shingles; the Jaccard distance between sets is a metric. Two documents link when
100 * intersection >= share * union, that is at a distance of at most r = 1 - share / 100.

1. Equal sets are one class, stood for by its smallest id; copies are never paired.
2. Unrelated texts all lie at a distance of almost 1 from any document, so distances to documents alone can't part
   them. Anchors do: of the shingles, in one global order with common ones last, the first n - ceil(share * n) + 1 of
   each set, each for the set's band of sizes (and for the next if a link can reach it). Linked sets share an anchor.
   The pivot of an anchor is the smallest id that holds it, a pivot's region all classes that share an anchor with
   it; so linked classes meet in a region.
3. Regions of up to `sketched` classes (and a bounded number of shingles) first meet as sketches: numbers of shingles by hash in about n / 8 buckets, whose
   smaller ones add up to a bound of the intersection. That bound gives a distance below the true one, so only
   groups that it holds together go on, each with its smallest id as the pivot.
4. A region is joined recursively. Some of its classes are pivots, and the exact distances of all to them make Voronoi
   cells: by the triangle inequality two linked classes both lie in the cell of the pivot next to one of them if a cell
   takes in all whose distance to its pivot is at most 2 r over that to their own nearest. Classes within r of a pivot
   are linked by it; a cell without others is done, the rest is cut again by pivots of its own. Regions and cells of up
   to `leaf` classes and `most` shingles are cut within one task, larger ones by Spark, a level a round. A region whose cells hold over half as
   many pairs as itself is joined directly: a small one at once, a large one in blocks of the same bounds, by shells of their
   distances to the pivot that differ by r at most.
5. Components of the links by alternating large-star and small-star rounds.

The order of shingles comes from a table of counts of fixed size (2 ** 18 slots for all shingles of the corpus). It
steers the work only, any order gives the same links.

Edge cases: a null or empty text has no shingles and links with nothing; a text of fewer than k words is one shingle,
its whole sequence; rows with a null id take part in no link and have a null component; rows of one id are one
document, which is linked with all that any of its texts links with, while n_shingles is each row's own; texts are read
whole, a very long one alone; other columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm._common import materialise, sieve, slices
from framewright.llm._words import NOT_SPACE, Words, grams, mix

_SLOTS = 18
#: Shingles of a region that one task holds: about 50 bytes each as sets, 2 each as sketches.
SET_SHINGLES, SKETCH_SHINGLES = 1 << 22, 1 << 24


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, NOT_SPACE)
    hashes, first = words.hashes(), words.first
    runs, out = grams(hashes, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h = np.sort(runs[a : b - k + 1] if b - a >= k else grams(hashes[a:b], b - a) if b > a else runs[:0])
        out.append(h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h)
    return out


def _slot_counts(k: int):
    def run(batches):
        total = np.zeros(1 << _SLOTS, np.int64)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - _SLOTS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(total[at[i : i + (1 << 16)]])], names=["slot", "n"])

    return run


def _anchored(k: int, share: int, levels):
    """id, n, sig, anchors, sketch. An anchor is a shingle and a band of sizes; the first shingles of the global order,
    level of commonness, then hash, give a set's anchors."""
    width = 4 * np.log(100 / share) or 1.0  # at 100 sets link only within their class, and no anchor decides anything

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            sig, anchors, sketches = [], [], []
            for h in sets:
                n = len(h)
                sig.append(xxhash.xxh3_128_digest(h) if n else None)
                p = n - (share * n + 99) // 100 + 1 if n else 0
                place = (levels.value[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)] << np.uint64(57)) | (h >> np.uint64(7))
                first = np.partition(place, p - 1)[:p] if p else place[:0]
                bands = range(int(np.log(n) / width), int((np.log(n * 100 / share) + 1e-9) / width) + 1) if n else []
                anchors.append(np.concatenate([mix(first + np.uint64(b << 1)) for b in bands] or [first]).view(np.int64))
                size = 1 << max(3, (n // 8).bit_length())
                held = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
                sketches.append(held.astype(np.uint8 if held.max() < 256 else np.uint32).tobytes())
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(a) for a in anchors], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(anchors) if anchors else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(sig, pa.binary()), lists, pa.array(sketches, pa.binary())], names=["id", "n", "sig", "anchors", "sketch"])

    return run


def _sketch(n: int, data: bytes) -> np.ndarray:
    """A set's counts: of one byte, or of four where one doesn't do."""
    return np.frombuffer(data, np.uint8 if len(data) == 1 << max(3, (n // 8).bit_length()) else np.uint32)


def _may_link(n: np.ndarray, sketches: list[np.ndarray], share: int) -> np.ndarray:
    """The square matrix of pairs whose sketches allow a link. Sketches have sizes of powers of two; where two differ by
    one power the larger is folded, where by more the sets' sizes rule out a link."""
    links = np.eye(len(n), dtype=bool)
    size = np.array([len(x) for x in sketches])
    for b in np.unique(size):
        at = np.flatnonzero((size == b) | (size == 2 * b))
        rows = np.array([sketches[i] if size[i] == b else sketches[i].reshape(2, -1).sum(0) for i in at], np.int64)
        for j in np.flatnonzero(size[at] == b):
            most = np.minimum(rows[j], rows).sum(1)
            ok = 100 * most >= share * (n[at[j]] + n[at] - most)
            links[at[j], at] |= ok
            links[at, at[j]] |= ok
    return links


def _sifted(share: int):
    """Rows (g, id, n, sketch), sorted by g, to (g, id, n) of what may link, g being the smallest id of its group."""

    def run(batches):
        now, held, out = None, [], []

        def close():
            if len(held) > 1:
                ids = np.array([x[0] for x in held], np.int64)
                edges = _stars(ids, _may_link(np.array([x[1] for x in held]), [_sketch(x[1], x[2]) for x in held], share))
                sizes = {x[0]: x[1] for x in held}
                out.extend((v, u, sizes[u]) for u, v in edges)
                out.extend((v, v, sizes[v]) for v in {v for _, v in edges})

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "n", "sketch")), strict=True):
                if g != now:
                    close()
                    now, held = g, []
                held.append(row)
            if len(out) > 10_000:
                yield _edges(out, ["g", "id", "n"])
                out = []
        close()
        yield _edges(out, ["g", "id", "n"])

    return run


def _levels(docs: DataFrame, k: int):
    """For each slot twice the binary logarithm of its shingle count, 0 to 63: a table of fixed size."""
    counts = docs.mapInArrow(_slot_counts(k), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    levels = np.zeros(1 << _SLOTS, np.uint64)
    for slot, n in counts.select("slot", "n").toLocalIterator():
        levels[slot] = min(63, int(2 * np.log2(n)))
    return docs.sparkSession.sparkContext.broadcast(levels)


def _linked(sets: list[np.ndarray], share: int) -> np.ndarray:
    """The square matrix of links between sets."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.array([[n[0], x := len(np.intersect1d(*sets, assume_unique=True))], [x, n[1]]])
    else:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        col = np.cumsum(new) - 1
        many = np.bincount(col)[col] > 1  # others are in one set only
        col, row = col[many], row[many]
        col = np.cumsum(np.r_[True, col[1:] != col[:-1]]) - 1 if len(col) else col
        both = np.zeros((len(sets), len(sets)))
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):
            a, b = np.searchsorted(col, [lo, lo + 8192])
            x = np.zeros((len(sets), min(8192, int(col[-1]) + 1 - lo)), np.float32)
            x[row[a:b], col[a:b] - lo] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        np.fill_diagonal(both, n)
    return 100 * both >= share * (n[:, None] + n[None] - both)


def _stars(ids: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """An edge from each member of a component to the component's smallest id."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    links = links[order][:, order]
    while True:  # smallest place among neighbours, until nothing changes
        least = np.where(links, label[None], len(ids)).min(1)
        if (least == label).all():
            break
        label = np.minimum(label, least)
    ids = ids[order]
    return [(int(ids[i]), int(ids[j])) for i, j in enumerate(label) if i != j]


def _overlaps(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of sets (none empty) with each of the pivots."""
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(n)[:-1]]
    both = [np.add.reduceat((p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat).astype(np.int64), starts) for p in pivots]
    both = np.stack(both, 1)
    return both, n[:, None] + np.array([len(p) for p in pivots])[None] - both


def _cells(both: np.ndarray, union: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets each pivot links, and which lie in its Voronoi cell or the window around it."""
    d = 1 - both / union
    return 100 * both >= share * union, d <= d.min(1, keepdims=True) + (100 - share) / 50 + 1e-9


def _recursive(ids: np.ndarray, sets: list[np.ndarray], share: int, few: int = 16) -> list[tuple[int, int]]:
    """Links of distinct sets, enough of them to connect all that link: by pivots and their cells, down to `few` sets."""
    at = range(0, len(sets), max(1, len(sets) // 8))
    if len(sets) > few:
        linked, cell = _cells(*_overlaps(sets, [sets[i] for i in at]), share)
        rest = [np.flatnonzero(cell[:, j]) for j in range(len(at)) if not linked[cell[:, j], j].all()]
        if sum(len(own) ** 2 for own in rest) <= len(sets) ** 2 / 2:  # else cutting saves nothing against all pairs
            out = [(int(ids[x]), int(ids[i])) for j, i in enumerate(at) for x in np.flatnonzero(linked[:, j]) if x != i]
            for own in rest:
                out += _recursive(ids[own], [sets[x] for x in own], share, few)
            return out
    return _stars(ids, _linked(sets, share)) if len(sets) > 1 else []


def _grouped(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows (g, id, text), sorted by g, as ids and shingle sets of one g at a time."""
    now, ids, sets = None, [], []
    for batch in slices(batches, "text"):
        for g, i, s in zip(batch.column("g").to_pylist(), batch.column("id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
            if g != now and ids:
                yield ids, sets
                ids, sets = [], []
            now = g
            ids.append(i)
            sets.append(s)
    if ids:
        yield ids, sets


def _edges(rows: list[tuple[int, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def _joined(k: int, share: int):
    def run(batches):
        out: list[tuple[int, int]] = []
        for ids, sets in _grouped(batches, k):
            out += _recursive(np.array(ids, np.int64), sets, share)
            if len(out) > 10_000:
                yield _edges(out, ["u", "v"])
                out = []
        yield _edges(out, ["u", "v"])

    return run


def _placed(k: int, share: int):
    """Rows (g, salt, pivot, id, text), sorted by g and salt, pivots first by id, to (g, at, id, n, both, union, inside, first): the
    members with each pivot `at` in whose cell or window they lie (inside), and with the first pivot."""

    def run(batches):
        now, pivots, sets = None, [], []
        for batch in slices(batches, "text"):
            rows, members = [], []

            def measured(rows=rows, members=members):
                both, union = _overlaps([m[1] for m in members], sets)
                cell = _cells(both, union, share)[1]
                told = cell.copy()
                told[:, 0] = True
                rows.extend((now[0], pivots[j], members[i][0], len(members[i][1]), int(both[i, j]), int(union[i, j]), int(cell[i, j]), int(j == 0)) for i, j in zip(*np.nonzero(told), strict=True))
                members.clear()

            of = zip(*(batch.column(c).to_pylist() for c in ("g", "salt", "pivot", "id")), shingle_sets(batch.column("text"), k), strict=True)
            for g, salt, is_pivot, i, own in of:
                if (g, salt) != now:
                    if members:
                        measured()
                    now, pivots, sets = (g, salt), [], []
                if is_pivot:
                    pivots.append(i)
                    sets.append(own)
                else:
                    members.append((i, own))
            if members:
                measured()
            yield _edges(rows, ["g", "at", "id", "n", "both", "union", "inside", "first"])

    return run


def _signed(k: int):
    def run(batches):
        for batch in slices(batches, "text"):
            sig = [xxhash.xxh3_128_digest(h) if len(h) else None for h in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sig, pa.binary()), batch.column("text")], names=["id", "sig", "text"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (u, v)."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        told = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen or not told[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = told
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u > v").distinct(), "edges")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 80, leaf: int = 256, sketched: int = 2048, most: int = SET_SHINGLES, most_sketched: int = SKETCH_SHINGLES) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id that links reach, the row's own included) for every row.

    share: the least similarity in hundredths, over 50. A task compares regions of up to leaf classes and most shingles (or of two
    classes) as sets, of up to sketched classes and most_sketched shingles as sketches; larger ones are cut over tasks."""
    if not 50 < share <= 100:
        raise ValueError("share must be over 50 (sketches of sets that differ by more than a factor of two aren't compared)")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialise(docs.mapInArrow(_anchored(k, share, _levels(docs, k)), "id bigint, n bigint, sig binary, anchors array<bigint>, sketch binary"), "sets")
    named = sets.filter("sig is not null and id is not null")
    classes = named.groupBy("sig").agg(F.min("id").alias("rep"), F.any_value("anchors").alias("anchors"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")).withColumn("node", F.col("rep"))
    # An id with several texts is in several classes: those that it stands for get numbers over all ids, and are linked with it.
    several = materialise(named.groupBy("id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a <> b").select("id"), "several")
    apart = edges = None
    if not several.isEmpty():
        over = F.lit(named.agg(F.max("id")).first()[0] + 1)
        apart = materialise(classes.select("sig", "rep").join(several.withColumnRenamed("id", "rep"), "rep", "left_semi").withColumn("own", over + F.monotonically_increasing_id()), "apart")
        classes = classes.join(apart.select("sig", "own"), "sig", "left").withColumn("node", F.coalesce("own", "rep")).drop("own")
        edges = named.join(several, "id", "left_semi").join(classes.select("sig", "node"), "sig").select(F.col("id").alias("u"), F.col("node").alias("v"))
    if share == 100:  # equal sets are one class already
        found = components(edges) if edges is not None else None
        return _named_components(sets, named, classes, found, id_col)
    held = classes.select(F.col("node").alias("id"), "n", F.explode("anchors").alias("anchor"))
    pivots = held.groupBy("anchor").agg(F.min("id").alias("g"), F.count("*").alias("c")).filter("c > 1").select("anchor", "g")
    regions = materialise(held.join(pivots, "anchor").select("g", "id", "n").distinct(), "regions")
    large = regions.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("held")).filter((F.col("size") > sketched) | (F.col("held") > most_sketched)).select("g")
    meet = regions.join(large, "g", "left_anti").join(classes.select(F.col("node").alias("id"), "sketch"), "id").select("g", "id", "n", "sketch")
    sifted = meet.repartition("g").sortWithinPartitions("g").mapInArrow(_sifted(share), "g bigint, id bigint, n bigint")
    regions = materialise(sifted.unionByName(regions.join(large, "g", "left_semi")).distinct(), "regions")
    needed = regions.select("id").distinct()
    maybe = sieve(needed, "id")
    texts = docs.filter(maybe(F.col("id"))).join(needed, "id", "left_semi")
    if apart is not None:
        signed = docs.join(several, "id", "left_semi").mapInArrow(_signed(k), "id bigint, sig binary, text string").withColumnRenamed("id", "rep")
        texts = texts.join(several, "id", "left_anti").unionByName(signed.join(apart, ["rep", "sig"]).select(F.col("own").alias("id"), "text"))
    texts = materialise(texts.dropDuplicates(["id"]), "texts")

    rest, depth = regions.select("g", "id", "n"), 0
    small_enough = (F.col("size") <= leaf) & ((F.col("held") <= most) | (F.col("size") <= 2))
    while True:
        sized = rest.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("held"))
        small = rest.join(sized.filter(small_enough).select("g"), "g", "left_semi")
        found = _local(small.join(texts, "id").select("g", "id", "text"), k, share)
        edges = found if edges is None else edges.unionByName(found)
        big = rest.join(sized.filter(~small_enough).select("g", "size"), "g")
        if big.isEmpty():
            break
        placed = _cut(materialise(big, "large"), texts, k, share, leaf, depth)
        edges = edges.unionByName(placed.filter("near and id <> at").select(F.col("id").alias("u"), F.col("at").alias("v")))
        cells = placed.filter("inside = 1")
        told = cells.groupBy("g", "at").agg(F.count("*").alias("c"), F.max("size").alias("size"), F.min("near").alias("done")).filter("not done")
        cost = told.groupBy("g").agg(F.sum(F.pow("c", F.lit(2.0))).alias("pairs"), F.max("size").alias("size"))
        stuck = materialise(cost.filter("pairs > pow(size, 2) / 2").select("g"), "stuck")  # cutting saves nothing against all pairs
        if not stuck.isEmpty():
            edges = edges.unionByName(_in_blocks(placed.filter("first = 1").join(stuck, "g", "left_semi"), texts, k, share, leaf, most))
        rest = cells.join(told.join(stuck, "g", "left_anti").select("g", "at"), ["g", "at"], "left_semi")
        rest = materialise(rest.select(F.xxhash64("g", "at", F.lit(depth)).alias("g"), "id", "n").distinct(), "cells")
        depth += 1

    return _named_components(sets, named, classes, components(edges), id_col)


def _named_components(sets: DataFrame, named: DataFrame, classes: DataFrame, found: DataFrame | None, id_col: str) -> DataFrame:
    """The rows of near_duplicates, from the components of classes that links join (node, component)."""
    of_class = classes.select("sig", F.col("rep").alias("component"))
    if found is not None:
        joined = classes.select("sig", "rep", "node").join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        of_class = joined.select("sig", F.coalesce("component", "rep").alias("component"))
    full = named.join(of_class, "sig").select("id", "n", "component")
    rest = sets.filter("sig is null or id is null").select("id", "n", F.col("id").alias("component"))
    return full.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _cut(big: DataFrame, texts: DataFrame, k: int, share: int, leaf: int, depth: int) -> DataFrame:
    """One level of large regions (g, id, size): g, size and what _placed tells, with near: whether the pivot links. About eight
    classes of a region, chosen by hash, and its smallest id are pivots; its members meet them in tasks of about `leaf`."""
    chosen = F.pmod(F.xxhash64("id", F.lit(depth)), F.ceil(F.col("size") / 8)) == 0
    least = big.groupBy("g").agg(F.min("id").alias("id"), F.max("size").alias("size"))
    pivots = big.filter(chosen).select("g", "id", "size").unionByName(least).distinct()
    salts = F.ceil(F.col("size") / leaf).cast("int")
    first = pivots.select("g", "id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("pivot"))
    rows = first.unionByName(big.select("g", "id", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(False).alias("pivot"))).join(texts, "id")
    rows = rows.select("g", "salt", "pivot", "id", "text").repartition("g", "salt").sortWithinPartitions("g", "salt", F.col("pivot").desc(), "id")
    placed = rows.mapInArrow(_placed(k, share), "g bigint, at bigint, id bigint, n bigint, both bigint, union bigint, inside bigint, first bigint")
    return materialise(placed.withColumn("near", F.expr(f"100 * both >= {share} * union")).join(big.select("g", "size").distinct(), "g"), "placed")


def _in_blocks(cells: DataFrame, texts: DataFrame, k: int, share: int, leaf: int, most: int) -> DataFrame:
    """Links within regions that pivots can't part (g, id, n; both, union, near with the first pivot): blocks of `leaf` classes and
    `most` shingles by their distance to it, in shells of width r / 2, and by hash; pairs of blocks that a link can join meet, but none of classes that
    the pivot itself links."""
    width = (100 - share) / 200
    apart = cells.select("g", "id", "n", "near", F.floor((1 - F.col("both") / F.col("union")) / width).cast("int").alias("shell"))
    sizes = apart.groupBy("g", "near", "shell").agg(F.ceil(F.greatest(F.count("*") / leaf, F.sum("n") / most)).cast("int").alias("parts"))
    one = sizes.select("g", "near", "shell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("g", F.struct("near", "shell", "part").alias("c"))
    pairs = one.alias("a").join(one.alias("b"), "g").filter("a.c <= b.c and abs(a.c.shell - b.c.shell) <= 3 and not (a.c.near and b.c.near)").select("g", F.col("a.c").alias("a"), F.col("b.c").alias("b"))
    pairs = pairs.withColumn("pair", F.xxhash64("g", "a", "b"))
    both = pairs.select("g", "pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("c")).select("g", "pair", "c.near", "c.shell", "c.part")
    placed = apart.join(sizes, ["g", "near", "shell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meets = placed.join(both, ["g", "near", "shell", "part"]).select(F.col("pair").alias("g"), "id").distinct()
    return _local(meets.join(texts, "id").select("g", "id", "text"), k, share)


def _local(rows: DataFrame, k: int, share: int) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_joined(k, share), "u bigint, v bigint")
