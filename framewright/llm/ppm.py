"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of contexts of up to `order` bytes (A-Z lower-cased, 256 for the borders of a text) with the
counts of what followed them in all training texts. A byte's probability is its share under the longest context in
which it was seen; each longer one costs an escape (half a count for each different follower, which pays for it: method D), and what was
seen under a longer context is excluded from the shorter one. Below the empty context all symbols not seen there are
equally likely. The end of a text is a symbol too, so that the probabilities of all texts add up to 1.

The model is a distributed table of all contexts of the training texts with their followers, of which none is pruned; it
grows with the corpus. Texts are put together to pieces of 16 MB. The different contexts with a follower of a piece are
dealt out, as packed arrays, by the last two symbols of the context, so that a part holds all longer contexts that end in them and
works out the probabilities of its own. Two symbols that more than one in `SPLIT` of these contexts end in (by measured sizes)
are dealt out by three, such three by four: by proof at most 257 x 257 different contexts with a follower end in four
symbols at order 5. What isn't in a part is broadcast: the counts of the orders 0 and 1 (at most 257 x 257) and the
followers of the suffixes that were split (at most `SPLIT` x 257 of either length). Arrays of many pieces are added up in a
tree of `FAN` at a time. The probabilities are joined to the pieces that hold them. A part that many pieces hold meets them
in blocks of no fewer contexts than it has itself (and than `MET`), so that all copies of parts together are no more
than what the pieces hold: the join grows as the corpus. Each piece's texts are scored with just its own.

The base score is that of single words, with 0.1 added to each count. The different words of a piece, told apart by hashes
of 64 bits, take the same way: to parts of their own, which add up the counts, and back to the pieces.

Edge cases: a null or empty text has just its end; without training rows every symbol is equally likely; rows for which
is_training is null, as with a null id, are held out and scored like others; repeated rows of one id are scored each; a
text longer than a piece is a piece of its own; equal texts have equal scores; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm._common import materialise, slices
from framewright.llm._words import NOT_SPACE, Words, mix, utf8

END = 256
_BITS = 9
_TABLE = 22
#: Pieces that a step of the tree adds up; numbers of pieces that meet a part's probabilities at a time.
FAN, MET = 64, 4 << 20
#: A suffix with more than this share of the numbers is split. Numbers in a row before they are dealt out; most parts.
SPLIT, CHUNK, PARTS = 2048, 1 << 20, 1 << 17


def _codes(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of the texts with its context as one number, and the texts' bounds among them."""
    buf, at = utf8(texts)
    n, m = int(at[-1]), len(at) - 1
    sym = np.full(n + m * (order + 1), END, np.int64)
    shift = np.arange(m) * (order + 1) + order
    where = np.arange(n) + np.repeat(shift, np.diff(at))
    sym[where] = buf[:n]
    targets = np.zeros(len(sym), bool)
    targets[where] = True
    targets[at[1:] + shift] = True
    code = sym.copy()
    for j in range(1, order + 1):
        code[j:] |= sym[:-j] << (_BITS * j)
    return code[targets], at + np.arange(m + 1)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return code[new], np.add.reduceat(n, new) if len(new) else n


class _Places:
    """Where numbers stand among sorted ones: by a hash table, by bisection where two collide."""

    def __init__(self, own: np.ndarray):
        self.own, self.slots = own, np.zeros(1 << _TABLE, np.int32)
        self.slots[self._spot(own)] = np.arange(len(own))

    @staticmethod
    def _spot(code: np.ndarray) -> np.ndarray:
        return (mix(code.view(np.uint64)) >> np.uint64(64 - _TABLE)).astype(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        """-1 for what isn't there."""
        own = self.own
        if not len(own):
            return np.full(len(code), -1)
        at = self.slots[self._spot(code)]
        lost = np.flatnonzero(own[at] != code)
        if len(lost):
            near = np.minimum(np.searchsorted(own, code[lost]), len(own) - 1)
            at[lost] = np.where(own[near] == code[lost], near, -1)
        return at


class Trie:
    """Counts by order, each as sorted numbers of context and follower."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.grams = grams  # by order, from 0
        self.contexts, self.total, self.distinct, self.below = [], [], [], []
        for j, (code, n) in enumerate(grams):
            context = code >> _BITS
            new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(code) else np.empty(0, np.int64)
            self.contexts.append(context[new])
            self.total.append(np.add.reduceat(n, new) if len(new) else n)
            self.distinct.append(np.diff(np.append(new, len(code))))
            if j:  # how often the followers of the context came after the shorter one
                shorter, m = grams[j - 1]
                short = m[np.searchsorted(shorter, code & ((1 << (_BITS * j)) - 1))] if len(code) else n
                self.below.append(np.add.reduceat(short, new) if len(new) else short)
            else:
                self.below.append(np.zeros(len(new), np.int64))
        code, n = grams[-1]
        context = np.searchsorted(self.contexts[-1], code >> _BITS)
        self.log = np.log10((2 * n - 1) / (2 * self.total[-1][context])) if len(code) else np.empty(0)

    def _backed_off(self, code: np.ndarray) -> np.ndarray:
        """Of symbols not seen under their longest context."""
        out, todo = np.zeros(len(code)), np.ones(len(code), bool)
        gone_n, gone_d = np.zeros(len(code)), np.zeros(len(code))  # excluded: their count here, how many they are
        for j in range(len(self.grams) - 1, -1, -1):
            own, n = self.grams[j]
            if not len(own):
                continue
            c = code & ((1 << (_BITS * (j + 1))) - 1)
            at = np.minimum(np.searchsorted(self.contexts[j], c >> _BITS), len(self.contexts[j]) - 1)
            known = self.contexts[j][at] == c >> _BITS
            room = np.where(known, 2 * (self.total[j][at] - gone_n), 0)
            spot = np.minimum(np.searchsorted(own, c), len(own) - 1)
            hit = todo & (own[spot] == c)
            out[hit] += np.log10((2 * n[spot[hit]] - 1) / room[hit])
            todo &= ~hit
            escape = todo & (room > 0)
            out[escape] += np.log10((self.distinct[j][at] - gone_d)[escape] / room[escape])
            gone_n, gone_d = np.where(known, self.below[j][at], 0), np.where(known, self.distinct[j][at], 0)
        out[todo] -= np.log10(END + 1 - len(self.grams[0][0]))
        return out


def _pieces(batches):
    """The texts as compressed batches of about 1 MB, with the piece of 16 MB that they belong to."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    for number, batch in enumerate(_gathered(batches)):
        for part in slices([batch], "text", 1 << 20):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([part.column("text").nbytes]), pa.array([pc.sum(part.column("train")).as_py() or 0], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["piece", "n_bytes", "n_train", "texts"])


def _unpacked(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def _packed(values: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers of eight bytes, byte by byte, compressed; of sorted ones the differences."""
    values = np.diff(values, prepend=0) if ordered else values
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _opened(data: bytes, size: int, kind=np.int64, ordered: bool = False) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, size).T).reshape(-1).view(kind)
    return np.cumsum(values) if ordered else values


def _all_of(rows: pa.Table, column: str, kind=np.int64, ordered: bool = False) -> np.ndarray:
    """A column of packed numbers as one array."""
    parts = [_opened(x, n, kind, ordered) for x, n in zip(rows[column].to_pylist(), rows["size"].to_pylist(), strict=True)]
    return np.concatenate([np.empty(0, kind), *parts])


#: A row of numbers (sorted) with counts: how many, both packed, and how many there were before equal ones were added up.
_ROW = "piece bigint, part bigint, size bigint, codes binary, n binary, held bigint"
#: What the rows are of before they are dealt out to parts: counts of order 1 (or less), sizes of suffixes, codes, words.
LOW, SIZES, CODES, WORDS = range(4)


def _row(piece: int, part: int, codes: np.ndarray, n: np.ndarray, held: int | None = None) -> tuple:
    return piece, part, len(codes), _packed(codes, True), _packed(n), len(codes) if held is None else held


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[x for x, _ in names])


def _counted(code: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, sorted, and how often they are in training texts."""
    by = np.argsort(code, kind="stable")
    code, train = code[by], train[by].astype(np.int64)
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return code[new], np.add.reduceat(train, new) if len(new) else train


class _Sum:
    """Numbers with counts, added up from time to time."""

    def __init__(self):
        self.codes, self.counts = [], []

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.codes.append(code)
        self.counts.append(n)
        if sum(map(len, self.codes[1:])) > 500_000:
            c, n = _summed(self.codes, self.counts)
            self.codes, self.counts = [c], [n]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.codes, self.counts)


def _symbols(n: int) -> int:
    """A mask of n symbols."""
    return (1 << (_BITS * n)) - 1


def _piece_codes(order: int):
    """The piece's different codes, sorted, and how often they are in training texts; the same of words by their hashes; the
    codes of order 1 (or less); how many codes there are for the last three symbols of a context."""

    def run(batches):
        piece, codes, words = None, _Sum(), _Sum()

        def done():
            c, n = codes.all()
            yield _batch([_row(piece, LOW, *_summed([c[n > 0] & _symbols(min(order, 1) + 1)], [n[n > 0]]))], _ROW)
            suffix = np.sort((c >> _BITS & _symbols(3)).astype(np.int32)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]])
            yield _batch([_row(piece, SIZES, suffix[first], np.diff(np.append(first, len(suffix))))], _ROW)
            for kind, (c, n) in ((CODES, (c, n)), (WORDS, words.all())):
                for i in range(0, len(c), CHUNK):
                    yield _batch([_row(piece, kind, c[i : i + CHUNK], n[i : i + CHUNK])], _ROW)

        for batch in batches:
            for of, blob in zip(batch.column("piece").to_pylist(), batch.column("texts"), strict=True):
                if of != piece and codes.codes:
                    yield from done()
                    codes, words = _Sum(), _Sum()
                piece, text = of, _unpacked(blob)
                code, first = _codes(text.column("text"), order)
                train = np.array(text.column("train").to_pylist(), bool)
                codes.add(*_counted(code, np.repeat(train, np.diff(first))))
                w = Words(text.column("text"), NOT_SPACE)
                words.add(*_counted(w.hashes().view(np.int64), np.repeat(train, w.counts())))
        if codes.codes:
            yield from done()

    return run


def _opened_rows(batches):
    """The rows' columns but for `size`, numbers and counts unpacked."""
    for batch in batches:
        for piece, part, size, codes, n in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "size", "codes", "n")), strict=True):
            yield piece, part, _opened(codes, size, ordered=True), _opened(n, size)


_NUMBERS = "depth int, code bigint, n bigint"


def _totals(sums: dict[int, _Sum]):
    """Numbers and counts, one a row."""
    for depth, added in sums.items():
        code, n = added.all() if added.codes else (np.empty(0, np.int64),) * 2
        for i in range(0, len(code), 1 << 16):
            c = code[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), depth, np.int32)), pa.array(c), pa.array(n[i : i + (1 << 16)])], names=["depth", "code", "n"])


def _numbers(batches):
    """The numbers of all rows and their counts, added up (orders 0 and 1, or suffixes of three symbols: a bounded number)."""
    out = _Sum()
    for _, _, code, n in _opened_rows(batches):
        out.add(code, n)
    yield from _totals({0: out})


def _among(own: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among own, sorted."""
    if not len(own):
        return np.zeros(len(values), bool)
    return own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values


class _Units:
    """How contexts are dealt out: by their last two symbols, or by three or four where those before were split."""

    def __init__(self, split: dict[int, np.ndarray]):
        self.split = split  # by length, sorted
        self.pairs = np.zeros(_symbols(2) + 1, bool)
        self.pairs[split[2]] = True

    def of(self, code: np.ndarray) -> np.ndarray:
        context = code >> _BITS
        unit = context & _symbols(2)
        at = np.flatnonzero(self.pairs[unit])
        triple = context[at] & _symbols(3)
        unit[at] = triple | 1 << 60
        more = np.flatnonzero(_among(self.split[3], triple))
        unit[at[more]] = context[at[more]] & _symbols(4) | 1 << 61
        return unit

    def followers(self, order: int):
        """Codes of the contexts that were split, with their counts: not all of them are in any one part."""

        def run(batches):
            sums = {2: _Sum(), 3: _Sum()}
            for _, _, code, n in _opened_rows(batches):
                code, n = code[n > 0], n[n > 0]
                for depth in range(2, min(order, 3) + 1):
                    hot = _among(self.split[depth], code >> _BITS & _symbols(depth))
                    sums[depth].add(*_summed([code[hot] & _symbols(depth + 1)], [n[hot]]))
            yield from _totals(sums)

        return run

    def dealt(self, parts: int, counts: bool):
        """Rows of codes and of words as rows for each part; words have parts of their own, from `parts` on."""

        def run(batches):
            for piece, kind, code, n in _opened_rows(batches):
                by = code if kind == WORDS else self.of(code)
                part = (mix(by.view(np.uint64)) % np.uint64(parts)).astype(np.int64) + (parts if kind == WORDS else 0)
                at = np.argsort(part, kind="stable")
                part, code, n = part[at], code[at], n[at]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for i in range(0, len(first), 64):
                    ends = np.append(first, len(code))[i : i + 65]
                    rows = [_row(piece, int(part[x]), code[x:y], n[x : y if counts else x]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                    yield _batch(rows, _ROW)

        return run


def _added(rows: pa.Table) -> pa.Table:
    """The rows of some pieces of a part as one."""
    code, n = _summed([_all_of(rows, "codes", ordered=True)], [_all_of(rows, "n")])
    return pa.Table.from_batches([_batch([_row(rows["piece"][0].as_py(), rows["part"][0].as_py(), code, n, pc.sum(rows["held"]).as_py())], _ROW)])


#: A part of the model: its numbers and what is known of each; of words also how many there are, and different ones; how many
#: numbers of pieces the part is of.
_MODEL = "part bigint, size bigint, codes binary, logs binary, total bigint, distinct bigint, held bigint"


def _logs(low, split: dict[int, np.ndarray], order: int, parts: int):
    """log10 of the probabilities of a part's codes; those with a count are the part's share of the model. Of words, from part
    `parts` on, the counts."""

    def run(rows: pa.Table) -> pa.Table:
        code, n = _summed([_all_of(rows, "codes", ordered=True)], [_all_of(rows, "n")])
        part, seen, total, distinct = rows["part"][0].as_py(), n > 0, 0, 0
        if part >= parts:
            out, total, distinct = n.astype(np.float64), int(n.sum()), int(seen.sum())
        else:
            orders, grams = low.value, []
            for j in range(order + 1):
                if j < 2:
                    grams.append(orders[j])
                    continue
                own, m = _summed([code[seen] & _symbols(j + 1)], [n[seen]])
                if j in split:  # contexts that were split have followers elsewhere
                    whole, (others, k) = ~_among(split[j], own >> _BITS), orders[j]
                    here = _among(np.unique(code >> _BITS & _symbols(j)), others >> _BITS)
                    own, m = _summed([own[whole], others[here]], [m[whole], k[here]])
                grams.append((own, m))
            trie = Trie(grams)
            out = np.zeros(len(code))
            out[seen] = trie.log[np.searchsorted(trie.grams[-1][0], code[seen])]
            out[~seen] = trie._backed_off(code[~seen])
        return pa.Table.from_batches([_batch([(part, len(code), _packed(code, True), _packed(out), total, distinct, pc.sum(rows["held"]).as_py())], _MODEL)])

    return run


_FOUND = "piece bigint, part bigint, size bigint, codes binary, logs binary"


def _of_pieces(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of pieces with what is known of their numbers, from those of the whole part."""
    own, logs, out = _all_of(right, "codes", ordered=True), _all_of(right, "logs", np.float64), []
    for piece, part, size, codes in zip(*(left[c].to_pylist() for c in ("piece", "part", "size", "codes")), strict=True):
        out.append((piece, part, size, codes, _packed(logs[np.searchsorted(own, _opened(codes, size, ordered=True))])))
    return pa.Table.from_batches([_batch(out, _FOUND)])


def _scored(order: int, parts: int):
    """A piece's texts, with the logarithms of its codes and the counts of its words."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = [], []
        for rows in (right.filter(pc.less(right["part"], parts)), right.filter(pc.greater_equal(right["part"], parts))):
            own, values = _all_of(rows, "codes", ordered=True), _all_of(rows, "logs", np.float64)
            by = np.argsort(own, kind="stable")
            found.append((_Places(own[by]), values[by]))
        (places, logs), (word_places, counts) = found
        for blob in left["texts"]:
            part = _unpacked(blob)
            code, first = _codes(part.column("text"), order)
            score = np.add.reduceat(logs[places.of(code)], first[:-1])
            words = Words(part.column("text"), NOT_SPACE)
            c = counts[word_places.of(words.hashes().view(np.int64))] if len(words.starts) else np.empty(0)
            of = np.repeat(np.arange(part.num_rows), words.counts())
            base, known = np.bincount(of, np.log10(c + 0.1), part.num_rows).astype(np.float64), np.bincount(of, c > 0, part.num_rows).astype(np.int64)
            columns = [part.column("id"), part.column("train"), pa.array(words.counts(), pa.int64()), pa.array(known), pa.array(base), pa.array(score)]
            out.append(pa.RecordBatch.from_arrays(columns, names=["id", "train", "n_words", "known", "base", "score"]))
        return pa.Table.from_batches(out)

    return run


def _gathered(batches, max_bytes: int = 16 << 20, max_rows: int = 1 << 15):
    """Arrow batches put together to pieces of about max_bytes of text."""
    held, size, rows = [], 0, 0
    for batch in slices(batches, "text", max_bytes):
        if held and (size + batch.column("text").nbytes > max_bytes or rows + batch.num_rows > max_rows):
            yield pa.concat_batches(held)
            held, size, rows = [], 0, 0
        held.append(batch)
        size, rows = size + batch.column("text").nbytes, rows + batch.num_rows
    if held:
        yield pa.concat_batches(held)


def _arrays(numbers: DataFrame, *depths: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers with their counts by depth, added up and sorted."""
    found = numbers.groupBy("depth", "code").agg(F.sum("n").alias("n")).toArrow()
    depth, code, n = (np.array(found[c], np.int64) for c in ("depth", "code", "n"))
    return {d: _summed([code[depth == d]], [n[depth == d]]) for d in depths or (0,)}


def _units(codes: DataFrame) -> _Units:
    """Suffixes of two and three symbols that more than one in SPLIT codes have are split: fewer than SPLIT of either."""
    total = codes.filter(F.col("part") == CODES).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sizes = codes.filter(F.col("part") == SIZES).mapInArrow(_numbers, _NUMBERS).groupBy("code").agg(F.sum("n").alias("n"))
    large = sizes.rollup(F.col("code").bitwiseAND(_symbols(2)).alias("pair"), "code").agg(F.sum("n").alias("n"), F.grouping_id().alias("all")).filter((F.col("n") * SPLIT > total) & (F.col("all") < 3))
    found = large.select(F.when(F.col("all") == 1, F.col("pair")).otherwise(F.col("code")).alias("suffix"), F.when(F.col("all") == 1, 2).otherwise(3).alias("length")).collect()
    return _Units({n: np.array(sorted(r.suffix for r in found if r.length == n), np.int64) for n in (2, 3)})


def score(docs: DataFrame, is_training, *, id_col: str = "doc_id", text_col: str = "text", order: int = 5) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; is_training: a condition."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"))
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    texts = materialise(docs.select("id", "train", "text").mapInArrow(_pieces, "piece bigint, n_bytes bigint, n_train bigint, texts binary"), "texts")
    size = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count_distinct("piece"), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts, pieces, ends = min(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size[0] >> 22), PARTS), size[1], size[2]
    codes = materialise(texts.mapInArrow(_piece_codes(order), _ROW), "codes")
    units = _units(codes)
    low = _arrays(codes.filter(F.col("part") == LOW).mapInArrow(_numbers, _NUMBERS))  # at most 257 x 257 rows
    orders = {j: _summed([low[0][0] & _symbols(j + 1)], [low[0][1]]) for j in range(min(order, 1) + 1)}
    split = {j: units.split[j] for j in range(2, min(order, 3) + 1)}
    if split and len(units.split[2]):
        orders |= _arrays(codes.filter(F.col("part") == CODES).mapInArrow(units.followers(order), _NUMBERS), *split)  # at most SPLIT x 257 each
    else:
        split = {}
    shared = spark.sparkContext.broadcast(orders)
    rows = codes.filter(F.col("part") >= CODES)
    summed, blocks = rows.mapInArrow(units.dealt(parts, True), _ROW), pieces
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        summed = summed.groupBy("part", F.pmod(F.xxhash64("piece"), F.lit(blocks)).alias("block")).applyInArrow(_added, _ROW)
    logs = materialise(summed.groupBy("part").applyInArrow(_logs(shared, split, order, parts), _MODEL), "model")
    n, v = logs.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    below = float(np.log10(n + 0.1 * (v + 1)))
    logs = logs.withColumn("blocks", F.ceil(F.col("held") / F.greatest(F.col("size"), F.lit(MET))))
    many = logs.filter("blocks > 1").select("part", "blocks")  # 2 * PARTS rows at most
    logs = logs.select("part", "size", "codes", "logs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    placed = rows.mapInArrow(units.dealt(parts, False), _ROW).select("piece", "part", "size", "codes").join(F.broadcast(many), "part", "left")
    placed = placed.select("piece", "part", "size", "codes", F.pmod(F.xxhash64("piece"), F.coalesce("blocks", F.lit(1).cast("bigint"))).alias("block"))
    of_piece = placed.groupBy("part", "block").cogroup(logs.groupBy("part", "block")).applyInArrow(_of_pieces, _FOUND)
    scored = texts.select("piece", "texts").groupBy("piece").cogroup(of_piece.groupBy("piece")).applyInArrow(_scored(order, parts), f"id {kind}, train boolean, n_words bigint, known bigint, base double, score double")
    tokens = F.col("n_words") + 1
    return scored.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 0.1)) - tokens * below).alias("base_score"), "score",
    )
