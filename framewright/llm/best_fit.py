"""Packing of token sequences into windows: best-fit decreasing with a segment tree over what is left in open windows.

Documents are tokenised where they lie. One longer than a window is first cut into full windows and a rest, so that no document
that fits is ever cut. Only lengths and checksums (not texts or ids, unless asked for) are dealt out evenly to groups of bounded
size, each of which one task packs: longest piece first, each into the tightest window that takes it. A group wastes at most
about one window more than the whole would.

Null texts are empty (the end id alone); rows with a null or repeated id and repeated rows are documents of their own; texts
of any length are read whole, a stretch at a time; equal lengths go in the order of the other columns; an empty table gives no
row; columns of other names are kept by `pack` and are not seen by `token_pieces`.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewright.llm._common import materialise, slices
from framewright.llm.rank_merge import byte_letters

#: Texts are split into stretches of about so many bytes; a worker keeps two generations of words of about so many bytes.
STRETCH, KEPT = 1 << 20, 128 << 20
_SPACE = re.compile(rb"[ \t-\r]")
#: A digit is a token of its own: between it and another plain letter or digit nothing spans.
_AFTER_DIGIT = re.compile(rb"(?<=[0-9])(?=[0-9A-Za-z])")
#: Latin letters that are lower-case and composed, which any normalisation leaves alone.
_LOWER = [*range(97, 123), *(c for c in range(0xDF, 0x100) if c != 0xF7)]
_SIGNS = b".,;:!?#$%&*|"
_LETTERS = re.compile(f"[{''.join(map(chr, _LOWER))}]+")


class _WordIds(dict):
    """Ids of words (bytes without ASCII white space) as little-endian unsigned 32-bit bytes, by the library.

    The tokenizer drops white space before anything spans it, so that a text's ids are its words' ids in a row. Words of up to
    64 bytes are kept in two generations of about KEPT bytes: those in use outlive the others."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.held, self.before = Tokenizer.from_file(path), 0, {}
        self.library.no_padding()
        self.library.no_truncation()
        plain = "".join(map(chr, _LOWER))
        seen = "".join(byte_letters()[b] for b in plain.encode())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(plain)) if self.library.pre_tokenizer and self.library.normalizer else []
        self.model = self.library.model if [w for w, _ in found] == [seen] else None

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word) or self._found(word)
        if len(word) <= 64:
            self.held += len(word) + len(ids) + 170
            if self.held > KEPT:
                self.before, self.held = dict(self), 0
                self.clear()
            self[word] = ids
        return ids

    def _found(self, word: bytes) -> bytes:
        if b"<" not in word:  # no special token
            lower = word.lower() if word.isascii() else word[:1].lower() + word[1:] if word[1:2].isascii() else word
            if lower != word:  # case doesn't matter, and nothing beyond ASCII composes with what is turned
                return self[lower]
            head = word.rstrip(_SIGNS)
            latin = not head.isascii() and _LETTERS.fullmatch(head.decode("utf-8", "replace"))
            if head != word and (latin or head[-1:].isalnum()):  # signs are a pre-token of their own after a letter or digit
                return self[head] + self[word[len(head) :]]
            if self.model and (latin or word.isalpha()):  # one pre-token as it is: the model gives the ids, without what goes before it
                text = word.decode("latin-1").translate(byte_letters()) if latin else word.decode()
                return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        ids = array("I")
        for part in _parts(word, _AFTER_DIGIT):
            ids.extend(self.library.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return ids.tobytes()


def _parts(raw: bytes, border: re.Pattern) -> Iterator[bytes]:
    """raw in pieces of STRETCH bytes and what it takes to the next border."""
    at = 0
    while len(raw) - at > STRETCH and (found := border.search(raw, at + STRETCH)):
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:]


@lru_cache(4)
def _words(path: str) -> _WordIds:
    return _WordIds(path)


def token_ids(raw: bytes, words: _WordIds) -> bytes:
    """A text's ids, as words gives them."""
    return b"".join(b"".join(map(words.__getitem__, part.split())) for part in _parts(raw, _SPACE))


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens and, if asked for, ids: the pieces of
    each row's text, tokenised without special tokens, with the end id after it; all but the last fill a window.

    tokenizer: a tokenizers file whose tokens never span ASCII white space, of which none is a token."""
    kind = docs.schema["doc_id"].dataType
    extra = [pa.field("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer), b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in slices(batches, "text"):
            rows, starts, lengths, sums, totals, kept = [], [], [], [], [], []
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                ids = token_ids(raw or b"", words) + end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(ids) // 4)
                    if with_ids:
                        kept.append(array("I", piece))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(kept, f.type) for f in extra)], names=[*names, *(f.name for f in extra)])

    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class OpenWindows:
    """Windows with room, by what is left in them: the leaves of a segment tree, whose nodes count the windows below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        node, count = self.leaves + room, self.count
        while node:
            count[node] += n
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the window with the least room that is enough, which is open no more; None without one."""
        node, count = self.leaves + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


def pack(pieces: DataFrame, window: int = 2048, group: int = 8192) -> DataFrame:
    """pieces (length, from 1 to window, and any other columns but these two) with sequence_id and offset: where each lies in
    which window, gapless from 0. group: how many pieces are packed together at most, about."""
    pieces = materialise(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    others = [F.col(f"`{c}`") for c in pieces.columns if c != "length"]
    dealt = pieces.repartition(groups).sortWithinPartitions(F.desc("length"), *others)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, following = OpenWindows(window), TaskContext.get().partitionId() << 32
        for batch in batches:
            sequences, offsets = [], []
            for n in batch.column("length").to_pylist():
                found = tree.take(n)
                if found is None:
                    found, following = (window, following), following + 1
                room, sequence = found
                sequences.append(sequence)
                offsets.append(window - room)
                if room > n:
                    tree.put(room - n, sequence)
            told = [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)
