"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes become Latin-1 letters, so that pyahocorasick finds every token inside a pre-token in one pass. From the left,
the longest token is tried that may follow the one before; where none may, the search steps back. Two tokens may
stand side by side if merging the bytes of both by rank gives just these two; this is worked out once for each pair
and remembered. A sequence in which all neighbours may stand side by side is the one that merging by rank gives, and
an end that failed once is never tried again, so the time is linear in the length.

Edge cases: null and empty texts have no ids and decode to no bytes; decoding keeps bytes that aren't UTF-8 by
themselves; an id outside the vocabulary is an error; other columns pass through, columns named like a result are
replaced; texts are encoded whole and repeated rows each on their own.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens, and pairs of tokens, that a worker remembers; beyond it each table starts anew.
KEPT = 300_000
#: Longer ones aren't kept, so that what is kept is bounded in bytes.
LONGEST = 64
NEVER = 1 << 60


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        self.auto = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
            self.auto.add_word(token.decode("latin-1"), rank)
        self.auto.make_automaton()
        self.length = [len(b) for b in self.bytes]
        self.spelt = [b or None for b in self.bytes]  # null where ranks have a hole
        self.most = max(self.length)
        self.shorter = [next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1) for t in self.bytes]
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self.known: dict[str, bytes] = {}

    def _spines(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Merging makes a token out of ever larger pieces. Those at its start and those at its end, each with the
        rank of the merge that swallows it."""
        got = self.spines.get(token)
        if got is None:
            data = self.bytes[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                got = ([(token, NEVER)], [(token, NEVER)])
            else:
                head, tail = self._spines(self.ranks[parts[0]])[0], self._spines(self.ranks[parts[1]])[1]
                got = ([*head[:-1], (head[-1][0], token), (token, NEVER)], [*tail[:-1], (tail[-1][0], token), (token, NEVER)])
            self.spines[token] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """No merge over the border of a and b comes before both have grown to their full size."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            left, right, i, j, got = self._spines(a)[1], self._spines(b)[0], 0, 0, True
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                rank = self.ranks.get(self.bytes[x] + self.bytes[y], NEVER)
                if rank < x_end and rank <= y_end:  # of equal ranks the left one merges first
                    got = False
                    break
                if x_end == y_end == NEVER:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 4 * KEPT:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, n, length, shorter, longest = data.decode("latin-1"), len(data), self.length, self.shorter, self.auto.iter_long
        pairs, out, pos, last = self.pairs, [], 0, -1
        for _, token in longest(text):  # as long as the longest tokens fit they are the way
            if last >= 0:
                good = pairs.get(last << 20 | token)
                if not (self.fits(last, token) if good is None else good):
                    break
            out.append(token)
            pos += length[token]
            last = token
        else:
            return out
        dead = bytearray(n + 1)
        token = shorter[token]
        while True:
            while token >= 0 and (dead[pos + length[token]] or out and not self.fits(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                if pos == n:
                    return out
                token = next(longest(text[pos : pos + self.most]))[1]  # from here on; what lies before isn't read again
            elif out:
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, each match of the pattern on its own."""
        words = self.pattern.findall(text)
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = array("i", self.encode_bytes(w.encode())).tobytes()
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
        for w in {w for w in words if len(w) > LONGEST}:
            del known[w]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; one that the vocabulary doesn't have, or null, is an error."""
        try:
            if ids and min(ids) < 0:
                raise IndexError
            return b"".join(map(self.spelt.__getitem__, ids))
        except (IndexError, TypeError):
            raise ValueError("an id that the vocabulary doesn't have") from None


@lru_cache(4)
def bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int>: the ids by the ranks in the file at path, which all machines hold."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        b = bpe(path, pattern)
        return _lists([b.encode(t.as_py() or "") for t in texts])

    return encoded(text.cast("string"))


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for; null gives none."""

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        b = bpe(path, pattern)
        return pa.array([b.decode(x.values.to_pylist()) if x.is_valid else b"" for x in lists], pa.binary())

    return decoded(ids)


def with_ids(df: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """df with ids and n_tokens."""
    return df.withColumn("ids", encode(F.col(text_col), path, pattern)).withColumn("n_tokens", F.size("ids").cast("bigint"))


def with_decoded(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df, which has ids, with decoded."""
    return df.withColumn("decoded", decode(F.col("ids"), path, pattern))


def with_round_trip(df: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """with_ids and with_decoded in one pass, with digests of both in place of the ids and bytes:
    n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256."""
    import hashlib

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        b, out = bpe(path, pattern), []
        for t in texts:
            ids = b.encode(t.as_py() or "").tolist()
            out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(b.decode(ids)).hexdigest()})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    kept = [c for c in df.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "_digests")]
    return df.withColumn("_digests", digests(F.col(text_col).cast("string"))).select(*kept, "_digests.*")
