"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch that aren't known yet lie in one ragged numpy array. In each round every sequence finds
the lowest rank among its adjacent pairs (only those that changed are looked up anew) and merges all its pairs of that rank, from left to right where they
overlap; sequences without a pair leave. The surviving symbols are the tokens. Counts of pre-tokens are kept in a
table of bounded size for each Python worker.

Special strings inside a text (the tokenizer file's added tokens) count as one token each and split the text.

Edge cases: null and empty texts have 0 tokens and 0 bytes; every text is counted whole, repeated rows each on
their own; other columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a worker keeps; beyond it the table starts anew.
KEPT = 400_000
#: Longer ones aren't kept, so that what is kept is bounded in bytes.
LONGEST = 64


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable letter by which vocabulary files of byte-level BPE write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class RankMerger:
    """Counts the BPE symbols of byte strings by merge ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = len(vocab)
        self.start = np.array([vocab[byte_letters()[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.into = pairs[order], order.astype(np.int64), into
        self.words = regex.compile(pattern)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def merged(self, texts: list[str]) -> np.ndarray:
        """The number of symbols that survive in each (non-empty) string."""
        raw = [t.encode() for t in texts]
        sym = self.start[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.array([len(r) for r in raw])
        seq = np.repeat(np.arange(len(raw)), sizes)
        counts = sizes.copy()
        rank = self._ranks(sym, seq, np.arange(len(sym)))
        while len(sym) > 1:
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])  # each sequence's first symbol
            least = np.minimum.reduceat(rank, heads)
            lens = np.diff(np.append(heads, len(sym)))
            at = np.flatnonzero((rank == np.repeat(least, lens)) & (rank < self.size))
            if not len(at):
                break
            run = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # of overlapping pairs every second one merges
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = self.into[rank[at]]
            counts -= np.bincount(seq[at], minlength=len(counts))
            keep = np.repeat(least < self.size, lens)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            changed = np.concatenate([new, new[new > 0] - 1])  # only these pairs are looked up again
            rank[changed] = self._ranks(sym, seq, changed)
        return counts

    def _ranks(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at these places; self.size where there is none."""
        out, pair = np.full(len(at), self.size), at < len(sym) - 1
        pair[pair] = seq[at[pair]] == seq[at[pair] + 1]
        keys = sym[at[pair]] * self.size + sym[at[pair] + 1]
        found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        out[pair] = np.where(self.pairs[found] == keys, self.ranks[found], self.size)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        split, extra = [], []
        for t in texts:
            if t and self.special and self.special.search(t):
                extra.append(len(self.special.findall(t)))
                split.append([w for part in self.special.split(t) for w in self.words.findall(part)])
            else:
                extra.append(0)
                split.append(self.words.findall(t) if t else [])
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, self.merged(part).tolist(), strict=True))
        known = self.known.__getitem__
        counts = [sum(map(known, s)) + n for s, n in zip(split, extra, strict=True)]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return counts


@lru_cache(4)
def merger(path: str, pattern: str) -> RankMerger:
    return RankMerger(path, pattern)


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of each text by a tokenizer file (a JSON one of byte-level BPE) at path, which all machines hold."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        m, out = merger(path, pattern), []
        for i in range(0, len(texts), 256):
            out += m.count(texts[i : i + 256].to_pylist())
        return pa.array(out, pa.int64())

    return counted(text.cast("string"))


def with_token_counts(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    sized = df.withColumn("n_tokens", token_count(F.col(text_col), path, pattern))
    return sized.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")).withColumn("over_limit", F.col("n_tokens") > limit)
