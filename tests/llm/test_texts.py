"""Operators on documents against brute force, on odd texts, copies and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import aho_bpe, metric_join, ppm, rank_merge, string_kernel, winnowing

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_token_counts(docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a<|endoftext|>b <|endoftext|><|endoftext")).withColumn("doc_id", F.lit(999).cast("bigint")))
    got = rank_merge.with_token_counts(special, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)


def test_byte_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in aho_bpe.with_decoded(aho_bpe.with_ids(docs, *args), *args).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids)
    for r in aho_bpe.with_round_trip(docs, *args).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary(r.text or ""))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_decoding_no_ids_and_broken_bytes(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [222])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in aho_bpe.with_decoded(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got[1] == b"" and got[2] == b"" and len(got[3]) == 1


def test_winnowing(spark, docs):
    own = texts(docs)
    long = [t for t in own.values() if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].split()[20:45])), (2, " ".join(long[1].split()[-10:])), (3, "Two words"), (4, None), (5, "nowhere to be found at all in any of these texts"), (6, ""), (2, " ".join(long[1].split()[-10:]))]
    got = {r.doc_id: r for r in winnowing.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) == set(own)
    for i, t in own.items():
        w, hit, found = LETTERS.findall(lower(t)), set(), set()
        for item, text in items:
            x = LETTERS.findall(lower(text))
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(found))
        assert sum(s.b - s.a for s in got[i].spans) == len(hit)
    assert any(r.n_hit for r in got.values())


def test_winnowing_of_rows_without_an_id_or_twice(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(None, "x " + " ".join(words[:12])), (None, "y"), (1, " ".join(words[3:13])), (1, "q " + " ".join(words[5:18])), (1, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (None, " ".join(words[:11]))], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in winnowing.decontaminate(docs, items).collect())
    assert got == [(0, 1, 0, []), (0, 13, 12, ["7"]), (1, 0, 0, []), (1, 10, 10, ["7"]), (1, 14, 13, ["7"])]


def test_long_pre_tokens():
    """Whole texts of one pre-token against the libraries; time follows the length."""
    import random
    import time

    draw = random.Random(2)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160_000))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merger, bpe = rank_merge.RankMerger(P.path("byte_bpe_50k.json"), P.PATTERN), aho_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in (text[:20_000], "a" * 20_000, "ab" * 7000 + text[:999]):
        assert merger.count([t]) == [len(library.encode(t, add_special_tokens=False).ids)]
        assert bpe.encode(t).tolist() == ranks.encode_ordinary(t)
    for f in (lambda t: merger.merged([t]), lambda t: bpe.encode_bytes(t.encode())):
        took = []
        for n in (40_000, 160_000):
            began = time.process_time()
            f(text[:n])
            took.append(time.process_time() - began)
        assert took[1] <= 8 * took[0] + 0.5, took


def brute_components(own, k, share):
    def shingles(t):
        w = WORDS.findall(lower(t).encode())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(t) for i, t in own.items()}
    label = {i: i for i in own}
    changed = True
    links = [(a, b) for a in own for b in own if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in own}


@pytest.mark.parametrize(("k", "share", "leaf", "sketched"), [(3, 90, 256, 2048), (5, 80, 2, 2), (2, 60, 3, 2048), (3, 100, 256, 2048)])
def test_metric_join(docs, k, share, leaf, sketched):
    found = metric_join.near_duplicates(docs, k=k, share=share, leaf=leaf, sketched=sketched).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts(docs), k, share)


def test_metric_join_of_ids_with_several_texts(spark):
    df = spark.createDataFrame([(2, "a b c d e f"), (2, "p q r s t u"), (1, "p q r s t u v"), (3, "a b c d e f g"), (4, "z"), (5, "p q r s t u"), (5, "z y")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in metric_join.near_duplicates(df, k=1, share=80).collect())
    assert got == [(1, 7, 1), (2, 6, 1), (2, 6, 1), (3, 7, 1), (4, 1, 4), (5, 2, 1), (5, 6, 1)]


def test_large_regions_are_cut(spark):
    """Groups of near copies far over `leaf`: through pivots, cells and blocks as by comparing all."""
    draw = __import__("random").Random(8)
    own = {}
    for g in range(3):
        base = [f"{g}w{i}" for i in range(60)]
        for n in range(40):
            t = list(base)
            for _ in range(draw.randint(0, 3 + 4 * g)):
                t[draw.randrange(60)] = f"x{draw.randrange(4)}"
            own[1000 * g + n] = " ".join(t) + " common passage of several words that all of them share in this table"
    df = spark.createDataFrame(list(own.items()), "doc_id bigint, text string")
    brute = brute_components(own, 3, 80)
    many = metric_join.SET_SHINGLES
    for leaf, sketched, most, most_sketched in ((4, 2, many, many), (10, 2, many, many), (10, 2048, many, many), (30, 2, many, many), (256, 2048, 300, 500), (256, 2048, 30, 1)):
        found = metric_join.near_duplicates(df, k=3, share=80, leaf=leaf, sketched=sketched, most=most, most_sketched=most_sketched).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute
    sets = metric_join.shingle_sets(metric_join.pa.array(list(own.values())), 3)
    ids = metric_join.np.array(list(own))
    label = {i: i for i in own}
    for _ in own:
        for a, b in metric_join._recursive(ids, sets, 80, few=3):
            label[a] = label[b] = min(label[a], label[b])
    assert label == {i: c for i, (_, c) in brute.items()}


def test_a_region_of_thousands_goes_through_pivots(spark, monkeypatch):
    """Regions of over a thousand different texts at the production `leaf`: through pivots, cells and windows as by comparing all. One has
    40 clusters under a pair of words that is rarer than what else they hold, in another the pivots link all."""
    draw = __import__("random").Random(5)
    common = [f"w{i}" for i in range(40)]
    own = {i: " ".join([*common, f"own{i}"]) for i in range(10_000, 11_500)}
    for g in range(40):
        base = draw.sample(common, 20)
        for n in range(30):
            t = list(base)
            t[draw.randrange(20)] = draw.choice(common)
            own[100 * g + n] = " ".join(["rare", "pair", *t])
    sizes = []
    cut = metric_join._cut

    def told(big, *rest):
        sizes.extend(r["size"] for r in big.select("g", "size").distinct().collect())
        return cut(big, *rest)

    monkeypatch.setattr(metric_join, "_cut", told)
    df = spark.createDataFrame(list(own.items()), "doc_id bigint, text string")
    found = metric_join.near_duplicates(df, k=1, share=90, sketched=2).collect()
    ids = metric_join.np.array(list(own))
    stars = dict(metric_join._stars(ids, metric_join._linked(metric_join.shingle_sets(metric_join.pa.array(list(own.values())), 1), 90)))
    assert {r.doc_id: r.component_id for r in found} == {i: stars.get(i, i) for i in own}
    assert sum(size > 1000 for size in sizes) > 1


def test_full_sketches_stay_exact():
    """Counts over 255 in a bucket: the bound may not fall below the true intersection."""
    import numpy as np

    h = np.arange(3000, dtype=np.uint64) << np.uint64(20)  # all in one bucket
    size = 1 << max(3, (3000 // 8).bit_length())
    counts = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
    data = counts.astype(np.uint32).tobytes()
    assert metric_join._sketch(3000, data).sum() == 3000
    assert metric_join._may_link(np.array([3000, 3000]), [metric_join._sketch(3000, data)] * 2, 99).all()


def test_metric_join_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (2, "a b c d"), (2, "a b c d")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in metric_join.near_duplicates(df).collect())
    assert got == [(0, None), (2, 2), (2, 2), (3, 2)]


def test_base_scores_and_probabilities(spark, docs):
    own = texts(docs)
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0
    counts = Counter()
    words = {i: WORDS.findall(lower(t).encode()) + [b""] for i, t in own.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in own}
    for i in own:
        if not held[i]:
            counts.update(words[i])
    n, v = sum(counts.values()), len(counts)
    got = ppm.score(docs, train).collect()
    assert len(got) == len(own)
    for r in got:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
    twice = ppm.score(docs.unionByName(docs), train).collect()
    assert len(twice) == 2 * len(own) and all(r.n_tokens == len(words[r.doc_id]) for r in twice)


def test_ppm_against_a_plain_trie(docs):
    own = [t for t in texts(docs).values() if t is not None]
    order, counts = 5, Counter()
    for t in own[::2]:
        s = [256] * order + list(lower(t).encode()) + [256]
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[tuple(s[i - j : i]), s[i]] += 1

    follow: dict[tuple, dict[int, int]] = {}
    for (c, x), m in counts.items():
        follow.setdefault(c, {})[x] = m

    def log(context, x):
        out, gone = 0.0, set()
        for j in range(order, -1, -1):
            seen = {y: m for y, m in follow.get(tuple(context[order - j :]), {}).items() if y not in gone}
            total = 2 * sum(seen.values())
            if x in seen:
                return out + math.log10((2 * seen[x] - 1) / total)
            if seen:
                out += math.log10(len(seen) / total)
            gone |= set(seen)
        return out - math.log10(257 - len(gone))

    df = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id bigint, text string")
    for r in ppm.score(df, F.col("doc_id") % 2 == 0).collect():
        s = [256] * order + list(lower(own[r.doc_id]).encode()) + [256]
        assert r.score == pytest.approx(sum(log(s[i - order : i], s[i]) for i in range(order, len(s))))


def test_probabilities_add_up(spark, docs):
    """Texts of one word that end in any of all symbols: the probabilities of a context's followers are 1 together."""
    import numpy as np

    own = [t for t in texts(docs).values() if t]
    grams = []
    for j in range(4):
        code = np.concatenate([ppm._codes(ppm.pa.array(own), 3)[0]]) & ((1 << (9 * (j + 1))) - 1)
        grams.append(ppm._summed([code], [np.ones(len(code), np.int64)]))
    trie = ppm.Trie(grams)
    for context in (b"abc", b"zzz", b"\n\n\n"):
        code = np.array([((context[0] << 9 | context[1]) << 9 | context[2]) << 9 | x for x in range(257)])
        seen = np.isin(code, trie.grams[-1][0])
        logs = np.where(seen, trie.log[np.searchsorted(trie.grams[-1][0], code) % len(trie.log)], trie._backed_off(code))
        assert (10**logs).sum() == pytest.approx(1)


def test_the_model_split_finer(spark, docs, monkeypatch):
    """Scores are those of the whole model however its pieces are added up and joined."""
    df = docs.filter("text is not null").select("doc_id", "text")
    train = F.col("doc_id") % 2 == 0
    whole = {r.doc_id: r.score for r in ppm.score(df, train).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    monkeypatch.setattr(ppm, "FAN", 2)
    monkeypatch.setattr(ppm, "MET", 1)
    monkeypatch.setattr(ppm, "CHUNK", 50)
    try:
        for share in (1, 30, 1 << 30):  # no suffix, some suffixes and all of them are split
            monkeypatch.setattr(ppm, "SPLIT", share)
            split = {r.doc_id: r.score for r in ppm.score(df.repartition(9), train).collect()}
            assert split == pytest.approx(whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("order", [0, 2, 3])
def test_short_orders_split(spark, docs, monkeypatch, order):
    df, train = docs.select("doc_id", "text"), F.col("doc_id") % 2 == 0
    scores = []
    for share in (1, 1 << 30):
        monkeypatch.setattr(ppm, "SPLIT", share)
        scores.append({r.doc_id: r.score for r in ppm.score(df, train, order=order).collect()})
    assert scores[1] == pytest.approx(scores[0])


def test_large_suffixes_are_dealt_out_by_more_symbols(spark, docs, monkeypatch):
    """What is dealt out together is under the share, or ends in the same four symbols."""
    import numpy as np

    monkeypatch.setattr(ppm, "SPLIT", 200)
    pieces = docs.selectExpr("doc_id as id", "coalesce(text, '') as text", "doc_id % 2 = 0 as train").coalesce(1).mapInArrow(ppm._pieces, "piece bigint, n_bytes bigint, n_train bigint, texts binary")
    rows = pieces.mapInArrow(ppm._piece_codes(5), ppm._ROW)
    units = ppm._units(rows)
    code = np.concatenate([ppm._opened(r.codes, r.size, ordered=True) for r in rows.filter(F.col("part") == ppm.CODES).collect()])
    assert len(units.split[2]) and len(units.split[3])
    unit = units.of(code)
    for u in np.unique(unit):
        own = code[unit == u]
        assert len(own) * 200 <= len(code) or len(np.unique(own >> 9 & ppm._symbols(4))) == 1


def test_scores_of_rows_without_an_id(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (None, None), (2, "b")], "doc_id bigint, text string")
    got = ppm.score(df, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0).collect()
    assert len(got) == 4 and [r.held_out for r in got if r.doc_id is None] == [True, True]
    assert {(r.n_tokens, round(r.score, 9)) for r in got if r.n_tokens == 4} == {(4, round(next(r.score for r in got if r.doc_id == 1), 9))}


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = string_kernel.fit(docs.filter(fold != 1))
    held = string_kernel.with_language(docs.filter(fold == 1), model)
    told = held.filter("lang is not null and lang_pred <> 'und'")
    assert told.filter("lang = lang_pred").count() >= 0.95 * told.count() > 0
    assert held.filter("score < 0 or score > 1").count() == 0


def test_language_against_plain_kernels(spark, sf_dir):
    """Kernel, Nystrom map and ridge solution by sets and plain formulas."""
    import numpy as np

    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and length(text) between 50 and 400").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = string_kernel.fit(df, landmarks=12)
    grams = lambda t: {b[i : i + n] for b in [lower(t).encode()] for n in (1, 2, 3) for i in range(len(b) - n + 1)}
    langs = sorted({lang for lang, _ in rows})
    own = sorted(rows)
    marks = [grams(t) for lang in langs for t in (lambda x: x[:: max(1, len(x) // max(2, 12 // len(langs)))][: max(2, 12 // len(langs))])([t for k, t in own if k == lang])]
    known = set().union(*marks)
    kernel = np.array([[len(grams(t) & m) / np.sqrt(len(m) * max(1, len(grams(t) & known))) for m in marks] for _, t in own])
    both = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(both)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    z, y = kernel @ root, np.array([[1.0 if k == lang else -1.0 for lang in langs] for k, _ in own])
    w = np.sqrt(1 / np.array([sum(k == x for x, _ in own) for k, _ in own]))[:, None]
    weights = np.linalg.solve((z * w).T @ (z * w) + 0.1 / len(own) * np.eye(len(marks)), (z * w).T @ (y * w))
    expected = z @ weights
    got = model.kernel(*string_kernel.utf8(string_kernel.pa.array([t for _, t in own]))) @ model.weights
    assert model.langs == langs and np.allclose(got, expected, atol=2e-2)
    assert (got.argmax(1) == expected.argmax(1)).mean() >= 0.95


def test_language_ties_and_long_texts(spark):
    model = string_kernel.KernelModel(["a", "b"], *[getattr(string_kernel.fit(spark.createDataFrame([(1, "xyz", "a"), (2, "xyz", "b")], "doc_id bigint, text string, lang string")), n) for n in ("grams", "held", "weights")])
    model.weights[:] = model.weights[:, :1]
    assert model.predict(string_kernel.pa.array(["xyz", "xyz " * 400_000, "xyz"]))[0] == ["a", "a", "a"]


def test_language_of_odd_texts(docs):
    model = string_kernel.fit(docs)
    for r in string_kernel.with_language(docs, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    nothing = string_kernel.fit(docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in string_kernel.with_language(docs, nothing).collect()} == {"und"}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert rank_merge.with_token_counts(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert aho_bpe.with_round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert winnowing.decontaminate(none, items).count() == 0
    assert winnowing.decontaminate(docs, items).filter("n_hit > 0").count() == 0
    assert metric_join.near_duplicates(none).count() == 0
    assert ppm.score(none, F.lit(True)).count() == 0
    assert ppm.score(docs, F.lit(False)).filter("n_known > 0").count() == 0
    assert string_kernel.with_language(none, string_kernel.fit(none)).count() == 0
