"""Packing, filter audit and centroid clustering against plain Python."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import aho_bpe, best_fit, filter_audit, heap_kmeans, rank_merge, string_kernel, winnowing

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


ODD_TEXTS = [
    "A<|endoftext|>b", "<|startoftext|> <|ENDOFTEXT|>", "It's they'RE 'S. don't.", "end.", "end...", "x9.", "9x9x", "\x1c a\x1cb", "a b c", "é É. J̌ ǰ Ǩ", "İ İ ΑΣ. ΣΑΣ",
    "日本語、テスト。", "ﬁ Ⅷ ½", "​zero", "!!!?.", "?a.", "-.", "é.", "a\x00b", "\U0001f600.", "it's<b>.</b>",
]


def test_ids_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(best_fit, "STRETCH", 40)
    monkeypatch.setattr(best_fit, "KEPT", 3000)
    words, draw = best_fit._WordIds(WORDS), random.Random(3)
    texts = ODD_TEXTS + [" ".join(draw.choice(ODD_TEXTS) for _ in range(9)) for _ in range(60)] + ["".join(draw.choice("ab1 2.'<|>sŚ") for _ in range(500)) for _ in range(60)] + ["z" * 3000, "ab1" * 2000]
    for text in texts:
        assert np.frombuffer(best_fit.token_ids(text.encode(), words), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(words) + len(words.before) < 60


def test_pieces_and_windows(spark, docs, library):
    window = 64
    rows = docs.unionByName(docs.filter("doc_id in (5, 30)")).unionByName(docs.filter("doc_id = 31").withColumn("doc_id", F.lit(None).cast("bigint")))
    pieces = best_fit.token_pieces(rows.withColumn("length", F.lit("clash")).withColumn("offset", F.lit("clash")), WORDS, window, 1, with_ids=True)
    out = best_fit.pack(pieces.withColumn("window", F.lit("other")), window, group=40).toPandas()
    texts = rows.select("doc_id", "text").toPandas()
    expected = []
    for r in texts.itertuples():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected += [(str(r.doc_id), at, ids[at : at + window], len(ids)) for at in range(0, len(ids), window)]
    assert sorted((str(r.doc_id), r.start, list(r.ids), r.doc_tokens) for r in out.itertuples()) == sorted(expected)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in out.itertuples())
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= window
    assert out.sequence_id.nunique() <= out.length.sum() / window * 1.1 + 4


def test_no_rows_to_pack(spark, docs):
    assert best_fit.pack(best_fit.token_pieces(docs.filter("false"), WORDS)).count() == 0


def test_tree_finds_the_tightest_window():
    for window in (1, 5, 64, 100):
        draw, tree, open_windows = random.Random(window), best_fit.OpenWindows(window), []
        for n in range(3000):
            if draw.random() < 0.5:
                room = draw.randint(1, window)
                tree.put(room, n)
                open_windows.append((room, n))
            else:
                need = draw.randint(1, window)
                found, least = tree.take(need), min((r for r, _ in open_windows if r >= need), default=None)
                assert (found and found[0]) == least
                if found:
                    open_windows.remove(found)


def brute_audit(docs, labels):
    rows = [(i, t or "", s or "") for i, t, s in docs]
    fails = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        fails.append({x for x, yes in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if yes})
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if s == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            before = set()
            for step, x in enumerate(order, 1):
                removed = [i for i, f in own if x in f and not f & before]
                removed_by[x] += len(removed)
                out[part, "".join(order), step] = [
                    sum(1 for _, f in own if not f & (before | {x})), len(removed), sum(1 for _, f in own if x in f and f & before), sum(1 for _, f in own if f == {x}), sum(1 for i in removed if i in good), sum(1 for i in removed if i in toxic),
                ]
                before.add(x)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def audited(spark):
    draw, rows = random.Random(8), []
    texts = ["", None, "a b", "Many WORDS " * 150, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " #", "x" * 5000, "Ümlaut $ 　"]
    for i in range(120):
        rows.append((i % 90, draw.choice(texts), draw.choice(["a", "b", None, ""]), "clash", 1))
    rows += [rows[3], rows[3], (None, "a b", "a", "clash", 1), (None, None, None, "clash", 1)] + [(200 + i, "everywhere & all over", "hot", "clash", 1) for i in range(150)]
    labels = [(i, i % 2, int(i % 3 == 0), "x") for i in range(0, 300, 2)] + [(4, 1, None, "x"), (4, None, 1, "x"), (None, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, part string, n int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")


def test_audit_by_brute_force(audited, monkeypatch):
    monkeypatch.setattr(filter_audit, "SPLIT_ROWS", 7)  # so that hot groups are split
    docs, labels = audited
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_equal_hashes_of_different_texts_are_no_copies(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "a", 7), (3, "a", 7), (None, "a", 7)], "doc_id bigint, text string, hash bigint")
    assert [r.doc_id for r in filter_audit.copies(rows).collect()] == [3, 3]


def test_audit_of_nothing(audited):
    docs, labels = audited
    assert filter_audit.audit(docs.filter("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.filter("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def brute_clusters(rows, k, rounds, scale):
    v = [[int(np.floor(scale * float(x))) for x in e] for _, e in rows]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for (i, _), x in zip(rows, v, strict=True) if i is not None)[:k]
    c = [list(x) for _, x in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), i) for i, y in enumerate(c)) for x in v]

    for _ in range(rounds):
        own = [i for _, i in assign()]
        for i in range(len(c)):
            if members := [x for x, o in zip(v, own, strict=True) if o == i]:
                c[i] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return [(i, o, d) for (i, _), (d, o) in zip(rows, assign(), strict=True)], c


def _vectors(n, size, seed):
    draw = np.random.default_rng(seed)
    e = np.round(draw.normal(size=(n, size)) * 4) / 4  # whole steps, so that distances tie
    e[: n // 3] = e[0]
    return [(i % (n - 5), [float(x) for x in row]) for i, row in enumerate(e)]


@pytest.mark.parametrize(("n", "k", "scale"), [(400, 5, 1), (400, 8, 1024), (30, 8, 4), (9, 8, 1), (6, 8, 1), (300, 1, 4)])
def test_clusters_by_brute_force(spark, monkeypatch, n, k, scale):
    monkeypatch.setattr(heap_kmeans, "BUCKET", 2)
    rows = _vectors(n, 3, n + k)
    odd = [(900, [1.0, 2.0]), (901, None), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, e, "clash", 1) for i, e in rows + odd + [(None, [0.25, 0.5, 0.5])]], "vec_id bigint, embedding array<float>, cluster string, v int").repartition(3)
    out, told = heap_kmeans.cluster(df, k, 10, 3, scale)
    expected, centroids = brute_clusters(rows + [(None, [0.25, 0.5, 0.5])], k, 10, scale)
    got = out.toPandas()
    assert told["centroids"].tolist() == centroids
    assert sorted((str(None if i != i else int(i)), c, d) for i, c, d in zip(got.vec_id, got.cluster, got.distance, strict=True)) == sorted((str(i), c, d) for i, c, d in expected)
    assert set(got.inertia) == {sum(d for *_, d in expected)}
    for c, g in got.groupby("cluster"):
        assert set(g.cluster_inertia) == {g.distance.sum()} and set(g.centroid_sha256) == {hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()}
    assert told["compared"][0] == len(expected) and (k == 1 or sum(told["compared"][5:]) < 5 * len(expected))


def test_far_vectors_are_exact_and_too_far_an_error(spark):
    rows = [(i, [float(x), float(-x), 1.0]) for i, x in enumerate((3, 2**26, 2**26 - 1, -(2**26), 5, 2**25))]
    schema = "vec_id bigint, embedding array<double>"
    expected, _ = brute_clusters(rows, 2, 10, 1)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in heap_kmeans.cluster(spark.createDataFrame(rows, schema), 2, 10, 3, 1)[0].collect()) == sorted(expected)
    with pytest.raises(Exception, match="too large"):
        heap_kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], schema), 2, 10, 3, 1)[0].collect()


def test_no_vectors(spark):
    assert heap_kmeans.cluster(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))[0].count() == 0


def test_repeated_rows_are_rows_of_their_own(spark, docs):
    bpe_json, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.filter("doc_id in (4, 12, 25)")
    model = string_kernel.fit(docs)
    for made in (
        lambda d: rank_merge.with_token_counts(d, bpe_json, public_tokenizers.PATTERN).select("doc_id", "n_bytes", "n_tokens", "over_limit"),
        lambda d: aho_bpe.with_round_trip(d, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
        lambda d: string_kernel.with_language(d, model).select("doc_id", "lang_pred", "score"),
    ):
        assert sorted(map(str, made(rows.unionByName(rows)).collect())) == sorted(2 * list(map(str, made(rows).collect())))


def test_ids_that_the_vocabulary_lacks(tmp_path):
    ranks = tmp_path / "ranks"
    ranks.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i if i < 200 else i + 5}\n" for i in range(256)))
    bpe = aho_bpe.ByteBPE(str(ranks), public_tokenizers.PATTERN)
    assert bpe.decode([65, 255 + 5]) == b"A\xff" and bpe.decode([]) == b""
    for bad in (-1, None, 202, 10**6):
        with pytest.raises(ValueError, match="vocabulary"):
            bpe.decode([65, bad])


def test_long_pre_tokens_are_not_kept():
    bpe = aho_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    merger = rank_merge.RankMerger(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    text = "short " + "x" * 5000 + " short"
    assert len(bpe.encode(text)) == len(bpe.encode(text)) == merger.count([text])[0] == merger.count([text, text])[1]
    assert max(map(len, bpe.known)) <= 64 and max(map(len, merger.known)) <= 64


def test_items_that_repeat_themselves(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j a b c d e f g h i j"), (2, "x " * 40)], "doc_id bigint, text string")
    once = [(1, "a b c d e f g h i j"), (2, "x " * 12)]
    many = [(i, t) for i, t in [(1, ("a b c d e f g h i j " * 30)), (2, "x " * 500)]]
    got = [sorted((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in winnowing.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()) for items in (once, many)]
    assert got[0] == got[1] == [(1, 20, ("1",)), (2, 40, ("2",))]


def test_plain_words_and_signs_take_the_model_alone():
    from framewright.llm import best_fit

    words = best_fit._WordIds(public_tokenizers.path("word_bpe_49k.json"))
    library, asked = words.library, []

    class Library:
        def encode(self, text, **kw):
            asked.append(text)
            return library.encode(text, **kw)

    words.library = Library()
    for text in ("plain", "Plain$$$", "für,", "straße", "naïve.***", "éa%%%", "İstanbul", "don't", "x1#", "…,", "aª.", "a<|endoftext|>b", "日本;"):
        assert best_fit.token_ids(text.encode(), words) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text
    assert not {"plain", "plain$$$", "für,", "für", "straße", "naïve.***"} & set(asked)
