"""Operators on vectors, pages and conversations, the registered queries, and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import pickle
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import multiprobe_lsh, queries, string_kernel, tool_calls, url_boosting, warc


def test_neighbours_recall_and_order(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = e.toPandas()
    x, ids = np.array(own.embedding.tolist(), float), own.vec_id.to_numpy()
    got = multiprobe_lsh.search(e, F.col("vec_id") % 10 == 0, sample=64).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 10 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        at = {v: i for i, v in enumerate(ids)}
        assert np.allclose(mine.score, [d[at[v]] for v in mine.vec_id], rtol=0, atol=1e-12)
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(mine.vec_id))
    assert hits >= 0.9 * 10 * (ids % 10 == 0).sum()


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    got = [(r.query_id, r.rank, r.vec_id) for r in multiprobe_lsh.search(df, F.col("vec_id").isin(0, 3, 4, 8), k=10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (8, 1, 0), (8, 2, 1), (8, 3, 2)]
    assert multiprobe_lsh.search(df.limit(0), F.lit(True)).count() == 0


def test_split_buckets_find_the_same(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = lambda **k: sorted(multiprobe_lsh.search(e, F.col("vec_id") % 100 == 0, **k).collect())
    assert rows() == rows(block=7)


def test_recall_beside_a_large_group_of_copies(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((6000, 64))
    x[::3] = x[0] + 0.01 * draw.standard_normal((2000, 64))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    asks = [i for i in range(6000) if i % 100 == 0]
    got = multiprobe_lsh.search(df, F.col("vec_id").isin(asks), sample=512).toPandas()
    hits = {True: [], False: []}
    for q in asks:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits[q % 3 == 0].append(len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id)) / 10)
    assert np.mean(hits[False]) >= 0.9 and np.mean(hits[True]) >= 0.9


URLS = [None, "", "nothing", "http://A.Example.ORG/es/1", "https://x.org", "https://x.org/", "http://example.org/en/12?a=1", "http://notexample.org/en/1", "http://a.com/fr/1#x", "http://com/de/", "http://a.net/de/1", "ftp://b.com?x://y.org/", "://q.com/de/x", "http://x.com:80/de/"]


def brute_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = ""
    said = None
    for r in queries.URL_RULES:
        what, rule = r.split()
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best):
            best, said = rule, what
    return host, path, best or None, said


def test_url_rules_and_trees(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 20)], "page_id bigint, url string, host string")
    got = url_boosting.judge(df, queries.URL_RULES).collect()
    assert len(got) == len(df.collect())
    for r in got:
        host, path, rule, said = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == said if said else r.verdict in ("allow", "block")
        assert (r.block_score is None) == (said is not None)
    assert {r.verdict for r in url_boosting.judge(df.filter("url like '%net%'"), queries.URL_RULES).collect()} == {"allow"}
    assert url_boosting.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_entropy_is_of_the_whole_url(spark):
    urls = ["", "http://a.com/é𝒳é", "http://a.com/?" + "a" * 5000, "http://a.com/?" + "a" * 2500 + "0123456789bcdef" * 400]
    df = url_boosting.with_parts(spark.createDataFrame([(u,) for u in urls], "url string"))
    for r in url_boosting.with_features(df).collect():
        n = len(r.url)
        assert r.entropy == pytest.approx(-sum(r.url.count(c) / n * np.log2(r.url.count(c) / n) for c in set(r.url)))


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "x", "x", "é" * 5000, "a\r\n\r\nWARC/1.1\r\n", "x"]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}\r\n", h, 0) for i, h in enumerate(html)], "page_id bigint, url string, html string, payload int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    first = {h: min(i for i, x in enumerate(html) if (x or "") == h) for h in {x or "" for x in html}}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        same = first[h or ""]
        assert tuple(got[i]) == (i, len(raw), digest, "response" if i == same else "revisit", None if i == same else same)
    path = str(tmp_path / "w")
    warc.write(warc.as_records(pages, min_bytes=2), path)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert plain.count(b"WARC-Type: response") == len(html)  # any gzip reader can read it
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_pushdown(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("payload "), (F.col("id") % 5 * 5000).cast("int")).alias("html"))
    path = str(tmp_path / "w")
    warc.write(warc.as_records(pages), path)
    revisits = warc.read(spark, path).filter("record_type = 'revisit'")
    assert revisits.count() == 45
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "= revisit" in x]  # the source took it over
    bare = warc.read(spark, path, payload=False)
    assert bare.filter("payload is not null").count() == 0 and bare.count() == 50


SCHEMAS = {"f": {"required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": "string", "enum": ["x"]}, "c": {"type": ["number", "null"]}}}}


def test_tool_calls(spark):
    arguments = {"1": '{"a": 3}', "2": '{"b":"x","a":10}', "3": '{"a":"3","z":1}', "4": "[1]", "5": "{", "6": '{"a":1,"c":null,"b":"y"}', "7": '{"a": 1, "c": 1.5}', "8": '{"a": 2}'}
    needs = {"1": None, "2": ["1"], "3": ["2", "1"], "4": ["9"], "5": ["6"], "6": ["5"], "7": ["6"], "8": ["3", "3"]}
    calls = spark.createDataFrame([(1, c, int(c), "f" if c != "8" else "g", arguments[c], needs[c], 0) for c in arguments] + [(1, "1", 5, "g", "{}", None, 0), (None, "1", 1, "f", "{}", None, 0)], "conv_id bigint, call_id string, ord int, tool string, arguments string, depends_on array<string>, level int")
    results = spark.createDataFrame([(1, "1", "ok"), (1, "1", "later"), (1, "7", None), (2, "1", "lost")], "conv_id bigint, call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link(calls, results, SCHEMAS).collect()}
    assert len(got) == 8
    assert {c: r.level for c, r in got.items()} == {"1": 0, "2": 1, "3": 2, "4": 0, "5": None, "6": None, "7": None, "8": 3}
    assert [c for _, c in sorted((r.position, c) for c, r in got.items() if r.position)] == ["1", "4", "2", "3", "8"]
    assert {c: r.errors for c, r in got.items()} == {"1": [], "2": ["a: maximum"], "3": ["z: unknown", "a: type"], "4": ["not a JSON object"], "5": ["not a JSON object"], "6": ["b: enum"], "7": [], "8": ["unknown tool"]}
    assert got["1"].status == "ok" and got["2"].status == "invalid" and got["7"].status == "cycle" and got["4"].missing == ["9"]
    assert json.loads(got["1"].json) == {"arguments": {"a": 3}, "depends_on": [], "id": "1", "name": "f", "result": "later"}
    assert [(r.conv_id, r.content) for r in tool_calls.orphans(calls, results).collect()] == [(2, "lost")]
    assert tool_calls.link(calls.limit(0), results, SCHEMAS).count() == 0


RULES = [
    {"type": "integer"}, {"type": ["number", "null"], "minimum": -1, "maximum": 3}, {"enum": [1, "1", None, True, [1], {"a": "é"}]}, {"type": "string", "minLength": 2, "maxLength": 3}, {"pattern": "^a.*b$"},
    {"type": "array", "items": {"type": "integer", "maximum": 5}, "minItems": 1, "maxItems": 2}, {"type": "object", "required": ["y"], "properties": {"y": {"type": "boolean"}, "z": {"items": {"enum": ["q"]}}}, "additionalProperties": False}, {},
]
VALUES = [None, True, 0, 1, 3.0, 3.5, -2, 7, "", "1", "ab", "axxb", "é", [], [1], ["1", 6], [1, 2, 3], {}, {"y": True}, {"y": 1, "z": ["q", "r", "s"], "w": 2}, {"a": "é"}]


def brute_errors(name, rule, v):
    """What is wrong with a value, by plain Python."""
    number, out = isinstance(v, int | float) and not isinstance(v, bool), []
    is_a = {"string": isinstance(v, str), "integer": number and v == int(v), "number": number, "boolean": isinstance(v, bool), "array": isinstance(v, list), "object": isinstance(v, dict), "null": v is None}
    types = rule.get("type", [])
    if types and not any(is_a[t] for t in ([types] if isinstance(types, str) else types)):
        out.append(f"{name}: type")
    if "enum" in rule and json.dumps(v) not in [json.dumps(x) for x in rule["enum"]]:
        out.append(f"{name}: enum")
    for word, wrong in (("minimum", lambda x: number and v < x), ("maximum", lambda x: number and v > x), ("minLength", lambda x: is_a["string"] and len(v) < x), ("maxLength", lambda x: is_a["string"] and len(v) > x), ("pattern", lambda x: is_a["string"] and not re.search(x, v)), ("minItems", lambda x: is_a["array"] and len(v) < x), ("maxItems", lambda x: is_a["array"] and len(v) > x)):
        if word in rule and wrong(rule[word]):
            out.append(f"{name}: {word}")
    if "items" in rule and is_a["array"]:
        out += [e for x in v for e in brute_errors(f"{name}[]", rule["items"], x)]
    if is_a["object"]:
        out += [f"{name}.{k}: missing" for k in rule.get("required", []) if k not in v]
        out += [f"{name}.{k}: unknown" for k in v if not rule.get("additionalProperties", True) and k not in rule.get("properties", {})]
        out += [e for k, r in rule.get("properties", {}).items() if k in v for e in brute_errors(f"{name}.{k}", r, v[k])]
    return sorted(set(out))


def test_schemas_against_plain_python(spark):
    schemas = {f"t{i}": {"properties": {"x": r}} for i, r in enumerate(RULES)}
    rows = [(f"t{i}", json.dumps({"x": v}), n) for i in range(len(RULES)) for n, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "tool string, arguments string, n int")
    for r in df.select("tool", "n", tool_calls.schema_errors(F.col("tool"), F.col("arguments"), schemas).alias("e")).collect():
        assert sorted(set(r.e)) == brute_errors("x", RULES[int(r.tool[1:])], VALUES[r.n]), (r.tool, VALUES[r.n])
    odd = spark.createDataFrame([("t0", a, 0) for a in ('{"x":1,"x":2}', "[]", None, "", " {}")], "tool string, arguments string, n int")
    assert [r.e for r in odd.select(tool_calls.schema_errors(F.col("tool"), F.col("arguments"), schemas).alias("e")).collect()] == [["repeated keys"], ["not a JSON object"], ["not a JSON object"], ["not a JSON object"], []]
    with pytest.raises(ValueError, match="oneOf"):
        tool_calls.schema_errors(F.lit("a"), F.lit("{}"), {"a": {"properties": {"x": {"oneOf": []}}}})


def test_levels_against_plain_python(spark):
    draw = random.Random(4)
    needs = {c: [f"c{draw.randrange(c)}" for _ in range(draw.randint(0, 3))] if c and draw.random() < 0.9 else [] for c in range(40)}
    needs[7], needs[9] = ["c9"], ["c7"]
    level: dict[str, int] = {}
    for _ in needs:
        level |= {f"c{c}": 1 + max([level[d] for d in n], default=-1) for c, n in needs.items() if all(d in level for d in n)}
    calls = spark.createDataFrame([(1, f"c{c}", c, "f", "{}", n) for c, n in needs.items()] * 2, "conv_id bigint, call_id string, ord int, tool string, arguments string, depends_on array<string>")
    got = tool_calls.link(calls, spark.createDataFrame([], "conv_id bigint, call_id string, content string"), {"f": {}}).collect()
    assert {r.call_id: r.level for r in got} == {f"c{c}": level.get(f"c{c}") for c in needs} and len(got) == 40
    order = [r.call_id for r in sorted((r for r in got if r.position), key=lambda r: r.position)]
    assert order == sorted(level, key=lambda c: (level[c], int(c[1:])))


def test_positions_of_a_long_conversation(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that it does span tasks
    try:
        calls = spark.range(3000).select(F.when(F.col("id") < 2900, 7).otherwise(F.col("id") % 3).cast("bigint").alias("conv_id"), F.col("id").cast("string").alias("call_id"), (F.col("id") * 37 % 50).alias("ord"), F.lit("f").alias("tool"), F.lit("{}").alias("arguments"), F.when(F.col("id") % 4 == 1, F.array((F.col("id") - 1).cast("string"))).alias("depends_on"))
        got = tool_calls.link(calls, spark.createDataFrame([], "conv_id bigint, call_id string, content string"), {"f": {}}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    place = lambda r: (r.level, int(r.call_id) * 37 % 50, r.call_id)
    for conv in (0, 1, 2, 7):
        of = sorted((r for r in got if r.conv_id == conv), key=place)
        assert of and [r.position for r in of] == list(range(1, len(of) + 1))
    assert len(got) == 3000 and {r.level for r in got} == {0, 1}


def test_url_features_against_plain_python(spark):
    urls = [u or "" for u in URLS] + ["https://x-y.Example.com:8/a//b1/?q=1&&r=2#f", "http://é.de/ü?%41", "a" * 3000]
    df = url_boosting.with_features(url_boosting.with_parts(spark.createDataFrame([(u,) for u in urls], "url string")))
    for r in df.collect():
        u, (host, path, _, _) = r.url, brute_rule(r.url)
        n = max(1, len(u))
        query = u.partition("?")[2].partition("#")[0] if "?" in u else ""
        assert (r.url_length, r.host_length, r.path_length) == (len(u), len(host), len(path))
        assert (r.depth, r.labels, r.hyphens) == (len([x for x in path.split("/") if x]), len(host.split(".")), host.count("-"))
        assert r.digit_ratio == pytest.approx(sum(c in "0123456789" for c in u) / n)
        assert (r.params, r.fragment, r.secure) == (len([x for x in query.split("&") if x]), "#" in u, u.startswith("https://"))
        assert r.entropy == pytest.approx(-sum(u.count(c) / n * np.log2(u.count(c) / n) for c in set(u)))


def test_suffix_statistics(spark):
    rows = [("com", 1.0)] * 7 + [("com", 0.0)] * 3 + [("org", 0.0)] * 5
    got = {r.suffix: r for r in url_boosting.suffix_statistics(spark.createDataFrame(rows, "suffix string, label double"), 7, 15).collect()}
    assert got["com"].suffix_blocked == pytest.approx((7 + 20 * 7 / 15) / 30) and got["org"].suffix_blocked == pytest.approx((20 * 7 / 15) / 25)
    assert got["com"].suffix_share == pytest.approx(10 / 15)


def test_trees_learn_the_rules(spark, sf_dir):
    """URLs that look like those a rule blocks are blocked; the same URL always gets the same verdict."""
    urls = [f"http://h{i}.bad.com/de/{i}?a=1" for i in range(200)] + [f"https://h{i}.good.org/x" for i in range(200)]
    asked = ["http://h1.bad.com/xx/1?a=1"] * 3 + ["https://h1.other.net/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + asked)], "page_id bigint, url string")
    got = [r.verdict for r in url_boosting.judge(df, queries.URL_RULES).filter("page_id >= 400").orderBy("page_id").collect()]
    assert got == ["block"] * 3 + ["allow"]


def test_a_member_of_several_records(spark, tmp_path):
    row = lambda n, kind="response": {"record_type": kind, "record_id": f"<urn:page:{n}>", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_bytes": 3 * n, "payload": b"abc" * n}
    several = b"".join(warc.record(row(n)) for n in (1, 2))
    path = tmp_path / "w"
    path.mkdir()
    blocks = [warc.member(warc.record(row(3, "request"))), gzip.compress(several), warc.member(several), warc.member(warc.record(row(4) | {"payload": bytes(200_000)})), gzip.compress(warc.record(row(5)))]
    (path / "a.warc.gz").write_bytes(b"".join(blocks))
    ids = lambda df: sorted(warc_id for (warc_id,) in df.select("record_id").collect())
    assert ids(warc.read(spark, str(path))) == [f"<urn:page:{n}>" for n in (1, 1, 2, 2, 3, 4, 5)]
    assert ids(warc.read(spark, str(path), payload=False).filter("record_type = 'response'")) == [f"<urn:page:{n}>" for n in (1, 1, 2, 2, 4, 5)]
    assert {len(r.payload) for r in warc.read(spark, str(path)).collect()} == {3, 6, 9, 200_000, 15}


def test_pages_without_an_id_or_twice(spark):
    pages = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (1, "u", "x"), (2, "v" * 9000, "x")], "page_id bigint, url string, html string")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert [g for g in got if g[0]] == [(1, "response", None), (1, "response", None), (2, "revisit", 1)] and len(got) == 4
    pages = spark.createDataFrame([(1, "u", "x"), (3, "u", "x"), (3, "u", "y"), (3, "u", "x"), (5, "u", "y")], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect()) == [(1, "response", 0), (3, "response", 0), (3, "revisit", 1), (3, "revisit", 1), (5, "revisit", 3)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    from tests.test_oracle import rows, twin

    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    table = {"op1": "embeddings", "op2": "conversations", "op7": "pages", "op8": "pages"}.get(name.split("_")[0], "documents")
    total = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name.startswith("op1_"):
        assert len(got) == 10 * total.filter("vec_id % 100 = 0").count()
    elif name.startswith("op2_"):
        assert len(got) == total.filter("role = 'user'").count()
    else:
        assert len(got) == total.count()
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(twin(queries.ORACLE_SQL[name], sf_dir))


def test_language_stage_decides_by_score(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**9, "QmFzZTY0IGVuY29kZWQgc3RyaW5nMTIzNDU2Nzg5MA==" * 20), (10**9 + 1, "12 34 " * 50)], "doc_id bigint, text string")
    kept = {r.doc_id for r in pipeline.language(spark, docs.unionByName(junk, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}


def test_language_stage_without_labels(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in pipeline.language(spark, docs, sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()} != set()


def test_stages_on_odd_tables(spark, sf_dir):
    """Null ids and texts, repeated rows, clashing names, no labels, no rows: each stage keeps the columns and its own rules."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, _maybe int, lang_pred string, score double, ids int"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(i, t, None, "s", 1, 7, "x", 0.5, 3) for i, t in [(None, long), (1, long), (1, long), (2, long + " end"), (3, ""), (4, None), (5, "!!"), (6, "one"), (5, "other words")]]
    docs = spark.createDataFrame(rows, schema)
    kept = {"language": [0, 1, 1, 2, 5, 6], "near_copies": [0, 1, 1, 3, 4, 5, 5, 6], "leaks": [0, 1, 1, 2, 3, 4, 5, 5, 6]}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "tokens" or out.columns == docs.columns
        got = sorted(r.doc_id or 0 for r in out.collect())
        assert got == kept.get(name, kept["leaks"]), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def _by_score(spark, sf_dir, docs):
    """What the language stage keeps, by the model's scores and plain thresholds."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = string_kernel.fit(rows.filter(~held_out))
    langs, scores = model.predict(pa.array(list(docs.values()), pa.string()))
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    kind = lambda t: sum(len(t.encode()) >= most for most in string_kernel.SIZES)
    judged = {i: (pred, score, kind(t or "")) for (i, t), pred, score in zip(docs.items(), langs, scores, strict=True)}
    seen = [[score for i, (pred, score, k) in judged.items() if k == c and lang[i] is not None and pred != "und" and zlib.crc32(str(i).encode()) % 3 == 1] for c in range(3)]
    needed = [min(0.5, 0.95 * sorted(x)[max(0, math.ceil(0.0001 * len(x)) - 1)]) if x else 0.0 for x in seen]
    return {i: docs[i] for i, (pred, score, k) in judged.items() if pred != "und" and score >= needed[k] - 1e-9}


def test_pipeline(spark, sf_dir):
    """run() against its decisions worked out apart."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_texts import LETTERS, brute_components, lower

    con = duckdb.connect()
    docs = dict(con.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    items = [LETTERS.findall(lower(t)) for (t,) in con.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    assert all(len(w) >= 10 for w in items)
    kept = _by_score(spark, sf_dir, docs)
    kept = {i: t for i, t in kept.items() if brute[i][1] == i} if (brute := brute_components(kept, 5, 80)) else {}
    clean = {i for i, t in kept.items() if not any(tuple(w[j : j + 10]) in windows for w in [LETTERS.findall(lower(t))] for j in range(len(w) - 9))}
    got = pipeline.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) == clean and len(got) == len(clean)
    for r in got.itertuples():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_archives_are_appended_and_overwritten(spark, tmp_path):
    pages = lambda a, b: spark.range(a, b).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html")).repartition(3)
    path = f"{tmp_path}/w"
    ids = lambda: sorted(r.i for r in warc.read(spark, path).select(warc.page_number(F.col("record_id")).alias("i")).collect())
    warc.write(warc.as_records(pages(0, 10)), path)
    warc.write(warc.as_records(pages(10, 20)), path)
    assert ids() == list(range(20))
    warc.write(warc.as_records(pages(30, 34)), path, "overwrite")
    assert ids() == [30, 31, 32, 33]
    (tmp_path / "w" / "sub").mkdir()
    (tmp_path / "w" / "_hidden").mkdir()
    next((tmp_path / "w").glob("*.warc.gz")).rename(tmp_path / "w" / "sub" / "x.warc.gz")
    assert ids() == [30, 31, 32, 33] and not list((tmp_path / "w").glob(".*"))


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/w"
    bad = spark.range(40).repartition(4).select(F.lit("response").alias("record_type"), F.when(F.col("id") < 39, "<urn:x>").otherwise(F.raise_error(F.lit("stop"))).alias("record_id"), *[F.lit(None).cast("string").alias(c) for c in ("target_uri", "payload_digest", "refers_to")], F.lit(1).cast("bigint").alias("payload_bytes"), F.lit(b"x").alias("payload"))
    with pytest.raises(Exception, match="stop"):
        warc.write(bad, path)
    assert not list((tmp_path / "w").glob("[!.]*")) and not warc.read(spark, path).count()


def test_small_files_when_asked(spark, tmp_path):
    rows = warc.as_records(spark.range(30).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).coalesce(1))
    rows.sparkSession.dataSource.register(warc.WarcSource)
    rows.write.format("warc").option("file_bytes", 1000).mode("append").save(f"{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 5 and warc.read(spark, f"{tmp_path}/w").count() == 30


def test_archives_of_others(spark, tmp_path):
    def raw(n, head, body):
        return b"\r\n".join([b"WARC/1.0", *head, b"Content-Length:%d" % len(body), b"", body]) + b"\r\n\r\n"

    blocks = [raw(1, [b"warc-type:response", b"WARC-Record-ID:  <urn:page:1> ", b"WARC-Target-URI: http://x/", b"\t?q=1"], b"one"), raw(2, ["WARC-Type: request".encode(), "WARC-Record-ID:<urn:page:2>".encode(), "WARC-Target-URI: http://é/".encode("latin-1")], b"x" * 200_000), raw(3, [b"WARC-TYPE:response", b"WARC-Record-ID:<urn:page:3>"], b"")]
    for name, data in (("a/plain.warc", b"".join(blocks)), ("packed.warc.gz", b"".join(gzip.compress(b) for b in blocks)), ("also.warc.gz", b"".join(blocks))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for path, times in ((f"{tmp_path}", 3), (f"{tmp_path}/a/plain.warc", 1), (f"{tmp_path}/packed.warc.gz", 1)):
        got = sorted((r.record_id, r.target_uri or "", r.payload_bytes, len(r.payload)) for r in warc.read(spark, path).collect())
        assert got == sorted([("<urn:page:1>", "http://x/ ?q=1", 3, 3), ("<urn:page:2>", "http://é/", 200_000, 200_000), ("<urn:page:3>", "", 0, 0)] * times)
        assert warc.read(spark, path, payload=False).filter("record_type = 'response'").count() == 2 * times
    (tmp_path / "bad.warc").write_bytes(blocks[1][:-100_000])
    for payload in (True, False):
        with pytest.raises(Exception, match="cut off"):
            warc.read(spark, f"{tmp_path}/bad.warc", payload=payload).collect()
    with pytest.raises(Exception, match="nowhere"):
        warc.read(spark, f"{tmp_path}/nowhere").collect()


def test_a_circle_beside_a_deep_ladder(spark):
    rows = [(1, "a", ["b"]), (1, "b", ["a"]), (1, "c", ["a", None])]
    for i in range(40):  # each rung needs both calls of the one below
        rows += [(2, f"{i:02d}{x}", [f"{i - 1:02d}l", f"{i - 1:02d}r"] if i else None) for x in "lr"]
    rows += [(3, f"{i:03d}", [f"{i - 1:03d}"] if i else []) for i in range(100)]
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(calls).collect()}
    assert got == {(2, f"{i:02d}{x}"): i for i in range(40) for x in "lr"} | {(3, f"{i:03d}"): i for i in range(100)}


def test_the_broadcast_model_is_small(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = string_kernel.fit(rows)
    model.predict(pa.array(["some text"]))
    assert len(pickle.dumps(model)) < 5 << 20
