"""URL filter: rules by host and path, gradient-boosted trees on lexical features for the rest.

Rules are text such as `allow org/` or `block example.org/es/`: a host that stands for itself and its subdomains, and
the start of a path. Of those that fit the longest wins. URLs that a rule judges are the labelled ones: trees are
boosted on them (Spark's own GBTClassifier, over at most `max_rows` of them, chosen by a hash of the URL) and judge
all others by length, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix.

Suffix statistics (how often labelled URLs of a suffix are blocked, smoothed) come from all labelled rows.

Edge cases: null, empty and `://`-less URLs have an empty host and path and are judged by the trees on what features
they have; where no labelled URL exists, or all agree, that one verdict (`allow` without any) holds for the rest;
equal URLs get equal verdicts, and repeated rows each their own; very long URLs are read whole; other columns pass through and columns named like a result are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm._common import materialise

SALTS = 32
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "fragment", "secure", "suffix_blocked", "suffix_share"]


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def rule_for(rules: list[str], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; both null if none fits."""
    parsed = sorted(((rule, what) for what, rule in (r.split(" ", 1) for r in rules)), key=lambda r: (-len(r[0]), r))
    said, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in reversed(parsed):
        where, slash, rest = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        said, name = F.when(fits, what).otherwise(said), F.when(fits, rule).otherwise(name)
    return name, said


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df, which has host and path, with all lexical features but those of the suffix."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    share = F.transform(letters, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)  # one pass for each different letter
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return (
        df.withColumn("url_length", F.length(url).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"))
        .withColumn("labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("digit_ratio", F.length(F.regexp_replace(url, "[^0-9]", "")) / size)
        .withColumn("hyphens", F.length(F.regexp_replace("host", "[^-]", "")).cast("double"))
        .withColumn("entropy", -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p)))
        .withColumn("params", F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"))
        .withColumn("fragment", url.contains("#").cast("double"))
        .withColumn("secure", url.startswith("https://").cast("double"))
    )


def suffix_statistics(labelled: DataFrame, blocked: float, total: float) -> DataFrame:
    """suffix, suffix_blocked (the share that is blocked, drawn to that of all by 20 rows) and suffix_share, of labelled URLs
    (suffix, label), of which there are `total`, `blocked` among them."""
    prior = blocked / total
    return labelled.groupBy("suffix").agg(((F.sum("label") + 20 * prior) / (F.count("*") + 20)).alias("suffix_blocked"), (F.count("*") / total).alias("suffix_share"))


def judge(df: DataFrame, rules: list[str], *, url_col: str = "url", max_rows: int = 20_000, trees: int = 20, depth: int = 3, seed: int = 7) -> DataFrame:
    """df with host, path, rule, verdict and block_score (the trees' probability of block; null where a rule judges)."""
    kept = [c for c in df.columns if c not in {"host", "path", "rule", "verdict", "block_score"}]
    base = df.select(F.struct(*kept).alias("_row"), F.col(url_col).cast("string").alias("_url"))
    base = with_parts(base, "_url")
    name, said = rule_for(rules, F.col("host"), F.col("path"))
    base = base.withColumn("rule", name).withColumn("said", said).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    labelled = materialise(base.filter("said is not null").select("_url", "host", "path", "suffix", F.when(F.col("said") == "block", 1.0).otherwise(0.0).alias("label")), "labelled")
    total = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("b")).first()
    if not total.n or total.b in (0, total.n):
        only = "block" if total.n and total.b else "allow"
        return base.select("_row.*", "host", "path", "rule", F.coalesce("said", F.lit(only)).alias("verdict"), F.when(F.col("said").isNull(), float(only == "block")).alias("block_score"))
    prior = total.b / total.n
    stats = suffix_statistics(labelled, total.b, total.n)
    unit = 1 << 20
    bound = int(unit * min(1.0, max_rows / total.n))
    sample = labelled.filter(F.pmod(F.xxhash64("_url"), F.lit(unit)) < bound).limit(2 * max_rows)

    # A suffix may hold a third of all rows: each one's statistics stand in SALTS parts of the join.
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def complete(x: DataFrame) -> DataFrame:
        spread = F.pmod(F.xxhash64("_row" if "_row" in x.columns else "_url"), F.lit(SALTS)).cast("int")
        joined = with_features(x, "_url").withColumn("_salt", spread).join(salted, ["suffix", "_salt"], "left").fillna({"suffix_blocked": prior, "suffix_share": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)

    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, cacheNodeIds=False).fit(complete(sample).select("features", "label").repartition(4))
    ruled = base.filter("said is not null").select("_row.*", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    judged = model.transform(complete(base.filter("said is null")))
    judged = judged.select("_row.*", "host", "path", "rule", F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict"), vector_to_array("probability")[1].alias("block_score"))
    return ruled.unionByName(judged)
