"""URL filter: host rules first, gradient-boosted trees on lexical features for the rest.

A rule names a verdict, a host and the start of a path. It fits its host and all subdomains of it where
the url's path starts with the rule's; of several the longest wins. The urls that a rule fits are the
labelled ones: trees are boosted on them and judge the urls without a rule.

Features of a url: its length and those of host, path and query, depth, share of digits, entropy of its
characters, number of parameters, labels and hyphens of the host, and statistics of the host's suffix
(its last two labels): how many urls of the table have it and which share of its labelled urls is blocked.

Everything is a column expression, an aggregation, a join, or MLlib on DataFrames; no Python touches a row.
Suffix statistics cover all rows. The trees are fitted on at most about ``FIT_URLS`` distinct urls per
verdict, chosen by hash; that is the only bound.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; its features are
those of the text itself (a null counts as empty). Repeated rows give repeated results. Very long urls
are taken whole. Without any labelled url every verdict is ``allow``; with one label only it is that one.
An empty table gives an empty result. Columns of other names stay outside.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.joins import attach

from .common import staged

ALLOW, BLOCK = "allow", "block"
#: Distinct labelled urls per verdict that the trees are fitted on, about.
FIT_URLS = 20_000
FIT_TASKS = 4
TREES, DEPTH, RATE, SEED = 30, 4, 0.2, 17
#: Labelled urls that the share of blocked ones in a suffix starts from, at the overall share.
PRIOR = 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_query_length", "f_depth", "f_digits", "f_entropy", "f_params",
    "f_labels", "f_hyphens", "f_suffix_urls", "f_suffix_blocked",
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def first_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """name and verdict of the longest rule that fits, else null."""
    found = [F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
             for r in sorted(rules, key=lambda r: -len(r.name))]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<name:string,verdict:string>")


def parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased), path and query of a url; empty where there is no ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER),
        "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1),
    }


def entropy(text: Column) -> Column:
    """Bits per character: runs of the sorted characters, one fold, so linear but for the sort."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    size = F.length(text).cast("double")
    bits = lambda run: F.when(run > 0, run / size * F.log2(size / run)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        same = s["c"] == c
        return F.struct(
            c.alias("c"), F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same, s["sum"]).otherwise(s["sum"] + bits(s["run"])).alias("sum"))

    return F.aggregate(chars, start, step, lambda s: s["sum"] + bits(s["run"]))


def read(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, query, rule, label (the rule's verdict) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    cut = rows.withColumns(parts(F.col("url")))
    host, path = F.col("host"), F.col("path")
    ruled = cut.withColumn("found", first_rule(rules, host, path))
    return ruled.select(*cut.columns, F.col("found.name").alias("rule"), F.col("found.verdict").alias("label"))


def with_features(urls: DataFrame) -> DataFrame:
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    suffix = F.substring_index(host, ".", -2)
    length = F.length(url)
    lexical = {
        "suffix": suffix,
        "f_length": length, "f_host_length": F.length(host), "f_path_length": F.length(path), "f_query_length": F.length(query),
        "f_depth": F.regexp_count(path, F.lit("[^/]+")),
        "f_digits": F.when(length > 0, F.regexp_count(url, F.lit("[0-9]")) / length).otherwise(0.0),
        "f_entropy": entropy(url),
        "f_params": F.regexp_count(query, F.lit("[^&]+")),
        "f_labels": F.regexp_count(host, F.lit("[^.]+")), "f_hyphens": F.regexp_count(host, F.lit("-")),
    }
    known, blocked = F.col("label").isNotNull(), F.col("label") == BLOCK
    seen = urls.groupBy(suffix.alias("suffix")).agg(
        F.count("*").alias("urls"), F.count_if(known).alias("labelled"), F.count_if(blocked).alias("blocked"))
    overall = seen.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("rate")).first()["rate"] or 0.5
    stats = seen.select(
        "suffix", F.log1p(F.col("urls").cast("double")).alias("f_suffix_urls"),
        ((F.col("blocked") + PRIOR * overall) / (F.col("labelled") + PRIOR)).alias("f_suffix_blocked"))
    joined = attach(urls.withColumns(lexical), stats, ["suffix"]).drop("suffix")
    return joined.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})


def _assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)


def fit(features: DataFrame) -> GBTClassificationModel | str:
    """The boosted trees, or the only verdict there is to learn."""
    known = features.filter("label IS NOT NULL").dropDuplicates(["url"])
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), ALLOW)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, FIT_URLS / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < share * 1_000_003)
    # the sample is small and every level of every tree reads it: few partitions, in a fixed order
    rows = _assembled(chosen.withColumn("y", (F.col("label") == BLOCK).cast("double"))).orderBy(F.xxhash64("url"), "url")
    rows = staged(rows.select("features", "y").coalesce(FIT_TASKS))
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=SEED)
    return trees.fit(rows)


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row: the trees' probability of ``block`` (null
    where no trees could be fitted). The verdict is the rule's, else ``block`` from ``threshold`` on."""
    features = with_features(read(pages, rules, id_col, url_col))
    model = fit(features)
    if isinstance(model, str):
        scored = features.withColumn("score", F.lit(None).cast("double"))
        learned = F.lit(model)
    else:
        scored = model.transform(_assembled(features)).withColumn("score", vector_to_array("probability")[1])
        learned = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", learned).alias("verdict"), "score")
