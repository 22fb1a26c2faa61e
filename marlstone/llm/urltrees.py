"""URL filter by gradient-boosted trees on lexical features (operator 4), DataFrame functions only.

URLs that a rule fits are the labelled ones: the rule is their label and their
verdict. All others get the verdict of boosted trees fitted to labelled URLs:
length, depth, digit ratio, character entropy, parameters, and for the last one
and two labels of the host how often labelled URLs with that suffix are
blocked (smoothed; a training row's own label is left out of its own figure).

The trees are fitted on at most ``fit_rows`` labelled URLs, chosen by a hash of
the URL; the suffix figures come from all labelled URLs and are joined as a
written table, so that Spark sees its size and can split a hot suffix.

A null URL, or one without "://", has an empty host and path; it is judged by
the trees like any other. Repeated rows are judged each; without labelled URLs,
or with one kind only, all others are allowed (or get that kind).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "fragment", "suffix_1", "suffix_2", "seen_2")


def url_parts(url: Column) -> dict[str, Column]:
    at = F.locate("://", F.col("__url"))
    rest = F.when(at > 0, F.substring(F.col("__url"), at + 3, F.length("__url"))).otherwise("")
    return {"__url": F.coalesce(url, F.lit("")), "__rest": rest, "host": ascii_lower(F.regexp_extract("__rest", r"^[^/?#]*", 0)), "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)}


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    for name, c in url_parts(F.col(url)).items():
        df = df.withColumn(name, c)
    return df


def matched(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _features(df: DataFrame) -> DataFrame:
    chars = F.split("__url", "")
    n = F.greatest(F.length("__url"), F.lit(1)).cast("double")
    share = lambda x: (F.length("__url") - F.length(F.replace(F.col("__url"), x, F.lit("")))) / n
    entropy = -F.aggregate(F.filter(F.array_distinct(chars), lambda x: x != ""), F.lit(0.0), lambda s, x: s + share(x) * F.log2(share(x)))
    labels = F.split("host", r"\.")
    query = F.regexp_extract("__url", r"\?([^#]*)", 1)
    return df.withColumns({
        "f_length": F.length("__url").cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "f_labels": F.size(labels).cast("double"),
        "f_digit_ratio": F.length(F.regexp_replace("__url", r"[^0-9]", "")) / n,
        "f_entropy": F.coalesce(entropy, F.lit(0.0)),
        "f_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "f_hyphens": F.length(F.regexp_replace("host", r"[^-]", "")).cast("double"),
        "f_fragment": F.contains(F.col("__url"), F.lit("#")).cast("double"),
        "suffix_1": F.element_at(labels, -1),
        "suffix_2": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
    })


def _with_suffixes(df: DataFrame, stats: DataFrame, prior: float, weight: float, own: Column | None = None) -> DataFrame:
    """own: the row's label where it is among the rows counted, which is taken out again."""
    for k in ("suffix_1", "suffix_2"):
        one = stats.filter(F.col("kind") == k).select(F.col("suffix").alias(f"__{k}"), F.col("n").alias(f"__n_{k}"), F.col("blocked").alias(f"__b_{k}"))
        df = df.join(one, F.col(k) == F.col(f"__{k}"), "left")
        n, b = F.coalesce(f"__n_{k}", F.lit(0)), F.coalesce(f"__b_{k}", F.lit(0))
        if own is not None:
            n, b = n - 1, b - own
        df = df.withColumn(f"f_{k}", (b + prior * weight) / (n + weight))
        if k == "suffix_2":
            df = df.withColumn("f_seen_2", F.log1p(n.cast("double")))
    return df


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_column: str = "page_id", fit_rows: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """pages: the id column and url. Host, path, rule, verdict and the trees' block probability for each row."""
    base = with_parts(pages.select(F.col(id_column), F.col("url").cast("string").alias("url")))
    name, verdict = matched(rules)
    base = _features(base.withColumns({"rule": name, "__verdict": verdict}))
    ruled = base.filter(F.col("rule").isNotNull()).withColumn("label", (F.col("__verdict") == "block").cast("double"))
    chosen = materialize(ruled.withColumn("__order", F.xxhash64("__url", F.lit(seed))).orderBy("__order", id_column).limit(fit_rows).select("label", "suffix_1", "suffix_2", *(f"f_{x}" for x in FEATURES if not x.startswith(("suffix", "seen")))), "url-fit")
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in ("suffix_1", "suffix_2"))))
    stats = materialize(ruled.select("label", both.alias("x")).groupBy("x.kind", "x.suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "url-suffixes")
    totals = stats.filter("kind = 'suffix_1'").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    n, blocked = totals["n"] or 0, totals["blocked"] or 0
    if not 0 < blocked < n:
        judged = base.withColumn("block_probability", F.lit(1.0 if n and blocked else 0.0))
    else:
        prior, weight = blocked / n, 5.0
        into = VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="__features")
        fit = into.transform(_with_suffixes(chosen, stats, prior, weight, F.col("label"))).select("label", "__features")
        model = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(fit)
        judged = model.transform(into.transform(_with_suffixes(base, stats, prior, weight))).withColumn("block_probability", vector_to_array("probability")[1])
    learned = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_column, "host", "path", "rule", F.coalesce("__verdict", learned).alias("verdict"), "block_probability")
