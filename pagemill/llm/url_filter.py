"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule decides; they see only lexical features, and how often
labelled hosts of the same suffix are blocked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagemill.llm.common import ascii_lower, table
from pagemill.session import cut

#: (rule, verdict): a host and its subdomains, and the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs that the trees are fitted on, at most; those of the least hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 4, 7
#: Labelled URLs that a suffix counts besides its own, at the overall rate.
SMOOTHING = 20
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "host_labels", "longest_label", "dashes", "suffix_rate")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equal lengths the one that
    comes first in the order of its code points wins."""
    chosen, verdict = None, None
    for rule, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        chosen = F.when(fits, rule) if chosen is None else chosen.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if chosen is None else (chosen, verdict)


@F.pandas_udf(DoubleType())
def _entropy(urls: pd.Series) -> pd.Series:
    """Shannon entropy of the characters, in bits."""

    def one(url: str | None) -> float:
        if not url:
            return 0.0
        counts = np.unique(np.frombuffer(url.encode("utf-32-le"), np.uint32), return_counts=True)[1]
        share = counts / counts.sum()
        return float(-(share * np.log2(share)).sum())

    return urls.map(one, na_action=None).astype("float64")


def _suffix(host: Column) -> Column:
    return F.element_at(F.split(host, "\\."), -1)


def _lexical(urls: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("_url"), F.lit(""))
    length = F.length(url).cast("double")
    labels = F.split("_host", "\\.")
    return urls.withColumns(
        {
            "length": length,
            "depth": F.regexp_count("_path", F.lit("/[^/]")).cast("double"),
            "digit_ratio": F.when(length > 0, F.regexp_count(url, F.lit("[0-9]")) / length).otherwise(0.0),
            "entropy": _entropy(url),
            "params": F.regexp_count(F.regexp_extract(url, "\\?([^#]*)", 1), F.lit("[^&]+")).cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "dashes": F.regexp_count("_host", F.lit("[-0-9]")).cast("double"),
            "_suffix": _suffix(F.col("_host")),
        }
    )


def _parsed(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Host and path as columns of their own, and the rule that fits."""
    both = pages.withColumns({"_host": url_host(F.col("_url")), "_path": url_path(F.col("_url"))})
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), rules)
    return both.withColumns({"_rule": rule, "_verdict": verdict})


def _vectors(urls: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    rated = _lexical(urls).join(suffixes, "_suffix", "left").withColumn("suffix_rate", F.coalesce("_rate", F.lit(rate)))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rated)


def train(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[GBTClassificationModel | None, DataFrame, float]:
    """(trees, blocked share per suffix, blocked share) from the URLs of ``urls`` that a rule decides. Suffix
    shares count all of them, the trees are fitted on ``TRAIN_ROWS``. With labels of one kind only there
    are no trees and the overall share decides."""
    labelled = _parsed(urls, rules).filter("_verdict IS NOT NULL").withColumn("label", (F.col("_verdict") == "block").cast("double"))
    total = labelled.agg(F.avg("label").alias("rate"), F.count(F.lit(1)).alias("n")).first()
    rate = float(total["rate"]) if total["n"] else 0.0
    suffixes = cut(
        labelled.groupBy(_suffix(F.col("_host")).alias("_suffix")).agg(
            ((F.sum("label") + SMOOTHING * rate) / (F.count(F.lit(1)) + SMOOTHING)).alias("_rate")
        )
    )
    if not 0.0 < rate < 1.0:
        return None, suffixes, rate
    sample = labelled.orderBy(F.xxhash64(F.lit(SEED), "_url"), "_url").limit(TRAIN_ROWS)
    rows = cut(_vectors(sample, suffixes, rate).select(*FEATURES, "label").repartition(4, F.hash(*FEATURES)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    return trees.fit(rows), suffixes, rate


def url_verdicts(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, blocked_chance`` (of the trees, 0 to 1).

    A null URL, or one without ``://``, has an empty host and path, meets no rule and is judged by the
    trees like any other. Equal URLs get equal verdicts. Columns of the new names are replaced. With
    no labelled URLs, and in an empty table, no URL is blocked by the trees."""
    kept = pages.drop("host", "path", "rule", "verdict", "blocked_chance")
    urls = pages.select(F.col(url).alias("_url"))
    trees, suffixes, rate = train(urls, rules)
    judged = _vectors(_parsed(kept.withColumn("_url", F.col(url)), rules), suffixes, rate)
    if trees is None:
        judged = judged.withColumn("blocked_chance", F.lit(rate))
    else:
        scored = trees.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q").transform(judged)
        judged = scored.withColumn("blocked_chance", F.get(vector_to_array("_q"), F.lit(1)))
    own = F.when(F.col("blocked_chance") > 0.5, "block").otherwise("allow")
    return judged.select(
        *kept.columns,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", own).alias("verdict"),
        "blocked_chance",
    )


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op3_url_filter": (op3_url_filter, None)}
