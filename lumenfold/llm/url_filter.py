"""URL filter: host and path rules, and boosted trees on lexical features for what no rule covers.

All row work is DataFrame expressions. The trees are fitted on the driver over a bounded sample of
labelled URLs and compiled to a column. Labels are a table of URLs, or else the verdicts of the
rules on those URLs that a rule covers; the rules themselves are no features, so the trees carry over
to other URLs what the covered ones look like.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled, scratch, stored
from .trees import Boosted, boost, margin_column

#: Fixed by the query's contract: verdict, rule.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Labelled URLs that the trees are fitted on, about, chosen by a hash of the URL.
SAMPLE = 20_000
FEATURES = ["f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy", "f_params", "f_query_len", "f_upper", "f_longest_label", "f_suffix_len", "f_suffix_rate", "f_folder_len", "f_folder_rate", "f_https", "f_vowels"]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame) -> DataFrame:
    """Add host and path of ``url``; null or without ``://``: both empty."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return df.withColumn("_rest", rest).withColumn("host", _lower(F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0))).withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_column(rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits host and path, as a struct (verdict, rule); null if none does. Of rules as long, the first."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<verdict: string, rule: string>")


def _entropy(c: Column) -> Column:
    """Bits for each character of ``c``; 0 if empty."""
    n = F.length(c)
    chars = F.array_distinct(F.split(c, ""))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(chars, F.lit(0.0), lambda acc, x: acc - F.when(F.length(x) == 0, 0.0).otherwise(((n - F.length(F.replace(c, x, F.lit("")))) / n) * F.log2((n - F.length(F.replace(c, x, F.lit("")))) / n))))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _suffix() -> Column:
    return F.element_at(F.split("host", r"\."), -1)


def _folder() -> Column:
    """The path's first folder; empty without one."""
    return F.regexp_extract("path", r"(?s)^/([^/]*)/", 1)


def with_features(df: DataFrame, suffixes: DataFrame, folders: DataFrame) -> DataFrame:
    """Lexical features of url, host and path. ``suffixes`` (suffix, f_suffix_rate) and ``folders`` (folder, f_folder_rate): how rare the end of a host and the start of a path are."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    n = F.greatest(F.length(host), F.lit(1)).cast("double")
    made = df.withColumns(
        {
            "suffix": _suffix(), "folder": _folder(), "f_folder_len": F.length(_folder()).cast("double"), "f_len": F.length(url).cast("double"), "f_host_len": F.length(host).cast("double"), "f_path_len": F.length(path).cast("double"),
            "f_depth": _count(path, "/[^/]"), "f_labels": F.size(labels).cast("double"), "f_digits": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "f_host_digits": _count(host, "[0-9]") / n,
            "f_hyphens": _count(host, "-"), "f_entropy": _entropy(host), "f_params": F.when(F.length(query) == 0, 0.0).otherwise(_count(query, "[&;]") + 1), "f_query_len": F.length(query).cast("double"),
            "f_upper": _count(url, "[A-Z]"), "f_longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"), "f_suffix_len": F.length(F.element_at(labels, -1)).cast("double"),
            "f_https": F.startswith(url, F.lit("https:")).cast("double"), "f_vowels": _count(host, "[aeiou]") / n,
        }
    )
    never = F.lit(-20.0)  # in labelled URLs alone
    joined = made.join(suffixes, "suffix", "left").join(folders, "folder", "left")
    return joined.withColumns({"f_suffix_rate": F.coalesce("f_suffix_rate", never), "f_folder_rate": F.coalesce("f_folder_rate", never)}).drop("suffix", "folder")


def rates(parts: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    """``name`` and f_``name``_rate: each value of ``key`` and the logarithm of its share of all ``n`` rows."""
    return parts.groupBy(key.alias(name)).agg(F.log(F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias(f"f_{name}_rate"))


def fit(labelled: DataFrame) -> Boosted:
    """Trees for ``labelled`` (FEATURES, label, url), a bounded sample. A URL counts once; of several labels the largest holds."""
    rows = labelled.groupBy("url").agg(F.max("label").alias("label"), *(F.first(f).alias(f) for f in FEATURES)).select("label", *FEATURES).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(-1, 1 + len(FEATURES))
    data = data[np.lexsort(data.T)]  # the same trees whatever the order of the rows
    return boost(data[:, 1:], data[:, 0])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, sample: int = SAMPLE, path: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' chance of block) of each row of ``pages`` (page_id, url).

    ``labelled``: url, label (1: block); default: the verdicts of ``rules`` on the pages that they
    cover. Other columns are ignored. A null url or one without ``://`` has an empty host and path,
    fits no rule, and is judged by the trees like any other; very long ones are too. Repeated rows are
    all kept. Without labelled rows the trees' score is 0.5. No rows give no verdicts.
    """
    parts = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    path, n = path or scratch(pages.sparkSession), parts.count()
    suffixes, folders = stored(rates(parts, _suffix(), "suffix", n), f"{path}/suffixes"), stored(rates(parts, _folder(), "folder", n), f"{path}/folders")
    if labelled is None:
        known = parts.withColumn("label", (rule_column(rules)["verdict"] == "block").cast("int")).drop("page_id")
    else:
        known = with_parts(labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")))
    model = fit(with_features(sampled(known.where("label is not null"), ["url"], sample), suffixes, folders))
    score = 1 / (1 + F.exp(-margin_column(model, FEATURES)))
    hit = with_features(parts, suffixes, folders).withColumn("_rule", rule_column(rules)).withColumn("score", score)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return hit.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def url_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``judge`` over all of ``pages``, by the contract's rules."""
    return judge(pages)
