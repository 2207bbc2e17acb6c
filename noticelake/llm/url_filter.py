"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML, on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import small_side

#: (verdict, host, path); a rule fits its host and all subdomains when the path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Labelled URLs the trees are fitted on, about; a fixed bound, so the fit does not grow with the input.
SAMPLE = 8_000
TREES = 12
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "host_labels",
    "digit_ratio",
    "entropy",
    "parameters",
    "has_fragment",
    "hyphens",
    "suffix_blocked",
    "suffix_share",
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for NULL or without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, of equally long ones the first given; else NULL."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits per character; the lambda sees each different character once."""
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.split(text, ""))

    def term(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when((c != "") & (p > 0), -p * F.log2(p)).otherwise(0.0)

    return F.when(F.length(text) > 0, F.aggregate(chars, F.lit(0.0).cast("double"), lambda a, c: a + term(c))).otherwise(0.0)


def _characters(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, kept, ""))


def lexical_features(df: DataFrame) -> DataFrame:
    """Numbers of ``url_``, ``url_host`` and ``url_path``; no row is dropped, NULL and empty URLs give zeros."""
    url, host, path = F.col("url_"), F.col("url_host"), F.col("url_path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "depth": _characters(path, "[^/]"),
            "host_labels": _characters(host, "[^.]"),
            "digit_ratio": _characters(url, "[^0-9]") / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url),
            "parameters": F.when(query == "", 0).otherwise(_characters(query, "[^&]") + 1),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"),
            "hyphens": _characters(host, "[^-]"),
        }
    )


def suffix_statistics(labelled: DataFrame, prior: float = 10.0) -> DataFrame:
    """Per suffix, the last label of the host: smoothed share of blocked URLs, and share of all labelled URLs."""
    counts = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    totals = counts.agg(F.sum("n").alias("n_all"), F.sum("blocked").alias("blocked_all")).first()
    n, blocked = totals["n_all"] or 0, totals["blocked_all"] or 0.0
    base = blocked / n if n else 0.5
    return counts.select(
        "suffix",
        ((F.col("blocked") + prior * base) / (F.col("n") + prior)).alias("suffix_blocked"),
        (F.col("n") / float(max(n, 1))).alias("suffix_share"),
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    sample: int = SAMPLE,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """Every row with ``host, path, rule, verdict, p_block`` added (columns of those names are replaced).

    A rule decides where one fits, else the trees: blocked above one half. They are fitted on ``labels`` (``url, label``,
    1 blocked) or, without it, on the URLs that rules decide; of the different ones about ``sample``, picked by a hash of
    the URL. Host and suffix statistics cover all labelled URLs. With labels of one class only, that class is the verdict;
    without any, ``allow``. NULL URLs and URLs without ``://`` have empty host and path and are judged like any other.
    """
    own = ("host", "path", "rule", "verdict", "p_block")
    columns = [c for c in pages.columns if c not in own]
    url = F.coalesce(F.col("url_"), F.lit(""))
    raw = pages.select(F.struct(*[pages[c] for c in columns]).alias("row_"), pages["url"].cast("string").alias("url_"))
    parsed = raw.select("row_", url.alias("url_"), host_of(url).alias("url_host"), path_of(url).alias("url_path"))
    parsed = parsed.withColumn("found", matching_rule(F.col("url_host"), F.col("url_path"), rules))
    suffix = F.regexp_extract("url_host", r"([^.]*)$", 1)
    if labels is None:
        known = parsed.where("found is not null").select(
            "url_", "url_host", "url_path", (F.col("found.verdict") == "block").cast("double").alias("label")
        )
    else:
        u = F.coalesce(F.col("url").cast("string"), F.lit(""))
        known = labels.where("label is not null").select(
            u.alias("url_"), host_of(u).alias("url_host"), path_of(u).alias("url_path"), F.col("label").cast("double").alias("label")
        )
    known = known.withColumn("suffix", suffix)
    classes = {
        r["label"]: r["n"]
        for r in known.groupBy("label").agg(F.approx_count_distinct("url_").alias("n")).collect()
    }
    if len(classes) < 2:
        only = "block" if 1.0 in classes else "allow"
        judged = parsed.withColumns({"p_block": F.lit(1.0 if only == "block" else 0.0), "other": F.lit(only)})
    else:
        statistics = small_side(suffix_statistics(known), "suffixes")
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

        def featured(df: DataFrame) -> DataFrame:
            numbers = lexical_features(df).join(statistics, "suffix", "left")
            return assembler.transform(
                numbers.fillna({"suffix_blocked": classes.get(1.0, 0) / sum(classes.values()), "suffix_share": 0.0})
            )

        share = min(1.0, sample / sum(classes.values()))
        picked = known.where(F.shiftrightunsigned(F.xxhash64("url_"), 11).cast("double") / float(1 << 53) < share)
        picked = picked.groupBy("url_", "url_host", "url_path", "suffix").agg(F.max("label").alias("label"))
        rows = featured(picked).select("features", "label").coalesce(4)
        model: GBTClassificationModel = GBTClassifier(
            maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label", maxBins=64
        ).fit(rows)
        judged = model.transform(featured(parsed.withColumn("suffix", suffix))).withColumn(
            "p_block", vector_to_array("probability")[1]
        )
        judged = judged.withColumn("other", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return judged.select(
        *[F.col("row_")[c].alias(c) for c in columns],
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "other").alias("verdict"),
        "p_block",
    )
