"""Mixing sources to target weights: whole copies by repetition rate, and one more by a hash-seeded coin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import size_in_words, small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = 42


def source_targets(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """One row per source: ``mix_source, mix_source_size, mix_target, mix_rate``.

    Sources are ordered by code point, NULL last, and weigh ``weights`` in turn. Together they get ``share`` times all
    words; none gets more than ``limit`` times its own. What is above goes to the others by weight until none is above:
    with the sources in ascending order of limit by weight, the filled ones come first, and the rest share what is left.

    Words are summed per source with map-side combine; only that table, one row per source, is ordered as a whole.
    """
    sizes = (
        docs.select(F.col("source").cast("string").alias("mix_source"), size_in_words().alias("n"))
        .groupBy("mix_source")
        .agg(F.sum("n").cast("long").alias("mix_source_size"))
    )
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("w"),
        (F.lit(float(limit)) * F.col("mix_source_size")).alias("most"),
    )
    everything = Window.partitionBy()
    by_limit = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("mix_source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.lit(float(share)) * F.sum("mix_source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("w").over(onward)
    placed = weighed.select("*", level.alias("level")).select(
        "*", (F.col("most") <= F.col("level") * F.col("w")).alias("full"), F.row_number().over(by_limit).alias("at")
    )
    # The first source that is not filled fixes the level for itself and all after it.
    fixed = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)
    open_ = F.coalesce(F.col("at") >= fixed["at"], F.lit(False))
    target = F.when(open_, fixed["level"] * F.col("w")).otherwise(F.col("most"))
    return placed.select("mix_source", "mix_source_size", target.alias("mix_target")).withColumn(
        "mix_rate",
        F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0),
    )


def mixing_rates(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: int = SEED,
) -> DataFrame:
    """Every row with ``mix_size, mix_source_size, mix_target, mix_rate, mix_copies`` added.

    The coin of a row is a hash of seed, id and text, so reruns agree whatever the partitions. NULL texts have size 0
    and NULL sources are one source, the last; equal rows get equal copies. Columns of those names in the input are
    replaced. The table of sources is broadcast while it is small, as counted; beyond that it is joined like any other.
    """
    docs = docs.drop("mix_size", "mix_source", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    targets = small_side(source_targets(docs, weights, share, limit), "targets")
    digest = F.md5(
        F.concat(
            F.lit(f"{seed}|"),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            F.lit("|"),
            F.coalesce(F.col("text"), F.lit("")),
        )
    )
    coin = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    tossed = docs.withColumns({"mix_size": size_in_words(), "mix_coin": coin})
    rated = tossed.join(targets, tossed["source"].cast("string").eqNullSafe(targets["mix_source"])).drop("mix_source")
    whole = F.floor("mix_rate")
    copies = (whole + (F.col("mix_coin") < F.col("mix_rate") - whole).cast("long")).cast("long")
    return rated.withColumn("mix_copies", copies).drop("mix_coin")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row as often as its source's rate says, with the input's columns as they were, whatever their names."""
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    read = [F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")]
    rated = mixing_rates(named.select("*", *read), **options)
    repeated = rated.where("mix_copies > 0").withColumn(
        "mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    )
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
