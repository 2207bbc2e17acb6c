"""A file layout for map and date filters: rows lie along a space-filling curve over cell and time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from uuid import uuid4

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.sources.offenses import PARTITIONS

#: Steps an axis is cut into, as a power of two. Steps hold about equally many rows, wherever those crowd.
STEP_BITS = 8
#: Accuracy of the quantile sketches the steps are cut by.
ACCURACY = 10_000
#: Bits of the hash that cuts the rows of one step.
SPREAD_BITS = 15


def _cuts(rows: DataFrame, bits: int) -> dict[str, list[float]]:
    """The values that cut each column into steps: one aggregate, at most ``2 ** bits - 1`` numbers a column."""
    shares = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    found = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(c) for c in rows.columns]).first()
    return {c: sorted({v for v in found[c] or () if not math.isnan(v)}) for c in rows.columns}


def hilbert(df: DataFrame, name: str, first: str, second: str, bits: int) -> DataFrame:
    """The rows with their place on the Hilbert curve through a square of ``2 ** bits`` steps a side, under ``name``.

    Neighbours on the curve are neighbours in the square, so a stretch of it never spans the map, as one of interleaved
    digits does. The two columns hold the steps and are used up.
    """
    rows, last = df.withColumn(name, F.lit(0)), (1 << bits) - 1
    x, y = F.col(first), F.col(second)
    for i in reversed(range(bits)):
        right, upper = (F.shiftright(c, i).bitwiseAND(F.lit(1)) for c in (x, y))
        # Of a lower quarter, the curve is the whole one with its axes exchanged; on the right, also read from behind.
        lower, turned = upper == 0, (upper == 0) & (right == 1)
        rows = rows.withColumns(
            {
                name: F.col(name) + (right * 3).bitwiseXOR(upper) * (1 << 2 * i),
                first: F.when(turned, last - y).when(lower, y).otherwise(x),
                second: F.when(turned, last - x).when(lower, x).otherwise(y),
            }
        )
    return rows.drop(first, second)


def with_curve(df: DataFrame, name: str, cell: str = "h3_res8", time: str = "time", bits: int = STEP_BITS) -> DataFrame:
    """The rows with their place on the curve, an int below ``4 ** bits``. Rows without cell or time lie at the first step.

    Cells are taken by their number: cells inside one parent are neighbours in it, so parents of every resolution stay together.
    """
    a, b, out = (f"_{uuid4().hex}" for _ in range(3))
    axes = {a: F.col(cell).cast("double"), b: F.col(time).cast("timestamp").cast("double")}
    cuts = _cuts(df.select(*[v.alias(n) for n, v in axes.items()]), bits)
    rows = df
    for axis, value in axes.items():
        if not cuts[axis]:
            rows = rows.withColumn(axis, F.lit(0))
            continue
        splits = [-math.inf, *cuts[axis], math.inf]
        stepped = Bucketizer(splits=splits, inputCol=axis, outputCol=out).transform(
            rows.withColumn(axis, F.coalesce(value, F.lit(-math.inf)))
        )
        rows = stepped.withColumn(axis, F.col(out).cast("int")).drop(out)
    return hilbert(rows, name, a, b, bits)


def write_clustered(
    df: DataFrame,
    path: str,
    partitions: Sequence[str] = PARTITIONS,
    cell: str = "h3_res8",
    time: str = "time",
    spread: Sequence[str] = ("doc_source", "record_id"),
    files: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write the offense table so that files, row groups and pages cover little of the map and little of the time.

    Rows are range-partitioned by partition column, then by their place on the curve, then by a hash of ``spread``, which cuts
    even a single crowded place into several files; a hot database is many ranges. Readers need nothing but the minima and
    maxima that Parquet keeps: filters on any ``h3_res*`` column and on ``time`` skip what lies outside
    (:mod:`noticelake.session` sets the type of stored times that has them). ``files`` is the number
    of ranges, else the session's shuffle partitions, which adaptive execution merges. The input is read three times (for
    the steps, the ranges and the rows), so a derived table should be stored first. An empty table writes an empty table.
    """
    curve, place = (f"_{uuid4().hex}" for _ in range(2))
    # One long instead of two columns, since it moves with every row.
    hashed = F.pmod(F.xxhash64(*spread), F.lit(1 << SPREAD_BITS))
    rows = with_curve(df, curve, cell, time)
    rows = rows.withColumn(place, F.shiftleft(F.col(curve).cast("long"), SPREAD_BITS) + hashed).drop(curve)
    keys = [*partitions, place]
    ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).drop(place).write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
