"""Key figures of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.cells import cell_hex
from noticelake.operators.predicates import Predicates, apply_predicates, dimension_column
from noticelake.schema import ARRAY_DIMENSIONS, CELL_RESOLUTIONS


def summary(df: DataFrame, preds: Predicates | None = None, dim: str | None = None) -> DataFrame:
    """Count, sum and mean of ``ur`` and the range of every cell column, in total or per value of ``dim``.

    Per database, also the number of documents and the latest publication date. One partial/final aggregation.
    """
    if dim in (*ARRAY_DIMENSIONS, "features"):
        raise ValueError(f"no summary by {dim}")
    measures = [
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum("ur"), F.lit(0)).alias("ur_total"),
        F.coalesce(F.avg("ur"), F.lit(0.0)).alias("ur_avg"),
    ]
    if dim == "database":
        measures += [
            F.countDistinct("doc_source").alias("doc_count"),
            F.max("doc_date").alias("last_doc_date"),
        ]
    for r in CELL_RESOLUTIONS:
        measures += [F.min(f"h3_res{r}").alias(f"min_h3_{r}"), F.max(f"h3_res{r}").alias(f"max_h3_{r}")]
    selected = apply_predicates(df, preds)
    if dim is None:
        return selected.agg(*measures)
    return (
        selected.groupBy(dimension_column(dim).alias("value"))
        .agg(*measures)
        .orderBy(F.col("value").asc_nulls_last())
    )


def viewport_cell(summary_df: DataFrame) -> DataFrame:
    """Add ``viewport_h3_index``: the finest of cells 8…2 all records share; at 2 the lowest cell regardless."""
    choices = [
        F.when(F.col(f"min_h3_{r}") == F.col(f"max_h3_{r}"), F.col(f"min_h3_{r}"))
        for r in sorted(CELL_RESOLUTIONS, reverse=True)
        if r > 2
    ]
    return summary_df.withColumn("viewport_h3_index", cell_hex(F.coalesce(*choices, F.col("min_h3_2"))))
