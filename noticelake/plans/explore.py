"""One selection, asked for everything an exploration page shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from noticelake.operators import facets, listing, maps, summary, timeseries
from noticelake.operators.predicates import Predicates


class OffenseQuery:
    """A lazily filtered offense table."""

    def __init__(self, df: DataFrame, preds: Predicates | None = None) -> None:
        self.df = df
        self.preds = dict(preds or {})

    def where(self, preds: Predicates) -> OffenseQuery:
        return OffenseQuery(self.df, {**self.preds, **preds})

    def page(self, page: int = 1, limit: int | None = None, after: dict | None = None) -> DataFrame:
        return listing.list_offenses(self.df, self.preds, page=page, limit=limit, after=after)

    def page_info(self, page: int = 1, limit: int | None = None) -> DataFrame:
        size = listing.page_size(listing.sort_mode(self.preds), limit)
        return listing.page_info(self.df, self.preds, page, size)

    def documents(self, page: int = 1, limit: int = listing.DOCUMENTS_PAGE_SIZE) -> DataFrame:
        return listing.list_documents(self.df, self.preds, page, limit)

    def summary(self, dim: str | None = None) -> DataFrame:
        return summary.viewport_cell(summary.summary(self.df, self.preds, dim))

    def facets(self, dims: Sequence[str], **options) -> DataFrame:
        return facets.facets(self.df, self.preds, dims, **options)

    def charts(self, group: str | None = None) -> dict[str, DataFrame]:
        return {
            "day_of_year": timeseries.by_day_of_year(self.df, self.preds, group),
            "day_of_week": timeseries.by_day_of_week(self.df, self.preds, group),
            "time_of_day": timeseries.by_time_of_day(self.df, self.preds, group),
        }

    def clusters(self, cell: int | str) -> DataFrame:
        return maps.map_clusters(self.df, self.preds, cell)
