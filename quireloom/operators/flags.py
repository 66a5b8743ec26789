"""What a page holds, as one row of flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireloom.functions import geometry as g


def has_visual_content(pages: DataFrame, images: DataFrame, page: list[str]) -> DataFrame:
    n = images.groupBy(*page).agg(F.count("*").alias("n_images"))
    return pages.join(n, page, "left").select(*page, (F.coalesce("n_images", F.lit(0)) > 0).alias("has_visual_content"))


def has_drawing(pages: DataFrame, drawings: DataFrame, page: list[str], min_items: int = 4) -> DataFrame:
    n = drawings.groupBy(*page).agg(F.count("*").alias("n"))
    return pages.join(n, page, "left").select(*page, (F.coalesce("n", F.lit(0)) > min_items).alias("has_drawing"))


def has_chart_like_drawing(pages: DataFrame, drawings: DataFrame, page: list[str], min_items: int = 2) -> DataFrame:
    found = drawings.groupBy(*page).agg(F.max("n_items").alias("items"), F.bool_or(g.is_chromatic(F.col("fill"))).alias("hue"))
    flag = (F.coalesce("items", F.lit(0)) >= min_items) | F.coalesce("hue", F.lit(False))
    return pages.join(found, page, "left").select(*page, flag.alias("has_chart_like_drawing"))


def has_table(pages: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """Any table candidate, valid or not."""
    n = tables.groupBy(*page).agg(F.count("*").alias("n"))
    return pages.join(n, page, "left").select(*page, (F.coalesce("n", F.lit(0)) > 0).alias("has_table"))


def drawing_diagnostics(drawings: DataFrame) -> DataFrame:
    return drawings.select("type", "fill", "n_items")
