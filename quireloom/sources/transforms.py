"""Document-level transforms of page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions.geometry import PAGE


def merge_documents(pages: DataFrame, source: str, page_no: str = "page_no") -> DataFrame:
    """One document of all pages: sources in order, pages numbered anew.

    Offsets come from one row for each source; numbering within a source stays
    parallel.
    """
    counts = pages.groupBy(source).agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(source).orderBy(page_no)) - 1
    return pages.withColumn("__within", within).join(offsets, source).withColumn(page_no, (F.col("__before") + F.col("__within")).cast("int")).drop("__within", "__before")


def rasterise_first_page(pages: DataFrame, doc: list[str], page_no: str = "page_no") -> DataFrame:
    """The first page of each document as a picture: no text, one image that fills it."""
    first = pages.groupBy(*doc).agg(F.min(page_no).alias(page_no))
    return first.select(*doc, page_no, F.lit("").alias("text"), *[F.lit(float(v)).alias(n) for v, n in zip(PAGE, ("x0", "y0", "x1", "y1"), strict=True)])
