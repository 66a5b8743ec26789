"""Table candidates: statistics, validity and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions.text import markdown

MIN_FILL, MIN_LENGTH, MIN_ALPHA = 0.3, 4, 0.2


def table_stats(cells: DataFrame, table: list[str], row: str = "row_key", col: str = "col_no", cell: str = "cell") -> DataFrame:
    """Per table: rows, width of the first row, and ratios over its cells.

    A cell is filled unless null or empty; white space alone fills it.
    """
    first = F.min(F.col(row)).over(Window.partitionBy(*table))
    filled = F.coalesce(F.col(cell), F.lit("")) != ""
    rows = cells.withColumn("__first", F.col(row) == first)
    return rows.groupBy(*table).agg(
        F.count_distinct(row).cast("int").alias("n_rows"),
        F.sum(F.col("__first").cast("int")).cast("int").alias("first_width"),
        F.avg(filled.cast("double")).alias("fill_ratio"),
        F.avg(F.when(filled, F.length(cell))).alias("avg_len"),
        F.avg(F.when(filled, F.col(cell).rlike(r"\p{L}").cast("double"))).alias("alpha_ratio"),
    )


def is_real():
    return F.coalesce((F.col("n_rows") >= 2) & (F.col("first_width") >= 2) & (F.col("fill_ratio") >= MIN_FILL) & (F.col("avg_len") >= MIN_LENGTH) & (F.col("alpha_ratio") >= MIN_ALPHA), F.lit(False))


def table_rows(cells: DataFrame, table: list[str], row: str = "row_key", col: str = "col_no", cell: str = "cell") -> DataFrame:
    """Cells gathered to (table, rows array<array<string>>), in order."""
    lines = cells.groupBy(*table, row).agg(F.sort_array(F.collect_list(F.struct(col, cell))).alias("c"))
    lines = lines.select(*table, row, F.transform("c", lambda x: x[cell]).alias("c"))
    whole = lines.groupBy(*table).agg(F.sort_array(F.collect_list(F.struct(row, "c"))).alias("r"))
    return whole.select(*table, F.transform("r", lambda x: x["c"]).alias("rows"))


def find_real_tables(cells: DataFrame, boxes: DataFrame, table: list[str]) -> DataFrame:
    """Valid tables with their box and Markdown: one filter decides both exclusion and emission."""
    real = table_stats(cells, table).where(is_real()).select(*table)
    text = table_rows(cells.join(real, table, "left_semi"), table).select(*table, markdown(F.col("rows")).alias("markdown"))
    return boxes.join(text, table)
