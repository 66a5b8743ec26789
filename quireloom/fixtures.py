"""Page primitives derived from the supplied tables, as SQL that Spark and DuckDB read alike.

The tables hold no PDFs; these views stand for what a PDF reader would emit.
``spark_view`` gives a DataFrame, ``cte`` the same rows for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {array:...} stands for an array literal of either dialect.
VIEWS: dict[str, str] = {
    "fx_paras": """SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS doc_key, CAST(o_orderkey % 40 AS INT) AS pos,
        o_orderpriority || CASE WHEN o_custkey % 3 = 0 THEN '.' ELSE '' END AS text FROM orders""",
    "fx_pages": "SELECT DISTINCT CAST(floor(o_orderkey / 8) AS BIGINT) AS page_key FROM orders",
    "fx_blocks": """SELECT page_key, block_no, x0, y0, x0 + 120 + w AS x1, y0 + 40 + h AS y1, text FROM (
        SELECT CAST(floor(o_orderkey / 8) AS BIGINT) AS page_key, CAST(o_orderkey % 8 AS INT) AS block_no,
        CAST(36 + (o_custkey % 5) * 60 AS DOUBLE) AS x0, CAST(36 + (o_orderkey % 8) * 90 AS DOUBLE) AS y0,
        CAST((o_custkey % 7) * 20 AS DOUBLE) AS w, CAST((o_custkey % 3) * 20 AS DOUBLE) AS h,
        CASE WHEN o_custkey % 11 = 0 THEN '' ELSE o_orderpriority || CASE WHEN o_custkey % 3 = 0 THEN '.' ELSE '' END END AS text FROM orders) b""",
    "fx_lines_of": """SELECT *, CAST(floor(l_orderkey / 8) AS BIGINT) AS page_key,
        CASE WHEN CAST(floor(l_orderkey / 8) AS BIGINT) % 10 = 0 THEN 5 WHEN CAST(floor(l_orderkey / 8) AS BIGINT) % 10 < 4 THEN 3 ELSE 1 END AS sc FROM lineitem""",
    "fx_drawings": """SELECT page_key, CAST(row_number() OVER (PARTITION BY page_key ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS draw_no,
        CAST((l_partkey * 37) % 560 AS DOUBLE) AS x0, CAST((l_suppkey * 53) % 740 AS DOUBLE) AS y0,
        least(CAST(612 AS DOUBLE), CAST((l_partkey * 37) % 560 AS DOUBLE) + CAST(l_quantity AS DOUBLE) * sc) AS x1,
        least(CAST(792 AS DOUBLE), CAST((l_suppkey * 53) % 740 AS DOUBLE) + CAST((l_partkey % 4) * 10 * sc AS DOUBLE)) AS y1,
        CAST(1 + (l_linenumber - 1) % 3 AS INT) AS n_items,
        CASE WHEN l_partkey % 5 = 0 THEN {array:0.8,0.1,0.1} WHEN l_partkey % 5 = 1 THEN {array:0.5,0.5,0.5} END AS fill,
        CASE WHEN l_linenumber % 2 = 0 THEN 's' ELSE 'f' END AS type, l_partkey, l_linenumber FROM fx_lines_of""",
    "fx_images": """SELECT page_key, CASE WHEN k = 1 THEN draw_no + 1000 ELSE draw_no END AS img_no,
        CASE WHEN l_partkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE x0 END AS x0, CASE WHEN l_partkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE y0 END AS y0,
        CASE WHEN l_partkey % 97 = 0 THEN CAST(612 AS DOUBLE) ELSE x1 END AS x1, CASE WHEN l_partkey % 97 = 0 THEN CAST(792 AS DOUBLE) ELSE y1 END AS y1
        FROM fx_drawings CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) z WHERE l_linenumber <= 3 AND (k = 0 OR l_partkey % 4 = 0)""",
    "fx_cells": """SELECT o_custkey AS table_key, o_orderkey AS row_key, CAST(c AS INT) AS col_no,
        CASE WHEN o_custkey % 5 = 0 THEN CASE WHEN c = 0 THEN CAST(o_orderkey % 10 AS VARCHAR(20)) END
             WHEN c = 0 THEN o_orderstatus
             WHEN c = 1 THEN CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END
             WHEN o_orderkey % 6 = 0 THEN 'a' || chr(10) || 'b|c' ELSE CAST(o_orderkey AS VARCHAR(20)) END AS cell
        FROM orders CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 AS c UNION ALL SELECT 2 AS c) z WHERE c = 0 OR o_custkey % 13 <> 0""",
    "fx_boxes": """SELECT DISTINCT o_custkey AS table_key, CAST(floor(o_custkey / 4) AS BIGINT) AS page_key, CAST(36 AS DOUBLE) AS x0, CAST(36 + (o_custkey % 4) * 180 AS DOUBLE) AS y0,
        CAST(576 AS DOUBLE) AS x1, CAST(36 + (o_custkey % 4) * 180 + 150 AS DOUBLE) AS y1 FROM orders""",
}
TABLES = ("orders", "lineitem", "documents", "embeddings")


def _dialect(sql: str, spark: bool) -> str:
    import re

    return re.sub(r"\{array:([^}]*)\}", lambda m: f"array({','.join(f'CAST({x} AS DOUBLE)' for x in m[1].split(','))})" if spark else f"CAST([{m[1]}] AS DOUBLE[])", sql)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, with the fixtures and tables that it names bound as DataFrames."""
    sql, given = _dialect(VIEWS[name], True), {}
    for other in (*TABLES, *VIEWS):
        if f"FROM {other}" in sql:
            sql = sql.replace(f"FROM {other}", f"FROM {{{other}}}")
            given[other] = spark_view(spark, sf_dir, other) if other in VIEWS else spark.read.parquet(f"{sf_dir}/{other}.parquet")
    return spark.sql(sql, **given)


def cte(*names: str) -> str:
    """``name AS (...)`` of the fixtures and of those they name, in order."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and f"FROM {other}" in VIEWS[name]:
                add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({_dialect(VIEWS[n], False)})" for n in need)
