"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.session import read_table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    pipeline = importlib.import_module("corpus_pipeline")
    return {**QUERIES, "pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = importlib.import_module("corpus_pipeline")
    return {**ORACLE, **({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quireloom.llm import bpe

    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.encode_and_decode(docs, path, pattern, keep_text=False)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import token_counts

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.add_token_counts(docs, tokenizer_file("byte_bpe_50k.json"), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import mixing

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

OP4_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(a, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(a, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES {rules}),
m AS (SELECT *, (SELECT max_by({{'rule': h || q, 'v': v}}, length(h || q) * 1000 + length(h)) FROM r
      WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS b FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM m
""".format(rules=", ".join(str(r) for r in URL_RULES))


@query("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import secrets

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, keep_text=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import simhash

    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import suffix_dedup

    cut = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_text=False)
    held_out = F.coalesce(toxicity.fold_of(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import nn_descent

    return nn_descent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op10_top_k", OP10_SQL)
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireloom.llm import mtree

    return mtree.top_k(read_table(spark, sf_dir, "embeddings"))
