"""The corpus pipeline: toxicity, near copies, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.llm import bpe, mixing, secrets, simhash, toxicity
from quireloom.session import materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; the labels teach the score."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    return simhash.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return _documents(secrets.redact(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the source mix takes them."""
    return _documents(mixing.emit(mixing.mix(docs.select(*COLUMNS))))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its exact bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    raw = docs.select("doc_id", "source", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    coded = bpe.encode_and_decode(raw, path, pattern, keep_text=False)
    return coded.select("doc_id", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
    ("byte-level bpe", to_token_ids),
]

#: Learned scores and near copies have no SQL form; tests hold the rows of
#: run() against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
