"""An index that grows as documents arrive.

An extension: new files of a folder become chunks and vectors, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quireloom.functions import text as t
from quireloom.plans import models


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def index_stream(documents: DataFrame, target: str, checkpoint: str, size: int = 800, overlap: int = 100, encode=models.hashed_embeddings) -> StreamingQuery:
    """Write (doc_id, ord, text, embedding) of each new document below ``target``, one folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so no
    chunk is there twice.
    """
    chunks = documents.select("doc_id", F.posexplode(t.chunk_paragraph(F.col("text"), size, overlap)).alias("ord", "text"))

    def write(batch: DataFrame, epoch: int) -> None:
        models.embed(batch, "text", encode).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
