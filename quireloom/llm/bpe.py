"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Defined results: a null or empty text has no tokens; repeated rows repeat; an
empty table gives an empty table; columns of the input that are called like an
output (``ids``, ``n_tokens``, ``decoded``) give way to it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quireloom.llm.common import add_columns, texts_of

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16

#: Places where a match of the splitting pattern always ends and the next one
#: begins, whatever stands further left or right: a match never runs from a
#: visible character into white space, nor between a letter and a digit.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~])(?=[ \n])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])")


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("quireloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = PIECE_CHARS):
    """Pieces of ``text`` that can be encoded one by one with the same result."""
    at = 0
    while len(text) - at > limit:
        found = SAFE.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode_text(encoding, text: str, limit: int = PIECE_CHARS) -> np.ndarray:
    """Token ids as little-endian unsigned 32-bit integers."""
    if not text:
        return np.empty(0, "<u4")
    parts = [encoding.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text, limit)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


IDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
DECODED = T.StructField("decoded", T.BinaryType())


def _encoded(encoding, texts: list[str]) -> list[pa.Array]:
    ids = [encode_text(encoding, t) for t in texts]
    return [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]


def _decoded(encoding, ids: pa.Array) -> pa.Array:
    return pa.array([encoding.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in ids.to_pylist()], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (packed little-endian unsigned 32-bit integers) and ``n_tokens``.

    Packed ids are what training shards store; ``unpack`` gives an array.
    """

    def make():
        encoding = load_encoding(path, pattern)
        return lambda batch: _encoded(encoding, texts_of(batch.column(text_col)))

    return add_columns(df, IDS, make, by=text_col, drop=() if keep_text else (text_col,))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the raw bytes of packed ids, which need not be valid UTF-8."""

    def make():
        encoding = load_encoding(path, pattern)
        return lambda batch: [_decoded(encoding, batch.column(ids_col))]

    return add_columns(df, [DECODED], make, by=ids_col)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``encode`` and then ``decode`` of its packed ids, by one Python worker instead of two."""

    def make():
        encoding = load_encoding(path, pattern)

        def kernel(batch):
            coded = _encoded(encoding, texts_of(batch.column(text_col)))
            return [*coded, _decoded(encoding, coded[0])]

        return kernel

    return add_columns(df, [*IDS, DECODED], make, by=text_col, drop=() if keep_text else (text_col,))


def unpack(df: DataFrame, ids_col: str = "ids", out: str = "token_ids") -> DataFrame:
    """Add ``out``: packed ids as an array of longs."""

    def make():
        def kernel(batch):
            return [pa.array([np.frombuffer(x or b"", "<u4").astype("i8") for x in batch.column(ids_col).to_pylist()], pa.list_(pa.int64()))]

        return kernel

    return add_columns(df, [T.StructField(out, T.ArrayType(T.LongType()))], make, by=ids_col)
