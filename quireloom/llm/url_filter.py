"""URL filters by a sorted digest array.

Rules (host, path, verdict) become an array of sorted 64-bit xxhash keys of
``host + path``, with the full strings stored beside it.  Executors fetch the
file from shared storage once and memory-map it.  A batch of urls expands into
candidate strings (each suffix of the host at a label boundary with each prefix
of the path that has a rule's length), whose digests are probed by one
vectorised binary search; stored strings confirm the hits, so a collision of
digests cannot match.  The longest matching rule wins; of equally long ones,
that with the longer host.

The array is shipped whole only up to ``MOST_RULES`` rules and ``MOST_BYTES``;
a larger rule table is probed by a shuffle join on the same digests instead.

Defined results: of rules that repeat a host and path the greatest verdict in
string order holds, whichever way is taken; a rule whose host or path is null
fits nothing; one without a verdict counts only if no other has its host and
path, and then gives the verdict of urls without a rule; a null url, or one
without ``://``, has an empty host and path and matches nothing; repeated rows
repeat; an empty table gives an empty table; input columns named like outputs
give way to them.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.llm.common import add_columns
from quireloom.session import shared_dir

MOST_RULES, MOST_BYTES = 2_000_000, 128 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """The index file: counts, path lengths, sorted digests, offsets, host lengths, verdicts, strings."""
    import xxhash

    items = sorted((xxhash.xxh64_intdigest((h + p).encode()), h, p, v) for h, p, v in rules)  # each host and path once
    words = [(h + p).encode() for _, h, p, _ in items]
    verdicts = sorted({v for *_, v in items})
    lengths = sorted({len(p) for _, _, p, _ in items})
    head = "\n".join(verdicts).encode()
    n, blob = len(items), b"".join(words)
    return b"".join([
        struct.pack("<4q", n, len(lengths), len(head), len(blob)),
        np.array(lengths, "<i8").tobytes(),
        np.array([d for d, *_ in items], "<u8").tobytes(),
        np.cumsum([0, *map(len, words)]).astype("<i8").tobytes(),
        np.array([len(h) for _, h, _, _ in items], "<i4").tobytes(),
        np.array([verdicts.index(v) for *_, v in items], "<i4").tobytes(),
        head,
        blob,
    ])


class DigestArray:
    """A packed index, memory-mapped."""

    def __init__(self, file: str) -> None:
        raw = np.memmap(file, np.uint8, "r")
        n, k, head, blob = struct.unpack("<4q", raw[:32].tobytes())
        at = 32

        def take(count, kind):
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = raw[at : at + size].view(kind) if at % np.dtype(kind).itemsize == 0 else np.frombuffer(raw[at : at + size].tobytes(), kind)
            at += size
            return out

        self.lengths = take(k, "<i8").tolist()
        self.digests, self.offsets = take(n, "<u8"), take(n + 1, "<i8")
        self.hosts, self.verdict = take(n, "<i4"), take(n, "<i4")
        self.verdicts = take(head, np.uint8).tobytes().decode().split("\n")
        self.blob = take(blob, np.uint8)

    def match(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """For each url the winning rule's string and verdict, or None."""
        import xxhash

        owner, rank, words = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffixes, at = [host], host.find(".")
            while at >= 0:
                suffixes.append(host[at + 1 :])
                at = host.find(".", at + 1)
            for s in suffixes:
                if s:
                    for k in self.lengths:
                        if k <= len(path):
                            owner.append(i)
                            rank.append((len(s) + k, len(s)))
                            words.append((s + path[:k]).encode())
        out: list = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        place = np.searchsorted(self.digests, keys)
        place[place == len(self.digests)] = 0
        for c in np.flatnonzero(self.digests[place] == keys) if len(self.digests) else ():
            # equal digests stand side by side: each stored string is compared
            j = int(place[c])
            while j < len(self.digests) and self.digests[j] == keys[c]:
                stored = self.blob[self.offsets[j] : self.offsets[j + 1]].tobytes()
                if stored == words[c] and len(stored[: self.hosts[j]].decode(errors="replace")) == self.hosts[j] == rank[c][1]:
                    if rank[c] > best[owner[c]]:
                        best[owner[c]], out[owner[c]] = rank[c], (stored.decode(), self.verdicts[self.verdict[j]])
                j += 1
        return out


def ship(spark: SparkSession, packed: bytes) -> str:
    """Put the index into shared storage and have executors fetch it; returns its name."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(packed))
    finally:
        out.close()
    spark.sparkContext.addFile(target.toString())
    return name


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``df``."""
    spark = df.sparkSession
    df = df.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    # repeated rules are resolved here, before either way is taken
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.coalesce(F.max("verdict"), F.lit(otherwise)).alias("verdict"))
    size = rules.agg(F.count("*"), F.sum(F.octet_length("host") + F.octet_length("path"))).first()
    if size[0] > MOST_RULES or (size[1] or 0) > MOST_BYTES:
        return judge_by_join(df, rules, otherwise)
    name = ship(spark, pack([tuple(r) for r in rules.select("host", "path", "verdict").collect()]))

    def make():
        index = DigestArray(SparkFiles.get(name))

        def kernel(batch):
            found = index.match(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            return [pa.array([x and x[0] for x in found], pa.string()), pa.array([x[1] if x else otherwise for x in found], pa.string())]

        return kernel

    return add_columns(df, [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())], make, by=url_col)


def judge_by_join(df: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """The same for distinct rules in any number: candidates meet rules by digest in a shuffle join.

    The join carries distinct (host, path) pairs, not rows, so that a page
    repeated many times is probed once.
    """
    rules = rules.select("host", "path", F.col("verdict").alias("v")).withColumn("digest", F.xxhash64(F.concat("host", "path")))
    pairs = df.select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    # hosts meet the lengths of their rules' paths first, so a url is tried with those lengths only
    lengths = rules.groupBy(F.col("host").alias("s")).agg(F.collect_set(F.length("path")).alias("lengths"))
    each = pairs.select("h", "p", suffix.alias("s")).where("s <> ''").join(lengths, "s").select("h", "p", "s", F.explode("lengths").alias("k")).where("k <= length(p)")
    each = each.withColumn("q", F.expr("substring(p, 1, k)")).withColumn("digest", F.xxhash64(F.concat("s", "q")))
    hit = each.join(rules, (each.digest == rules.digest) & (each.s == rules.host) & (each.q == rules.path))
    best = hit.groupBy("h", "p").agg(F.max(F.struct(F.length(F.concat("s", "q")), F.length("s"), F.concat("s", "q").alias("rule"), F.col("v"))).alias("b"))
    out = df.drop(*[c for c in df.columns if c.lower() in ("rule", "verdict")]).join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.withColumn("rule", F.col("b.rule")).withColumn("verdict", F.coalesce("b.v", F.lit(otherwise))).drop("h", "p", "b")
