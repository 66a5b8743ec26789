"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a hash of their id.  The mix takes a
source's blocks in permuted order, whole passes first, until the source's target
is met; the last block is cut short, within a document if need be, so that the
words taken are the rounded target exactly.  The draws of all sources are split
among the output shards by a binary tree: at each node the left half's share of
the draws is one multivariate-hypergeometric sample of what is left of every
source, so all quotas stay exact and every shard is a fair sample.  A shard finds
its own path from the root by seeds that the nodes name, so no task sees more
than one row for each source.  Offsets along the path make the draws of
different shards disjoint; within a shard, draws are in hashed order.

Defined results: a null source is a source of its own, last in order; a null or
empty text has size 0 and is never taken; repeated rows count as often as they
stand there (which of several rows with one id and size is cut short is not
defined, that one is is); an empty table gives an empty table; input columns
named like outputs give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.session import materialize, ship_package

#: Words are maximal runs of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Expected documents of a block; very large sources get larger blocks instead of more.
BLOCK_DOCS, MOST_BLOCKS = 128, 1 << 20
#: Words that an output shard should hold.
SHARD_WORDS = 1 << 20
#: Draws from which on counts are split by the normal law, which then errs by far less than one in the count's root.
MOST_COUNT = 10**9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_times: float) -> DataFrame:
    """``target`` for each row (src, source_size): shares by weight, cut at ``most_times`` the size.

    The fair level is where the capped shares add up to the total: sources in
    order of cap over weight fill up one after another, and the first that the
    level does not fill, with all behind it, shares the rest by weight.  One row
    for each source is all that these windows see.
    """
    order = Window.orderBy("src")
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    everything = Window.partitionBy()
    fill = Window.orderBy((F.col("source_size") / F.col("w")), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("source_size").over(fill), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(fill), F.lit(0.0)).alias("w_before"),
    )
    rest = share * F.col("all_size") - most_times * F.col("size_before")
    level = level.withColumn("level", F.greatest(rest, F.lit(0.0)) / (F.col("all_w") - F.col("w_before")))
    # the first source, in the filling order, whose cap the level does not reach
    level = level.withColumn("open", F.col("level") * F.col("w") <= most_times * F.col("source_size"))
    level = level.withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("w")).alias("a"), F.col("src").alias("b"), F.col("level").alias("v")))).over(everything)["v"])
    cap = most_times * F.col("source_size")
    return level.select("src", "source_size", F.when(F.col("final").isNull(), cap).otherwise(F.least(cap, F.col("final") * F.col("w"))).alias("target"))


def hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws are good; numpy's own sampler up to its limit, beyond it the rounded normal law."""
    if good + bad < MOST_COUNT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    every = good + bad
    mean, spread = n * (good / every), (n * (good / every) * (bad / every) * ((every - n) / (every - 1))) ** 0.5
    return min(n, good, max(0, n - bad, round(mean + spread * float(rng.standard_normal()))))


def split(rng, counts, take: int):
    """The left half's draws of each source: exact in total, never more than there are."""
    import numpy as np

    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, take)
        take -= int(out[i])
        if not take:
            break
    return out


def _shard_draws(quotas: list[tuple[int, int]], n_shards: int, seed: int):
    """For each shard: rows (source number, shard, first draw, draws)."""
    import numpy as np

    counts0 = np.array([q for _, q in quotas], np.int64)
    total = int(counts0.sum())

    def run(batches):
        import pandas as pd

        for batch in batches:
            for shard in batch["id"].tolist():
                lo, hi, counts, offset = 0, n_shards, counts0, np.zeros(len(counts0), np.int64)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    take = mid * total // n_shards - lo * total // n_shards
                    rng = np.random.default_rng([seed, lo, hi])
                    left = split(rng, counts, take)
                    if shard < mid:
                        hi, counts = mid, left
                    else:
                        lo, counts, offset = mid, counts - left, offset + left
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"no": np.array([quotas[i][0] for i in some], np.int64), "shard": shard, "first": offset[some], "draws": counts[some]})

    return run


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_times: float = 2.0, shard_words: int = SHARD_WORDS, seed: int = 17, keep_text: bool = True) -> DataFrame:
    """``df``, without the text if that is not kept, with ``size``, ``source_size``, ``target``, ``draws`` and ``taken``.

    ``draws`` lists, for each time that the document is drawn, its output shard,
    its place there (``slot`` for the block, ``at`` for the document within it)
    and how many of its leading words are taken.  ``taken`` adds these up.
    """
    spark = df.sparkSession
    ship_package(spark)
    own = ["size", "source_size", "target", "draws", "taken", "src", "block", "no"]
    rows = df.drop(*[c for c in df.columns if c.lower() in own and c not in (text_col, id_col, source_col)])
    src = F.struct(F.col(source_col).isNull().alias("missing"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    rows = rows.withColumn("size", n_words(F.col(text_col))).withColumn("src", src)
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), F.col(id_col), F.col("size")))
    if keep_text:
        slim = materialize(rows.select("src", "key", "size"), "mix-rows")
    else:  # words are counted once, and texts are not read again
        slim = rows = materialize(rows.drop(text_col), "mix-rows")

    # one row for each source: sizes, targets, number of blocks
    sizes = slim.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = materialize(sizes, "mix-sizes")
    blocks_of = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long")
    sources = source_targets(sizes.select("src", "source_size"), weights, share, most_times).join(sizes.select("src", blocks_of.alias("n_blocks")), "src")
    sources = materialize(sources.withColumn("no", F.row_number().over(Window.orderBy("src")).cast("long")), "mix-sources")

    # one row for each block and pass: its place in the permuted order and the words it gives.
    # Hashed blocks spread a source evenly over the tasks, whatever its share of the rows.
    dealt = rows.join(sources, "src").withColumn("block", F.pmod("key", F.col("n_blocks")))
    words = slim.join(sources.select("src", "n_blocks", "no"), "src").groupBy("no", F.pmod("key", F.col("n_blocks")).alias("block")).agg(F.sum("size").alias("words"))
    passes = int(-(-most_times // 1))
    in_order = Window.partitionBy("no", "turn").orderBy(F.xxhash64(F.lit(seed), "no", "turn", "block"), "block")
    one = words.where("words > 0").select("*", F.explode(F.array(*[F.lit(p) for p in range(passes)])).alias("turn"))
    one = one.join(sources.select("no", "source_size", "target"), "no")
    one = one.withColumn("before", F.sum("words").over(in_order) - F.col("words") + F.col("turn") * F.col("source_size"))
    one = one.withColumn("rank", F.row_number().over(in_order) - 1)
    one = one.withColumn("gives", F.least(F.col("words"), F.round("target").cast("long") - F.col("before"))).where("gives > 0")
    width = Window.partitionBy("no", "turn")
    drawn = one.select("no", "block", "turn", "rank", "gives", F.max(F.col("rank") + 1).over(width).alias("in_turn"))
    drawn = materialize(drawn, "mix-drawn")

    # the tree: draws of each source are numbered, pass after pass
    turns = drawn.groupBy("no", "turn").agg(F.count("*").alias("n"))
    ahead = turns.select("no", "turn", (F.sum("n").over(Window.partitionBy("no").orderBy("turn")) - F.col("n")).alias("ahead"))
    quotas = [(r["no"], r["q"]) for r in turns.groupBy("no").agg(F.sum("n").alias("q")).orderBy("no").collect()]  # one row for each source
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n_shards = max(1, int(-(-total // shard_words)))
    leaves = spark.range(n_shards).mapInPandas(_shard_draws(quotas, n_shards, seed), "no long, shard long, first long, draws long") if quotas else spark.createDataFrame([], "no long, shard long, first long, draws long")
    seats = leaves.select("no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1)).alias("seat"))
    drawn = drawn.join(ahead, ["no", "turn"]).withColumn("seat", F.col("ahead") + F.col("rank"))
    drawn = drawn.join(seats, ["no", "seat"]).withColumn("slot", F.xxhash64(F.lit(seed), "shard", "no", "seat"))
    by_block = drawn.groupBy("no", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "shard", "slot", "gives"))).alias("given"))  # one for each pass at most

    inside = Window.partitionBy("no", "block").orderBy("key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(by_block, ["no", "block"], "left")
    cut = F.transform("given", lambda g: F.struct(g["shard"].alias("shard"), g["slot"].alias("slot"), F.col("at").alias("at"), F.greatest(F.lit(0), F.least(F.col("size"), g["gives"] - F.col("at"))).cast("long").alias("words")))
    draws = F.coalesce(F.filter(cut, lambda d: d["words"] > 0), F.expr("cast(array() as array<struct<shard:bigint,slot:bigint,at:bigint,words:bigint>>)"))
    out = placed.withColumn("draws", draws)
    out = out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"]))
    return out.drop("src", "key", "no", "block", "n_blocks", "at", "given")


def cut_words(text: Column, words: Column) -> Column:
    """The first ``words`` words, one space between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: one row for each draw, with ``shard``, ``slot``, ``at`` and the words taken."""
    rows = mixed.withColumn("draw", F.explode("draws"))
    whole = F.col("draw.words") >= F.col("size")
    rows = rows.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut_words(F.col(text_col), F.col("draw.words"))))
    return rows.select(*[c for c in mixed.columns if c not in ("draws", "taken", "size", "source_size", "target")], "draw.shard", "draw.slot", "draw.at")

