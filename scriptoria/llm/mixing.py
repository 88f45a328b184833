"""Mixing sources to target weights by packed blocks.

The words of a source's documents, laid end to end in a pseudorandom document order, are cut into
blocks of ``BLOCK_WORDS``. A source's target, in words, gives the number of slots that it
fills. Slots are dealt to output shards: a source's counts over the shards are a multinomial draw of its slots, made by halving the range of shards, each half
getting a binomial share, so that any executor finds the shards of any range of slots by itself in log2(shards) steps. Shards hold ``SHARD_SLOTS``
slots on average. Slot j of a source
reads block P(j mod blocks), P being that source's own permutation for the epoch j div blocks: a keyed
Feistel network walked until it stays among the blocks. The drawn slots are joined to the blocks by index.

No target is above ``MAX_REPEATS`` times its source, so no block is taken more often than that.
Everything is keyed by ``seed``; reruns agree. Sources are rows of a table throughout, however many there are; only sums over all of them reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, pick, stored, table, words

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
BUCKET_DOCS = 1000
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Slots that are drawn together.
DRAW_SLOTS = 1 << 16


def in_rank(rows: DataFrame) -> DataFrame:
    """Sources (src, source, n) with rank, from 0, by code point and null last. Only the sizes of range partitions are summed in one place."""
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "mix_ranges")
    base = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("inside", inside).join(base, "part").withColumn("rank", F.col("base") + F.col("inside") - 1).drop("part", "base", "inside")


def targeted(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Sources (src, source, n words, ...) with target, the words to take: all words shared by weight; a target stops at most times its source and its excess is shared again.

    All targets below their limit are one level times their weight; the level rises until none is above. Sums over all sources reach the driver.
    """
    rows = stored(in_rank(sources).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "mix_weights")
    total = rows.agg(F.sum("n")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(most) * F.col("n") < F.col("w") * level
        at = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, most * F.col("n")).otherwise(0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if at.full == full or not at.open:
            break
        level, full = (total - at.held) / at.open, at.full
    return rows.withColumn("target", F.least(F.lit(float(most)) * F.col("n"), F.col("w") * level)).drop("w", "rank")


def _seed(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)))


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, keyed, applied to the positions at."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_seed(key, r)) for r in range(4)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(33)) & mask)
        return (left << np.uint64(half)) | right

    out = once(at.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def shards_of(first: int, last: int, total: int, shards: int, key: int) -> np.ndarray:
    """The shards of the slots first to last - 1 of a source of total slots: shard s holds the slots after those of the shards before it, as many as the draw gives it."""
    out = np.empty(last - first, np.int64)
    todo = [(0, shards, 0, total)]  # a range of shards, and the slots that it holds
    while todo:
        lo, hi, a, b = todo.pop()
        if b <= first or a >= last:
            continue
        if hi - lo == 1:
            out[max(a, first) - first : min(b, last) - first] = lo
            continue
        mid = (lo + hi) // 2
        left = a + int(np.random.Generator(np.random.Philox(key=_seed(key, lo, hi))).binomial(b - a, (mid - lo) / (hi - lo)))
        todo += [(lo, mid, a, left), (mid, hi, left, b)]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, a fingerprint of the text and the source's key, which is never null."""
    return pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64("text").alias("fp"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("src"),
    )


def laid_out(rows: DataFrame) -> DataFrame:
    """rows with off, the words before a document in its source. Sums run over buckets of about BUCKET_DOCS documents and over groups of BUCKET_DOCS buckets first, so a source meets in one task as one row for each million of all documents."""
    n = rows.count()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "fp"), F.lit(max(1, -(-n // BUCKET_DOCS)))))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda w, over: F.coalesce(F.sum(w).over(over), F.lit(0))
    buckets = stored(rows.groupBy("src", "bucket").agg(F.sum("size").alias("w")).withColumn("group", F.floor(F.col("bucket") / BUCKET_DOCS)), "mix_buckets")
    groups = buckets.groupBy("src", "group").agg(F.sum("w").alias("w")).select("src", "group", summed("w", before(["src"], ["group"])).alias("base"))
    base = buckets.withColumn("part", summed("w", before(["src", "group"], ["bucket"]))).join(groups, ["src", "group"]).select("src", "bucket", (F.col("base") + F.col("part")).alias("base"))
    rows = rows.withColumn("inner", summed("size", before(["src", "bucket"], ["doc_id", "fp"])))
    return rows.join(base, ["src", "bucket"]).withColumn("off", F.col("base") + F.col("inner")).drop("bucket", "base", "inner")


def drawn_slots(sources: DataFrame, seed: int = 0, block: int = BLOCK_WORDS) -> DataFrame:
    """Every slot of the mix from sources (src, n words, target): shard, place (a pseudorandom number that orders a shard's slots), src and the block's idx."""
    blocks = F.ceil(F.col("n") / block)
    slots = F.least(F.lit(MAX_REPEATS) * blocks, F.round(F.col("target") * blocks / F.col("n")).cast("long"))
    known = stored(sources.where("n > 0").select("src", blocks.alias("blocks"), slots.alias("slots")).where("slots > 0"), "mix_slots")
    total = known.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // SHARD_SLOTS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for src, blocks, slots, go in b.itertuples(index=False):
                j = np.arange(go * DRAW_SLOTS, min(slots, (go + 1) * DRAW_SLOTS))
                idx = np.empty(len(j), np.int64)
                for epoch in np.unique(j // blocks):
                    own = j // blocks == epoch
                    idx[own] = permuted(j[own] % blocks, int(blocks), _seed(seed, src, epoch))
                shard = shards_of(int(j[0]), int(j[-1]) + 1, int(slots), shards, _seed(seed, src))
                yield pd.DataFrame({"shard": shard, "place": permuted(j, 1 << 62, _seed(seed, src, "place")), "src": src, "idx": idx})

    goes = known.select("src", "blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / DRAW_SLOTS))).alias("go"))
    tasks = max(1, min(-(-total // DRAW_SLOTS), 10_000))
    return goes.repartition(tasks, "src", "go").mapInPandas(run, "shard long, place long, src string, idx long")


def mixed(docs: DataFrame, seed: int = 0, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): every document with size, source_size, target, off; and, for each document of at least one word
    and each of its blocks, the words it has there (own), from its word first on, and how often the mix takes them (times).

    Null and empty texts have size 0 and are never taken. Rows that repeat count each. A null source is
    a source of its own, the last. An empty table gives empty results.
    """
    rows = stored(laid_out(stored(sized(docs), "mix_sizes")), "mix_rows")
    sources = stored(targeted(rows.groupBy("src", "source").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))), "mix_sources")
    taken = drawn_slots(sources, seed, block).groupBy("src", "idx").agg(F.count("*").alias("times"))
    rows = hot_join(rows, sources.select("src", F.col("n").alias("source_size"), "target", F.col("docs").alias("n")), "src")
    parts = rows.where("size > 0").select(
        "src", "doc_id", "fp", "off", "size", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))).alias("idx")
    )
    start, end = F.greatest("off", F.col("idx") * block), F.least(F.col("off") + F.col("size"), (F.col("idx") + 1) * block)
    pieces = parts.select("src", "doc_id", "fp", "off", "size", "idx", (start - F.col("off")).alias("first"), (end - start).alias("own"))
    return rows, pieces.join(taken.hint("merge"), ["src", "idx"])  # the planner takes what mapInPandas makes to be as small as its input


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, taken."""
    rows, pieces = mixed(docs, seed)
    taken = pieces.groupBy("src", "off", "size").agg(F.sum(F.col("own") * F.col("times")).alias("taken"))
    return (
        rows.join(taken, ["src", "off", "size"], "left")
        .select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
