"""N-gram Jaccard join by a MinHash LSH forest.

Texts of equal shingle sets are one node from the start, however many copies there are. A node has TREES labels of DEPTH
MinHash values; a tree is the trie of its labels. Nodes that share a prefix of a label, a trie node, are candidates. The
forest is first matched at whole labels; candidate pairs are verified by their exact Jaccard similarity, and from the similarities of
the links found, the recall is estimated that each shorter prefix would have. Prefixes are shortened, and what meets
newly is verified, until the estimate reaches TARGET.

Pairs whose signatures agree in fewer than FLOOR of all places are put aside first: of 144 places a pair at the threshold agrees
in fewer with probability 1e-8; a floor of 0 verifies all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup as N
from .common import bit_set, has_bit, hot_join, kernel_starts, pick, sliced, stored, table

TREES, DEPTH, TARGET = 24, 6, 0.99999
FLOOR = 0.6
VALUES = TREES * DEPTH
#: Bits for each text that is to be verified, and the most that there are of them (8 MB), in the set that keeps other texts out of the shuffle.
TEXT_BITS, MAX_BITS = 16, 26


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel_starts("shingles")
    for some in sliced(batches, N.TEXTS):
        sets = [N.shingles(t or "") for t in some.column(2).to_pylist()]
        full = [s for s in sets if len(s)]
        made = iter(N.signatures(full, VALUES)) if full else iter(())
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        sigs = [next(made).tobytes() if len(s) else None for s in sets]
        sizes = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "fp", "id", "sig", "size"])
    N.forget()


def forest_rows(nodes: DataFrame, prefix: int) -> DataFrame:
    """A row (bucket, tree, id, size) for each tree of each node: bucket hashes the prefix of its label."""
    trees = nodes.select("id", "size", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return trees.select(F.xxhash64("tree", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * prefix))).alias("bucket"), "tree", "id", "size")


def joined(docs: DataFrame, target: float = TARGET) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links, degrees): doc_id, fp and node of every row; every node with first, its smallest row, and n, its rows; verified links (a, b) that join what all verified links join; and the number of all of these of each node."""
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    members = stored(rows.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(_sketch, f"doc_id {kind}, fp long, id binary, sig binary, size long"), "join_members")
    nodes = stored(members.where("id is not null").groupBy("id").agg(F.min("sig").alias("sig"), F.min("size").alias("size"), F.min(F.struct("doc_id", "fp")).alias("first"), F.count("*").alias("n")), "join_nodes")
    texts = rows.withColumn("fp", F.xxhash64("text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        needed = stored(ids.join(nodes, "id").select("id", F.col("first.doc_id").alias("d"), F.col("first.fp").alias("f")), "join_needed")
        size = 1 << min(MAX_BITS, max(6, (TEXT_BITS * needed.count()).bit_length()))
        own = texts.where(has_bit(bit_set(needed.select(F.xxhash64("d", "f")), size), size, F.xxhash64("doc_id", "fp")))
        return own.join(needed, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("f") == F.col("fp"))).select("id", "text").dropDuplicates(["id"])

    links, degrees, _ = N.forest_links(nodes, lambda prefix: forest_rows(nodes, prefix), texts_of, FLOOR, TREES, DEPTH, target)
    return members, nodes, links, degrees


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id that copies and links lead to) and n_links (verified links of its text to different texts).

    Links are those between different shingle sets; copies share theirs. Texts without words are never linked and are each their own class; so is a row
    of null doc_id among such. An empty table gives an empty result.
    """
    members, nodes, links, degrees = joined(docs)
    of = nodes.select("id", "n", "first.doc_id").join(N.components(links), "id", "left").join(degrees, "id", "left")
    of = stored(of.select("id", F.col("n").alias("rows"), "doc_id", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "join_of")
    least = stored(of.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "join_least")
    of = stored(hot_join(of, least, "root").select("id", "class_id", "n_links", F.col("rows").alias("n")), "join_classes")
    alone = members.where("id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return hot_join(members.where("id is not null"), of, "id").select("doc_id", "class_id", "n_links").unionByName(alone)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
