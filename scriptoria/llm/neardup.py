"""What the near-duplicate operators share: word shingles, MinHash signatures, pairs from buckets, exact verification and components.

Words are runs of other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. A shingle is a hash of five consecutive words; a text of one to four words has one shingle of them all, an empty text none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_join, kernel_starts, sliced, stored

SHINGLE = 5
SIMILAR = 0.8
#: Members of a bucket whose pairs leave it as rows; those of a larger one, a crowd, are verified where they meet.
ALL_PAIRS = 16
#: Members, and shingles, of a crowd that one part holds; every two parts meet in a tile.
HOT_ROWS = 1000
HOT_SHINGLES = 1_000_000
#: Edges of a graph that one task takes when no more are left.
LAST_EDGES = 20_000
#: Texts of a batch that are Python objects at a time.
TEXTS = 256
#: Width of the bins in which links are counted by their similarity.
BIN = 0.01
TILE = ("bucket", "i", "j", "part", "tree", "id", "sig")
LINKS = "a binary, b binary, n long, bin int"
#: Pairs of one text that one part of the verification holds.
PART_PAIRS = 256

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Hashes(dict):
    """64-bit hashes of words; the first KEPT words seen are kept until the partition ends."""

    KEPT = 250_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.KEPT:
            self[word] = h
        return h


_hashes = _Hashes()


def forget() -> None:
    """Gives the kept hashes' memory back: called where a partition ends."""
    _hashes.clear()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_order(w: np.ndarray) -> np.ndarray:
    """The shingles of word hashes, one for each place."""
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return mixed(np.add.reduce(w * _MUL[: len(w)], keepdims=True) + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    s = w[:n] * _MUL[0]
    for k in range(1, SHINGLE):
        s = s + w[k : n + k] * _MUL[k]
    return mixed(s)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    return np.unique(in_order(hashed(text.encode("utf-8", "surrogatepass").lower().split())))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(sets: list[np.ndarray], n: int, seed: int = 1) -> np.ndarray:
    """n MinHash values of 16 bits for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    mul = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), n), np.uint16)
    for j in range(n):
        low = np.minimum.reduceat(spread(flat, mul[j]), starts)
        out[:, j] = (mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def spread(x: np.ndarray, mul: np.uint64) -> np.ndarray:
    """A keyed order of 64-bit values that a plain product alone would leave too regular."""
    x = x * mul
    x ^= x >> np.uint64(32)
    x *= mul
    return x


def _tiles(rows: DataFrame) -> DataFrame:
    """rows (bucket, parts, id, ...) dealt to tiles (bucket, i, j), i <= j, of each two parts of a bucket: a row goes to as many tiles as its bucket has parts."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "part", "id")


def dealt_buckets(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows (bucket, tree, id, size) of buckets of several members with sig, held (members) and parts (of up to HOT_ROWS members and about HOT_SHINGLES shingles each). Signatures join only what is left."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / HOT_ROWS, F.col("total") / HOT_SHINGLES)).cast("int")
    sizes = stored(sizes.select("bucket", "n", F.col("n").alias("held"), parts.alias("parts")), "bucket_sizes")
    return hot_join(rows.drop("size"), sizes, "bucket").join(sigs.select("id", "sig"), "id")


class Candidates(NamedTuple):
    """What is to be verified: pairs (a, b) of buckets of up to ALL_PAIRS members, and the members of larger ones, crowds."""

    pairs: DataFrame
    crowd: DataFrame
    members: DataFrame
    floor: float
    layout: tuple[int, int, int]
    done: int

    def ids(self) -> DataFrame:
        return self.pairs.select(F.col("a").alias("id")).union(self.pairs.select("b")).union(self.crowd.select("id")).distinct()


def candidates(rows: DataFrame, sigs: DataFrame, floor: float, layout: tuple[int, int, int], done: int = 0) -> Candidates:
    """The candidates among items that share a bucket. rows: bucket, tree, id, size (shingles). sigs: id, sig. layout: trees, values of a tree, values of its prefix; members of a bucket share the prefix of its tree.

    Every pair that shares a bucket, and whose signatures agree in floor of their values or more, is one, once: in the first tree that it shares. If done > 0, pairs that
    share a prefix of done values in any tree have been verified before and are left out.
    """
    members = stored(dealt_buckets(rows, sigs), "bucket_members")
    few = _tiles(members.where(F.col("held") <= ALL_PAIRS).drop("held").withColumn("parts", F.lit(1)))
    pairs = stored(few.select(*TILE).mapInArrow(_tile_run(_pairs_of(floor, layout, done)), LINKS).select("a", "b"), "bucket_pairs")
    return Candidates(pairs, members.where(F.col("held") > ALL_PAIRS).drop("held"), members, floor, layout, done)


def verified_links(c: Candidates, texts: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, ends, found) of the candidates whose texts (id, text) have an exact Jaccard similarity of at least least.

    links (a, b) join whatever verified pairs join; ends (id, n) add up to the number of all verified pairs of
    an item; found (bin, n) counts all of them by the bin of their similarity. A crowd's pairs grow with its square, so they are verified in tiles of two of its
    parts, and a tile returns its members' numbers of links and a spanning forest of these: not more rows than members.
    """
    spark = texts.sparkSession
    sets = stored(texts.join(c.crowd.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_sets, "id binary, shingles binary"), "bucket_sets")
    dealt = _tiles(c.crowd.join(sets, "id"))
    in_crowds = stored(dealt.select(*TILE, "shingles").mapInArrow(_tile_run(_links_of(c.floor, c.layout, c.done, least)), LINKS), "crowd_links")
    alone = stored(verified(c.pairs, texts, least=least), "pair_links")
    links = stored(alone.select("a", "b").union(in_crowds.where("b is not null").select("a", "b")), "bucket_links")
    one = F.lit(1).cast("long")
    ends = alone.select(F.col("a").alias("id"), one.alias("n")).union(alone.select("b", one)).union(in_crowds.where("a is not null and b is null").select("a", "n"))
    ends = stored(ends.groupBy("id").agg(F.sum("n").alias("n")), "bucket_ends")
    found = stored(alone.select("bin", one.alias("n")).union(in_crowds.where("a is null").select("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")), "bucket_found")
    for df in (c.members, c.pairs, sets, alone, in_crowds):
        dropped(spark, df)
    return links, ends, found


def recall(found: dict[int, int], trees: int, prefix: int, least: float = SIMILAR) -> float:
    """The share of links that a forest of that many trees finds when prefixes of that length are matched, going by links found so far (bin: n, each taken at its bin's lower end).

    Each found link stands for one over its chance of being found. Without any the chance of a pair at the threshold is taken.
    """
    chance = lambda k: 1 - (1 - (least + k * BIN) ** prefix) ** trees
    return sum(found.values()) / sum(n / chance(k) for k, n in found.items()) if found else chance(0)


def forest_links(nodes: DataFrame, rows_at: Callable[[int], DataFrame], texts_of: Callable[[DataFrame], DataFrame], floor: float, trees: int, depth: int, target: float) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """(links, degrees, rounds) of an LSH forest: the tries are matched at prefixes of depth values, and the prefix is shortened until the recall reaches target.

    rows_at(prefix) gives bucket, tree, id, size; texts_of gives id, text of a frame of ids. A round verifies the pairs that meet at its prefix and did not meet before; the recall of the next one is estimated
    from the similarities of all links found so far, so collections whose links lie close to the threshold are searched at shorter prefixes than others. The histogram of at most 1 / BIN rows reaches the driver.
    rounds has each prefix with the recall estimated after it.
    """
    all_links, all_ends, seen, rounds = [], [], {}, []
    prefix, done = depth, 0
    while True:
        c = candidates(rows_at(prefix), nodes, floor, (trees, depth, prefix), done)
        texts = stored(texts_of(c.ids()), "forest_texts")
        links, ends, found = verified_links(c, texts)
        dropped(nodes.sparkSession, texts)
        all_links.append(links)
        all_ends.append(ends)
        for r in found.collect():
            seen[r.bin] = seen.get(r.bin, 0) + r.n
        rounds.append((prefix, recall(seen, trees, prefix)))
        if rounds[-1][1] >= target or prefix == 1:
            break
        done = prefix
        prefix = next((p for p in range(prefix - 1, 1, -1) if recall(seen, trees, p) >= target), 1)
    links, ends = reduce(DataFrame.union, all_links), reduce(DataFrame.union, all_ends)
    return links, stored(ends.groupBy("id").agg(F.sum("n").alias("n_links")), "forest_degrees"), rounds


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel_starts("shingles")
    for some in sliced(batches, TEXTS):
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingles(t).tobytes() for t in some.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])
    forget()


def _near(values: np.ndarray, first: int, floor: float, layout: tuple[int, int, int], done: int, tree: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the members js that i is verified with. Of first > 0 members of one part each meets all of the other, else each meets all after it."""
    trees, width, prefix = layout
    for i in range(first or len(values)):
        lo = first or i + 1
        same = values[lo:] == values[i]
        js = np.flatnonzero(np.count_nonzero(same, axis=1) >= floor * values.shape[1])
        if len(js) and (tree or done):
            shared = same[js].reshape(len(js), trees, width)
            met = shared[:, :tree, :prefix].all(2).any(1)
            if done:
                met |= shared[:, :, :done].all(2).any(1)
            js = js[~met]
        if len(js):
            yield i, js + lo


def _pairs_of(floor: float, layout: tuple[int, int, int], done: int):
    def run(ids: list[bytes], values: np.ndarray, first: int, tree: int, _: list) -> Iterator[tuple]:
        for i, js in _near(values, first, floor, layout, done, tree):
            yield from ((min(ids[i], ids[j]), max(ids[i], ids[j]), None, None) for j in js.tolist() if ids[i] != ids[j])

    return run


def _links_of(floor: float, layout: tuple[int, int, int], done: int, least: float):
    def run(ids: list[bytes], values: np.ndarray, first: int, tree: int, sets: list[tuple]) -> Iterator[tuple]:
        own = [np.frombuffer(x[0], np.uint64) for x in sets]
        sizes = np.array([len(x) for x in own])
        starts = np.cumsum(sizes) - sizes
        words, at = np.unique(np.concatenate(own), return_inverse=True)
        held = np.zeros(len(words), np.int32)
        degree, label, bins = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(int(1 / BIN) + 1, np.int64)
        for i, js in _near(values, first, floor, layout, done, tree):
            mine = at[starts[i] : starts[i] + sizes[i]]
            held[mine] = 1
            both = np.add.reduceat(held[np.concatenate([at[starts[j] : starts[j] + sizes[j]] for j in js])], np.cumsum(sizes[js]) - sizes[js])
            held[mine] = 0
            alike = both / (sizes[i] + sizes[js] - both)
            linked = js[alike >= least]
            np.add.at(bins, _bin(alike[alike >= least], least), 1)
            degree[i] += len(linked)
            degree[linked] += 1
            for j in linked[label[linked] != label[i]].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield min(ids[i], ids[j]), max(ids[i], ids[j]), None, None
        yield from ((ids[k], None, int(degree[k]), None) for k in np.flatnonzero(degree).tolist())
        yield from ((None, None, int(bins[k]), k) for k in np.flatnonzero(bins).tolist())

    return run


def _bin(alike, least: float):
    return np.floor((alike - least) / BIN + 1e-9).astype(np.int64)


def _tile_run(tile: Callable):
    """Calls tile(ids, signatures, members of the first of two parts or 0, tree, what else each member has) for each tile of rows that _tiles dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "n", "bin"])

        def members() -> Iterator[tuple]:
            for some in sliced(batches, TEXTS):
                yield from zip(*(c.to_pylist() for c in some.columns), strict=True)

        kernel_starts("shingles")
        out: list[tuple] = []
        for (_, i, j), group in groupby(members(), lambda r: r[:3]):
            own = list(group)
            first = sum(r[3] == i for r in own) if i < j else 0
            if len(own) < 2 or i < j and first in (0, len(own)):
                continue
            values = np.frombuffer(b"".join(r[6] for r in own), np.uint16).reshape(len(own), -1)
            for row in tile([r[5] for r in own], values, first, own[0][4], [r[7:] for r in own]):
                out.append(row)
                if len(out) >= 50_000:
                    yield batch(out)
                    out = []
        yield batch(out)

    return run


def verified(pairs: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose items' texts have an exact Jaccard similarity of shingles of at least least, with its bin. items: id, text.

    Each text b travels to the part that holds its a; a text with many pairs is held by several parts, of PART_PAIRS pairs each.
    """
    counts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / PART_PAIRS).cast("int").alias("parts"))
    heads = counts.join(items, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "text")
    asked = pairs.join(counts, "a").join(items, F.col("b") == F.col("id")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "text")
    dealt = heads.unionByName(asked).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_starts("shingles")
        own = np.zeros(0, np.uint64)
        for some in sliced(batches, TEXTS):
            a, b, bins = [], [], []
            for one, other, text in zip(*(some.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if other is None:
                    own = shingles(text)
                elif (alike := jaccard(own, shingles(text))) >= least:
                    a.append(one)
                    b.append(other)
                    bins.append(int(_bin(alike, least)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(bins, pa.int32())], names=["a", "b", "bin"])
        forget()

    return dealt.mapInArrow(run, "a binary, b binary, bin int")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the smallest node of its component.

    Each round points every node at the smallest of its neighbours, or at itself, and then at what that one points at, and contracts the edges: those whose ends
    now meet go, so a large group costs its edges once. When no more than LAST_EDGES are left, one task joins their ends. Only the number of edges left reaches the driver.
    """
    both = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "cc_edges")
    nodes = both(edges).select(F.col("a").alias("id")).distinct()
    roots = stored(nodes.select("id", F.col("id").alias("root")), "cc_roots")
    while edges.limit(LAST_EDGES + 1).count() > LAST_EDGES:
        low = stored(both(edges).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"), "n"), "cc_low")
        up = low.select(F.col("v").alias("to"), F.col("to").alias("top")).join(low.groupBy("to").agg(F.count("*").alias("n")), "to")
        step = stored(hot_join(low.withColumnRenamed("n", "degree"), stored(up, "cc_up"), "to").select("v", F.col("top").alias("to"), F.col("degree").alias("n")), "cc_step")
        edges = hot_join(edges, step.select(F.col("v").alias("a"), F.col("to").alias("to_a"), "n"), "a")
        edges = hot_join(stored(edges, "cc_half"), step.select(F.col("v").alias("b"), F.col("to").alias("to_b"), "n"), "b")
        edges = stored(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), "cc_edges")
        moved = roots.groupBy("root").agg(F.count("*").alias("n")).join(step.select(F.col("v").alias("root"), "to"), "root")
        roots = stored(hot_join(roots, stored(roots.select("root").distinct().join(moved, "root", "left").select("root", "to", F.coalesce("n", F.lit(1)).alias("n")), "cc_moved"), "root").select("id", F.coalesce("to", "root").alias("root")), "cc_roots")
    last = edges.coalesce(1).mapInArrow(_joined_ends, "root binary, last binary")
    return roots.join(F.broadcast(last), "root", "left").select("id", F.coalesce("last", "root").alias("root"))  # two rows for each of LAST_EDGES at most


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([root(x) for x in up], pa.binary())], names=["root", "last"])
