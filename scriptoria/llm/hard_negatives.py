"""Hard negatives by distributed radix selection.

An anchor's score with a row is their integer inner product. What is wanted of a window of scores, the k-th best row, is found without ever sorting or shuffling the scores: rows and anchors meet in tiles
of ``BLOCK`` by ``BLOCK``, and each tile counts its scores by their leading digit of ``DIGIT`` bits, from the best bucket on until these hold k rows, as none beyond can matter. Summed over the tiles, the counts name
the bucket of the k-th row; the next pass looks into this bucket alone. Where one score holds too many rows, their ids are the further digits, so any number of equal vectors costs
passes and not rows. At last the rows up to the k-th bucket are gathered, k + ``SLACK`` at most, and ranked.

First each anchor has one window over all rows of its label, which gives its positives; then each anchor and positive have a window over the rows of other labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kernel_starts, new_path, pick, stored, table

POSITIVES = 5
NEGATIVES = 3
#: Rows, and anchors, of a tile.
BLOCK = 4096
#: Anchors of a tile whose scores are held together.
SLICE = 64
DIGIT = 12
#: A window is done when no more than so many rows over k are left to be gathered.
SLACK = 32
#: Above every score's bound: inner products of components as doubles are exact.
EXACT = 2**53
ANCHORS_AMONG = 50
CHANGED_AMONG = 7
LABELS = 10
SCALE = 256
LEAST, MOST = 50, 95

KEY = ("a_id", "a_uid", "p_id", "p_uid")
_STATE = ("p_id", "p_uid", "top", "lo", "hi", "u_lo", "u_hi", "need")


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, uid, label and q (components as integers) of the rows that take part, each once."""
    rows = pick(rows, "vec_id", "embedding", "label").where("vec_id is not null and label is not null and embedding is not null")
    value = lambda x: x.cast("double")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf"))))
    rows = rows.where(F.forall("embedding", lambda x: (F.abs(value(x)) < 2.0**22) | F.raise_error(F.lit("a component's size is over 2^22: scores would not be exact"))))
    label = F.when(F.col("vec_id") % CHANGED_AMONG == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    rows = rows.select(F.col("vec_id").cast("long"), label.alias("label"), F.transform("embedding", lambda x: F.floor(SCALE * value(x)).cast("int")).alias("q"))
    return rows.withColumn("uid", F.xxhash64("label", "q")).dropDuplicates(["vec_id", "uid"])


def _signed(u: int) -> int:
    return u - 2**64 if u >= 2**63 else u


class Selection:
    """Windows of scores over rows (vec_id, uid, label, q), all passes over the same blocks of rows."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.rows = rows
        square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, low, high, most = rows.agg(F.count("*"), F.min("vec_id"), F.max("vec_id"), F.max(square)).first()
        if (most or 0) >= EXACT:
            raise ValueError("the square of a vector's length is over 2^53: scores would not be exact")
        self.bound = int(most or 0)
        self.n_blocks = max(1, -(-n // BLOCK))
        low, high = (low or 0) + 2**63, (high or 0) + 2**63
        bits = (low ^ high).bit_length()
        self.u_lo, self.u_hi = _signed(low >> bits << bits), _signed(low >> bits << bits | (1 << bits) - 1)
        block = F.pmod(F.xxhash64("vec_id", "uid"), F.lit(self.n_blocks)).cast("int")
        blocks = rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "uid", "label", "q")).alias("rows"))
        # a file for each block or two, so that a task, which reads as many files as fit its size, holds few blocks
        self.blocks = stored(blocks.repartition(min(self.n_blocks, 10_000), "block"), "negatives_blocks")

    def _tiles(self, windows: DataFrame, same: bool, gather: bool) -> Iterator[DataFrame]:
        """What each block of anchors with their windows finds in all blocks of rows.

        The rows stay where they are stored: a block of anchors, ``BLOCK`` at most, is sent to them, one after another. So nothing of the tiles is shuffled or written, however many they are.
        """
        per = windows.groupBy("a_id", "a_uid").agg(F.collect_list(F.struct(*_STATE)).alias("windows"))
        own = self.rows.select(F.col("vec_id").alias("a_id"), F.col("uid").alias("a_uid"), "label", "q")
        n_anchors = -(-windows.select("a_id", "a_uid").distinct().count() // BLOCK)
        anchors = per.join(own, ["a_id", "a_uid"]).groupBy(F.pmod(F.xxhash64("a_id", "a_uid"), F.lit(max(1, n_anchors))).cast("int").alias("ablock"))
        anchors = stored(anchors.agg(F.collect_list(F.struct("a_id", "a_uid", "label", "q", "windows")).alias("anchors")), "negatives_anchors")
        keys = ", ".join(f"{k} long" for k in KEY)
        for k in range(n_anchors):
            met = self.blocks.select("rows").crossJoin(F.broadcast(anchors.where(F.col("ablock") == k).select("anchors")))  # one row of about BLOCK anchors
            yield met.mapInArrow(_scored(same, gather), f"{keys}, vec_id long, uid long, score long" if gather else f"{keys}, bin int, n long")
        dropped(self.spark, anchors)

    def _gathered(self, windows: DataFrame, same: bool, gather: bool, name: str, finish: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        """The tiles' results, finished for each block of anchors, whose windows are in no other, in one table."""
        path = new_path(self.spark, name)
        self.spark.createDataFrame([], schema).write.parquet(path)
        for tiles in self._tiles(windows, same, gather):
            finish(tiles).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each window (a_id, a_uid, p_id, p_uid, lo, hi): the columns of KEY, rank, vec_id, uid, score. same: of the anchor's label and not the anchor, else of another label."""
        state = windows.select(*KEY, F.col("hi").alias("top"), "lo", "hi", F.lit(self.u_lo).cast("long").alias("u_lo"), F.lit(self.u_hi).cast("long").alias("u_hi"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))
        state = stored(state, "negatives_windows")
        keys = ", ".join(f"{key} long" for key in KEY)
        while not state.where("open").isEmpty():
            summed = lambda tiles: tiles.groupBy(*KEY, "bin").agg(F.sum("n").alias("n"))
            counts = self._gathered(state.where("open"), same, False, "negatives_counts", summed, f"{keys}, bin int, n long")
            narrowed = stored(_narrowed(state, counts, k), "negatives_windows")
            dropped(self.spark, counts)
            dropped(self.spark, state)
            state = narrowed
        order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id", "uid")
        ranked = lambda tiles: tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = self._gathered(state, same, True, "negatives_found", ranked, f"{keys}, vec_id long, uid long, score long, rank int")
        dropped(self.spark, state)
        return out


def _narrowed(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Each open window's bucket of its k-th row becomes its range; it stays open while too many rows are left in it. A window of fewer than k rows keeps its range, and is done."""
    order = Window.partitionBy(*KEY).orderBy("bin")
    upto = F.sum("n").over(order)
    met = counts.join(state.where("open").select(*KEY, "need"), list(KEY)).withColumn("upto", upto)
    met = met.where("upto >= need and upto - n < need").select(*KEY, F.col("bin").cast("long").alias("bin"), "n", (F.col("upto") - F.col("n")).alias("above"))
    bits = lambda x: F.length(F.bin(x))
    shift = lambda x: F.greatest(F.lit(0), bits(x) - DIGIT)
    left = lambda x, by: F.call_function("shiftleft", x, by)
    one, hit = F.lit(1).cast("long"), F.col("open") & F.col("bin").isNotNull()
    by_score = hit & (F.col("lo") < F.col("hi"))
    by_id = hit & (F.col("lo") == F.col("hi"))
    s, u = shift(F.col("hi") - F.col("lo")), shift(F.col("u_lo").bitwiseXOR(F.col("u_hi")))
    hi = F.col("hi") - left(F.col("bin"), s)
    digits = left(F.lit((1 << DIGIT) - 1).cast("long"), u)
    u_lo = F.col("u_lo").bitwiseAND(F.bitwise_not(digits)).bitwiseOR(left(F.col("bin"), u))
    out = state.join(met, list(KEY), "left").select(
        *KEY,
        "top",
        F.when(by_score, F.greatest("lo", hi - left(one, s) + 1)).otherwise(F.col("lo")).alias("lo"),
        F.when(by_score, hi).otherwise(F.col("hi")).alias("hi"),
        F.when(by_id, u_lo).otherwise(F.col("u_lo")).alias("u_lo"),
        F.when(by_id, u_lo.bitwiseOR(left(one, u) - 1)).otherwise(F.col("u_hi")).alias("u_hi"),
        F.when(hit, F.col("need") - F.col("above")).otherwise(F.col("need")).alias("need"),
        F.when(hit, F.col("n") - (F.col("need") - F.col("above"))).otherwise(F.lit(0)).alias("over"),
    )
    return out.withColumn("open", (F.col("over") > SLACK) & ((F.col("lo") < F.col("hi")) | (F.col("u_lo") != F.col("u_hi")))).drop("over")


def _matrix(q: pa.ListArray) -> np.ndarray:
    """Rows of doubles; shorter ones are filled up with zeros."""
    sizes = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
    return out


def _scored(same: bool, gather: bool):
    """Counts of score digits, or the qualifying rows, of each window over a tile's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_starts("negatives")
        for batch in batches:
            for i in range(batch.num_rows):
                rows, anchors = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                yield tile(rows, anchors)

    def tile(rows: pa.StructArray, anchors: pa.StructArray) -> pa.RecordBatch:
        of = lambda x, name: x.field(name).to_numpy(zero_copy_only=False)
        ids, uids, labels = of(rows, "vec_id"), of(rows, "uid"), of(rows, "label")
        u = ids.view(np.uint64) ^ np.uint64(1 << 63)
        r, a = _matrix(rows.field("q")), _matrix(anchors.field("q"))
        d = min(r.shape[1], a.shape[1])
        r, a = r[:, :d].T, a[:, :d]
        a_ids, a_uids, a_labels = of(anchors, "a_id"), of(anchors, "a_uid"), of(anchors, "label")
        windows = anchors.field("windows")
        starts, windows = windows.offsets.to_numpy() - windows.offsets[0].as_py(), windows.flatten()
        p_ids, p_uids, tops, los, his, need = (of(windows, name) for name in ("p_id", "p_uid", "top", "lo", "hi", "need"))
        u_los, u_his = (of(windows, name).view(np.uint64) for name in ("u_lo", "u_hi"))
        keys: list[tuple] = []
        first: list[np.ndarray] = []
        second: list[np.ndarray] = []
        third: list[np.ndarray] = []
        for k in range(0, len(a), SLICE):
            scores = (a[k : k + SLICE] @ r).astype(np.int64)
            for j, s in enumerate(scores, k):
                own = labels == a_labels[j]
                own = np.flatnonzero(own & ~((ids == a_ids[j]) & (uids == a_uids[j])) if same else ~own)
                s = s[own]
                for w in range(starts[j], starts[j + 1]):
                    lo, hi, top, tied = los[w], his[w], tops[w], los[w] == his[w]
                    at = np.flatnonzero((s >= lo) & (s <= (top if gather else hi)))
                    if tied and gather:
                        at = at[(s[at] > lo) | (u[own[at]] <= u_his[w])]
                    elif tied:
                        at = at[(u[own[at]] >= u_los[w]) & (u[own[at]] <= u_his[w])]
                    if not len(at):
                        continue
                    if gather:
                        first.append(ids[own[at]])
                        second.append(uids[own[at]])
                        third.append(s[at])
                    else:
                        if tied:
                            shift = max(0, int(u_los[w] ^ u_his[w]).bit_length() - DIGIT)
                            digit = (u[own[at]] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
                        else:
                            digit = (hi - s[at]) >> max(0, int(hi - lo).bit_length() - DIGIT)
                        bins, n = np.unique(digit, return_counts=True)
                        last = int(np.searchsorted(np.cumsum(n), need[w])) + 1
                        first.append(bins[:last].astype(np.int32))
                        second.append(n[:last].astype(np.int64))
                    keys.append((a_ids[j], a_uids[j], p_ids[w], p_uids[w], len(first[-1])))
        cols = np.array(keys, np.int64).reshape(-1, 5)
        cols = np.repeat(cols[:, :4], cols[:, 4], axis=0)
        parts = [(first, np.int64), (second, np.int64), (third, np.int64)] if gather else [(first, np.int32), (second, np.int64)]
        data = [pa.array(np.ascontiguousarray(cols[:, c])) for c in range(4)] + [pa.array(np.concatenate([np.zeros(0, t), *x])) for x, t in parts]
        return pa.RecordBatch.from_arrays(data, names=[*KEY, *(("vec_id", "uid", "score") if gather else ("bin", "n"))])

    return run


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of rows (vec_id, embedding, label).

    Rows with a null id, label or vector, or with any null or non-finite component, take no part; of rows that are equal in all three, one does. Rows that share an id otherwise are rows of their own, and
    tie by a hash of the rest. Of two vectors of different sizes the shorter one is filled up with zeros; an empty vector scores 0 with all. Components over 2^22, or vectors whose square is over 2^53, are an error, as scores
    would not be exact. An empty table gives no rows.
    """
    known = stored(taking_part(rows), "negatives_rows")
    selection = Selection(known)
    zero, bound = F.lit(0).cast("long"), F.lit(selection.bound).cast("long")
    anchors = known.where(F.col("vec_id") % ANCHORS_AMONG == 0 if anchor is None else anchor)
    windows = anchors.select(F.col("vec_id").alias("a_id"), F.col("uid").alias("a_uid"), zero.alias("p_id"), zero.alias("p_uid"), (-bound).alias("lo"), bound.alias("hi"))
    pairs = selection.best(windows, positives, True).select("a_id", "a_uid", F.col("vec_id").alias("p_id"), F.col("uid").alias("p_uid"), F.col("score").alias("positive_score"))
    # a negative positive_score leaves no scores between its shares
    pairs = stored(pairs.where("positive_score >= 0"), "negatives_pairs")
    share = lambda of, up: F.expr(f"({of} * positive_score + {up}) div 100")
    windows = pairs.select(*KEY, share(LEAST, 99).alias("lo"), share(MOST, 0).alias("hi")).where("lo <= hi")
    found = selection.best(windows, negatives, False)
    return found.join(pairs, list(KEY)).select(
        F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH known AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s
  FROM known a JOIN known b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT a, b, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
negatives AS (
  SELECT p.a, p.b AS p, n.b AS n, p.s AS ps, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM negatives WHERE rank <= 3
"""
