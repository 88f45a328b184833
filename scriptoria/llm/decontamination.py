"""Benchmark decontamination, in DataFrame functions only.

The windows of the benchmark's items are made into a hash set in two layers. The first is a bit set of the hashes of
each window's first three words; it goes into every task as a scalar and turns away most of a document's
positions without leaving the row. What passes is put to the second, the windows' own
texts, by an exact join, which verifies every hit: broadcast while there are at most
``BROADCAST_WINDOWS`` of them (of up to ten words each), shuffled by the window beyond.
The bit set has at most 2 ** MAX_BITS bits, however large the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bit_set, has_bit, pick, stored, table
from .quality import bound

WINDOW = 10
LEAD = 3
BROADCAST_WINDOWS = 100_000
MIN_BITS, MAX_BITS = 14, 22
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text that still has its capitals.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, _OTHER, -1), "")


def _lead(v: Column, i: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(v, i + k) for k in range(min(length, LEAD))])


def _windows(w: Column, length: int, keep=None) -> Column:
    """Structs (at, len, gram, lead) of the windows of that length in the array w; keep chooses by their first words' hash."""
    at = lambda v: F.sequence(F.lit(0), F.size(v) - length)
    make = lambda v: lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.concat_ws(" ", *[F.get(v, i + k) for k in range(length)]).alias("gram"), _lead(v, i, length).alias("lead"))
    some = lambda v: F.transform(at(v) if keep is None else F.filter(at(v), lambda i: keep(_lead(v, i, length))), make(v))
    none = F.array().cast("array<struct<at:int,len:int,gram:string,lead:bigint>>")
    return F.when(F.size(w) < length, none).otherwise(bound(w, some))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, len, lead and the sorted item_ids (as strings; a null id is 'null') of every distinct window of the items."""
    rows = pick(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), normal_words(F.col("text")).alias("w"))
    cases = _windows(F.col("w"), window)
    for n in range(1, window):
        cases = F.when(F.size("w") == n, _windows(F.col("w"), n)).otherwise(cases)
    rows = rows.select("item", F.explode(cases).alias("x"))
    return rows.groupBy(F.col("x.gram").alias("gram"), F.col("x.len").alias("len"), F.col("x.lead").alias("lead")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, fp, n_words, at (sorted numbers of its words in verified windows) and items.

    Null and empty texts have no words, and an item without words has no window. Rows of docs that repeat give a row each;
    items that repeat count once. An empty benchmark hits nothing.
    """
    grams = stored(benchmark_windows(items, window), "benchmark_windows")
    lengths = {r.len: r.n for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most one row for each length up to the window's
    n = sum(lengths.values())
    size = 1 << min(MAX_BITS, max(MIN_BITS, (64 * max(n, 1)).bit_length()))
    bits = bit_set(grams.select("lead"), size)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("fp"), normal_words(F.col("text")).alias("w"))

    none = F.array().cast("array<struct<at:int,len:int,gram:string,lead:bigint>>")
    found = F.concat(none, *[_windows(F.col("w"), k, lambda h: has_bit(F.col("bits"), size, h)) for k in sorted(lengths)])
    rows = rows.withColumn("bits", bits).select("doc_id", "fp", F.size("w").alias("n_words"), found.alias("found"))
    # The row that stands for the document itself has a gram that no window has, different from one document to the next.
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.concat(F.lit(" "), F.col("fp").cast("string")).alias("gram"), F.lit(0).cast("long").alias("lead")))
    rows = rows.select("doc_id", "fp", "n_words", F.explode(F.concat(own, "found")).alias("x")).select("doc_id", "fp", "n_words", "x.at", "x.len", "x.gram")
    known = grams.select("gram", "len", "items")
    known = F.broadcast(known) if n <= BROADCAST_WINDOWS else known.hint("merge")
    rows = rows.join(known, ["gram", "len"], "left").where("items is not null or at < 0")
    per = rows.groupBy("doc_id", "fp", "n_words").agg(
        F.count_if(F.col("at") < 0).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at") >= 0, F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)))))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per.select("doc_id", "fp", "n_words", "at", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    h = hits(docs, items)
    return h.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("at").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("at") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, items: DataFrame, drop_from: float = 0.0) -> DataFrame:
    """doc_id and text of the documents that stay. One whose share of hit words reaches drop_from, and that has any, goes whole; from the
    others the hit words go, with what stands between them."""
    h = hits(docs, items).where("size(at) > 0").dropDuplicates(["doc_id", "fp"]).withColumnsRenamed({"doc_id": "h_doc", "fp": "h_fp"})
    rows = pick(docs, "doc_id", "text").withColumn("fp", F.xxhash64("text"))
    rows = rows.join(h, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("fp") == F.col("h_fp")), "left")
    rows = rows.where(F.col("at").isNull() | (F.size("at") < drop_from * F.col("n_words")))
    both = F.struct(F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1)).alias("w"), F.split("text", _WORD, -1).alias("gap"), F.col("at").alias("at"))
    left = bound(both, lambda s: F.concat(F.get(s["gap"], F.lit(0)), F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["w"]) - 1), s["at"]), lambda i: F.concat(F.get(s["w"], i), F.get(s["gap"], i + 1))), "")))
    return rows.select("doc_id", F.when(F.col("at").isNull(), F.col("text")).otherwise(left).alias("text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT x.r, x.i, x.n, g.item FROM x JOIN g ON x.gram = g.gram AND x.n = g.n),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN q ON d.r = q.r
"""
