"""Secret scans, in DataFrame functions only.

Strong patterns are reported wherever they match. Weak candidates (long tokens of mixed characters)
are mostly not secrets; one is reported only where its complementary parts, an identifier (an access key id, an
e-mail address or a named user) and an endpoint, lie within ``SCOPE`` characters of it in the same document. Parts are dealt out by
document and linked by an interval join on their places: the nearest part of each kind before and after a
candidate decides, so one sorted pass over a document's parts does it and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table

SCOPE = 300
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, test of a match, test of a text that can have one); the first three are the base, in their order among equal starts.
KINDS = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, lambda t: F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))),
    "access": (r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 16, lambda t: F.contains(t, F.lit("AKIA"))),
    "hex": (r"[0-9a-f]{32,}", lambda m: F.lit(True), lambda t: F.lit(True)),
    "weak": (r"[A-Za-z0-9+/_=-]{20,}", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), lambda t: F.contains(t, F.lit("://"))),
    "ident": (
        r"""(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+|(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{3,}""",
        lambda m: F.lit(True),
        lambda t: F.contains(t, F.lit("://")),
    ),
    "endpoint": (r"https?://[A-Za-z0-9.:/_?&=%-]+", lambda m: F.lit(True), lambda t: F.contains(t, F.lit("://"))),
}
BASE = ("assign", "access", "hex")
_PART = "array<struct<kind:int,k:int,gap:int,len:int,ok:boolean>>"


def _parts(number: int, pattern: str, ok, may) -> Column:
    """Structs of a kind's matches in text: their number, the length of the text since the last match, their length, and whether they pass the test."""
    both = F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("gap"))
    made = F.get(
        F.transform(
            F.array(both),
            lambda s: F.transform(s["m"], lambda m, k: F.struct(F.lit(number).alias("kind"), k.alias("k"), F.length(F.get(s["gap"], k)).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok"))),
        ),
        F.lit(0),
    ).cast(_PART)
    return F.when(may(F.col("text")), made).otherwise(F.array().cast(_PART))


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: doc_id and found, a sorted array of (start, kind, end) by place in KINDS, code points, end exclusive.

    Null and empty texts have none. Rows that repeat give a row each.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    own = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("k"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok"))).cast(_PART)
    parts = F.concat(own, *[_parts(i, *spec) for i, spec in enumerate(KINDS.values())])
    rows = rows.select("doc_id", "fp", F.explode(parts).alias("x")).select("doc_id", "fp", "x.*")
    # All steps below need a document's parts together, by doc_id and fp: this is the only shuffle.
    rows = rows.repartition("doc_id", "fp").groupBy("doc_id", "fp", "kind", "k", "gap", "len", "ok").agg(F.count("*").alias("copies"))
    by_kind = Window.partitionBy("doc_id", "fp", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(by_kind)).withColumn("start", F.col("end") - F.col("len")).where("ok")
    names = list(KINDS)
    is_ = lambda *kinds: F.col("kind").isin([names.index(k) for k in kinds])
    by_place = Window.partitionBy("doc_id", "fp").orderBy("start", "kind", "k")
    before, after = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(1, Window.unboundedFollowing)
    near = lambda *kinds: (F.col("start") - F.max(F.when(is_(*kinds), F.col("end"))).over(before) <= scope) | (F.min(F.when(is_(*kinds), F.col("start"))).over(after) - F.col("end") <= scope)
    apart = (F.coalesce(F.max(F.when(is_(*BASE), F.col("end"))).over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(is_(*BASE, "endpoint", "ident"), F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    inside = F.coalesce(F.max(F.when(is_("endpoint", "ident"), F.col("end"))).over(before), F.lit(0)) > F.col("start")
    rows = rows.withColumn("linked", F.coalesce(near("access", "ident"), F.lit(False)) & F.coalesce(near("endpoint"), F.lit(False)) & apart & ~inside)
    held = is_(*BASE) | (is_("weak") & F.col("linked"))
    per = rows.groupBy("doc_id", "fp").agg(F.max(F.when(F.col("kind") < 0, F.col("copies"))).alias("copies"), F.sort_array(F.collect_list(F.when(held, F.struct("start", "kind", "end")))).alias("found"))
    return per.select("doc_id", "found", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == list(KINDS).index(kind))).cast("long").alias(f"n_{kind}")
    return spans(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(_written(F.filter("found", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
