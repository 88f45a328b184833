"""Highlights: finding them again and cutting paragraphs into marked segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relocated(highlights: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """highlights (hid, pdf_id, page, paragraph, start, end, quote) with where they are now: at their old place if the quote is still there, at the only other
    place on the page if there is just one, else nowhere (nulls). Two look-ups per paragraph tell one occurrence from several; overlapping ones count."""
    rows = highlights.join(paragraphs.select("pdf_id", "page", F.col("paragraph").alias("p"), "text"), ["pdf_id", "page"], "left")
    rows = rows.withColumn("first", F.expr("locate(quote, text)")).withColumn("second", F.when(F.col("first") > 0, F.expr("locate(quote, text, first + 1)")).otherwise(0))
    same = (F.col("p") == F.col("paragraph")) & (F.expr("substring(text, start + 1, end - start)") == F.col("quote"))
    n = F.when(F.col("first") > 0, 1).otherwise(0) + F.when(F.col("second") > 0, 1).otherwise(0)
    per = rows.groupBy("hid").agg(
        F.coalesce(F.bool_or(same), F.lit(False)).alias("kept"),
        F.sum(n).alias("n"),
        F.min(F.when(F.col("first") > 0, F.struct(F.col("p").alias("p"), (F.col("first") - 1).alias("s")))).alias("found"),
    )
    back = highlights.join(per, "hid")
    only = F.col("n") == 1
    place = lambda old, new: F.when(F.col("kept"), old).when(only, new)
    return back.select(
        "hid",
        place(F.col("paragraph"), F.col("found.p")).alias("paragraph"),
        place(F.col("start"), F.col("found.s")).alias("start"),
        place(F.col("end"), F.col("found.s") + F.length("quote")).alias("end"),
    )


def segments(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments (key, start, end, winner, ids) of texts (key, length) under ranges (key, pos, start, end): between neighbouring bounds the active range of the largest pos wins; equal neighbours are one.

    Ranges outside their text are ignored. Bounds come from the ranges; each range covers the elementary pieces between its own, found by a
    range join within the key.
    """
    fine = ranges.join(lengths, "key").where("start >= 0 and end <= length and end > start").select("key", "pos", "start", "end")
    bounds = fine.select("key", F.explode(F.array("start", "end")).alias("at")).union(lengths.select("key", F.explode(F.array(F.lit(0), "length")).alias("at"))).distinct()
    following = Window.partitionBy("key").orderBy("at")
    pieces = bounds.withColumn("to", F.lead("at").over(following)).where("to is not null").select("key", F.col("at").alias("a"), F.col("to").alias("b"))
    r = fine.withColumnsRenamed({"key": "k"})
    on = (pieces.key == r.k) & (r.start <= pieces.a) & (r.end >= pieces.b)
    held = pieces.join(r, on, "left").groupBy("key", "a", "b").agg(F.max("pos").alias("winner"), F.array_sort(F.collect_list("pos")).alias("ids"))
    new = (~F.lag("winner").over(Window.partitionBy("key").orderBy("a")).eqNullSafe(F.col("winner"))) | (~F.lag("ids").over(Window.partitionBy("key").orderBy("a")).eqNullSafe(F.col("ids")))
    runs = held.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(Window.partitionBy("key").orderBy("a")))
    return runs.groupBy("key", "run").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.first("winner").alias("winner"), F.first("ids").alias("ids")).drop("run")
