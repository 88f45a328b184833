"""Passage retrieval: blocks, term rarity, ranked passages within a budget, and chat history."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, like, stripped, terms, text

#: Words that ask about a whole paper, and words that point back to the answer before.
BROAD_WORDS = ("summar\\w*", "overview", "overall", "main findings", "key findings", "limitations", "strengths", "weaknesses", "compare", "comparison", "whole paper", "entire paper", "across the paper")
FOLLOW_UP_WORDS = ("it", "that", "those", "these", "they", "this", "above", "previous", "elaborate", "more detail")
BROAD, FOLLOW_UP = (rf"(?i)\b({'|'.join(w)})\b" for w in (BROAD_WORDS, FOLLOW_UP_WORDS))
FOCUSED_BUDGET, BROAD_BUDGET, SUMMARY_BUDGET = 12_000, 24_000, 90_000
CHUNK, CHUNK_LEAST = 1200, 600


def is_broad(question: Column | str) -> Column:
    return like(question, BROAD)


def is_follow_up(question: Column | str) -> Column:
    return (F.size(terms(question)) < 2) | like(question, FOLLOW_UP)


def cited_pages(answer: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text(answer), F.lit(r"\[p\.\s*(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def unique_blocks(blocks: DataFrame) -> DataFrame:
    """Of blocks (pdf_id, page, ord, text) of one text, white space put aside, the first; blank ones go."""
    key = F.regexp_replace(stripped(text("text")), r"(?U)\s+", " ")
    first = Window.partitionBy("pdf_id", key).orderBy("ord")
    return blocks.where(key != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _chunks(batches):
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            start, n = 0, len(r.text)
            while start < n:
                end = min(n, start + CHUNK)
                if end < n:
                    space = r.text.rfind(" ", 0, end + 1)
                    if space > start + CHUNK_LEAST:
                        end = space + 1
                rows.append((r.pdf_id, r.page, r.ord, start, r.text[start:end]))
                start = end
        yield pd.DataFrame(rows, columns=["pdf_id", "page", "ord", "start", "text"])


def chunked(blocks: DataFrame) -> DataFrame:
    """Blocks cut into parts of up to CHUNK characters, at the last space after CHUNK_LEAST. Each cut depends on the one before, hence the Arrow kernel."""
    kind = blocks.schema["pdf_id"].dataType.simpleString()
    return blocks.select("pdf_id", F.col("page").cast("int"), F.col("ord").cast("long"), text("text").alias("text")).mapInPandas(_chunks, f"pdf_id {kind}, page int, ord long, start int, text string")


def document_frequency(blocks: DataFrame, key: list[str]) -> DataFrame:
    """term and df, the number of blocks with it."""
    return blocks.select(*key, F.explode(terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def scored(blocks: DataFrame, query: list[str], previous: list[str] = (), pages: list[int] = ()) -> DataFrame:
    """blocks (pdf_id, page, ord, text) with score: the rarity of the query's terms, half that of the previous question's, and a quarter for pages asked for."""
    asked = blocks.sparkSession.createDataFrame([(t, 1.0) for t in dict.fromkeys(query)] + [(t, 0.5) for t in dict.fromkeys(previous)] or [("", 0.0)], "term string, weight double").groupBy("term").agg(F.sum("weight").alias("weight"))
    n = blocks.groupBy("pdf_id").agg(F.count("*").alias("n"))
    has = blocks.select("pdf_id", "ord", F.explode(terms("text")).alias("term")).join(F.broadcast(asked), "term")  # a question's terms
    df = has.groupBy("pdf_id", "term").agg(F.count("*").alias("df"))
    per = has.join(df, ["pdf_id", "term"]).join(n, "pdf_id").groupBy("pdf_id", "ord").agg(F.sum(F.col("weight") * F.log1p(F.col("n") / F.col("df"))).alias("s"))
    bonus = F.when(F.col("page").isin(*pages), 0.25).otherwise(0.0) if pages else F.lit(0.0)
    return blocks.join(per, ["pdf_id", "ord"], "left").withColumn("score", F.coalesce("s", F.lit(0.0)) + bonus).drop("s")


def within_budget(rows: DataFrame, budget: int, key: str = "pdf_id") -> DataFrame:
    """Ranked blocks of positive score until the budget of characters is used up; the last one is cut to fit."""
    order = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where("score > 0").withColumn("before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0))).where(F.col("before") < budget)
    return rows.withColumn("text", F.left("text", (budget - F.col("before")).cast("int"))).drop("before")


def page_coverage(blocks: DataFrame, cap: int) -> DataFrame:
    """Blocks in page order with an equal share of the cap for each page of their document; the last one of a page is cut to fit."""
    pages = blocks.groupBy("pdf_id").agg(F.count_distinct("page").alias("_pages"))
    order = Window.partitionBy("pdf_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.join(pages, "pdf_id").withColumn("_share", F.floor(F.lit(cap) / F.col("_pages"))).withColumn("_before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)))
    return rows.where("_before < _share").withColumn("text", F.left("text", (F.col("_share") - F.col("_before")).cast("int"))).drop("_pages", "_share", "_before")


def selected(scores: DataFrame, question: str) -> DataFrame:
    """The passages of each document that answer a question, with their neighbours on the page, within the question's budget.

    A broad question, or one that nothing in a document matches well, gives each page an equal share of half the budget first. Then passages are asked for by rank, each
    followed by its neighbours; the first time that one is asked for counts, and a running sum of what is left of their texts cuts off at the budget.
    """
    broad = bool(re.search(BROAD, question))
    budget = BROAD_BUDGET if broad else FOCUSED_BUDGET
    doc = Window.partitionBy("pdf_id")
    rows = scores.select("pdf_id", "page", "ord", "text", "score").withColumn("i", F.row_number().over(doc.orderBy("ord"))).withColumn("n", F.length("text"))
    rows = rows.withColumn("rank", F.row_number().over(doc.orderBy(F.col("score").desc(), "i"))).withColumn("covered", F.lit(True) if broad else F.max("score").over(doc) <= 0.25)
    pages = F.size(F.collect_set("page").over(doc))
    upto = Window.partitionBy("pdf_id", "page").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    room = F.floor(F.lit(budget // 2) / pages) - F.coalesce(F.sum("n").over(upto), F.lit(0))
    rows = rows.withColumn("held", F.when(F.col("covered"), F.greatest(F.lit(0), F.least("n", room))).otherwise(0).cast("long"))
    rows = rows.withColumn("used", F.sum("held").over(doc))
    asked = rows.where("score > 0").select("pdf_id", "page", F.posexplode(F.array(F.col("i"), F.col("i") - 1, F.col("i") + 1)).alias("k", "i"), (F.col("rank") * 3).alias("turn"))
    asked = asked.groupBy("pdf_id", "page", "i").agg(F.min(F.col("turn") + F.col("k")).alias("turn"))
    rows = rows.join(asked, ["pdf_id", "page", "i"], "left").withColumn("more", F.when(F.col("turn").isNotNull(), F.col("n") - F.col("held")).otherwise(0))
    before = F.coalesce(F.sum("more").over(doc.orderBy(F.col("turn").asc_nulls_last(), "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("take", F.col("held") + F.greatest(F.lit(0), F.least("more", budget - F.col("used") - before)))
    return rows.where("take > 0").select("pdf_id", "page", "ord", F.left("text", F.col("take").cast("int")).alias("text"))


def compact_history(messages: DataFrame) -> DataFrame:
    """The last four messages of each conversation (pdf_id, pos, role, content), shortened: 1500 and 2500 characters for the newest pair's question and answer, 700 and 1100 for the pair before."""
    back = Window.partitionBy("pdf_id").orderBy(F.col("pos").desc())
    user, newest = F.col("role") == "user", F.col("back") <= 2
    limit = F.when(newest & user, 1500).when(newest, 2500).when(user, 700).otherwise(1100)
    return messages.withColumn("back", F.row_number().over(back)).where("back <= 4").select("pdf_id", "pos", "role", excerpt("content", limit).alias("content"))


def context(passages: DataFrame) -> DataFrame:
    """The passages of each document as one text with page tags."""
    line = F.concat(F.lit("[p. "), F.col("page").cast("string"), F.lit("] "), "text")
    return passages.groupBy("pdf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))

