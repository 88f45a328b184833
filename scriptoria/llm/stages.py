"""The operators as stages of a pipeline: each takes documents with all their columns and gives back those that stay.

Rows are known by doc_id and a hash of their text, so that every decision is taken on what the operator saw, whatever other columns
(even of clashing names) there are. Rows of equal doc_id and text get the same decision.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import decontamination, mixing, ngram_join, quality
from . import neardup as N
from .common import stored
from .line_dedup import NO_DOC


def _keyed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs under positional names with the key columns _doc, never null, and _fp; and what undoes it."""
    names = docs.columns
    doc, text = (f"_c{names.index(c)}" for c in ("doc_id", "text"))
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = plain.withColumn("_doc", F.coalesce(F.col(doc).cast("long"), F.lit(NO_DOC))).withColumn("_fp", F.xxhash64(text))
    return rows, lambda df: df.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def _keys(df: DataFrame, doc: str = "doc_id", fp: str = "fp") -> DataFrame:
    return df.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_DOC)).alias("_doc"), F.col(fp).alias("_fp")).distinct()


def good_quality(docs: DataFrame) -> DataFrame:
    """The documents that the quality rules keep: null and empty texts and those of under ten words go, and an empty table gives an empty one. Rows of equal doc_id and text are decided alike."""
    rows, back = _keyed(docs)
    return back(rows.join(_keys(quality.judged(docs).where("kept")), ["_doc", "_fp"], "left_semi"))


def _others(rows: DataFrame, *but: str):
    """A hash of a row's own columns, which orders rows of equal doc_id and text."""
    return F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns if c.startswith("_c") and c not in but])))


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Of rows of equal _doc and _fp, where several lists those keys, the one whose columns have the smallest hash; rows that are equal in all columns are one anyway."""
    several = stored(several, "stage_several")
    if not several.limit(1).count():
        return rows
    hashed = rows.join(several, ["_doc", "_fp"], "left_semi").withColumn("_all", _others(rows))
    least = hashed.groupBy("_doc", "_fp").agg(F.min("_all").alias("_all"))
    again = hashed.join(least, ["_doc", "_fp", "_all"], "left_semi").dropDuplicates(["_doc", "_fp"]).drop("_all")
    return rows.join(several, ["_doc", "_fp"], "left_anti").unionByName(again)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class of near-duplicates the row of the smallest doc_id (of equal ones, that of the smallest hash). Texts without words all stay.

    Rows of equal doc_id and text are one: of those that differ in other columns, the one whose columns have the smallest hash stays. A null doc_id is smaller than all others; an empty table gives an empty one.
    """
    members, nodes, links, _ = ngram_join.joined(docs)
    known = nodes.select("id", F.coalesce(F.col("first.doc_id").cast("long"), F.lit(NO_DOC)).alias("_doc"), F.col("first.fp").alias("_fp"))
    first = known.join(N.components(links), "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min(F.struct("_doc", "_fp")).alias("x")).select("x._doc", "x._fp")
    stay = first.unionByName(_keys(members.where("id is null")))
    rows, back = _keyed(docs)
    several = members.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("_doc"), F.col("fp").alias("_fp")).count().where("count > 1").drop("count")
    return back(_once(rows.join(stay.distinct(), ["_doc", "_fp"], "left_semi"), several))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of a benchmark item occurs. Null and empty texts have none and stay; null and empty items have no window; empty tables give what the other leaves."""
    hit = decontamination.hits(docs, items).where("size(at) > 0")
    rows, back = _keyed(docs)
    return back(rows.join(_keys(hit), ["_doc", "_fp"], "left_anti"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _taken(text: str | None, pieces) -> list[str]:
    """For r = 1, 2, ...: the words of text that the mix takes at least r times; parts that do not touch are put on lines of their own."""
    pieces = sorted((p["first"], p["own"], p["times"]) for p in pieces)
    places = None
    out = []
    for r in range(1, max((t for *_, t in pieces), default=0) + 1):
        spans: list[list[int]] = []
        for first, own, times in pieces:
            if times >= r:
                if spans and spans[-1][1] == first:
                    spans[-1][1] = first + own
                else:
                    spans.append([first, first + own])
        if places is None:
            places = [m.span() for m in _WORD.finditer(text or "")]
        if spans == [[0, len(places)]]:
            out.append(text)
        else:
            out.append("\n".join(text[places[a][0] : places[b - 1][1]] for a, b in spans))
    return out


def remixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """What the mix takes: for each document a row for each time that any of its words is taken, with those words as its text (whole texts stay as they are).

    n_chars, where there is such a column, is the new text's length. Documents of which nothing is taken go, so do null and empty texts; an empty table gives an empty one. Rows of equal doc_id and
    text are taken in the order of a hash of their other columns.
    """
    _, pieces = mixing.mixed(docs, seed)
    per = pieces.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("_doc"), F.col("fp").alias("_fp"), "off").agg(F.collect_list(F.struct("first", "own", "times")).alias("p"))
    per = stored(per.groupBy("_doc", "_fp").agg(F.sort_array(F.collect_list(F.struct("off", "p"))).alias("copies")), "mix_pieces")
    rows, back = _keyed(docs)
    names = docs.columns
    text = f"_c{names.index('text')}"
    @F.pandas_udf("array<string>")
    def taken(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([_taken(t, p) for t, p in zip(texts, pieces, strict=True)], dtype=object)

    same = Window.partitionBy("_doc", "_fp").orderBy(_others(rows, text))
    rows = rows.join(per, ["_doc", "_fp"]).withColumn("_k", F.row_number().over(same) - 1)
    rows = rows.withColumn("_p", F.get("copies", F.col("_k"))["p"]).where("_p is not null")
    rows = rows.withColumn(text, F.explode(taken(text, "_p")))
    if "n_chars" in names:
        at = f"_c{names.index('n_chars')}"
        rows = rows.withColumn(at, F.length(text).cast(rows.schema[at].dataType))
    return back(rows)
