"""The paper library: filters, sorting, counts, import without duplicates, captures and changes.

Every table has lib_pos, the place in the library, as the order of papers means something.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import CSL_TYPES, arxiv_identifier, doi_capture, doi_client, safe_url
from ..functions.text import like, or_else, stripped, text
from ..storage import stored
from .graph import components

STATUSES = ("To read", "Reading", "Finished")
COLOURS = ("yellow", "green", "blue", "pink", "purple")
REQUIRED = ("id", "title", "authors", "year", "journal", "doi", "collection", "tags", "status", "notes")
UNFILED = "Unfiled"
_UUID = r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"


def in_view(papers: DataFrame, view: str = "All", status: str = "All", search: str = "") -> DataFrame:
    """A view (All, Starred, Reading list or collection:NAME), a status or All, and a substring in title, authors, doi, pmid, tags or journal."""
    kept = papers
    if view == "Starred":
        kept = kept.where("starred")
    elif view == "Reading list":
        kept = kept.where(F.col("status") != "Finished")
    elif view.startswith("collection:"):
        kept = kept.where(F.col("collection") == view.split(":", 1)[1])
    if status != "All":
        kept = kept.where(F.col("status") == status)
    if search:
        hay = F.lower(F.concat_ws(" ", *[text(c) for c in ("title", "authors", "doi", "pmid", "tags", "journal")]))
        kept = kept.where(F.contains(hay, F.lit(search.lower())))
    return kept


def ranked(papers: DataFrame, by: str = "Recent") -> DataFrame:
    """papers with rank, from 1: Recent is library order, Title ascending and Year descending, both as texts in Unicode collation."""
    order = {"Recent": [F.col("lib_pos")], "Title": [F.collate("title", "UNICODE").asc(), F.col("lib_pos")], "Year": [F.collate("year", "UNICODE").desc(), F.col("lib_pos")]}[by]
    return ranked_by(papers, *order).withColumnRenamed("_rank", "rank")


def ranked_by(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with _rank, from 1 on, by ranges: only the partitions' sizes are summed up in one place."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = stored(rows)
    base = rows.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_inner", inner).join(base, "_part").withColumn("_rank", (F.col("_base") + F.col("_inner")).cast("long")).drop("_part", "_base", "_inner")


def view_counts(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("n_all"), F.count_if("starred").alias("starred"), F.count_if(F.col("status") != "Finished").alias("reading_list"), F.count_if(F.col("status") == "Reading").alias("reading"))


def collection_counts(papers: DataFrame, collections: DataFrame) -> DataFrame:
    """Papers of every collection, the empty ones included."""
    names = collections.select("collection").union(papers.select("collection")).distinct()
    return names.join(papers.groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n_papers"))


def valid(papers: DataFrame) -> Column:
    """All required texts there, title and id not blank, starred a boolean, a known status, and valid highlights if there are any."""
    have = [F.col(c).isNotNull() for c in REQUIRED]
    filled = [stripped(text(c)) != "" for c in ("id", "title")]
    ok = [*have, *filled, F.col("starred").isNotNull(), F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))]
    if "highlights" in papers.columns:
        ok.append(F.coalesce(valid_highlights(F.col("highlights")), F.lit(True)))
    return reduce(lambda a, b: a & b, ok)


def valid_citation_fields() -> Column:
    """The server's further rules for pmid, arXiv id, type and date parts."""
    return (
        ((text("pmid") == "") | like(text("pmid"), r"^[1-9]\d{0,8}$"))
        & ((text("arxivId") == "") | arxiv_identifier("arxivId").isNotNull())
        & ((text("cslType") == "") | F.col("cslType").isin(*CSL_TYPES))
    )


def checked_papers(papers: DataFrame, files: DataFrame) -> DataFrame:
    """papers with problem, the first rule of a server's that a row breaks, null for rows that may be stored. files: file_id of the stored PDFs.

    Optional columns may be missing. An attachment must have the form of an id and be among files, a semi-join by key; addresses must be safe ones; a null pdfId is no attachment, an empty one is no id.
    """
    has = set(papers.columns)
    opt = lambda c, rule, else_=True: rule if c in has else F.lit(else_)
    of = lambda c: F.col(c) if c in has else F.lit(None)
    stored_files = files.select(F.lower("file_id").alias("_file")).distinct().withColumn("_stored", F.lit(True))
    rows = papers.withColumn("_pdf", F.lower(of("pdfId").cast("string"))).join(stored_files, F.col("_pdf") == F.col("_file"), "left")
    web = lambda c: opt(c, (text(c) == "") | (safe_url(c) != ""))
    required = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED]) & (text("id") != "") & (stripped(text("title")) != "") & (stripped(text("collection")) != "")
    rules = [
        ("incomplete", required & F.col("starred").isNotNull()),
        ("status", F.col("status").isin(*STATUSES)),
        ("highlights", opt("highlights", valid_highlights(F.col("highlights")))),
        ("pmid", opt("pmid", (text("pmid") == "") | like("pmid", r"^[1-9]\d{0,8}$"))),
        ("arxivId", opt("arxivId", (text("arxivId") == "") | arxiv_identifier("arxivId").isNotNull())),
        ("type", opt("cslType", (text("cslType") == "") | F.col("cslType").isin(*CSL_TYPES))),
        ("authors", opt("cslAuthors", F.size("cslAuthors") <= 1000)),
        ("date", opt("dateParts", F.size("dateParts").between(0, 3))),
        ("address", web("sourceUrl") & web("pdfUrl")),
        ("pdf id", F.col("_pdf").isNull() | like("_pdf", _UUID)),
        ("pdf missing", F.col("_pdf").isNull() | F.col("_stored")),
    ]
    lists = {"highlights": "highlights", "authors": "cslAuthors", "date": "dateParts"}
    broken = F.coalesce(*[F.when(~F.coalesce(rule, of(lists[name]).isNull() if name in lists else F.lit(False)), F.lit(name)) for name, rule in rules])
    return rows.withColumn("problem", broken).drop("_pdf", "_file", "_stored")


def valid_highlight(h: Column) -> Column:
    n = F.length(h["quote"])
    rules = [
        stripped(h["id"]) != "",
        F.length(h["id"]) <= 128,
        F.regexp_like(h["pdfId"], F.lit(_UUID)),
        h["page"].between(1, 500),
        h["paragraph"].between(0, 4999),
        h["start"] >= 0,
        h["end"] > h["start"],
        h["end"] <= 50_000,
        n.between(1, 10_000),
        h["end"] - h["start"] == n,
        F.length(h["createdAt"]) <= 64,
        F.try_to_timestamp(h["createdAt"]).isNotNull(),
        h["color"].isNull() | h["color"].isin(*COLOURS),
        h["note"].isNull() | (F.length(h["note"]) <= 10_000),
    ]
    return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


def valid_highlights(hs: Column, most: int = 5000) -> Column:
    return (F.size(hs) <= most) & F.forall(hs, valid_highlight) & (F.size(F.array_distinct(F.transform(hs, lambda h: h["id"]))) == F.size(hs))


def import_key() -> Column:
    """What an imported paper is known by: its DOI, else its address, else its id."""
    return (
        F.when(text("doi") != "", F.concat(F.lit("doi:"), F.lower(doi_client("doi"))))
        .when(text("sourceUrl") != "", F.concat(F.lit("url:"), "sourceUrl"))
        .otherwise(F.concat(F.lit("id:"), "id"))
    )


def not_in_library(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming without the papers whose id, key or pmid the library has: three equi-joins."""
    old = existing.withColumn("_key", import_key())
    new = incoming.withColumn("_key", import_key())
    new = new.join(old.select("id"), "id", "left_anti").join(old.select("_key"), "_key", "left_anti")
    known = old.where(text("pmid") != "").select(F.col("pmid").alias("_pmid"))
    return new.join(known, F.col("pmid") == F.col("_pmid"), "left_anti").drop("_key")


def _accepted(rows: pd.DataFrame) -> pd.DataFrame:
    """In order: a paper is taken if its id, key and pmid are new among those taken so far; what is refused leaves no trace."""
    seen: set = set()
    kept = []
    for r in rows.sort_values("lib_pos").itertuples():
        own = {("i", r.id), ("k", r.key)} | ({("p", r.pmid)} if r.pmid else set())
        if not own & seen:
            seen |= own
            kept.append(r.lib_pos)
    return pd.DataFrame({"lib_pos": kept})


def deduplicated(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The papers that an import adds. Papers that share no id, key or pmid, even over others, don't touch: one that shares none is taken, and components of the rest bound the groups that are walked in order."""
    new = not_in_library(existing, incoming).withColumn("_key", import_key())
    me = F.concat(F.lit("#"), F.col("lib_pos").cast("string"))
    keys = F.filter(F.array(F.concat(F.lit("i:"), "id"), F.concat(F.lit("k:"), "_key"), F.when(text("pmid") != "", F.concat(F.lit("p:"), "pmid"))), lambda x: x.isNotNull())
    keyed = new.select("lib_pos", F.explode(keys).alias("k"))
    edges = stored(keyed.join(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "k"))
    parts = components(edges.select(me.alias("a"), F.col("k").alias("b"))).withColumnRenamed("id", "part")
    placed = new.select(me.alias("node"), "id", F.col("_key").alias("key"), text("pmid").alias("pmid"), "lib_pos").join(parts, F.col("node") == F.col("part"))
    kept = placed.select("root", "id", "key", "pmid", "lib_pos").groupBy("root").applyInPandas(lambda p: _accepted(p), "lib_pos long")
    new = new.drop("_key")
    return new.join(edges, "lib_pos", "left_anti").unionByName(new.join(kept, "lib_pos", "left_semi"))


def captured(papers: DataFrame, captures: DataFrame, fill: tuple = ("pmid", "arxivId", "cslType", "volume", "issue", "pages")) -> DataFrame:
    """For each capture (capture_id and a paper's fields) the paper after it: match_id is the first paper of equal pmid, DOI or address, of which only empty fields are
    filled; null means a new paper, which goes first. The OR of the three is three equi-joins, each paper taken once by its place."""
    lib = papers.select("id", "lib_pos", F.nullif(text("pmid"), F.lit("")).alias("k1"), F.nullif(doi_capture("doi"), F.lit("")).alias("k2"), F.nullif(text("sourceUrl"), F.lit("")).alias("k3"))
    cap = captures.select("capture_id", F.nullif(text("pmid"), F.lit("")).alias("k1"), F.nullif(doi_capture("doi"), F.lit("")).alias("k2"), F.nullif(text("sourceUrl"), F.lit("")).alias("k3"))
    hits = reduce(DataFrame.unionByName, [cap.join(lib.select("id", "lib_pos", k), k).select("capture_id", "id", "lib_pos") for k in ("k1", "k2", "k3")])
    first = hits.groupBy("capture_id").agg(F.min_by("id", "lib_pos").alias("match_id"))
    old = papers.select(F.col("id").alias("match_id"), F.struct(*[c for c in fill if c in papers.columns], "title", "doi").alias("old"))
    rows = captures.join(first, "capture_id", "left").join(old, "match_id", "left")
    both = [c for c in fill if c in papers.columns and c in captures.columns]
    return rows.select(
        "capture_id",
        "match_id",
        F.col("match_id").isNotNull().alias("duplicate"),
        F.when(F.col("match_id").isNotNull(), F.col("old.title")).otherwise(text("title")).alias("title"),
        F.when(F.col("match_id").isNotNull(), F.col("old.doi")).otherwise(doi_capture("doi")).alias("doi"),
        *[F.when(F.col("match_id").isNotNull(), or_else(f"old.{c}", c)).otherwise(text(c)).alias(c) for c in both],
    )


def with_collection(papers: DataFrame, old: str, new: str | None) -> DataFrame:
    """A collection renamed, or deleted (new is None): its papers go to UNFILED."""
    if new is not None and (not new.strip() or len(new.strip()) > 200 or new.strip() == UNFILED):
        raise ValueError("choose a valid collection name")
    return papers.withColumn("collection", F.when(F.col("collection") == old, F.lit(UNFILED if new is None else new.strip())).otherwise(F.col("collection")))


def opened(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Papers whose PDF was opened go from To read to Reading."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return papers.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "To read"), F.lit("Reading")).otherwise(F.col("status"))).drop("_hit")


def upserted(papers: DataFrame, edits: DataFrame) -> DataFrame:
    """papers after edits (same columns): titles trimmed, blank collections UNFILED, DOIs normalised; an edit of a known id keeps that paper's notes and place, others go first, the last edit (by lib_pos) at the top.
    An edit is refused if another paper has its pmid or its lower-cased DOI, or if an earlier edit of the batch, of another id, does; of several edits of an id the last one counts."""
    new = edits.withColumns({"title": stripped("title"), "collection": or_else(stripped(text("collection")), F.lit(UNFILED)), "doi": doi_client("doi")})
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("lib_pos").desc()))).where("_n = 1").drop("_n")
    new = new.withColumns({"_pmid": F.nullif(text("pmid"), F.lit("")), "_doi": F.nullif(F.lower("doi"), F.lit(""))})
    for key in ("_pmid", "_doi"):
        others = papers.select(F.col("id").alias("_id"), F.nullif(text("pmid") if key == "_pmid" else F.lower(doi_client("doi")), F.lit("")).alias("_key"))
        new = new.join(others, (F.col(key) == F.col("_key")) & (F.col("id") != F.col("_id")), "left_anti")
        first = F.when(F.col(key).isNotNull(), F.min("lib_pos").over(Window.partitionBy(key)))
        new = new.withColumn("_first", first).where("_first is null or _first = lib_pos").drop("_first")
    old = papers.select(F.col("id").alias("_id"), F.col("notes").alias("_notes"), F.col("lib_pos").alias("_pos"))
    top = papers.agg(F.coalesce(F.min("lib_pos"), F.lit(0)).alias("_top"))
    new = stored(new.drop("_pmid", "_doi").join(old, F.col("id") == F.col("_id"), "left").join(F.broadcast(top)))  # one row
    added = ranked_by(new.where("_id is null"), "lib_pos").withColumn("lib_pos", F.col("_top") - F.col("_rank")).drop("_rank")
    kept = new.where("_id is not null").withColumns({"notes": F.coalesce("_notes", "notes"), "lib_pos": F.col("_pos")})
    new = kept.select(papers.columns).unionByName(added.select(papers.columns))
    return papers.join(new.select("id"), "id", "left_anti").select(papers.columns).unionByName(new)


def exported(papers: DataFrame) -> DataFrame:
    """Papers as portable JSON texts, without their attachments."""
    return papers.select("lib_pos", F.to_json(F.struct(*[c for c in papers.columns if c not in ("pdfId", "pdfName", "lib_pos")])).alias("json"))
