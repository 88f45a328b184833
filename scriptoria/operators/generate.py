"""Manuscripts rewritten in a citation style: in-text citations, bibliographies and what is to be reviewed.

Markers are parsed and resolved once and stored; items are few columns of papers, joined by key. Within a document, items get their numbers and their letters by windows over the style's sort keys, clusters are
aggregates, and all that a style writes are expressions of operators.csl.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import csl_item, metadata_warnings
from ..functions.text import xml_escaped
from ..storage import stored
from .citations import entity_records, lettered, parse_markers, resolve_markers, spliced
from .csl import ADDED, Style, tidy


class Generated(NamedTuple):
    """texts (doc_id, text, n_citations), citations (doc_id, ord, start, end, replacement, replacement_html), bibliography (doc_id, pos, record, entry, entry_html), unresolved (doc_id, pos, identifier) and warnings (doc_id, pos, subject, warning)."""

    texts: DataFrame
    citations: DataFrame
    bibliography: DataFrame
    unresolved: DataFrame
    warnings: DataFrame


def items_of(papers: DataFrame) -> DataFrame:
    """id and the columns of an item (operators.csl.ITEM, type, author, date_parts) of papers, whose optional columns may be missing; with what its metadata should be reviewed for."""
    return papers.select("id", csl_item(papers.columns, literal=False).alias("item"), metadata_warnings().alias("review")).select("id", "item.*", "review")


def _orders(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]


def lettered_items(items: DataFrame, style: Style) -> DataFrame:
    """items (doc_id, record, first, ...) with pos (their place in the bibliography), number, level (names added) and year_suffix.

    Citations of one document that read alike get further names, the fewest that tell them apart, where the style adds names, and letters in the bibliography's order, where it adds letters.
    """
    by_doc = Window.partitionBy("doc_id")
    items = items.withColumn("number", F.row_number().over(by_doc.orderBy("first"))).withColumn("year_suffix", F.lit(None).cast("string"))
    keys = style.sort_keys("bibliography") if style.bibliography is not None else None
    items = items.withColumn("pos", F.row_number().over(by_doc.orderBy(*_orders(keys), "first")) if keys else F.col("number"))
    if style.by_number:
        items = items.withColumn("number", F.col("pos"))
    adds_names = style.citation.get("disambiguate-add-names") == "true"
    adds_letters = style.citation.get("disambiguate-add-year-suffix") == "true"
    items = items.withColumn("level", F.lit(0))
    if not (adds_names or adds_letters):
        return items
    levels = range(ADDED + 1 if adds_names else 1)
    items = items.withColumn("_cites", F.array(*[F.coalesce(style.written("citation", suffixes=False, added=k), F.lit("")) for k in levels]))
    alike = lambda k: Window.partitionBy("doc_id", F.get("_cites", F.lit(k)))
    if adds_names:
        level = F.lit(0)
        for k in reversed(levels):
            level = F.when(F.count("*").over(alike(k)) == 1, k).otherwise(level)
        items = items.withColumn("level", level)
    if adds_letters:
        cite = F.get("_cites", F.col("level"))
        same = Window.partitionBy("doc_id", cite)
        items = items.withColumn("year_suffix", F.when(F.count("*").over(same) > 1, lettered(F.row_number().over(same.orderBy("pos")))))
    return items.drop("_cites")


def _by_level(style: Style, **more) -> Column:
    if style.citation.get("disambiguate-add-names") != "true":
        return style.written("citation", **more)
    out = None
    for k in range(ADDED + 1):
        c = style.written("citation", added=k, **more)
        out = F.when(F.col("level") == k, c) if out is None else out.when(F.col("level") == k, c)
    return out


def _ranges(cites: Column, delimiter: str, dash: str) -> Column:
    """cites (array of number, cite; by number) joined, with three and more numbers in a row as a range."""
    inside = lambda i: (F.get(cites, i - 1)["number"] == F.get(cites, i)["number"] - 1) & (F.get(cites, i + 1)["number"] == F.get(cites, i)["number"] + 1)
    kept = F.filter(F.transform(cites, lambda x, i: F.struct(x["cite"].alias("cite"), F.coalesce(inside(i), F.lit(False)).alias("inside"), F.coalesce(inside(i - 1), F.lit(False)).alias("after"))), lambda x: ~x["inside"])
    return F.array_join(F.transform(kept, lambda x, i: F.concat(F.when(i == 0, "").when(x["after"], dash).otherwise(delimiter), x["cite"])), "")


def clusters(cites: DataFrame, style: Style, html: bool) -> DataFrame:
    """doc_id, ord and replacement of the clusters of cites (doc_id, ord, k, number, key, cite, names, years): in the citation's order, collapsed as the style wants, inside its layout's affixes."""
    layout = style.citation.find(f"{style.ns}layout")
    delimiter, collapse = layout.get("delimiter", ""), style.citation.get("collapse", "")
    if collapse in ("year", "year-suffix", "year-suffix-ranged"):
        # works of the same people stand together, where the first of them does, and name them once
        group = cites.groupBy("doc_id", "ord", "names").agg(F.min("key").alias("key"), F.array_sort(F.collect_list(F.struct("key", "cite", "years"))).alias("c"))
        each = style.citation.get("year-suffix-delimiter") or style.citation.get("cite-group-delimiter", ", ")
        rest = F.transform(F.slice("c", 2, F.greatest(F.lit(0), F.size("c") - 1)), lambda x: x["years"])
        text = F.when(F.col("names").isNull() | (F.size("c") == 1), F.array_join(F.transform("c", lambda x: x["cite"]), delimiter)).otherwise(F.concat_ws(each, F.get("c", F.lit(0))["cite"], F.array_join(rest, each)))
        per = group.withColumn("cite", text).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("key", "cite"))).alias("c"))
    else:
        per = cites.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("key", "number", "cite"))).alias("c"))
    c = F.filter("c", lambda x: x["cite"].isNotNull())
    body = _ranges(c, delimiter, style.term("page-range-delimiter") or "–") if collapse == "citation-number" else F.array_join(F.transform(c, lambda x: x["cite"]), delimiter)
    body = F.concat(F.lit(layout.get("prefix", "")), body, F.lit(layout.get("suffix", "")))
    if html and style.superscript:
        body = F.concat(F.lit("<sup>"), body, F.lit("</sup>"))
    return per.select("doc_id", "ord", tidy(body, False).alias("replacement"))


def generate(docs: DataFrame, papers: DataFrame, style: Style, aliases: DataFrame | None = None) -> Generated:
    """docs (doc_id, text) with their markers replaced by the style's citations of papers."""
    markers = stored(parse_markers(docs))
    aliases = stored(entity_records(papers) if aliases is None else aliases)
    markers = stored(resolve_markers(markers, aliases))
    first = aliases.groupBy("record_id").agg(F.min_by("paper_id", "pos").alias("id"))
    cites = markers.where("resolved").select("doc_id", "ord", "start", "end", F.posexplode("records").alias("k", "record"))
    works = cites.groupBy("doc_id", "record").agg(F.min(F.struct("ord", "k")).alias("first"))
    works = works.join(first.withColumnRenamed("record_id", "record"), "record").join(items_of(papers), "id")
    works = stored(works)
    # of the few types that there are, those that occur: what others would read like is not compiled
    style = style.for_types(sorted(r[0] for r in works.select("type").distinct().collect()))
    works = stored(lettered_items(works, style))
    numbers = "citation-number" in (style.citation.get("collapse") or "")
    keys = style.sort_keys("citation")
    key = F.struct(*[(F.col("pos") if numbers else c).alias(f"k{i}") for i, (c, _) in enumerate(keys or [])], F.col("number").alias("n")) if keys else None
    shown = works.select(
        "doc_id", "record", "number", *([key.alias("key")] if keys else []),
        *[c.alias(f"{name}{'_html' if html else ''}") for html in (False, True) for name, c in (("cite", _cite(style, html)), ("names", _by_level(style, html=html, names_only=True)), ("years", _years(style)))],
    )
    shown = cites.join(shown, ["doc_id", "record"])
    shown = shown if keys else shown.withColumn("key", F.struct("k"))
    plain = clusters(shown, style, False)
    html = clusters(shown.select("doc_id", "ord", "number", "key", F.col("cite_html").alias("cite"), F.col("names_html").alias("names"), F.col("years_html").alias("years")), style, True)
    places = markers.where("resolved").select("doc_id", "ord", "start", "end")
    plain = places.join(plain, ["doc_id", "ord"])  # none of these is made before it is asked for
    done = plain.join(html.withColumnRenamed("replacement", "replacement_html"), ["doc_id", "ord"])
    counts = places.groupBy("doc_id").agg(F.count("*").alias("n_citations"))
    texts = spliced(docs, plain.select("doc_id", "start", "end", "replacement")).join(counts, "doc_id", "left").select("doc_id", "text", F.coalesce("n_citations", F.lit(0)).alias("n_citations"))
    entries = works.where("false") if style.bibliography is None else works
    none = F.lit(None).cast("string")
    entry = lambda html: none if style.bibliography is None else F.coalesce(style.written("bibliography", html), F.lit(""))
    entries = entries.select("doc_id", "pos", "record", entry(False).alias("entry"), entry(True).alias("entry_html"))
    missed = markers.select("doc_id", "ord", F.posexplode("misses").alias("k", "identifier")).groupBy("doc_id", "identifier").agg(F.min(F.struct("ord", "k")).alias("at"))
    by_place = Window.partitionBy("doc_id").orderBy("at")
    missed = missed.select("doc_id", F.row_number().over(by_place).alias("pos"), "identifier")
    return Generated(texts, done, entries, missed, reviewed(markers, works, aliases))


def _cite(style: Style, html: bool) -> Column:
    """What an item is cited by; where the style writes nothing for it, its title, or the record's name."""
    return F.coalesce(_by_level(style, html=html), F.nullif(xml_escaped("title") if html else F.col("title"), F.lit("")), F.col("record"))


def _years(style: Style) -> Column:
    return F.concat(F.coalesce(F.get("date_parts", F.lit(0)).cast("string"), F.lit(style.term("no date", "short"))), F.coalesce("year_suffix", F.lit("")))


def reviewed(markers: DataFrame, works: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, pos, subject and warning, each once: identifiers that mean several records first, by where they stand, then what cited records should be reviewed for."""
    several = aliases.groupBy("key").agg(F.count_distinct("record_id").alias("n")).where("n > 1")
    ids = markers.select("doc_id", "ord", F.posexplode("identifiers").alias("k", "i")).select("doc_id", "ord", "k", F.col("i.key").alias("key"))
    doubtful = ids.join(several, "key").groupBy("doc_id", "key").agg(F.min(F.struct(F.lit(0).alias("group"), "ord", "k", F.lit(0).alias("r"))).alias("at"))
    doubtful = doubtful.select("doc_id", "at", F.col("key").alias("subject"), F.lit("means several records").alias("warning"))
    own = works.select("doc_id", "record", "first", F.posexplode("review").alias("r", "warning"))
    own = own.select("doc_id", F.struct(F.lit(1).alias("group"), F.col("first.ord").alias("ord"), F.col("first.k").alias("k"), "r").alias("at"), F.col("record").alias("subject"), "warning")
    return doubtful.unionByName(own).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("pos"), "subject", "warning")
