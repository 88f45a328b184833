"""Metadata records of PubMed (XML), Crossref (JSON) and arXiv (Atom)."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import arxiv_identifier, crossref_type, date_parts, doi_identifier, doi_pubmed, month_number, names_text
from ..functions.text import clean, or_else, text

PUBMED_BYTES = 4 * 1024 * 1024
_NONE = "cast(null as string)"


#: Records of a batch that goes back to Spark.
_BATCH = 500


def _root(xml: str | None, name: str) -> ET.Element | None:
    """A record's element; none where it is not well-formed or of another name. Prefixes are parts of names."""
    tree, parser = ET.TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, tree.end, tree.data
    try:
        parser.Parse(xml or "", True)
        root = tree.close()
    except (expat.ExpatError, AssertionError, UnicodeError):
        return None
    return root if root.tag == name else None


def _said(at: ET.Element | None) -> str:
    return "" if at is None else "".join(at.itertext())


def _read(rows: DataFrame, name: str, one: dict[str, str], many: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """rows with x, the texts of the record in their column r, instead of it; null where that is not well-formed. A record is parsed once.

    one: what the first element at a path says, empty if there is none. many: for each element at a path, what the first elements at paths from there say, as an array of structs (v0, v1, ...).
    """
    kept = [c for c in rows.columns if c != "r"]
    texts = pa.list_(pa.struct([("v0", pa.string()), ("v1", pa.string()), ("v2", pa.string()), ("v3", pa.string())]))
    x = pa.struct([*[(c, pa.string()) for c in one], *[(c, texts) for c in many]])

    def values(xml: str | None) -> dict | None:
        if (root := _root(xml, name)) is None:
            return None
        return {c: _said(root.find(path)) for c, path in one.items()} | {c: [{f"v{k}": _said(e.find(of)) for k, of in enumerate(inner)} for e in root.iterfind(path)] for c, (path, inner) in many.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                b = whole.slice(at, _BATCH)
                made = pa.array([values(v) for v in b.column("r").to_pylist()], x)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], made], [*kept, "x"])

    shown = "array<struct<v0:string,v1:string,v2:string,v3:string>>"
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*types, f"x struct<{','.join([*[f'{c}:string' for c in one], *[f'{c}:{shown}' for c in many]])}>"]))


def _author(a: Column) -> Column:
    group, family, given = clean(a["v0"]), clean(a["v1"]), or_else(clean(a["v2"]), clean(a["v3"]))
    none = F.lit(None).cast("string")
    return F.when(group != "", F.struct(none.alias("family"), none.alias("given"), group.alias("literal"))).when(family != "", F.struct(family.alias("family"), given.alias("given"), none.alias("literal"))).otherwise(F.struct(none.alias("family"), none.alias("given"), given.alias("literal")))


_ARTICLE = "MedlineCitation/Article"
_ISSUE = f"{_ARTICLE}/Journal/JournalIssue"
_PUBMED = {
    "pmid": "MedlineCitation/PMID", "title": f"{_ARTICLE}/ArticleTitle", "journal": f"{_ARTICLE}/Journal/Title", "abbreviation": f"{_ARTICLE}/Journal/ISOAbbreviation", "year": f"{_ISSUE}/PubDate/Year", "medline": f"{_ISSUE}/PubDate/MedlineDate", "month": f"{_ISSUE}/PubDate/Month",
    "day": f"{_ISSUE}/PubDate/Day", "doi": "PubmedData/ArticleIdList/ArticleId[@IdType='doi']", "located": f"{_ARTICLE}/ELocationID[@EIdType='doi']", "volume": f"{_ISSUE}/Volume", "issue": f"{_ISSUE}/Issue", "pages": f"{_ARTICLE}/Pagination/MedlinePgn",
}


def pubmed(responses: DataFrame) -> DataFrame:
    """Papers of PubMed responses (response_id, xml). Responses with entities, an internal DTD or over PUBMED_BYTES are refused (no rows); a public DTD is taken off, nothing is fetched. Records that are not well-formed are left out."""
    safe = ~F.col("xml").rlike(r"(?i)<!ENTITY\b") & ~F.col("xml").rlike(r"(?i)<!DOCTYPE[^>]*\[") & (F.octet_length("xml") <= PUBMED_BYTES)
    rows = responses.where(safe).select("response_id", F.regexp_replace("xml", r"(?i)<!DOCTYPE[^>]*>", "").alias("xml"))
    rows = rows.select("response_id", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)(<PubmedArticle\b.*?</PubmedArticle>)"), F.lit(1))).alias("pos", "r"))
    rows = _read(rows, "PubmedArticle", _PUBMED, {"authors": (".//Author", ("CollectiveName", "LastName", "ForeName", "Initials"))})
    x = lambda name: clean(F.col(f"x.{name}"))
    authors = F.filter(F.transform("x.authors", _author), lambda a: or_else(a["family"], a["literal"]) != "")
    rows = rows.where(x("pmid").rlike(r"^[1-9]\d{0,8}$")).select(
        "response_id",
        "pos",
        x("pmid").alias("pmid"),
        x("title").alias("title"),
        authors.alias("cslAuthors"),
        x("journal").alias("journal"),
        x("abbreviation").alias("journalAbbreviation"),
        or_else(x("year"), F.regexp_extract(x("medline"), r"\b(\d{4})\b", 1)).alias("year"),
        month_number(x("month")).alias("_m"),
        x("day").try_cast("int").alias("_d"),
        doi_pubmed(or_else("x.doi", "x.located")).alias("doi"),
        x("volume").alias("volume"),
        x("issue").alias("issue"),
        x("pages").alias("pages"),
    )
    return rows.withColumn("dateParts", date_parts(F.col("year").try_cast("int"), F.col("_m"), F.col("_d"))).withColumn("authors", names_text(F.col("cslAuthors"))).withColumn("sourceUrl", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))).drop("_m", "_d")


_DATE = "struct<`date-parts`:array<array<int>>>"
_CROSSREF = (
    "struct<message:struct<DOI:string,title:array<string>,author:array<struct<family:string,given:string,name:string>>,"
    f"published:{_DATE},`published-print`:{_DATE},`published-online`:{_DATE},issued:{_DATE},type:string,`container-title`:array<string>,`short-container-title`:array<string>,"
    "volume:string,issue:string,page:string,`article-number`:string,publisher:string,`publisher-location`:string,event:struct<name:string>>>"
)


def crossref(responses: DataFrame) -> DataFrame:
    """Papers of Crossref responses (doi, json): the record's DOI must be the one asked for, and it needs a title."""
    rows = responses.select(doi_identifier("doi").alias("doi"), F.from_json("json", _CROSSREF)["message"].alias("m"))
    m = F.col("m")
    first = lambda c: clean(F.get(c, F.lit(0)))
    parts = F.get(F.coalesce(m["published"], m["published-print"], m["published-online"], m["issued"])["date-parts"], F.lit(0))
    year = F.when(F.get(parts, F.lit(0)) > 0, F.get(parts, F.lit(0)))
    none = F.lit(None).cast("string")
    author = lambda a: F.when(clean(a["family"]) != "", F.struct(clean(a["family"]).alias("family"), clean(a["given"]).alias("given"), none.alias("literal"))).otherwise(F.struct(none.alias("family"), none.alias("given"), or_else(clean(a["name"]), clean(a["given"])).alias("literal")))
    people = F.filter(F.transform(F.coalesce(m["author"], F.array().cast("array<struct<family:string,given:string,name:string>>")), author), lambda a: or_else(a["family"], a["literal"]) != "")
    rows = rows.where((doi_identifier(m["DOI"]) == F.col("doi")) & (first(m["title"]) != ""))
    return rows.select(
        "doi",
        first(m["title"]).alias("title"),
        people.alias("cslAuthors"),
        first(m["container-title"]).alias("journal"),
        first(m["short-container-title"]).alias("journalAbbreviation"),
        text(year.cast("string")).alias("year"),
        date_parts(year, F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).alias("dateParts"),
        clean(m["volume"]).alias("volume"),
        clean(m["issue"]).alias("issue"),
        clean(F.coalesce(m["page"], m["article-number"])).alias("pages"),
        clean(m["publisher"]).alias("publisher"),
        clean(m["publisher-location"]).alias("publisherPlace"),
        clean(m["event"]["name"]).alias("eventTitle"),
        crossref_type(m["type"]).alias("cslType"),
        F.concat(F.lit("https://doi.org/"), "doi").alias("sourceUrl"),
    ).withColumn("authors", names_text(F.col("cslAuthors")))


def arxiv(responses: DataFrame) -> DataFrame:
    """Papers of arXiv answers (arxiv_id, xml): exactly one entry, of the id asked for, with a title, and well-formed; full names are kept as they are."""
    rows = responses.where(~F.col("xml").rlike(r"(?i)<!DOCTYPE\b|<!ENTITY\b")).select(arxiv_identifier("arxiv_id").alias("arxivId"), F.regexp_extract_all("xml", F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1)).alias("e"))
    rows = rows.where(F.size("e") == 1).select("arxivId", F.regexp_replace(F.regexp_replace(F.get("e", F.lit(0)), r"(</?)[a-z]+:", "$1"), r"\sxmlns(?::\w+)?=(\"[^\"]*\"|'[^']*')", "").alias("r"))
    rows = _read(rows, "entry", {"id": "id", "title": "title", "published": "published", "doi": "doi"}, {"names": ("author/name", (".",))})
    own, title = clean("x.id"), clean("x.title")
    rows = rows.where(own.rlike(r"(?i)^https?://arxiv\.org/abs/") & (arxiv_identifier(own) == F.col("arxivId")) & (title != ""))
    date = F.regexp_extract(clean("x.published"), r"^(\d{4}-\d{2}-\d{2})T", 1)
    part = lambda k: F.get(F.split(date, "-"), F.lit(k)).try_cast("int")
    fine = part(1).between(1, 12) & part(2).between(1, 31)
    none = F.lit(None).cast("string")
    names = F.filter(F.transform("x.names", lambda n: clean(n["v0"])), lambda n: n != "")
    rows = rows.select(
        "arxivId",
        title.alias("title"),
        F.coalesce(doi_identifier(clean("x.doi")), F.lit("")).alias("doi"),
        F.transform(names, lambda n: F.struct(none.alias("family"), none.alias("given"), n.alias("literal"))).alias("cslAuthors"),
        F.lit("arXiv").alias("journal"),
        F.when(fine, F.array(part(0), part(1), part(2))).otherwise(F.array().cast("array<int>")).alias("dateParts"),
        F.lit("article").alias("cslType"),
        F.concat(F.lit("https://arxiv.org/abs/"), "arxivId").alias("sourceUrl"),
    )
    return rows.withColumn("year", text(F.get("dateParts", F.lit(0)).cast("string"))).withColumn("authors", names_text(F.col("cslAuthors")))


def looked_up(identifiers: DataFrame, pubmed_rows: DataFrame, crossref_rows: DataFrame, arxiv_rows: DataFrame) -> DataFrame:
    """identifiers (type, value) with title and source of the record that answers: PMIDs and DOIs of PubMed first, DOIs then of Crossref, preprints of arXiv. Three look-up joins on fixed tables of answers."""
    i = identifiers.select("type", "value").distinct()
    by_pmid = i.where("type = 'pmid'").join(pubmed_rows.select(F.col("pmid").alias("value"), "title"), "value").select("type", "value", "title", F.lit(0).alias("rank"))
    by_doi = i.where("type = 'doi'").join(pubmed_rows.select(F.col("doi").alias("value"), "title"), "value").select("type", "value", "title", F.lit(0).alias("rank"))
    by_crossref = i.where("type = 'doi'").join(crossref_rows.select(F.col("doi").alias("value"), "title"), "value").select("type", "value", "title", F.lit(1).alias("rank"))
    by_arxiv = i.where("type = 'arxiv'").join(arxiv_rows.select(F.col("arxivId").alias("value"), "title"), "value").select("type", "value", "title", F.lit(2).alias("rank"))
    best = by_pmid.unionByName(by_doi).unionByName(by_crossref).unionByName(by_arxiv).groupBy("type", "value").agg(F.min(F.struct("rank", "title")).alias("x"))
    names = F.array(F.lit("pubmed"), F.lit("crossref"), F.lit("arxiv"))
    return i.join(best, ["type", "value"], "left").select("type", "value", "x.title", F.get(names, F.col("x.rank")).alias("source"))
