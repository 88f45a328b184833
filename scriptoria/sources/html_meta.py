"""Metadata of web pages: meta elements, JSON-LD, canonical links and PDF links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import doi_extension, pmid_identifier, proxied
from ..functions.text import clean, or_else, text

#: Meta names in order of preference.
NAMES = {
    "title": ("citation_title", "dc.title", "dcterms.title"),
    "authors": ("citation_author", "dc.creator", "dc.creator.personalname", "dcterms.creator"),
    "date": ("citation_publication_date", "citation_date", "dc.date", "dcterms.issued"),
    "journal": ("citation_journal_title", "prism.publicationname"),
    "doi": ("citation_doi", "dc.identifier.doi", "prism.doi"),
    "pmid": ("citation_pmid", "pmid"),
    "pdf": ("citation_pdf_url",),
}
_LD = "struct<`@type`:string,headline:string,name:string,datePublished:string,author:string,isPartOf:struct<name:string>>"


def raw_title(c: Column | str) -> Column:
    return F.regexp_extract(c, r"(?is)<title>([^<]*)</title>", 1)


def _attribute(tag: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*'([^']*)'""", 1), F.lit("")), F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""", 1))


def unescaped(c: Column) -> Column:
    out = c
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as captures: page_id, title, authors, year, journal, doi, pmid, url and pdf_url.

    meta elements win (names in any case, several of one name in page order), then an Article of JSON-LD, then the page itself.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    metas = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(F.nullif(_attribute(t, "name"), F.lit("")), _attribute(t, "property"))).alias("k"), clean(unescaped(_attribute(t, "content"))).alias("v")))
    scripts = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    rows = pages.withColumn("_m", F.filter(metas, lambda x: x["v"] != ""))
    one = F.filter(F.transform(scripts, lambda s: F.from_json(s, _LD)), lambda x: x.isNotNull())
    many = F.flatten(F.filter(F.transform(scripts, lambda s: F.coalesce(F.from_json(s, f"array<{_LD}>"), F.from_json(F.get_json_object(s, "$['@graph']"), f"array<{_LD}>"))), lambda x: x.isNotNull()))
    rows = rows.withColumn("_a", F.get(F.filter(F.concat(one, many), lambda x: F.coalesce(x["@type"].rlike("Article"), F.lit(False))), F.lit(0)))
    values = lambda k: F.transform(F.filter("_m", lambda x: x["k"].isin(*NAMES[k])), lambda x: x["v"])
    first = lambda k: F.get(values(k), F.lit(0))
    people = F.regexp_extract_all(text("_a.author"), F.lit(r'"name"\s*:\s*"([^"]*)"'), F.lit(1))
    plain = F.filter(F.array(F.when(~text("_a.author").rlike(r"^\s*[\[{]") & (text("_a.author") != ""), F.col("_a.author"))), lambda x: x.isNotNull())
    canonical = _attribute(F.regexp_extract("html", r"""(?is)(<link\b[^>]*rel\s*=\s*["']canonical["'][^>]*>)""", 1), "href")
    own_pmid = F.when(F.try_parse_url("url", F.lit("HOST")) == "pubmed.ncbi.nlm.nih.gov", F.regexp_extract(F.try_parse_url("url", F.lit("PATH")), r"^/([1-9]\d{0,8})/?$", 1))
    return rows.select(
        "page_id",
        or_else(first("title"), "_a.headline", "_a.name", clean(unescaped(raw_title("html"))), F.lit("Untitled reference")).alias("title"),
        F.array_join(F.when(F.size(values("authors")) > 0, values("authors")).when(F.size(people) > 0, people).otherwise(plain), "; ").alias("authors"),
        F.regexp_extract(or_else(first("date"), "_a.datePublished"), r"\b((?:19|20)\d{2})\b", 1).alias("year"),
        or_else(first("journal"), "_a.isPartOf.name").alias("journal"),
        doi_extension(first("doi")).alias("doi"),
        F.coalesce(pmid_identifier(or_else(first("pmid"), own_pmid)), F.lit("")).alias("pmid"),
        F.when(canonical.rlike(r"(?i)^https?://"), canonical).otherwise(F.col("url")).alias("url"),
        proxied(F.coalesce(first("pdf"), F.when(F.col("url").rlike(r"(?i)\.pdf(?:$|[?#])"), F.col("url")), F.lit("")), "url").alias("pdf_url"),
    )
