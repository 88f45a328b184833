"""Queries over records in the formats of metadata services, reference files and web pages: Spark writes a record for each row of a table, the reader reads it, and SQL has what the row says."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import reading
from ..sources import html_meta, library, records
from . import surrogates as S
from .queries import B, query, read

_MONTH = "element_at(array('Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'), CAST(p_size % 12 + 1 AS INT))"
#: Every fourth response has a date as a text; every fourth an entity, and every fourth an id that is none, which are refused.
_PUBMED = f"""
SELECT CAST(p_partkey AS STRING) AS response_id, concat('<?xml version="1.0"?>', CASE p_partkey % 4 WHEN 2 THEN '<!ENTITY x "y">' ELSE '<!DOCTYPE PubmedArticleSet PUBLIC "-//NLM//DTD" "x.dtd">' END,
  '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">', CASE p_partkey % 4 WHEN 3 THEN '0' ELSE '3' END, CAST(p_partkey AS STRING), '</PMID><Article><Journal><JournalIssue><Volume>', CAST(p_size AS STRING), '</Volume><PubDate>',
  CASE p_partkey % 4 WHEN 1 THEN concat('<MedlineDate>', CAST(1975 + p_size AS STRING), ' Mar-Apr</MedlineDate>') ELSE concat('<Year>', CAST(1975 + p_size AS STRING), '</Year><Month>', {_MONTH}, '</Month><Day>', CAST(p_partkey % 28 + 1 AS STRING), '</Day>') END,
  '</PubDate></JournalIssue></Journal><ArticleTitle>A <i>', p_name, '</i>  title</ArticleTitle><ELocationID EIdType="doi">10.1000/LOC.', CAST(p_partkey AS STRING), '</ELocationID><AuthorList><Author><LastName>', p_brand,
  '</LastName><ForeName>Ada</ForeName></Author><Author><CollectiveName>Group ', CAST(p_size AS STRING), '</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList>',
  CASE p_partkey % 4 WHEN 0 THEN concat('<ArticleId IdType="doi">10.1000/ID.', CAST(p_partkey AS STRING), '</ArticleId>') ELSE '' END, '</ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>') AS xml
FROM {{part}}
"""
_WHO = "p_brand || ', Ada; Group ' || p_size AS authors"


def _written(spark, d, sql: str, spread: bool = False):
    """A table of texts; quotation marks inside of them are none of names."""
    return S.spark_table(spark, d, sql.replace('"', "\\u0022"), spread)


_date = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")


@query(
    f"SELECT '3' || p_partkey AS pmid, 'A ' || p_name || ' title' AS title, {_WHO}, CAST(1975 + p_size AS VARCHAR) AS year, 1975 + p_size || CASE p_partkey % 4 WHEN 1 THEN '' ELSE '-' || (p_size % 12 + 1) || '-' || (p_partkey % 28 + 1) END AS date, "
    "CASE p_partkey % 4 WHEN 0 THEN '10.1000/id.' ELSE '10.1000/loc.' END || p_partkey AS doi, CAST(p_size AS VARCHAR) AS volume FROM part WHERE p_partkey % 4 < 2"
)
def pubmed_projection(spark, d):
    return records.pubmed(_written(spark, d, _PUBMED, spread=True)).select("pmid", "title", "authors", "year", _date("dateParts").alias("date"), "doi", "volume")


#: Every third answer is of another DOI than the one asked for; dates of conference papers have a thirteenth month.
_CROSSREF = """
SELECT concat('https://doi.org/10.1000/cr.', CAST(p_partkey + CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 0 END AS STRING)) AS doi,
  to_json(named_struct('message', named_struct('DOI', concat('10.1000/CR.', CAST(p_partkey AS STRING)), 'title', array(concat('  ', p_name, '   twice ')), 'author', array(named_struct('family', p_brand, 'given', 'Ada', 'name', CAST(NULL AS STRING)), named_struct('family', CAST(NULL AS STRING), 'given', CAST(NULL AS STRING), 'name', concat('Group ', CAST(p_size AS STRING)))),
    CASE p_partkey % 2 WHEN 0 THEN 'published' ELSE 'published' END, named_struct('date-parts', array(array(1975 + p_size, CASE p_partkey % 3 WHEN 2 THEN 13 ELSE p_size % 12 + 1 END, p_partkey % 28 + 1))),
    'type', CASE p_partkey % 3 WHEN 2 THEN 'proceedings-article' ELSE 'journal-article' END, 'container-title', array(p_type), 'event', named_struct('name', CASE p_partkey % 3 WHEN 2 THEN concat('Days of ', p_type) END)))) AS json
FROM {part}
""".replace("CASE p_partkey % 2 WHEN 0 THEN 'published' ELSE 'published' END", "'published'")


@query(
    f"SELECT '10.1000/cr.' || p_partkey AS doi, p_name || ' twice' AS title, {_WHO}, p_type AS journal, CAST(1975 + p_size AS VARCHAR) AS year, 1975 + p_size || CASE p_partkey % 3 WHEN 2 THEN '' ELSE '-' || (p_size % 12 + 1) || '-' || (p_partkey % 28 + 1) END AS date, "
    "CASE p_partkey % 3 WHEN 2 THEN 'paper-conference' ELSE 'article-journal' END AS \"cslType\", CASE p_partkey % 3 WHEN 2 THEN 'Days of ' || p_type ELSE '' END AS \"eventTitle\" FROM part WHERE p_partkey % 3 > 0"
)
def crossref_projection(spark, d):
    return records.crossref(_written(spark, d, _CROSSREF)).select("doi", "title", "authors", "journal", "year", _date("dateParts").alias("date"), "cslType", "eventTitle")


#: Every third answer has two entries, and every third an entry of another id.
_ENTRY = "concat('<entry><id>http://arxiv.org/abs/2101.', CAST(10000 + p_partkey % 80000 + CASE p_partkey % 3 WHEN 1 THEN 1 ELSE 0 END AS STRING), 'v2</id><published>', CAST(1975 + p_size AS STRING), '-05-09T10:00:00Z</published><title>Deep\\n ', p_name, '</title><author><name>Ada Berg</name></author><author><name>', p_brand, '</name></author><arxiv:doi xmlns:arxiv=\"http://arxiv.org/schemas/atom\">10.1000/AX.', CAST(p_partkey AS STRING), '</arxiv:doi></entry>')"
_ARXIV = f"SELECT concat('arXiv:2101.', CAST(10000 + p_partkey % 80000 AS STRING)) AS arxiv_id, concat('<feed xmlns=\"http://www.w3.org/2005/Atom\">', {_ENTRY}, CASE p_partkey % 3 WHEN 0 THEN {_ENTRY} ELSE '' END, '</feed>') AS xml FROM {{part}}"


@query("SELECT '2101.' || (10000 + p_partkey % 80000) AS \"arxivId\", 'Deep ' || p_name AS title, 'Ada Berg; ' || p_brand AS authors, CAST(1975 + p_size AS VARCHAR) AS year, 1975 + p_size || '-5-9' AS date, '10.1000/ax.' || p_partkey AS doi FROM part WHERE p_partkey % 3 = 2")
def arxiv_projection(spark, d):
    return records.arxiv(_written(spark, d, _ARXIV, spread=True)).select("arxivId", "title", "authors", "year", _date("dateParts").alias("date"), "doi")


#: A file for each brand; every fifth record has no title.
_RIS = """
SELECT p_brand AS file, array_join(transform(sort_array(collect_list(named_struct('k', p_partkey, 'r', concat('TY  - ', CASE p_partkey % 4 WHEN 0 THEN 'CPAPER' ELSE 'JOUR' END, '\\n', CASE p_partkey % 5 WHEN 0 THEN '' ELSE concat('TI  - ', p_name, '\\n') END,
  'AU  - Berg, Ada\\nA1  - ', p_brand, '\\nPY  - ', CAST(1975 + p_size AS STRING), '/05/01\\nJO  - ', p_type, '\\nSP  - ', CAST(p_size AS STRING), '\\n', CASE p_partkey % 2 WHEN 0 THEN concat('EP  - ', CAST(p_size + 9 AS STRING), '\\n') ELSE '' END,
  'DO  - https://doi.org/10.1000/RIS.', CAST(p_partkey AS STRING), '\\nKW  - nests\\nKW  - k', CAST(p_size AS STRING), '\\n', CASE p_partkey % 3 WHEN 0 THEN concat('UR  - https://pubmed.ncbi.nlm.nih.gov/', CAST(p_partkey AS STRING), '/\\n') WHEN 1 THEN concat('AN  - 8', CAST(p_partkey AS STRING), '\\nDB  - PubMed\\n') ELSE '' END, 'ER  - \\n')))), x -> x.r), '') AS text
FROM {part} GROUP BY p_brand
"""


@query(
    "SELECT p_name AS title, 'Berg, Ada; ' || p_brand AS authors, CAST(1975 + p_size AS VARCHAR) AS year, p_type AS journal, p_size || CASE p_partkey % 2 WHEN 0 THEN '-' || (p_size + 9) ELSE '' END AS pages, '10.1000/RIS.' || p_partkey AS doi, 'nests, k' || p_size AS tags, "
    "CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '8' || p_partkey ELSE '' END AS pmid, CASE p_partkey % 4 WHEN 0 THEN 'paper-conference' END AS \"cslType\" FROM part WHERE p_partkey % 5 > 0"
)
def ris_import(spark, d):
    return library.parse_ris(_written(spark, d, _RIS)).select("title", "authors", "year", "journal", "pages", "doi", "tags", "pmid", "cslType")


#: The given pages, each third with meta elements and each third with JSON-LD in front.
_PAGES = """
SELECT page_id, url, concat(CASE page_id % 3 WHEN 0 THEN concat('<meta name="citation_title" content="Nests &amp; page ', CAST(page_id AS STRING), '"><meta content="Berg, Ada" name="Citation_Author"><meta name=citation_author content="Cho, Min"><meta property="citation_doi" content="doi:10.1000/p', CAST(page_id AS STRING), '"><meta name="citation_publication_date" content="', CAST(1990 + page_id % 30 AS STRING), '/04">')
  WHEN 1 THEN concat('<script type="application/ld+json">{{"@type":"ScholarlyArticle","headline":"Data of ', CAST(page_id AS STRING), '","datePublished":"', CAST(1990 + page_id % 30 AS STRING), '-01-02","author":[{{"@type":"Person","name":"Ada Berg"}},{{"name":"Min Cho"}}]}}</script><link rel="canonical" href="https://example.org/c/', CAST(page_id AS STRING), '">') ELSE '' END, html) AS html
FROM {pages}
"""


@query(
    r"WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Nests & page ' || page_id WHEN 1 THEN 'Data of ' || page_id ELSE CASE WHEN t = '' THEN 'Untitled reference' ELSE replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&') END END AS title, "
    + "CASE page_id % 3 WHEN 0 THEN 'Berg, Ada; Cho, Min' WHEN 1 THEN 'Ada Berg; Min Cho' ELSE '' END AS authors, CASE WHEN page_id % 3 < 2 THEN CAST(1990 + page_id % 30 AS VARCHAR) ELSE '' END AS year, CASE page_id % 3 WHEN 0 THEN '10.1000/p' || page_id ELSE '' END AS doi, CASE page_id % 3 WHEN 1 THEN 'https://example.org/c/' || page_id ELSE url END AS url FROM p"
)
def html_metadata_records(spark, d):
    return html_meta.extract(_written(spark, d, _PAGES)).select("page_id", "title", "authors", "year", "doi", "url")


_NAMED = [("abstract", "Abstract"), ("Summary", "Abstract"), ("INTRODUCTION", "Introduction"), ("Results and discussion", "Results"), ("materials and methods", "Methods"), ("STAR★METHODS", "Methods"), ("References", "References"), ("acknowledgements", "Acknowledgments"), ("Fig. 2", None), ("On nests", None)]
_case = lambda k: "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {'NULL' if x[k] is None else repr(x[k])}" for i, x in enumerate(_NAMED)) + " END"
_HEADING = f"SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 10 = 5 THEN '' WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) || '. ' WHEN p_size % 3 = 1 THEN CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || ' ' ELSE '' END || {_case(0)} || CASE WHEN p_partkey % 10 = 5 THEN '' WHEN p_size % 4 = 0 THEN '.' WHEN p_size % 4 = 1 THEN ':' ELSE '' END AS heading FROM {{part}}"


@query(f"SELECT h.k, h.heading, {_case(1)} AS section FROM ({S.duck(_HEADING)}) h JOIN part ON p_partkey = k")
def canonical_sections(spark, d):
    return S.spark_table(spark, d, _HEADING).select("k", "heading", reading.canonical_section("heading").alias("section"))


#: Blocks of documents, some of them headings, entries of a list of references, or a step that only looks like one.
_LISTED = "CASE ord % 23 WHEN 5 THEN 'References' WHEN 8 THEN '1. Smith, J. Birds. 2001.' WHEN 9 THEN '12. van der Berg, K. Nests. 1999.' WHEN 14 THEN 'Methods' WHEN 17 THEN '1. Collect samples from the 2020 cohort.' ELSE text END AS text, ord % 23 = 14 AS is_heading"
_ENDS = "|".join(re.escape(x).replace("'", "''") for x in reading.ENDS_BIBLIOGRAPHY)
_TITLES = "|".join(map(re.escape, reading.BIBLIOGRAPHY_TITLES))


@query(
    f"WITH b AS ({B}), v AS (SELECT pdf_id, page, ord, {_LISTED} FROM b), e AS (SELECT *, trim(text, ' \t\n\r') AS t FROM v), f AS (SELECT *, CASE WHEN regexp_matches(t, '^(?:{_TITLES})[:.]?$', 'i') OR (regexp_matches(t, '^[0-9]{{1,4}}[.)]\\s+[A-Za-z]+(?:\\s+[A-Za-z]+){{0,3}},\\s*[A-Z](?:[.\\s]|$)') AND regexp_matches(t, '\\b(18|19|20)[0-9]{{2}}[a-z]?\\b')) THEN true "
    f"WHEN is_heading OR regexp_matches(t, '^(?:{_ENDS}|fig(?:ure)?\\.?\\s*[0-9])\\b', 'i') THEN false END AS ev FROM e), s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY pdf_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM f) "
    "SELECT pdf_id, page, ord AS paragraph, row_number() OVER (PARTITION BY pdf_id, page ORDER BY ord) - 1 AS new_paragraph FROM s WHERE NOT inside"
)
def bibliography_omit(spark, d):
    rows = S.spark_table(spark, d, f"SELECT pdf_id, page, ord AS paragraph, {_LISTED} FROM ({S.BLOCKS_SPARK})")
    return reading.without_bibliography(rows).select("pdf_id", "page", "paragraph", F.col("new_paragraph").cast("long").alias("new_paragraph"))
