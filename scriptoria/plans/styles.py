"""Queries over manuscripts written in styles of our own: numbers in brackets, and authors with years. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations
from ..operators.csl import Style
from ..operators.generate import generate
from .queries import _RESOLVED, WITH, manuscripts, papers, query

_HEAD = '<style xmlns="http://purl.org/net/xbiblio/csl" class="in-text" version="1.0" default-locale="en-US"{more}><info><title>{title}</title><id>{id}</id></info>'
NUMERIC = _HEAD.format(title="Numbers in brackets", id="own-numeric", more=' page-range-format="minimal" initialize-with-hyphen="false"') + """
  <macro name="people"><names variable="author"><name initialize-with="" name-as-sort-order="all" sort-separator=" " delimiter=", " et-al-min="3" et-al-use-first="2"/><substitute><text variable="title"/></substitute></names></macro>
  <macro name="place"><group delimiter=":"><group delimiter=";"><date variable="issued"><date-part name="year"/></date><text variable="volume" font-weight="bold"/></group><text variable="page"/></group></macro>
  <citation collapse="citation-number"><sort><key variable="citation-number"/></sort><layout prefix="[" suffix="]" delimiter=","><text variable="citation-number"/></layout></citation>
  <bibliography second-field-align="flush"><layout suffix="."><text variable="citation-number" suffix="."/>
    <group delimiter=". "><text macro="people"/><text variable="title"/>
      <choose><if type="paper-conference"><group delimiter=" "><text term="in" text-case="capitalize-first" suffix=":"/><text variable="container-title" font-style="italic"/></group></if><else><text variable="container-title" font-style="italic"/></else></choose>
      <text macro="place"/><text variable="DOI" prefix="doi:"/></group></layout></bibliography>
</style>"""
AUTHOR_DATE = _HEAD.format(title="Authors and years", id="own-author-date", more=' demote-non-dropping-particle="never"') + """
  <macro name="short"><names variable="author"><name form="short" and="symbol" delimiter=", "/><substitute><text variable="title" quotes="true"/></substitute></names></macro>
  <macro name="people"><names variable="author"><name initialize-with=". " name-as-sort-order="all" and="symbol" delimiter=", " delimiter-precedes-last="always"/><substitute><text variable="title"/></substitute></names></macro>
  <macro name="year"><choose><if variable="issued"><date variable="issued"><date-part name="year"/></date></if><else><text term="no date" form="short"/></else></choose></macro>
  <citation et-al-min="3" et-al-use-first="1" disambiguate-add-year-suffix="true"><sort><key macro="people"/><key variable="issued"/><key variable="title"/></sort>
    <layout prefix="(" suffix=")" delimiter="; "><group delimiter=", "><text macro="short"/><text macro="year"/></group></layout></citation>
  <bibliography><sort><key macro="people"/><key variable="issued"/><key variable="title"/></sort>
    <layout suffix="."><group delimiter=". "><group delimiter=" "><text macro="people"/><text macro="year" prefix="(" suffix=")"/></group><text variable="title"/><text variable="container-title" font-style="italic"/></group></layout></bibliography>
</style>"""


def _generated(spark, d, style: str, docs=None):
    return generate(manuscripts(spark, d) if docs is None else docs, papers(spark, d), Style(style))


_CITED = (
    f"{WITH}{_RESOLVED}, ordered AS (SELECT doc_id, ord, paper, k FROM (SELECT hit.doc_id, hit.ord, paper, hit.key, length(original) AS ln, instr(lower(original), split_part(hit.key, ':', 2)) AS k FROM hit JOIN res USING (doc_id, ord) WHERE resolved)), "
    "firsts AS (SELECT doc_id, paper, min(ord * 100000 + k) AS first FROM ordered GROUP BY doc_id, paper), "
    "works AS (SELECT f.doc_id, f.paper, row_number() OVER (PARTITION BY f.doc_id ORDER BY first) AS number, p.*, list_filter(list_transform(string_split(p.authors, ';'), lambda x: trim(x)), lambda x: x <> '') AS names FROM firsts f JOIN papers p ON p.id = f.paper), "
    "people AS (SELECT *, list_transform(names, lambda n: CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) WHEN contains(n, ' ') THEN split_part(n, ' ', -1) ELSE n END) AS family, "
    "list_transform(names, lambda n: CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 2)) WHEN contains(n, ' ') THEN split_part(n, ' ', 1) ELSE '' END) AS given FROM works)"
)
_NUMERIC_WORKS = f"""{_CITED}, written AS (
  SELECT *, list_transform(range(1, len(names) + 1), lambda i: family[i] || CASE WHEN given[i] = '' THEN '' ELSE ' ' || upper(given[i][1]) END) AS shown FROM people
), entries AS (
  SELECT doc_id, number, paper, number || '. ' || array_to_string(list_filter([CASE WHEN len(names) = 0 THEN title WHEN len(names) >= 3 THEN shown[1] || ', ' || shown[2] || ', et al' ELSE array_to_string(shown, ', ') END,
    CASE WHEN len(names) = 0 THEN NULL ELSE title END, CASE WHEN "cslType" = 'paper-conference' THEN 'In: ' ELSE '' END || journal,
    year || ';' || volume || CASE WHEN pages = '' THEN '' ELSE ':1–9' END, CASE WHEN doi = '' THEN NULL ELSE 'doi:' || doi END], lambda x: x IS NOT NULL), '. ') || '.' AS entry FROM written
)"""


@query(f"{_NUMERIC_WORKS} SELECT doc_id, number AS pos, paper, entry FROM entries")
def style_numeric_bibliography(spark, d):
    out = _generated(spark, d, NUMERIC).bibliography
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("p"), (F.regexp_extract("record", r"(\d+)$", 1).cast("long") % 10000000).cast("string")).alias("paper"), "entry")


_CLUSTERS = (
    f"{_NUMERIC_WORKS}, c AS (SELECT o.doc_id, o.ord, n.number FROM (SELECT DISTINCT doc_id, ord, paper FROM ordered) o JOIN entries n USING (doc_id, paper)), "
    "islands AS (SELECT *, number - row_number() OVER (PARTITION BY doc_id, ord ORDER BY number) AS g FROM c), runs AS (SELECT doc_id, ord, g, min(number) AS a, max(number) AS b FROM islands GROUP BY doc_id, ord, g), "
    "shown AS (SELECT doc_id, ord, '[' || string_agg(CASE WHEN b = a THEN a::VARCHAR WHEN b = a + 1 THEN a || ',' || b ELSE a || '–' || b END, ',' ORDER BY a) || ']' AS replacement FROM runs GROUP BY doc_id, ord)"
)


@query(f"{_CLUSTERS} SELECT doc_id, ord, replacement, replacement AS replacement_html FROM shown")
def style_numeric_citations(spark, d):
    return _generated(spark, d, NUMERIC).citations.select("doc_id", F.col("ord").cast("long").alias("ord"), "replacement", "replacement_html")


_DATED = f"""{_CITED}, written AS (
  SELECT *, CASE WHEN len(names) = 0 THEN '“' || title || '”' WHEN len(names) >= 3 THEN family[1] || ' et al.' WHEN len(names) = 2 THEN family[1] || ' & ' || family[2] ELSE family[1] END AS short,
    list_transform(range(1, len(names) + 1), lambda i: family[i] || CASE WHEN given[i] = '' THEN '' ELSE ', ' || upper(given[i][1]) || '.' END) AS long,
    lower(CASE WHEN len(names) = 0 THEN title ELSE array_to_string(list_transform(range(1, len(names) + 1), lambda i: family[i] || CASE WHEN given[i] = '' THEN '' ELSE ', ' || given[i] END), '|') END) AS who FROM people
), cites AS (SELECT *, CASE WHEN len(names) = 0 THEN '“' || title || ',”' ELSE short || ',' END || ' ' || year AS cite, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN len(names) < 2 THEN who ELSE split_part(who, '|', 1) || ', ' || CASE WHEN len(names) = 2 THEN '& ' ELSE '' END || split_part(who, '|', 2) || CASE WHEN len(names) = 3 THEN ', & ' || split_part(who, '|', 3) ELSE '' END END, year, lower(title), number) AS pos FROM written),
letters AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id, cite) > 1 THEN chr((96 + row_number() OVER (PARTITION BY doc_id, cite ORDER BY pos))::INTEGER) ELSE '' END AS letter FROM cites)"""


@query(
    f"{_DATED} SELECT doc_id, pos, CASE len(names) WHEN 0 THEN title WHEN 1 THEN long[1] WHEN 2 THEN long[1] || ', & ' || long[2] ELSE long[1] || ', ' || long[2] || ', & ' || long[3] END || ' (' || year || letter || '). ' || CASE WHEN len(names) = 0 THEN '' ELSE title || '. ' END || journal || '.' AS entry FROM letters"
)
def style_author_date_bibliography(spark, d):
    return _generated(spark, d, AUTHOR_DATE).bibliography.select("doc_id", F.col("pos").cast("long").alias("pos"), "entry")


@query(
    f"{_DATED}, shown AS (SELECT o.doc_id, o.ord, '(' || string_agg(l.cite || l.letter, '; ' ORDER BY l.pos) || ')' AS replacement FROM (SELECT DISTINCT doc_id, ord, paper FROM ordered) o JOIN letters l USING (doc_id, paper) GROUP BY o.doc_id, o.ord) SELECT doc_id, ord, replacement FROM shown"
)
def style_author_date_citations(spark, d):
    return _generated(spark, d, AUTHOR_DATE).citations.select("doc_id", F.col("ord").cast("long").alias("ord"), "replacement")


@query(f"{_CITED}, miss AS (SELECT doc_id, CASE WHEN key LIKE 'pmid:%' THEN key[6:] ELSE key END AS identifier, min(ord) AS first FROM hit WHERE paper IS NULL GROUP BY doc_id, key) SELECT doc_id, identifier, first FROM miss")
def unresolved_identifiers(spark, d):
    markers = citations.resolve_markers(citations.parse_markers(manuscripts(spark, d)), citations.entity_records(papers(spark, d)))
    return markers.select("doc_id", "ord", F.explode("misses").alias("identifier")).groupBy("doc_id", "identifier").agg(F.min("ord").cast("long").alias("first"))
