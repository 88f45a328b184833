"""The queries of the engine over the benchmark tables, each with its DuckDB SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as T
from ..operators import citations, highlights, library, reading, retrieval, storage
from ..storage import stored
from ..streaming import capture
from . import surrogates as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
P, Q, B, M = (S.duck(x) for x in (S.PAPERS, S.INCOMING, S.BLOCKS_DUCK, S.MANUSCRIPTS_DUCK))
WITH = f"WITH papers AS ({P}), incoming AS ({Q}), blocks AS ({B}), manuscripts AS ({M})"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def papers(spark: SparkSession, d: str) -> DataFrame:
    return S.spark_table(spark, d, S.PAPERS)


def incoming(spark: SparkSession, d: str) -> DataFrame:
    return S.spark_table(spark, d, S.INCOMING)


def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    return S.spark_table(spark, d, S.MANUSCRIPTS_SPARK)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.spark_table(spark, d, S.BLOCKS_SPARK)


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# ---- library ----------------------------------------------------------------


@query(f"{WITH} SELECT id, title, lib_pos FROM papers WHERE status <> 'Finished' AND status = 'Reading' AND contains(lower(title || ' ' || authors || ' ' || doi || ' ' || pmid || ' ' || tags || ' ' || journal), 'berg')")
def library_filter_search(spark, d):
    return library.in_view(papers(spark, d), "Reading list", "Reading", "Berg").select("id", "title", "lib_pos")


@query(f"{WITH} SELECT id, row_number() OVER (ORDER BY lower(title), title, lib_pos) AS rank FROM papers")
def library_sort_title(spark, d):
    return library.ranked(papers(spark, d), "Title").select("id", "rank")


@query(f"{WITH} SELECT id, row_number() OVER (ORDER BY year DESC, lib_pos) AS rank FROM papers")
def library_sort_year(spark, d):
    return library.ranked(papers(spark, d), "Year").select("id", "rank")


@query(f"{WITH}, names AS (SELECT collection FROM papers UNION SELECT 'Empty ' || n_name FROM nation) SELECT names.collection, count(papers.id) AS n_papers FROM names LEFT JOIN papers ON names.collection = papers.collection GROUP BY names.collection")
def collection_counts(spark, d):
    empty = read(spark, d, "nation").select(F.concat(F.lit("Empty "), "n_name").alias("collection"))
    return library.collection_counts(papers(spark, d), empty)


@query(f"{WITH} SELECT count(*) AS n_all, count(*) FILTER (starred) AS starred, count(*) FILTER (status <> 'Finished') AS reading_list, count(*) FILTER (status = 'Reading') AS reading FROM papers")
def view_counts(spark, d):
    return library.view_counts(papers(spark, d))


@query(
    f"{WITH}, n AS (SELECT id, list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '') AS a FROM papers) "
    "SELECT id, CASE WHEN len(a) = 0 THEN 'No authors added' WHEN len(a) > 2 THEN a[1] || '; …; ' || a[-1] ELSE array_to_string(a, '; ') END AS shown FROM n"
)
def display_authors(spark, d):
    return papers(spark, d).select("id", I.display_authors("authors").alias("shown"))


@query(
    f"{WITH}, n AS (SELECT id, unnest(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '')) AS a FROM papers) "
    "SELECT id, CASE WHEN contains(a, ',') THEN trim(a[1:strpos(a, ',') - 1]) WHEN contains(a, ' ') THEN string_split(a, ' ')[-1] END AS family, "
    "CASE WHEN contains(a, ',') THEN trim(a[strpos(a, ',') + 1:]) WHEN contains(a, ' ') THEN array_to_string(string_split(a, ' ')[:-2], ' ') END AS given, CASE WHEN NOT contains(a, ',') AND NOT contains(a, ' ') THEN a END AS literal FROM n"
)
def author_parse(spark, d):
    return papers(spark, d).select("id", F.inline(I.authors_parsed("authors")))


_DOI = r"regexp_replace(trim(doi), '^https?://(?:dx\.)?doi\.org/', '', 'i')"
_BARE = rf"regexp_replace({_DOI}, '^doi:\s*', '', 'i')"


@query(
    f"{WITH} SELECT id, lower({_DOI}) AS capture, {_BARE} AS client, CASE WHEN regexp_matches({_BARE}, '^10\\.\\d{{4,9}}/[^\\s<>]+$', 'i') THEN lower({_BARE}) END AS identifier, lower({_BARE}) AS pubmed, "
    rf"regexp_replace(regexp_replace(doi, '^https?://(?:dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i') AS extension, CASE WHEN regexp_matches({_BARE}, '^10\.\d{{4,9}}/[^\s]+$', 'i') THEN {_BARE} ELSE '' END AS citation FROM incoming"
)
def doi_normalisers(spark, d):
    return incoming(spark, d).select("id", I.doi_capture("doi").alias("capture"), I.doi_client("doi").alias("client"), I.doi_identifier("doi").alias("identifier"), I.doi_pubmed("doi").alias("pubmed"), I.doi_extension("doi").alias("extension"), I.doi_citation().alias("citation"))


_URL = (
    "CASE WHEN doi <> '' THEN 'https://doi.org/' || doi WHEN \"sourceUrl\" <> '' AND NOT starts_with(\"sourceUrl\", 'https://pubmed.ncbi.nlm.nih.gov/') THEN \"sourceUrl\" "
    "WHEN \"arxivId\" <> '' THEN 'https://arxiv.org/abs/' || \"arxivId\" "
)


@query(f"{WITH} SELECT id, {_URL} ELSE '' END AS url, {_URL} WHEN \"sourceUrl\" <> '' THEN \"sourceUrl\" WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS any_url FROM papers")
def reference_url(spark, d):
    return papers(spark, d).select("id", I.reference_url().alias("url"), I.reference_url(pubmed=True).alias("any_url"))


@query(f"{WITH} SELECT id, CASE WHEN pmid <> '' THEN '(PMID: ' || pmid || ')' WHEN doi <> '' THEN '(doi:' || doi || ')' WHEN \"arxivId\" <> '' THEN '(arxiv:' || \"arxivId\" || ')' ELSE '({I.LOCAL}:' || id || ')' END AS marker FROM papers")
def citation_marker_text(spark, d):
    return papers(spark, d).select("id", I.marker_text().alias("marker"))


@query(
    f"{WITH}, n AS (SELECT *, array_to_string(list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> ''), ' and ') AS a, {_URL} WHEN \"sourceUrl\" <> '' THEN \"sourceUrl\" WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS url, "
    "'ref' || array_to_string(list_transform(string_split(id, ''), lambda c: lower(hex(c))), 'x') AS k FROM papers) "
    "SELECT id, '@' || CASE \"cslType\" WHEN 'paper-conference' THEN 'inproceedings' WHEN 'article' THEN 'misc' ELSE 'article' END || '{' || k || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {' || title || '}', '  author = {' || nullif(a, '') || '}', '  year = {' || year || '}', "
    "'  ' || CASE \"cslType\" WHEN 'paper-conference' THEN 'booktitle' ELSE 'journal' END || ' = {' || replace(journal, '#', '\\#') || '}', '  doi = {' || nullif(doi, '') || '}', '  volume = {' || nullif(volume, '') || '}', '  number = {' || nullif(issue, '') || '}', '  pages = {' || nullif(pages, '') || '}', '  url = {' || nullif(url, '') || '}') || chr(10) || '}' AS entry FROM n"
)
def bibtex_export(spark, d):
    return papers(spark, d).select("id", I.bibtex().alias("entry"))


_KEY = f"CASE WHEN doi <> '' THEN 'doi:' || lower({_BARE}) WHEN \"sourceUrl\" <> '' THEN 'url:' || \"sourceUrl\" ELSE 'id:' || id END"


@query(f"{WITH}, o AS (SELECT id, pmid, {_KEY} AS k FROM papers) SELECT id FROM (SELECT *, {_KEY} AS k FROM incoming) i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = i.id) AND NOT EXISTS (SELECT 1 FROM o WHERE o.k = i.k) AND NOT EXISTS (SELECT 1 FROM o WHERE o.pmid = i.pmid AND i.pmid <> '')")
def dedup_anti_join(spark, d):
    return library.not_in_library(papers(spark, d), incoming(spark, d)).select("id")


@query()
def dedup_greedy(spark, d):
    return library.deduplicated(papers(spark, d), incoming(spark, d)).select("id", "lib_pos")


_CAP = r"lower(regexp_replace(trim(doi), '^https?://(?:dx\.)?doi\.org/', '', 'i'))"


@query(
    f"{WITH}, l AS (SELECT *, {_CAP} AS k FROM papers), c AS (SELECT lib_pos AS capture_id, *, {_CAP} AS k FROM incoming), "
    "h AS (SELECT capture_id, l.id, l.lib_pos FROM c JOIN l ON c.pmid <> '' AND c.pmid = l.pmid UNION SELECT capture_id, l.id, l.lib_pos FROM c JOIN l ON c.k <> '' AND c.k = l.k UNION SELECT capture_id, l.id, l.lib_pos FROM c JOIN l ON c.\"sourceUrl\" <> '' AND c.\"sourceUrl\" = l.\"sourceUrl\"), "
    "m AS (SELECT capture_id, arg_min(id, lib_pos) AS match_id FROM h GROUP BY capture_id) "
    "SELECT c.capture_id, match_id, match_id IS NOT NULL AS duplicate, CASE WHEN match_id IS NULL THEN c.title ELSE l.title END AS title, CASE WHEN match_id IS NULL THEN c.k ELSE l.doi END AS doi, coalesce(nullif(l.pmid, ''), c.pmid) AS pmid, coalesce(nullif(l.volume, ''), c.volume) AS volume "
    "FROM c LEFT JOIN m USING (capture_id) LEFT JOIN l ON l.id = match_id"
)
def capture_upsert(spark, d):
    caps = incoming(spark, d).withColumn("capture_id", F.col("lib_pos"))
    return library.captured(papers(spark, d), caps, fill=("pmid", "volume")).select("capture_id", "match_id", "duplicate", "title", "doi", "pmid", "volume")


@query(f"{WITH} SELECT id, CASE WHEN collection = 'Unfiled' THEN collection WHEN starts_with(collection, 'PROMO') THEN collection ELSE collection END AS collection, CASE WHEN id IN (SELECT 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 40) AND status = 'To read' THEN 'Reading' ELSE status END AS status FROM papers")
def status_on_open(spark, d):
    ids = read(spark, d, "lineitem").where("l_quantity >= 40").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"))
    return library.opened(papers(spark, d), ids).select("id", "collection", "status")


@query(f"{WITH}, c AS (SELECT min(collection) AS lo, max(collection) AS hi FROM papers) SELECT id, CASE WHEN collection = lo THEN 'Renamed' WHEN collection = hi THEN 'Unfiled' ELSE collection END AS collection FROM papers, c")
def collection_rename(spark, d):
    p = papers(spark, d)
    lo, hi = p.agg(F.min("collection"), F.max("collection")).first()
    return library.with_collection(library.with_collection(p, lo, "Renamed"), hi, None).select("id", "collection")


_EDITS = "SELECT *, id AS own FROM papers WHERE lib_pos % 3 = 0"


@query(
    f"{WITH}, e AS (SELECT CASE WHEN lib_pos % 2 = 0 THEN id ELSE 'n' || id END AS id, '  ' || title || ' (2nd) ' AS title, doi, CASE WHEN lib_pos % 2 = 0 THEN pmid ELSE '' END AS pmid, lib_pos FROM papers WHERE lib_pos % 3 = 0), "
    "ok AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.pmid = e.pmid AND e.pmid <> '' AND p.id <> e.id) AND NOT EXISTS (SELECT 1 FROM papers p WHERE lower(p.doi) = lower(e.doi) AND e.doi <> '' AND p.id <> e.id)) "
    ", r AS (SELECT id, title, doi, pmid, 1 AS part, lib_pos AS spot FROM papers WHERE id NOT IN (SELECT id FROM ok) UNION ALL SELECT id, trim(title), doi, pmid, CASE WHEN id LIKE 'n%' THEN 0 ELSE 1 END, CASE WHEN id LIKE 'n%' THEN -lib_pos ELSE lib_pos END FROM ok) "
    "SELECT id, title, doi, pmid, CASE WHEN part = 1 AND spot % 3 = 0 THEN 'kept' ELSE '' END AS notes, row_number() OVER (ORDER BY part, spot) AS place FROM r"
)
def paper_upsert(spark, d):
    p = papers(spark, d).withColumn("notes", F.when(F.col("lib_pos") % 3 == 0, "kept").otherwise(""))
    even = F.col("lib_pos") % 2 == 0
    edits = p.where("lib_pos % 3 = 0").select(*[{"id": F.when(even, F.col("id")).otherwise(F.concat(F.lit("n"), "id")), "title": F.concat(F.lit("  "), "title", F.lit(" (2nd) ")), "pmid": F.when(even, F.col("pmid")).otherwise(""), "notes": F.lit("")}.get(c, F.col(c)).alias(c) for c in p.columns])
    done = library.upserted(p, edits)
    return library.ranked_by(done, "lib_pos").select("id", "title", "doi", "pmid", "notes", F.col("_rank").cast("long").alias("place"))


@query(f"{WITH}, b AS (SELECT id, CASE lib_pos % 4 WHEN 0 THEN '  ' ELSE title END AS title, CASE lib_pos % 5 WHEN 0 THEN 'Lost' ELSE status END AS status, \"cslType\", pmid FROM papers) SELECT id, trim(title) <> '' AND status IN ('To read', 'Reading', 'Finished') AS valid, true AS fields FROM b")
def paper_validity(spark, d):
    p = papers(spark, d)
    p = p.withColumn("title", F.when(F.col("lib_pos") % 4 == 0, "  ").otherwise(F.col("title"))).withColumn("status", F.when(F.col("lib_pos") % 5 == 0, "Lost").otherwise(F.col("status")))
    return p.select("id", library.valid(p).alias("valid"), library.valid_citation_fields().alias("fields"))


# ---- citations --------------------------------------------------------------

_PARSED = (
    ", piece AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\([^()\\r\\n]*\\)|\\[[^\\[\\]\\r\\n]+\\]')) AS original, unnest(range(len(regexp_extract_all(text, '\\([^()\\r\\n]*\\)|\\[[^\\[\\]\\r\\n]+\\]')))) AS k FROM manuscripts), "
    "part AS (SELECT doc_id, k, original, unnest(list_transform(regexp_split_to_array(original[2:-2], '[;,] *'), lambda x: trim(x))) AS p, original[1] = '[' AS square, regexp_matches(original[2:-2], '^PMID *:', 'i') AS grp FROM piece), "
    "id AS (SELECT doc_id, k, original, p, CASE WHEN regexp_matches(p, '^pmid *: *[1-9][0-9]{0,8}$', 'i') THEN 'pmid:' || regexp_extract(p, '([0-9]+)$', 1) WHEN regexp_matches(p, '^doi *: *10\\.[0-9]{4,9}/', 'i') THEN 'doi:' || lower(regexp_extract(p, '(10\\..*)$', 1)) "
    "WHEN regexp_matches(p, '^arxiv *: *[0-9]{4}\\.', 'i') THEN 'arxiv:' || regexp_extract(p, '([0-9]{4}\\.[0-9]{4,5})', 1) WHEN NOT square AND (regexp_matches(p, '^[1-9][0-9]{6,8}$') OR grp AND regexp_matches(p, '^[1-9][0-9]{0,8}$')) THEN 'pmid:' || p END AS key FROM part), "
    "marker AS (SELECT doc_id, k, original, array_to_string(list_sort(list(DISTINCT key)), ' ') AS keys FROM id GROUP BY doc_id, k, original HAVING bool_and(key IS NOT NULL))"
)


_FOUND = r"'\([^()\r\n]*\)|\[[^\[\]\r\n]+\]'"
_PLACES = (
    f", cut AS (SELECT doc_id, regexp_extract_all(text, {_FOUND}) AS m, regexp_split_to_array(text, {_FOUND}) AS g FROM manuscripts), "
    "place AS (SELECT marker.*, list_sum(list_transform(g[1:k + 1], lambda x: length(x)))::BIGINT + CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(m[1:k], lambda x: length(x))) END::BIGINT AS start FROM marker JOIN cut USING (doc_id))"
)


@query(f'{WITH}{_PARSED}{_PLACES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, start, start + length(original) AS "end", original, keys FROM place')
def markers_parse(spark, d):
    m = citations.parse_markers(manuscripts(spark, d))
    return m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("ord", "start", "end")], "original", F.array_join(F.array_sort("identifiers.key"), " ").alias("keys"))


#: Papers of one arXiv id, the only identifier that papers share here, in library order: each goes to the first record that has no other PMID or DOI, else it begins one. record is a record's first paper.
_SHARED = """, same AS (SELECT id, pmid, lower(doi) AS doi, "arxivId" AS arxiv, row_number() OVER (PARTITION BY "arxivId" ORDER BY lib_pos) AS n FROM papers WHERE "arxivId" <> ''),
walk AS (WITH RECURSIVE w AS (
  SELECT arxiv, n, id, id AS record, [{'pmid': pmid, 'doi': doi, 'id': id}] AS records FROM same WHERE n = 1
  UNION ALL SELECT arxiv, n, id, CASE WHEN h > 0 THEN records[h].id ELSE id END,
    CASE WHEN h > 0 THEN list_transform(records, lambda r, i: CASE WHEN i = h THEN {'pmid': CASE r.pmid WHEN '' THEN pmid ELSE r.pmid END, 'doi': CASE r.doi WHEN '' THEN doi ELSE r.doi END, 'id': r.id} ELSE r END) ELSE list_append(records, {'pmid': pmid, 'doi': doi, 'id': id}) END
  FROM (SELECT s.*, w.records, coalesce(list_position(list_transform(w.records, lambda r: (r.pmid = '' OR s.pmid = '' OR r.pmid = s.pmid) AND (r.doi = '' OR s.doi = '' OR r.doi = s.doi)), true), 0) AS h FROM w JOIN same s ON s.arxiv = w.arxiv AND s.n = w.n + 1)
) SELECT id, record FROM w)"""
_ALIAS = _SHARED + ", alias AS (SELECT unnest(['pmid:' || nullif(pmid, ''), 'doi:' || lower(nullif(doi, '')), 'arxiv:' || nullif(\"arxivId\", ''), 'local:' || id]) AS key, coalesce(record, id) AS id FROM papers LEFT JOIN walk USING (id)), known AS (SELECT key, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS paper FROM alias WHERE key IS NOT NULL GROUP BY key)"
_RESOLVED = (
    _PARSED
    + _ALIAS
    + ", m2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord FROM marker), one AS (SELECT doc_id, ord, original, unnest(string_split(keys, ' ')) AS key FROM m2), "
    "hit AS (SELECT one.*, paper FROM one LEFT JOIN known USING (key)), res AS (SELECT doc_id, ord, bool_and(paper IS NOT NULL) AS resolved FROM hit GROUP BY doc_id, ord)"
)


def _resolved(spark, d):
    return citations.resolve_markers(citations.parse_markers(manuscripts(spark, d)), _aliases(spark, d))


def _aliases(spark, d):
    return citations.entity_records(papers(spark, d))


_ORDERED = (
    f"{WITH}{_RESOLVED}, placed AS (SELECT hit.*, resolved, instr(lower(original), split_part(key, ':', 2)) AS k FROM hit JOIN res USING (doc_id, ord)), "
    "firsts AS (SELECT doc_id, paper, min(ord * 100000 + k) AS first FROM placed WHERE resolved GROUP BY doc_id, paper), "
    "numbers AS (SELECT doc_id, paper, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS number, first // 100000 AS first FROM firsts)"
)


def _paper_ids(aliases: DataFrame) -> DataFrame:
    """Records by their first paper's id, which doesn't depend on how records are named."""
    return aliases.groupBy("record_id").agg(F.min_by("paper_id", "pos").alias("paper"))


@query(
    f"{_ORDERED}, once AS (SELECT doc_id, ord, resolved, paper, min(k) AS k FROM placed WHERE paper IS NOT NULL GROUP BY ALL), r AS (SELECT doc_id, ord, string_agg(paper, ' ' ORDER BY k) AS records FROM once GROUP BY doc_id, ord), "
    "m AS (SELECT doc_id, ord, string_agg(CASE WHEN key LIKE 'pmid:%' THEN key[6:] ELSE key END, ' ' ORDER BY k) AS misses FROM placed WHERE paper IS NULL GROUP BY doc_id, ord) "
    "SELECT doc_id, ord, resolved, coalesce(records, '') AS records, coalesce(misses, '') AS misses FROM res LEFT JOIN r USING (doc_id, ord) LEFT JOIN m USING (doc_id, ord)"
)
def markers_resolve(spark, d):
    aliases = stored(_aliases(spark, d))
    rows = citations.resolve_markers(citations.parse_markers(manuscripts(spark, d)), aliases).select("doc_id", "ord", "resolved", "records", "misses")
    papers_of = rows.select("doc_id", "ord", "resolved", "misses", F.posexplode_outer("records").alias("k", "record")).join(_paper_ids(aliases).withColumnRenamed("record_id", "record"), "record", "left")
    per = papers_of.groupBy("doc_id", "ord").agg(F.first("resolved").alias("resolved"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("paper").isNotNull(), F.struct("k", "paper")))), lambda x: x["paper"]), " ").alias("records"), F.array_join(F.first("misses"), " ").alias("misses"))
    return per.withColumn("ord", F.col("ord").cast("long"))


@query(f"{_ORDERED} SELECT doc_id, paper, number, first FROM numbers")
def citation_numbering(spark, d):
    aliases = stored(_aliases(spark, d))
    numbers = citations.numbered(citations.resolve_markers(citations.parse_markers(manuscripts(spark, d)), aliases))
    return numbers.join(_paper_ids(aliases).withColumnRenamed("record_id", "record"), "record").select("doc_id", "paper", F.col("number").cast("long").alias("number"), F.col("first").cast("long").alias("first"))


_SPLICED = (
    f"{_ORDERED}, done AS (SELECT p.doc_id, p.ord, '[' || array_to_string(list_sort(list(DISTINCT n.number)), ',') || ']' AS replacement FROM placed p JOIN numbers n USING (doc_id, paper) WHERE p.resolved GROUP BY p.doc_id, p.ord)"
    f"{_PLACES}, spot AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, start, start + length(original) AS stop FROM place), "
    "span AS (SELECT doc_id, start, stop, replacement, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM spot JOIN done USING (doc_id, ord)), "
    "head AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || replacement, '' ORDER BY start) AS t, max(stop) AS stop, count(*) AS n FROM span JOIN manuscripts USING (doc_id) GROUP BY doc_id)"
)


@query(f"{_SPLICED} SELECT doc_id, coalesce(t || substr(text, stop + 1), text) AS text, coalesce(n, 0) AS n_citations FROM manuscripts LEFT JOIN head USING (doc_id)")
def citation_splice(spark, d):
    return citations.cited(manuscripts(spark, d), papers(spark, d)).select("doc_id", "text", "n_citations")


@query(f"{_ORDERED} SELECT doc_id, number, authors || '. ' || title || '. ' || journal || '. ' || year || '.' AS entry FROM numbers JOIN papers ON papers.id = numbers.paper")
def bibliography_list(spark, d):
    aliases = stored(_aliases(spark, d))
    return citations.bibliography(citations.numbered(citations.resolve_markers(citations.parse_markers(manuscripts(spark, d)), aliases)), aliases, papers(spark, d)).withColumn("number", F.col("number").cast("long"))


@query()
def citation_author_date(spark, d):
    from ..operators import styles_text

    p, docs = papers(spark, d), manuscripts(spark, d)
    aliases = stored(citations.entity_records(p))
    new, _ = styles_text.author_date(stored(citations.resolve_markers(citations.parse_markers(docs), aliases)), aliases, p)
    return citations.spliced(docs, new)


@query()
def entity_resolution(spark, d):
    both = citations.with_temporary(papers(spark, d), incoming(spark, d))
    return citations.entity_records(both).groupBy("record_id").agg(F.min_by("paper_id", "pos").alias("paper_id"), F.array_join(F.array_sort(F.collect_set("key")), " ").alias("keys"))


#: r counts from 0; r1, r2 and r3 are what is left for the letters before the last, -1 if nothing is.
_LETTERS = "CASE WHEN {r} < 0 THEN '' ELSE chr(CAST(97 + {r} % 26 AS INT)) END"


@query(
    f"{WITH}, g AS (SELECT id, count(*) OVER (PARTITION BY authors, year) AS n, row_number() OVER (PARTITION BY authors, year ORDER BY title, lib_pos) - 1 AS r FROM papers), "
    "g1 AS (SELECT *, CASE WHEN r < 26 THEN -1 ELSE r // 26 - 1 END AS r1 FROM g), g2 AS (SELECT *, CASE WHEN r1 < 26 THEN -1 ELSE r1 // 26 - 1 END AS r2 FROM g1), g3 AS (SELECT *, CASE WHEN r2 < 26 THEN -1 ELSE r2 // 26 - 1 END AS r3 FROM g2) "
    f"SELECT id, CASE WHEN n = 1 THEN '' ELSE {' || '.join(_LETTERS.format(r=r) for r in ('r3', 'r2', 'r1', 'r'))} END AS suffix FROM g3"
)
def year_suffix(spark, d):
    return citations.year_suffixes(papers(spark, d), ["authors", "year"], ["title", "lib_pos"]).select("id", "suffix")


@query(
    f"{WITH}, m AS (SELECT *, list_filter(['title', 'authors', 'year', 'journal'], lambda c: (CASE c WHEN 'title' THEN title WHEN 'authors' THEN authors WHEN 'year' THEN year ELSE journal END) = '') AS missing FROM papers), "
    "w AS (SELECT id, list_filter([CASE WHEN doi = '' AND contains(\"sourceUrl\", 'pubmed') AND \"arxivId\" = '' THEN 'only a PubMed link' END, CASE WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ', ') END, CASE WHEN authors <> '' AND NOT contains(authors, ',') THEN 'inferred names' END], lambda x: x IS NOT NULL) AS w FROM m) "
    "SELECT id, array_to_string(w, '; ') AS warnings FROM w"
)
def metadata_warnings(spark, d):
    return papers(spark, d).select("id", F.array_join(I.metadata_warnings(), "; ").alias("warnings"))


# ---- retrieval --------------------------------------------------------------


@query(f"{WITH}, k AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key FROM blocks), r AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, key ORDER BY ord) AS n FROM k WHERE key <> '') SELECT pdf_id, page, ord, length(text) AS chars FROM r WHERE n = 1")
def block_dedup(spark, d):
    return retrieval.unique_blocks(blocks(spark, d)).select("pdf_id", "page", "ord", F.length("text").cast("long").alias("chars"))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: w NOT IN {_STOP}))"


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def document_frequency(spark, d):
    return retrieval.document_frequency(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


_ASKED = ["that", "tion", "onthe", "ereau", "ment", "ciónos", "ungen", "ered", "thand"]
_HAS = f"{WITH}, has AS (SELECT pdf_id, ord, unnest({_TERMS}) AS term FROM blocks), asked AS (SELECT unnest([{', '.join(repr(x) for x in _ASKED)}]) AS term), h AS (SELECT has.* FROM has JOIN asked USING (term)), df AS (SELECT pdf_id, term, count(*) AS df FROM h GROUP BY pdf_id, term), n AS (SELECT pdf_id, count(*) AS n FROM blocks GROUP BY pdf_id), sc AS (SELECT pdf_id, ord, sum(ln(1 + n / df)) AS s FROM h JOIN df USING (pdf_id, term) JOIN n USING (pdf_id) GROUP BY pdf_id, ord), scored AS (SELECT b.pdf_id, b.page, b.ord, b.text, coalesce(s, 0) AS score FROM blocks b LEFT JOIN sc USING (pdf_id, ord))"


def _scores(spark, d):
    return retrieval.scored(blocks(spark, d), _ASKED)


@query(f"{_HAS} SELECT pdf_id, page, ord, round(score, 6) AS score FROM scored")
def passage_scores(spark, d):
    return _scores(spark, d).select("pdf_id", "page", "ord", F.round("score", 6).alias("score"))


@query(f"{_HAS}, r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY pdf_id ORDER BY round(score, 9) DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM scored WHERE score > 0) SELECT pdf_id, ord, left(text, CAST(2000 - before AS INT)) AS text FROM r WHERE before < 2000")
def passage_topk(spark, d):
    return retrieval.within_budget(_scores(spark, d), 2000).select("pdf_id", "ord", "text")


@query(f"{WITH}, c AS (SELECT pdf_id, floor(3000 / count(DISTINCT page)) AS share FROM blocks GROUP BY pdf_id), r AS (SELECT b.*, share, coalesce(sum(length(text)) OVER (PARTITION BY pdf_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks b JOIN c USING (pdf_id)) SELECT pdf_id, page, ord, left(text, CAST(share - before AS INT)) AS text FROM r WHERE before < share")
def page_coverage(spark, d):
    return retrieval.page_coverage(blocks(spark, d), 3000)


@query()
def passages_selected(spark, d):
    return retrieval.selected(_scores(spark, d), "which findings on that and ered")


@query()
def chunk_1200(spark, d):
    b = read(spark, d, "documents").select(F.col("doc_id").alias("pdf_id"), F.lit(1).alias("page"), F.lit(0).cast("long").alias("ord"), "text")
    return retrieval.chunked(b).select("pdf_id", "start", "text")


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), l AS (SELECT *, CASE WHEN back <= 2 AND role = 'user' THEN 1500 WHEN back <= 2 THEN 2500 WHEN role = 'user' THEN 700 ELSE 1100 END AS lim FROM r WHERE back <= 4), "
    "h AS (SELECT *, lim - 29 AS room, CAST(floor((lim - 29) * 0.7) AS INT) AS head FROM l) SELECT conv_id AS pdf_id, turn AS pos, role, CASE WHEN length(text) <= lim THEN text ELSE left(text, head) || chr(10) || '[earlier message shortened]' || chr(10) || right(text, CAST(room - head AS INT)) END AS content FROM h"
)
def history_compaction(spark, d):
    return retrieval.compact_history(read(spark, d, "conversations").select(F.col("conv_id").alias("pdf_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content")))


_BROAD = retrieval.BROAD.removeprefix("(?i)")
_FOLLOW = retrieval.FOLLOW_UP.removeprefix("(?i)")


@query(f"SELECT conv_id, turn, regexp_matches(text, '{_BROAD}', 'i') AS broad, len({_TERMS}) < 2 OR regexp_matches(text, '{_FOLLOW}', 'i') AS follow_up FROM conversations WHERE role = 'user'")
def question_class(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", retrieval.is_broad("text").alias("broad"), retrieval.is_follow_up("text").alias("follow_up"))


# ---- reading views and highlights -------------------------------------------


@query(f"{WITH}, k AS (SELECT pdf_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM blocks) SELECT text, count(DISTINCT pdf_id) AS n_docs FROM k WHERE contains(text, ' ') AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 12 GROUP BY text HAVING count(DISTINCT pdf_id) >= 3")
def repeated_lines(spark, d):
    return reading.repeated_lines(blocks(spark, d))


@query(f"{WITH} SELECT pdf_id AS doc_id, ord AS paragraph, coalesce(sum(length(text) + 1) OVER (PARTITION BY pdf_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM blocks")
def paragraph_offsets(spark, d):
    rows = blocks(spark, d).select(F.col("pdf_id").alias("doc_id"), F.col("ord").alias("paragraph"), "text")
    return reading.offsets(rows).select("doc_id", "paragraph", F.col("offset").cast("long").alias("offset"))


_HL = (
    ", h AS (SELECT pdf_id, text[4:13] AS quote, CASE WHEN pdf_id % 2 = 0 THEN ord ELSE ord + 1 END AS anchor FROM blocks WHERE ord = 1 AND length(text) >= 20), "
    "c AS (SELECT h.pdf_id, anchor, quote, b.ord, b.ord = anchor AND b.text[4:13] = quote AS same, strpos(b.text, quote) AS first, CASE WHEN strpos(b.text, quote) > 0 AND contains(b.text[strpos(b.text, quote) + 1:], quote) THEN 1 ELSE 0 END AS more FROM h JOIN blocks b USING (pdf_id)), "
    "g AS (SELECT pdf_id, any_value(anchor) AS anchor, bool_or(same) AS kept, sum(CASE WHEN first > 0 THEN 1 + more ELSE 0 END) AS n, arg_min(ord, ord) FILTER (first > 0) AS o, arg_min(first, ord) FILTER (first > 0) AS f FROM c GROUP BY pdf_id)"
)


@query(f"{WITH}{_HL} SELECT pdf_id AS hid, CASE WHEN kept THEN anchor ELSE o END AS paragraph, CASE WHEN kept THEN 3 ELSE f - 1 END AS start, CASE WHEN kept THEN 13 ELSE f + 9 END AS \"end\" FROM g WHERE kept OR n = 1")
def highlight_relocate(spark, d):
    p = blocks(spark, d).select("pdf_id", F.lit(1).alias("page"), F.col("ord").alias("paragraph"), "text")
    own = p.where("paragraph = 1 and length(text) >= 20")
    h = own.select(F.col("pdf_id").alias("hid"), "pdf_id", "page", F.when(F.col("pdf_id") % 2 == 0, F.col("paragraph")).otherwise(F.col("paragraph") + 1).alias("paragraph"), F.lit(3).alias("start"), F.lit(13).alias("end"), F.substring("text", 4, 10).alias("quote"))
    return highlights.relocated(h, p).where("paragraph is not null").select("hid", "paragraph", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_RANGES = "SELECT user_id AS key, event_id AS pos, CAST(event_id * 37 % 900 AS INT) AS start, CAST(event_id * 37 % 900 + 1 + event_id * 53 % 140 AS INT) AS \"end\" FROM {events}"


@query(
    f"WITH r AS ({S.duck(_RANGES)}), f AS (SELECT * FROM r WHERE \"end\" <= 1000), b AS (SELECT DISTINCT key, pt FROM (SELECT key, start AS pt FROM f UNION ALL SELECT key, \"end\" FROM f UNION ALL SELECT DISTINCT key, unnest([0, 1000]) FROM r)), "
    "e AS (SELECT key, pt AS a, lead(pt) OVER (PARTITION BY key ORDER BY pt) AS z FROM b), h AS (SELECT e.key, a, z, max(pos) AS winner, list_sort(list(pos) FILTER (pos IS NOT NULL)) AS ids FROM e LEFT JOIN f ON f.key = e.key AND f.start <= e.a AND f.\"end\" >= e.z WHERE z IS NOT NULL GROUP BY e.key, a, z), "
    "n AS (SELECT *, CASE WHEN lag(winner) OVER (PARTITION BY key ORDER BY a) IS NOT DISTINCT FROM winner AND lag(ids) OVER (PARTITION BY key ORDER BY a) IS NOT DISTINCT FROM ids AND row_number() OVER (PARTITION BY key ORDER BY a) > 1 THEN 0 ELSE 1 END AS new FROM h), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY a) AS run FROM n) SELECT key, min(a) AS start, max(z) AS \"end\", coalesce(any_value(winner), -1) AS winner FROM g GROUP BY key, run"
)
def highlight_segments(spark, d):
    r = S.spark_table(spark, d, _RANGES)
    return highlights.segments(r, r.select("key").distinct().withColumn("length", F.lit(1000))).select("key", "start", "end", F.coalesce("winner", F.lit(-1)).alias("winner"))


@query(f"{WITH}, e AS (SELECT pdf_id, page, ord AS idx FROM blocks WHERE ord % 3 = 0) SELECT pdf_id, page, idx, row_number() OVER (PARTITION BY pdf_id ORDER BY page, idx) AS number FROM e")
def equation_numbering(spark, d):
    rows = blocks(spark, d).where("ord % 3 = 0").select("pdf_id", "page", F.col("ord").alias("idx"))
    return reading.equation_numbers(rows).select("pdf_id", "page", "idx", F.col("number").cast("long").alias("number"))


@query("SELECT l_orderkey AS k, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM lineitem GROUP BY l_orderkey")
def median_height(spark, d):
    return reading.median_of(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity"), "k", "l_quantity")


@query("WITH g AS (SELECT user_id AS k, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events), b AS (SELECT *, max(CASE WHEN gap > 2.1 * 60 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS broken FROM g) SELECT k, event_id FROM b WHERE broken = 0")
def caption_growth(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", F.lit(60).alias("size"))
    return reading.grown(rows, "k", "event_id", "size", 2.1).select("k", "event_id")


# ---- metadata, storage and streams ------------------------------------------


@query(r"SELECT page_id, url, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS raw_title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN regexp_matches(url, '^https?://[^@/]+(/|$)') THEN regexp_replace(url, '#.*$', '') ELSE '' END AS web FROM pages")
def html_metadata(spark, d):
    from ..sources.html_meta import raw_title

    return read(spark, d, "pages").select("page_id", "url", raw_title("html").alias("raw_title"), F.try_parse_url("url", F.lit("HOST")).alias("host"), I.web_url("url").alias("web"))


_FILES = "SELECT doc_id AS file_id, CAST(n_chars AS BIGINT) AS length, {hash} AS sha256 FROM documents"


def _files(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").cast("long").alias("length"), F.sha2("text", 256).alias("sha256"))


@query(f"WITH f AS ({_FILES.format(hash='sha256(text)')}), r AS (SELECT doc_id AS file_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) SELECT (SELECT count(*) FROM f) AS file_count, (SELECT sum(length)::BIGINT FROM f) AS bytes, (SELECT count(*) FROM r) AS reference_count, (SELECT sum(length)::BIGINT FROM r JOIN f USING (file_id)) AS logical_bytes, (SELECT (SELECT sum(length) FROM r JOIN f USING (file_id)) - sum(length) FROM f WHERE file_id IN (SELECT file_id FROM r))::BIGINT AS saved_bytes, (SELECT sum(length) FROM f WHERE file_id NOT IN (SELECT file_id FROM r))::BIGINT AS unused_bytes")
def storage_stats(spark, d):
    refs = read(spark, d, "labels").select(F.col("doc_id").alias("file_id")).unionByName(read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id")))
    return storage.stats(_files(spark, d), refs)


@query(f"WITH f AS ({_FILES.format(hash='sha256(text)')}) SELECT file_id, min(file_id) OVER (PARTITION BY length, sha256) AS kept_id, min(file_id) OVER (PARTITION BY length, sha256) <> file_id AS reused FROM f")
def content_dedup(spark, d):
    return storage.same_content(_files(spark, d)).select("file_id", "kept_id", "reused")


@query(
    f"WITH f AS ({_FILES.format(hash='sha256(text)')}), b AS (SELECT file_id + 5 AS file_id, length, sha256 FROM f UNION ALL SELECT file_id, length, sha256 FROM f WHERE file_id < 5), j AS (SELECT coalesce(f.file_id, b.file_id) AS file_id, f.length AS la, b.length AS lb, f.sha256 AS ha, b.sha256 AS hb FROM f FULL JOIN b USING (file_id)) "
    "SELECT CAST(file_id AS VARCHAR) AS name, CASE WHEN hb IS NULL THEN 'missing' WHEN ha IS NULL THEN 'unexpected' WHEN la <> lb THEN 'size' WHEN ha <> hb THEN 'content' END AS problem FROM j WHERE hb IS NULL OR ha IS NULL OR la <> lb OR ha <> hb"
)
def manifest_diff(spark, d):
    f = _files(spark, d)
    named = lambda df: df.select(F.col("file_id").cast("string").alias("name"), "length", "sha256")
    two = f.withColumn("file_id", F.col("file_id") + 5).unionByName(f.where("file_id < 5"))
    return storage.manifest_diff(named(f), named(two))


@query("SELECT event_id, greatest(pow(2.0, event_id % 5) * 1000, CASE WHEN event_id % 3 = 0 THEN value * 1000 ELSE 0.0 END) AS delay FROM events")
def retry_backoff(spark, d):
    return read(spark, d, "events").select("event_id", T.retry_delay(F.col("event_id") % 5, F.when(F.col("event_id") % 3 == 0, F.col("value") * 1000)).alias("delay"))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g) "
    "SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY user_id, run"
)
def notes_debounce(spark, d):
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = capture.debounced(rows, "user_id", "ts", "event_id", "30 minutes")
    return out.select("user_id", F.unix_micros("first_ts").alias("first_us"), "n", "last_event")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_capture_dedup(spark, d):
    return capture.dedup_stream_to_table(spark, f"{d}/events.parquet", ["user_id", "event_type"], "event_id")


@query("WITH w AS (SELECT user_id AS library, event_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS revision FROM events) SELECT library, seq, revision, true AS accepted FROM w UNION ALL SELECT library, seq + 1000000, revision, false FROM w")
def optimistic_writes(spark, d):
    from pyspark.sql import Window

    w = read(spark, d, "events").select(F.col("user_id").alias("library"), F.col("event_id").alias("seq"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("revision"))
    late = w.withColumn("seq", F.col("seq") + 1000000)
    return capture.applied(w.unionByName(late))


@query("WITH e AS (SELECT user_id AS k, event_id AS ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT k, event_id, CAST(max(ms - n * 350) OVER (PARTITION BY k ORDER BY n) + n * 350 AS BIGINT) AS at_ms FROM e")
def request_pacing(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ms"), "event_id")
    return capture.paced(rows, "k", "ms", 350).select("k", "event_id", F.col("at_ms").cast("long").alias("at_ms"))


@query("SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def docx_round_trip(spark, d):
    from ..sources import archives

    files = archives.write_docx(read(spark, d, "documents").select("doc_id", "text"))
    return archives.read_docx(files).where("problem is null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


#: Manuscripts' pieces, their markers numbered, and what becomes of a copy whose first citation is edited by hand.
_WORD = f"""
WITH p AS (SELECT *, (l_partkey + l_linenumber) % 9 NOT IN (3, 6) AS cites FROM ({S.duck(S.CITE)})),
n AS (SELECT *, count(*) FILTER (cites) OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, piece ROWS UNBOUNDED PRECEDING) AS k FROM p),
t AS (SELECT doc_id, count(*) FILTER (cites) AS n_citations, string_agg(piece, '. ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, piece) AS source,
  string_agg(CASE WHEN cites THEN regexp_replace(piece, '[(\\[].*[)\\]]', '<' || k || '>') ELSE piece END, '. ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, piece) AS made FROM n GROUP BY doc_id)
"""


@query(f"{_WORD} SELECT doc_id, n_citations, made || CASE WHEN n_citations > 0 THEN chr(10) || 'References' || chr(10) || 'Works cited: ' || n_citations ELSE '' END AS made, source AS restored, n_citations > 0 AS refused FROM t")
def word_restore(spark, d):
    from ..sources import archives, word

    docs = manuscripts(spark, d)
    cites = citations.parse_markers(docs).select("doc_id", "ord", "start", "end", "original", F.concat(F.lit("<"), F.row_number().over(Window.partitionBy("doc_id").orderBy("start")), F.lit(">")).alias("replacement"))
    cites = stored(cites)
    entries = cites.groupBy("doc_id").agg(F.lit(1).alias("pos"), F.concat(F.lit("Works cited: "), F.count("*")).alias("entry"))
    made = stored(word.generate_docx(archives.write_docx(docs), cites, entries))
    whole = lambda files, name: archives.read_docx(files).where("problem is null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"]), "\n").alias(name))
    edited = word.restore_docx(made.select("doc_id", word.with_text(F.col("content"), "<1>", "<0>").alias("content"))).select("doc_id", F.col("problem").isNotNull().alias("refused"))
    back = stored(word.restore_docx(made))
    counts = back.select("doc_id", F.size("sources").cast("long").alias("n_citations"))
    return counts.join(whole(made, "made"), "doc_id").join(whole(back, "restored"), "doc_id").join(edited, "doc_id")
