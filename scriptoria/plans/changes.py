"""Queries over changes by id, embedded papers, caches, tables, polls and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import identifiers as I
from ..operators import caches, changes, embedded, layout, library, storage, styles
from ..sources.library import chat_rows
from ..streaming import capture
from . import surrogates as S
from .queries import WITH, blocks, papers, query, read

_MARKED = (
    "hs AS (SELECT 'p' || CAST(user_id AS VARCHAR) AS id, list('h' || CAST(event_id AS VARCHAR) ORDER BY event_id) AS ids FROM events GROUP BY user_id), "
    "marked AS (SELECT p.id, coalesce(ids, []) AS ids FROM papers p LEFT JOIN hs USING (id))"
)


def _marks(spark, d):
    """A highlight for each event."""
    h = F.struct(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("id"), F.lit("yellow").alias("color"), F.col("event_type").alias("note"))
    return read(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("pos"), h.alias("highlight"))


def _marked(spark, d):
    bare = papers(spark, d).select("id", F.lit(None).cast("array<struct<id:string,color:string,note:string>>").alias("highlights"))
    known = _marks(spark, d)
    return changes.with_highlights(bare, known.join(bare.select("id"), "id", "left_semi"))


@query(f"{WITH} SELECT id, CASE WHEN lib_pos % 3 = 0 THEN 'Ada; Ida' ELSE authors END AS authors, CASE WHEN lib_pos % 6 = 0 THEN '1999' ELSE year END AS year, status, "
       "CASE WHEN lib_pos % 3 = 0 AND authors <> 'Ada; Ida' THEN NULL ELSE 'parsed ' || authors END AS \"cslAuthors\", CASE WHEN lib_pos % 6 = 0 AND year <> '1999' THEN NULL ELSE 'parts ' || year END AS \"dateParts\" FROM papers")
def paper_edit(spark, d):
    p = papers(spark, d).withColumns({"cslAuthors": F.concat(F.lit("parsed "), "authors"), "dateParts": F.concat(F.lit("parts "), "year")})
    new = papers(spark, d).where("lib_pos % 3 = 0").select("id", F.lit("Ada; Ida").alias("authors"), F.when(F.col("lib_pos") % 6 == 0, "1999").alias("year"))
    return changes.edited(p, new).select("id", "authors", "year", "status", "cslAuthors", "dateParts")


_PDFS = "f AS (SELECT doc_id AS pos, 'f' || CAST(doc_id AS VARCHAR) AS file_id, replace(lang, ' ', '_') || '_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS name FROM documents)"


@query(f"{WITH}, {_PDFS} SELECT id, title, lib_pos FROM papers UNION ALL SELECT file_id, regexp_replace(name, '\\.pdf$', '', 'i'), (SELECT min(lib_pos) FROM papers) - row_number() OVER (ORDER BY pos) FROM f WHERE name NOT LIKE '%.txt'")
def pdf_batch_import(spark, d):
    name = F.concat(F.replace("lang", F.lit(" "), F.lit("_")), F.lit("_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".PDF").otherwise(".txt"))
    files = read(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), name.alias("name"), (F.col("doc_id") % 3 < 2).alias("is_pdf"))
    p = papers(spark, d).select("id", "title", F.lit("").alias("pdfId"), F.lit("").alias("pdfName"), "lib_pos")
    return changes.pdf_imported(p, files)[0].select("id", "title", "lib_pos")


_OUT = "lib_pos % 4 = 0"


@query(f"{WITH}, p AS (SELECT id, lib_pos, lib_pos // 3 AS file_id FROM papers), gone AS (SELECT * FROM p WHERE {_OUT}), f AS (SELECT DISTINCT file_id FROM gone WHERE file_id NOT IN (SELECT file_id FROM p WHERE NOT ({_OUT}))) "
       f"SELECT 'paper' AS what, id FROM p WHERE NOT ({_OUT}) UNION ALL SELECT 'file', CAST(file_id AS VARCHAR) FROM f")
def paper_delete(spark, d):
    p = papers(spark, d).select("id", "lib_pos", F.floor(F.col("lib_pos") / 3).cast("long").alias("pdfId"))
    files = p.select(F.col("pdfId").alias("file_id")).distinct()
    kept, unused = changes.deleted(p, p.where(_OUT), files)
    return kept.select(F.lit("paper").alias("what"), "id").unionByName(unused.select(F.lit("file").alias("what"), F.col("file_id").cast("string").alias("id")))


@query(f"{WITH}, {_MARKED} SELECT id, array_to_string(ids, ' ') AS ids FROM marked")
def highlight_add(spark, d):
    return _marked(spark, d).select("id", F.array_join(F.transform("highlights", lambda h: h["id"]), " ").alias("ids")).select("id", F.coalesce("ids", F.lit("")).alias("ids"))


@query(f"{WITH} SELECT 'p' || CAST(user_id AS VARCHAR) AS paper, 'h' || CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'blue' ELSE 'yellow' END AS color, CASE WHEN event_id % 6 = 0 THEN 'seen' ELSE event_type END AS note FROM events "
       "WHERE event_id % 5 <> 0 AND 'p' || CAST(user_id AS VARCHAR) IN (SELECT id FROM papers)")
def highlight_change(spark, d):
    p = _marked(spark, d)
    each = read(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("paper"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("id"), "event_id")
    each = each.join(p.select(F.col("id").alias("paper")), "paper", "left_semi")
    new = each.where("event_id % 2 = 0").select("paper", "id", F.lit("blue").alias("color"), F.when(F.col("event_id") % 6 == 0, "seen").alias("note"))
    rows = changes.highlights_removed(changes.highlights_changed(p, new), each.where("event_id % 5 = 0"))
    return rows.select(F.col("id").alias("paper"), F.inline("highlights")).select("paper", "id", "color", "note")


@query("SELECT l_orderkey AS pdf_id, l_orderkey || '-' || (row_number() OVER w - 1) AS id, l_linenumber AS paragraph, l_returnflag || CAST(l_partkey AS VARCHAR) AS quote, CASE WHEN row_number() OVER w = 1 THEN 'why' END AS note "
       "FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice)")
def highlight_selection(spark, d):
    part = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    made = lambda x: F.struct(F.lit(1).alias("page"), x["l_linenumber"].alias("paragraph"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.concat(x["l_returnflag"], x["l_partkey"].cast("string")).alias("quote"))
    picked = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(part)), made).alias("parts"))
    picked = picked.select(F.col("l_orderkey").cast("string").alias("selection"), F.col("l_orderkey").alias("pdf_id"), F.lit("green").alias("color"), F.lit("why").alias("note"), "parts")
    return changes.highlight_parts(picked).select("pdf_id", "id", "paragraph", "quote", "note")


@query("SELECT count(*) AS cache_count, CAST(sum(n_chars) AS BIGINT) AS cache_bytes FROM documents WHERE doc_id % 3 = 0")
def cache_stats(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".json.gz").otherwise(".json"))
    return caches.stats(read(spark, d, "documents").select(name.alias("name"), F.col("n_chars").cast("long").alias("length")))


@query(f"{WITH}, p AS (SELECT pdf_id, page, sum(length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) AS n FROM blocks GROUP BY pdf_id, page), "
       "s AS (SELECT pdf_id, CAST(sum(n) AS BIGINT) AS characters, count(*) FILTER (n < 30) AS blank_pages, count(*) FILTER (page % 4 = 0) AS omitted_pages FROM p GROUP BY pdf_id) "
       "SELECT *, characters >= 50 AS usable, concat_ws('|', CASE WHEN blank_pages > 0 THEN blank_pages || ' page(s) hold little or no text.' END, CASE WHEN omitted_pages > 0 THEN omitted_pages || ' page(s) are kept without their figures.' END) AS warnings FROM s")
def page_character_stats(spark, d):
    pages = blocks(spark, d).groupBy("pdf_id", "page").agg(F.collect_list("text").alias("paragraphs"), F.bool_or(F.col("page") % 4 == 0).alias("omitted"))
    return caches.page_stats(pages).withColumn("warnings", F.array_join("warnings", "|"))


_CELLS = "SELECT l_suppkey AS pdf_id, 1 AS page, l_orderkey % 30 AS row, l_quantity * 3 + l_linenumber * 0.25 AS x, CASE WHEN l_partkey % 3 = 0 THEN 'word' ELSE CAST(l_partkey AS STRING) END AS text FROM {lineitem} WHERE l_linenumber < 3"


@query(f"WITH c AS ({S.duck(_CELLS)}), k AS (SELECT pdf_id, page, row FROM c GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (text <> 'word') >= 3), d AS (SELECT c.* FROM c JOIN k USING (pdf_id, page, row)), "
       "s AS (SELECT pdf_id, page, row, x, (SELECT count(DISTINCT o.row) FROM d o WHERE o.pdf_id = d.pdf_id AND o.page = d.page AND abs(o.x - d.x) < 2) AS support FROM d), "
       "a AS (SELECT pdf_id, page, row, count(*) AS n_cells FROM s WHERE support >= 4 GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY pdf_id, page) >= 4")
def table_rows(spark, d):
    return layout.aligned_rows(S.spark_table(spark, d, _CELLS))


@query("WITH r AS (SELECT user_id AS pdf_id, event_id AS ord, CAST(event_id AS DOUBLE) AS x, CAST(event_id % 30 + 20 AS DOUBLE) AS width, CAST(10 + event_id % 7 AS DOUBLE) AS height FROM events), "
       "g AS (SELECT *, CASE WHEN x - lag(x + width) OVER w > 0.9 * least(height, lag(height) OVER w) OR lag(x) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY pdf_id ORDER BY x, ord)), c AS (SELECT *, sum(new) OVER (PARTITION BY pdf_id ORDER BY x, ord) AS chain FROM g) "
       "SELECT pdf_id, min(x) AS x, max(x + width) - min(x) AS width, max(height) AS height, string_agg(CAST(ord AS VARCHAR), ' ' ORDER BY x, ord) AS text FROM c GROUP BY pdf_id, chain HAVING count(*) >= 3")
def spanning_chains(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("pdf_id"), F.lit(1).alias("page"), F.lit(1).alias("baseline"), F.col("event_id").alias("ord"), F.col("event_id").cast("double").alias("x"), (F.col("event_id") % 30 + 20).cast("double").alias("width"), (F.col("event_id") % 7 + 10).cast("double").alias("height"), F.col("event_id").cast("string").alias("text"))
    return layout.spanning_chains(e).select("pdf_id", "x", "width", "height", "text")


@query("SELECT lang AS manifest, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def manifest_totals(spark, d):
    return storage.manifest_totals(read(spark, d, "documents").select(F.col("lang").alias("manifest"), F.col("n_chars").cast("long").alias("length")), "manifest")


@query("SELECT doc_id AS file_id, CAST(greatest(1, ceil(strlen(text) / 1024.0)) AS BIGINT) AS n_chunks, sha256(text) AS sha256 FROM documents")
def chunk_transfer(spark, d):
    chunks = storage.chunked(read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content")), 1024)
    return storage.reassembled(chunks).select("file_id", "n_chunks", F.sha2("content", 256).alias("sha256"))


@query("WITH p AS (SELECT user_id AS library, event_id AS seq, CAST(event_id + 40 * (event_id % 3) AS BIGINT) AS revision FROM events) SELECT *, coalesce(revision >= max(revision) OVER (PARTITION BY library ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM p")
def revision_polls(spark, d):
    return capture.refreshed(read(spark, d, "events").select(F.col("user_id").alias("library"), F.col("event_id").alias("seq"), (F.col("event_id") + F.col("event_id") % 3 * 40).alias("revision")))


@query(f"{WITH}, s AS (SELECT id, title AS label, row_number() OVER (ORDER BY lib_pos) AS rank, contains(lower(title || ' ' || id), 'ring') AS m FROM papers) SELECT id, CASE WHEN m THEN rank ELSE 0 END AS rank FROM s WHERE m OR id = 'p1'")
def style_choices(spark, d):
    s = papers(spark, d).select("id", F.col("title").alias("label"), (F.col("lib_pos") + 1).alias("rank"))
    return styles.choices(s, " Ring ", "p1").select("id", F.col("rank").cast("long").alias("rank"))


_THROUGH = "CASE n % 4 WHEN 0 THEN 'https://www-host{k}-org.ezproxy.lib.edu/a/{k}' WHEN 1 THEN 'http://www-host{k}-org.proxy.lib.edu/a' WHEN 2 THEN 'https://www-host{k}-org.example.edu/a' ELSE 'https://www-host{k}-org.lib.proxy.edu:8443/a' END".replace("{k}", "' || k || '")


@query(f"WITH c AS (SELECT c_custkey AS n, CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT n, CASE n % 4 WHEN 0 THEN 'https://www-host' || k || '-org.ezproxy.lib.edu' WHEN 3 THEN 'https://www-host' || k || '-org.lib.proxy.edu:8443' ELSE 'https://www.host' || k || '.org' END || '/x.pdf?n=' || k AS url FROM c")
def proxied_pdf(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("k"))
    return c.select("n", I.proxied(F.concat(F.lit("https://www.host"), "k", F.lit(".org/x.pdf?n="), "k"), F.expr(_THROUGH)).alias("url"))


@query("SELECT n_nationkey AS n, CASE n_nationkey % 5 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'de-DE' WHEN 2 THEN 'eu' WHEN 3 THEN NULL ELSE 'zh-CN' END AS locale FROM nation")
def style_locale(spark, d):
    given = F.element_at(F.array(*[F.lit(x) for x in ("en-GB", "de", "eu", "EN_us", "zh")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("n"), I.locale(given).alias("locale"))


@query("WITH f AS (SELECT p_partkey AS id, p_size * 40 + 100 AS w, p_retailprice AS h, p_size * 90 AS t FROM part), s AS (SELECT *, least(greatest(0.25, t / w), sqrt(12000000 / (w * h))) AS k FROM f) SELECT id, round(k, 6) AS scale, CAST(ceil(w * k) AS BIGINT) AS width, CAST(ceil(h * k) AS BIGINT) AS height, "
       "floor(greatest(25, least(600, t / 3.0)) * 10 + 0.5) / 10 AS zoom, round((5 + 7) * (floor(greatest(25, least(600, t / 3.0)) * 10 + 0.5) / 10 / 100) - 7, 6) AS \"left\", round(100 * exp(-greatest(-400, least(400, (id % 90 - 45) * CASE id % 3 WHEN 1 THEN 16 WHEN 2 THEN 800 ELSE 1 END)) * 0.002), 6) AS wheel FROM s")
def figure_zoom(spark, d):
    n = F.col("p_partkey")
    w, h, t = F.col("p_size") * 40 + 100, F.col("p_retailprice"), F.col("p_size") * 90
    size, at = geometry.figure_size(w, h, t), geometry.zoomed(F.lit(100.0), t / 3.0, F.lit(5), F.lit(6), F.lit(7), F.lit(8))
    wheel = geometry.wheel_zoom(F.lit(100.0), n % 90 - 45, n % 3, F.lit(800))
    return read(spark, d, "part").select(n.alias("id"), F.round(size["scale"], 6).alias("scale"), size["width"].alias("width"), size["height"].alias("height"), at["zoom"].cast("double").alias("zoom"), F.round(at["left"], 6).alias("left"), F.round(wheel, 6).alias("wheel"))


_ODD = "SELECT * REPLACE (CASE lib_pos % 10 WHEN 1 THEN '  ' ELSE title END AS title, CASE lib_pos % 10 WHEN 2 THEN '0123' ELSE pmid END AS pmid, CASE lib_pos % 10 WHEN 3 THEN 'http://me:pw@example.org/' ELSE \"sourceUrl\" END AS \"sourceUrl\", CASE lib_pos % 10 WHEN 4 THEN '10.x/1' ELSE doi END AS doi) FROM papers"


def _odd(spark, d):
    r = F.col("lib_pos") % 10
    put = lambda k, v, c: F.when(r == k, F.lit(v)).otherwise(F.col(c))
    return papers(spark, d).withColumns({"title": put(1, "  ", "title"), "pmid": put(2, "0123", "pmid"), "sourceUrl": put(3, "http://me:pw@example.org/", "sourceUrl"), "doi": put(4, "10.x/1", "doi")})


@query(f"{WITH} SELECT collection AS request, count(*) AS n, bool_and(lib_pos % 10 NOT IN (1, 2, 3, 4)) AS valid, bool_and(lib_pos % 10 NOT IN (1, 2, 3, 4)) AND count(*) <= 100 AS fits FROM (SELECT *, collection || lib_pos % 10 AS c FROM papers) GROUP BY collection, c".replace("SELECT collection AS request", "SELECT c AS request"))
def temporary_papers(spark, d):
    rows = _odd(spark, d).withColumn("request", F.concat("collection", (F.col("lib_pos") % 10).cast("string")))
    return embedded.temporary_fits(rows, "request").select("request", "n", "valid", "fits")


@query(f"{WITH} SELECT id, lib_pos % 10 NOT IN (1, 2, 3, 4, 5, 6, 7) AS valid FROM papers")
def embedded_papers(spark, d):
    r = F.col("lib_pos") % 10
    rows = _odd(spark, d).withColumn("cslType", F.when(r == 6, "poem").otherwise(F.col("cslType"))).withColumn("dateParts", F.when(r == 7, F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).otherwise(F.array(F.lit(1999))))
    known = [c for c in rows.columns if c in embedded.FIELDS]
    json = F.to_json(F.struct(*known, F.when(r == 5, "x").alias("secret")))
    return embedded.read_embedded(rows.select(F.col("id").alias("paper"), json.alias("json")), "json").select(F.col("paper").alias("id"), "valid")


@query("SELECT l_orderkey AS document, CAST(l_suppkey % 4 AS VARCHAR) AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber * 100000 + l_partkey), CAST(l_suppkey % 4 AS VARCHAR)) AS pos FROM lineitem GROUP BY l_orderkey, l_suppkey % 4")
def embedded_snapshots(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("at"), (F.col("l_suppkey") % 4).cast("string").alias("title"))
    out = embedded.snapshots(rows, "document", "at")
    return out.select("document", F.get_json_object("json", "$.title").alias("title"), F.col("pos").cast("long").alias("pos"))


@query("WITH m AS (SELECT conv_id, max(turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id AS paper, CAST(t + k AS BIGINT) AS pos, CASE k WHEN 1 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 1 THEN 'q' ELSE 'a' END || conv_id AS text FROM m, (VALUES (1), (2)) v(k) WHERE n < 100")
def chat_append(spark, d):
    chats = read(spark, d, "conversations").select(F.col("conv_id").alias("paper"), F.col("turn").cast("long").alias("pos"), "role", "text")
    turns = chats.select("paper").distinct().select("paper", F.concat(F.lit("q"), "paper").alias("question"), F.concat(F.lit("a"), "paper").alias("answer"))
    return chat_rows(chats, turns)


@query(
    f"{WITH} SELECT id, CASE lib_pos % 9 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'status' WHEN 3 THEN 'pmid' WHEN 4 THEN 'type' WHEN 5 THEN 'date' WHEN 6 THEN 'address' WHEN 7 THEN 'pdf id' ELSE CASE WHEN lib_pos % 4 = 0 THEN 'pdf missing' END END AS problem FROM papers"
)
def server_validity(spark, d):
    r = F.col("lib_pos") % 9
    put = lambda k, v, c: F.when(r == k, F.lit(v)).otherwise(F.col(c))
    pdf = F.concat(F.lit("0000000A-0000-4000-8000-"), F.lpad(F.col("lib_pos").cast("string"), 12, "0"))
    p = papers(spark, d).withColumns({"title": put(1, " ", "title"), "status": put(2, "Lost", "status"), "pmid": put(3, "012", "pmid"), "cslType": put(4, "poem", "cslType"), "sourceUrl": put(6, "ftp://x.org/", "sourceUrl")})
    p = p.withColumn("dateParts", F.when(r == 5, F.array(*map(F.lit, (2020, 1, 2, 3)))).otherwise(F.array(F.lit(2020)))).withColumn("pdfId", F.when(r == 7, "x.pdf").when(F.col("lib_pos") % 2 == 0, pdf))
    files = p.where("lib_pos % 4 > 0").select(F.lower(pdf).alias("file_id"))
    return library.checked_papers(p, files).select("id", "problem")
