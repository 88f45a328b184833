"""Queries over pages made of the benchmark tables: glyph runs and image boxes of a page for each order, with its line items as images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures, furniture, openings, tables
from . import surrogates as S
from .queries import query

#: Captions stand at one of five heights; half of their second lines are too far away.
CAPTIONS = """
SELECT o_orderkey AS pdf_id, CAST(1 + o_orderkey % 7 AS INT) AS page, CAST(200 + 10 * (o_orderkey % 5) AS DOUBLE) AS y, 'Figure ' || CAST(o_orderkey AS STRING) || ': Parts of orders ' AS first,
       o_orderpriority || ' and more.' AS second, CAST(CASE o_orderkey % 2 WHEN 0 THEN 10 ELSE 20 END AS DOUBLE) AS step
FROM {orders}
"""
RUNS = f"""
SELECT pdf_id, page, 1 AS seq, 'the first line of an article that is long enough to be prose' AS str, 50.0D AS x, 760.0D AS y, 500.0D AS width, 10.0D AS size, 'body' AS font FROM ({CAPTIONS})
UNION ALL SELECT pdf_id, page, 2, 'the second line of an article that is long enough to be prose', 50.0D, 748.0D, 500.0D, 10.0D, 'body' FROM ({CAPTIONS})
UNION ALL SELECT pdf_id, page, 3, 'the third line of an article that is long enough to be prose', 50.0D, 736.0D, 500.0D, 10.0D, 'body' FROM ({CAPTIONS})
UNION ALL SELECT pdf_id, page, 4, first, 50.0D, y, 300.0D, 8.0D, 'legend' FROM ({CAPTIONS})
UNION ALL SELECT pdf_id, page, 5, second, 50.0D, y - step, 300.0D, 8.0D, 'legend' FROM ({CAPTIONS})
"""
BOXES = f"""
SELECT pdf_id, page, 0.08 + 0.02 * (l_partkey % 20) AS x, (800 - y - 8) / 800 - 0.009 * (l_partkey % 9) - (0.026 + 0.01 * (l_suppkey % 3)) AS y, 0.05 + 0.01 * (l_partkey % 13) AS width, 0.026 + 0.01 * (l_suppkey % 3) AS height
FROM ({CAPTIONS}) c JOIN {{lineitem}} l ON l.l_orderkey = c.pdf_id
"""
DOUBLE_BOXES = f"SELECT pdf_id, page, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM ({BOXES})".replace("0.08 +", "0.08D +").replace("0.02 *", "0.02D *").replace("0.009 *", "0.009D *").replace("0.026 +", "0.026D +").replace("0.01 *", "0.01D *").replace("0.05 +", "0.05D +")


def _duck(sql: str) -> str:
    import re

    return re.sub(r"\b(\d+\.\d+)D\b", r"\1::DOUBLE", S.duck(sql))


_CROPS = f"""
WITH captions AS ({_duck(CAPTIONS)}), boxes AS ({_duck(DOUBLE_BOXES)}),
near AS (SELECT b.*, b.y + b.height AS stop, (800 - c.y - 8) / 800 AS top, c.y AS cy FROM boxes b JOIN captions c USING (pdf_id, page)
  WHERE b.width * 600 > 25 AND b.height * 800 > 20 AND ((800 - c.y - 8) / 800 - (b.y + b.height)) * 800 < 60 AND b.y + b.height <= (800 - c.y - 8) / 800 + 0.01::DOUBLE AND (b.x + b.width / 2) * 600 BETWEEN 42 AND 575),
walk AS (SELECT *, coalesce(stop < min(y) OVER (PARTITION BY pdf_id, page ORDER BY stop DESC, y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.04::DOUBLE, false)::INTEGER AS far FROM near),
cut AS (SELECT *, max(far) OVER (PARTITION BY pdf_id, page ORDER BY stop DESC, y, x ROWS UNBOUNDED PRECEDING) AS apart FROM walk),
crops AS (SELECT pdf_id, page, greatest(0, min(x) - 4::DOUBLE / 600) AS x, greatest(0, min(y) - 4::DOUBLE / 800) AS y, least(1, max(x + width) + 4::DOUBLE / 600) AS r, least((800 - any_value(cy) - 8 - 2) / 800, max(stop) + 4::DOUBLE / 800) AS b, count(*) AS n FROM cut WHERE apart = 0 GROUP BY pdf_id, page),
found AS (SELECT c.pdf_id, c.page, 'Figure ' || c.pdf_id AS label, trim(first) || CASE WHEN step < 8 * 1.65 THEN ' ' || second ELSE '' END AS caption,
  coalesce(k.x, 42::DOUBLE / 600) AS x, coalesce(k.y, 72::DOUBLE / 800) AS y, coalesce(k.r, 575::DOUBLE / 600) AS r, coalesce(k.b, (800 - c.y - 8 - 5) / 800) AS b, coalesce(n, 0) AS n_images FROM captions c LEFT JOIN crops k USING (pdf_id, page))
"""


def _tables(spark, d):
    runs = S.spark_table(spark, d, RUNS)
    zero = F.lit(0.0)
    items = runs.select("pdf_id", "page", "seq", "str", F.array("size", zero, zero, "size", "x", "y").alias("transform"), "width", F.col("size").alias("height"), F.col("font").alias("fontName"))
    pages = S.spark_table(spark, d, CAPTIONS).select("pdf_id", "page").distinct().withColumn("page_width", F.lit(600.0)).withColumn("page_height", F.lit(800.0))
    return items, pages, S.spark_table(spark, d, DOUBLE_BOXES)


@query(f"{_CROPS} SELECT pdf_id, page, label, caption, round(x, 6) AS x, round(y, 6) AS y, round(r - x, 6) AS width, round(b - y, 6) AS height FROM found")
def figure_crops(spark, d):
    found, _ = figures.figures(*_tables(spark, d))
    return found.select("pdf_id", "page", "label", "caption", *[F.round(f"crop.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


@query(f"{_CROPS} SELECT pdf_id, page, n_images FROM found WHERE n_images > 0")
def figure_panels(spark, d):
    return figures.panel_groups(*_tables(spark, d)).select("pdf_id", "page", F.col("n_boxes").cast("long").alias("n_images"))


@query(f"{_CROPS} SELECT pdf_id, page, 3 + CASE WHEN step < 8 * 1.65 THEN 0 ELSE 1 END AS n_left FROM captions")
def figure_texts_left(spark, d):
    _, rest = figures.figures(*_tables(spark, d))
    return rest.groupBy("pdf_id", "page").agg(F.count("*").cast("int").alias("n_left"))


# ---- furniture ----------------------------------------------------------------

#: A journal, a beginning of its DOIs, a line of its margins and whether that stands at the foot; {doi} is the paper's.
PUBLISHERS = """
SELECT * FROM (VALUES (0, 'Nature Communications', '10.1038/s41467-', 'Nature Communications | (2024) 15:1234', true), (1, 'Nature', '10.1038/s41586-', 'Article https://doi.org/', false), (2, 'Genome Biol.', '10.1186/s13059-', 'Berg et al. Genome Biology (2020) 21:12', false),
  (3, 'PLOS ONE', '10.1371/journal.', 'PLOS ONE | 9 / 12 | May 9, 2024 | https://doi.org/', true), (4, 'Science Advances', '10.1126/sciadv.', '3 of 12', true), (5, 'Science', '10.1126/science.', 'SCIENCE www.sciencemag.org VOL 300 9 MAY 2003', true),
  (6, 'Cell', '10.1016/j.cell.', 'Cell 30, 1-9, January 7, 2020', true), (7, 'Reeds', '10.1000/r', 'REEDS | VOL 50 | 1 MAY 2013', true), (8, 'bioRxiv', '10.1101/', 'bioRxiv preprint doi: https://doi.org/10.1101/2020.01.02.3', false), (9, 'Journal of Nests', '10.1000/n', 'Journal of Nests', false)) AS v(k, journal, start, line, foot)
"""
_MARGINS = f"""
SELECT o_orderkey AS pdf_id, CAST(2 + o_custkey % 5 AS INT) AS page, o.k AS k, own.journal AS journal, own.start || CAST(o_orderkey AS STRING) AS doi, own.foot AS foot, other.foot AS other_foot,
       own.line || CASE WHEN own.k IN (1, 3) THEN own.start || CAST(o_orderkey AS STRING) ELSE '' END AS own_line, other.line || CASE WHEN other.k IN (1, 3) THEN other.start || CAST(o_orderkey AS STRING) ELSE '' END AS other_line
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 10 AS k FROM {{orders}}) o JOIN ({PUBLISHERS}) own ON own.k = o.k JOIN ({PUBLISHERS}) other ON other.k = (o.k + 1) % 10
"""


@query(
    f"WITH m AS ({S.duck(_MARGINS)}) SELECT pdf_id, page, 2 - CASE WHEN k IN (4, 6, 7) THEN 1 ELSE 0 END AS n_left, CASE WHEN k IN (4, 6, 7) THEN '' ELSE other_line || chr(10) END || own_line AS texts FROM m"
)
def furniture_left(spark, d):
    m = S.spark_table(spark, d, _MARGINS)
    run = lambda seq, line, y: F.struct(F.lit(seq).alias("seq"), line.alias("str"), F.array(*[F.lit(x) for x in (9.0, 0.0, 0.0, 9.0, 50.0)], y.cast("double")).alias("transform"))
    at = lambda foot, low, high: F.when(F.col(foot), low).otherwise(high)
    runs = F.array(run(1, F.col("own_line"), at("foot", 30, 770)), run(2, F.col("other_line"), at("other_foot", 24, 776)), run(3, F.col("page").cast("string"), F.lit(10)), run(4, F.col("own_line"), F.lit(400)))
    items = m.select("pdf_id", "page", F.explode(runs).alias("r")).select("pdf_id", "page", "r.*")
    pages = m.select("pdf_id", "page", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    rest = furniture.without_furniture(items, pages, m.select("pdf_id", F.lit("").alias("title"), "journal", "doi"))
    return rest.groupBy("pdf_id", "page").agg(F.count("*").cast("int").alias("n_left"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda x: x["str"]), "\n").alias("texts"))


# ---- tables --------------------------------------------------------------------

#: A labelled table for each order: a row for each line item, whose last cell stands at one of three places.
_CELLS = """
SELECT pdf_id, CAST(1 AS INT) AS page, CAST(rn AS INT) AS rn, CAST(c AS INT) AS c, CAST(60 + 60 * c + CASE c WHEN 5 THEN 1.5 * place ELSE 0 END AS DOUBLE) AS x, CAST(660 - 10 * rn AS DOUBLE) AS y, CAST(10 + v % 9 AS DOUBLE) AS width, CAST(v + c AS STRING) AS t
FROM (SELECT l_orderkey AS pdf_id, CAST(l_quantity AS INT) AS v, l_partkey % 3 AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM {lineitem}) r CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS k(c)
"""


@query(
    f"WITH cells AS ({S.duck(_CELLS)}), support AS (SELECT a.pdf_id, a.rn, a.c, count(DISTINCT b.rn) AS n FROM cells a JOIN cells b ON a.pdf_id = b.pdf_id AND abs(a.x - b.x) < 2 GROUP BY ALL), kept AS (SELECT c.*, n FROM cells c JOIN support USING (pdf_id, rn, c)), "
    "good AS (SELECT pdf_id, rn, max(CASE WHEN n >= 4 THEN x + width END) AS stop, max(y) AS y FROM kept GROUP BY pdf_id, rn HAVING count(*) FILTER (n >= 4) >= 5), t AS (SELECT pdf_id, max(stop) + 2 AS stop, max(y) + 20 AS top, min(y) - 5 AS bottom FROM good GROUP BY pdf_id HAVING count(*) >= 4) "
    "SELECT pdf_id, page, count(*) + 1 AS n_texts, string_agg(cells.t, ' ' ORDER BY rn, c) AS texts FROM cells JOIN t USING (pdf_id) WHERE cells.y BETWEEN bottom AND top AND x + width <= stop GROUP BY pdf_id, page"
)
def table_labels(spark, d):
    cells = S.spark_table(spark, d, _CELLS, dealt_by={"lineitem": "l_orderkey"})
    zero = F.lit(0.0)
    shown = lambda seq, text, x, y, width, size: [seq.cast("int").alias("seq"), text.alias("str"), F.array(size, zero, zero, size, x, y).alias("transform"), width.cast("double").alias("width"), size.alias("height"), F.lit("f").alias("fontName")]
    rows = cells.select("pdf_id", "page", *shown(F.col("rn") * 6 + F.col("c"), F.col("t"), F.col("x"), F.col("y"), F.col("width"), F.lit(7.0)))
    # grouped by what cells are dealt by, so that labels and pages come to where their rows are
    one = S.spark_table(spark, d, _CELLS).where("c = 0").groupBy("pdf_id").agg(F.first("page").alias("page"))
    labels = one.select("pdf_id", "page", *shown(F.lit(0), F.lit("Table 1. Items"), F.lit(60.0), F.lit(700.0), F.lit(100), F.lit(10.0)))
    items = rows.unionByName(labels)
    pages = one.select("pdf_id", "page", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    found = tables.table_texts(items, pages)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") > 0, F.struct("seq", "str")))), lambda x: x["str"]), " ")
    return found.groupBy("pdf_id", "page").agg(F.count("*").alias("n_texts"), texts.alias("texts"))


# ---- opening pages ---------------------------------------------------------------

#: An opening page for each order: one of four templates or none, with an abstract of two to five lines, too few of which are no evidence.
_OPENINGS = """
SELECT o_orderkey AS pdf_id, CAST(o_orderkey % 5 AS INT) AS k, CAST(2 + o_custkey % 4 AS INT) AS m, CAST(CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 3 > 0 THEN o_custkey % 3 ELSE 1 END AS INT) AS page, o_orderpriority AS what FROM {orders}
"""
_JOURNALS = "SELECT * FROM (VALUES (0, 'Cell Reports'), (1, 'Science Advances'), (2, 'Proceedings of Nests'), (3, 'Nature Methods'), (4, 'Reeds')) v(k, journal)"
#: Runs of a template's page: k, seq, what it is (heads go, abstracts, headings, bodies and notes stay), the first line's place, how many lines (0: as many as the abstract has), the step, width, size, font and text.
_KINDS = """
SELECT * FROM (VALUES
  (0, 100, 'title', 40, 720, 1, 12, 100, 10, 'Sans-Bold', 'Abstract'), (0, 200, 'abstract', 40, 700, 0, 12, 510, 10, 'Serif', ''), (0, 300, 'heading', 40, 630, 1, 12, 130, 10, 'Sans-Bold', 'Introduction'), (0, 400, 'left', 40, 610, 5, 12, 240, 10, 'Serif', ''), (0, 500, 'right', 320, 610, 5, 12, 240, 10, 'Serif', ''),
  (1, 100, 'head', 40, 740, 1, 12, 200, 12, 'Sans', 'The authors of it'), (1, 200, 'abstract', 40, 700, 0, 12, 420, 10, 'ABCDEF+MyriadPro-Semibold', ''), (1, 300, 'heading', 40, 630, 1, 12, 130, 10, 'Sans-Bold', 'Introduction'), (1, 400, 'left', 40, 610, 3, 12, 240, 10, 'Serif', ''),
  (2, 100, 'head', 70, 700, 1, 12, 400, 16, 'Sans', 'A title of it'), (2, 150, 'title', 150, 570, 1, 12, 60, 12, 'Sans', 'Abstract'), (2, 200, 'abstract', 75, 550, 0, 12, 200, 10, 'Serif', ''), (2, 250, 'rest', 327, 571, 1, 12, 200, 10, 'Serif', 'applications of them'),
  (2, 300, 'heading', 307, 535, 1, 12, 90, 12, 'Sans', '1. Introduction'), (2, 400, 'left', 307, 515, 2, 12, 210, 10, 'Serif', ''), (2, 500, 'note', 65, 480, 1, 12, 90, 9, 'Serif', 'Equal contribution of all'),
  (3, 100, 'head', 217, 760, 1, 12, 250, 9, 'GraphikNaturel-Semibold', 'The authors of it'), (3, 200, 'abstract', 217, 700, 0, 12, 250, 10, 'HardingText-Regular', ''), (3, 400, 'left', 40, 580, 5, 11, 250, 8, 'HardingText-Regular', ''), (3, 500, 'right', 306, 580, 5, 11, 250, 8, 'HardingText-Regular', ''),
  (4, 100, 'heading', 40, 720, 1, 12, 130, 10, 'Sans-Bold', 'Introduction'), (4, 400, 'left', 40, 700, 3, 12, 510, 10, 'Serif', '')
) v(k, seq, kind, x, y, n, step, width, size, font, own)
"""
_OPENING_RUNS = f"""
SELECT p.pdf_id, p.page, p.k, p.m, CAST(r.seq + i.i AS INT) AS seq, r.kind, CAST(r.x AS DOUBLE) AS x, CAST(r.y - r.step * i.i AS DOUBLE) AS y, CAST(r.width AS DOUBLE) AS width, CAST(r.size AS DOUBLE) AS size, r.font,
       CASE WHEN r.own <> '' THEN r.own ELSE 'line ' || CAST(i.i AS STRING) || ' of the ' || r.kind || ' tells at some length of ' || p.what || ' and of all that was seen in the spring of the year' END AS str
FROM ({_OPENINGS}) p JOIN ({_KINDS}) r ON r.k = p.k JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) w(i)) i ON i.i < CASE r.n WHEN 0 THEN p.m ELSE r.n END
"""
#: Which pages show enough: three wide lines; four of 350 characters set off; three lines below the heading of a split abstract; three larger lines.
_SHOWN = "CASE WHEN k = 0 AND m >= 3 AND page <= 2 THEN 'wide' WHEN k = 1 AND m >= 4 THEN 'set off' WHEN k = 2 AND m >= 3 THEN 'split' WHEN k = 3 AND m >= 3 THEN 'inset' END"


@query(f"""
WITH runs AS ({S.duck(_OPENING_RUNS)}), told AS (SELECT *, {_SHOWN} AS template FROM runs),
kept AS (SELECT * FROM told WHERE kind <> 'head' OR template IS NULL OR template = 'wide'),
placed AS (SELECT *, CASE WHEN template IS NULL AND k = 2 THEN -y * 1000 + x
  WHEN kind = 'head' THEN 0 WHEN kind = 'title' THEN 1000 WHEN kind = 'abstract' THEN 2000 - y WHEN kind = 'rest' THEN 3000 WHEN kind = 'heading' THEN 4000 WHEN kind = 'left' THEN 6000 - y WHEN kind = 'right' THEN 8000 - y ELSE 9000 END AS place FROM kept)
SELECT pdf_id, page, any_value(template) AS template,
  CASE WHEN any_value(template) IN ('set off', 'inset') THEN 'Abstract ' ELSE '' END || coalesce(string_agg(str, ' ' ORDER BY place) FILTER (k <> 3 OR kind IN ('head', 'abstract')), '') || CASE WHEN any_value(template) = 'inset' THEN ' Introduction' ELSE '' END || coalesce(' ' || string_agg(str, ' ' ORDER BY place) FILTER (k = 3 AND kind NOT IN ('head', 'abstract')), '') AS texts,
  CASE any_value(template) WHEN 'set off' THEN 1 WHEN 'inset' THEN 2 ELSE 0 END AS n_synthetic FROM placed GROUP BY pdf_id, page
""")
def opening_pages(spark, d):
    runs = S.spark_table(spark, d, _OPENING_RUNS)
    zero = F.lit(0.0)
    items = runs.select("pdf_id", "page", "seq", "str", F.array("size", zero, zero, "size", "x", "y").alias("transform"), "width", F.col("size").alias("height"), F.col("font").alias("fontName"))
    about = S.spark_table(spark, d, f"SELECT p.pdf_id, p.page, j.journal FROM ({_OPENINGS}) p JOIN ({_JOURNALS}) j ON j.k = p.k")
    pages, papers = about.select("pdf_id", "page", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height")), about.select("pdf_id", "journal", F.lit("").alias("doi"))
    texts = openings.paragraphs(items, pages, papers).groupBy("pdf_id", "page").agg(
        F.first("template").alias("template"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"]), " ").alias("texts"), F.count_if("synthetic").cast("int").alias("n_synthetic")
    )
    return texts
