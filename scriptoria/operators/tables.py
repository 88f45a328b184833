"""Tables of pages by their labels: which runs are table text, and rows that are kept together.

A label, as Table 1., meets the runs below it on its page; their baselines are rows, and a table is there if enough rows have cells that stand at the same places. Labels and the widths of pages are windows of the page,
rows and supports windows and aggregates (layout.table_support) within the region of one label, and nothing is joined: all share the shuffle that the runs have come by.

Runs are as in operators.figures; pages: pdf_id, page, page_width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like, text
from ..storage import stored
from .figures import KEY, runs_of
from .layout import table_support

LABEL, WIDE_LABEL = r"(?i)^table\s+\d+\s*[.:|]", r"(?i)^table\s+\d+[.:]\s"
#: Rows that must stand at the same places, and cells of such a row.
ROWS, CELLS = 4, 5
NUMBER = r"^[+−–-]?\d+([.,]\d+)*[%×]?$"


def _labelled(runs: DataFrame, pages: DataFrame, label: str) -> DataFrame:
    """Runs once for each label (its seq) of their page, with the label's columns (beginning with l_) and page_width. Runs of pages without labels or that are not in pages are left out."""
    return _on_labels(runs.unionByName(pages.select(*KEY, F.col("page_width")), allowMissingColumns=True).dropna(subset=KEY), label)


def _on_labels(rows: DataFrame, label: str) -> DataFrame:
    """_labelled of runs and pages that are rows of one table; pages have no t."""
    page = Window.partitionBy(*KEY)
    told = F.when(like("t", label), F.struct(F.col("seq").alias("label"), *[F.col(c).alias(f"l_{c}") for c in ("x", "y", "size", "width")]))
    rows = rows.withColumns({"_labels": F.collect_list(told).over(page), "page_width": F.max("page_width").over(page)})
    return rows.where("t is not null and page_width is not null").select("*", F.inline("_labels")).drop("_labels")


def _regions(runs: DataFrame, pages: DataFrame, label: str, fits: Column) -> DataFrame:
    """Runs with the label (its seq) that they may belong to; fits is about both, the label's columns beginning with l_."""
    return _labelled(runs, pages, label).where(fits)


def _in_rows(cells: DataFrame, step: Column) -> DataFrame:
    """cells with row, from 0 at the top of each label's region: baselines less than step apart are one."""
    down = Window.partitionBy(*KEY, "label").orderBy(F.desc("y"), "x", "seq")
    new = F.coalesce(F.lag("y").over(down) - F.col("y") >= step, F.lit(False))
    return cells.withColumn("row", F.sum(new.cast("int")).over(down))


def _supported(cells: DataFrame, near: float, digits: int, wide: int) -> DataFrame:
    """cells with support, within their label's region."""
    return table_support(cells.withColumn("text", F.col("t")), near, digits, wide, (*KEY, "label"))


def table_regions(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Where labelled tables of small type are: pdf_id, page, label, left, right, top, bottom, head (where their head begins) and n_rows. A table has ROWS rows of CELLS cells or more that ROWS rows have at the same place, within 2 points."""
    return _small_tables(_labelled(runs, pages, LABEL))


def _small_tables(labelled: DataFrame) -> DataFrame:
    s = F.col("l_size")
    fits = (F.col("y") < F.col("l_y") - s) & (F.col("x") >= F.col("l_x") - 2) & F.col("size").between(s * 0.45, s * 0.85) & (F.col("width") < F.col("page_width") * 0.22)
    cells = labelled.where(fits).select(*KEY, "label", "seq", "x", "y", "width", "t", "l_x", "l_y", "l_size")
    held = _supported(_in_rows(cells, F.lit(1.5)), 2.0, 3, CELLS)
    rows = held.groupBy(*KEY, "label", "row").agg(F.count_if(F.col("support") >= ROWS).alias("n"), F.max("y").alias("at"), F.max(F.when(F.col("support") >= ROWS, F.col("x") + F.col("width"))).alias("end"), *[F.first(c).alias(c) for c in ("l_x", "l_y", "l_size")])
    per = rows.where(F.col("n") >= CELLS).groupBy(*KEY, "label").agg(F.count("*").alias("n_rows"), F.max("end").alias("end"), F.max("at").alias("high"), F.min("at").alias("low"), *[F.first(c).alias(c) for c in ("l_x", "l_y", "l_size")])
    return per.where(F.col("n_rows") >= ROWS).select(*KEY, "label", (F.col("l_x") - 2).alias("left"), (F.col("end") + 2).alias("right"), (F.col("high") + s * 2).alias("top"), (F.col("low") - s * 0.5).alias("bottom"), (F.col("l_y") + 2).alias("head"), s.alias("l_size"), "n_rows")


def table_texts(items: DataFrame, pages: DataFrame) -> DataFrame:
    """pdf_id, page, seq, label and str of the runs that are text of labelled tables: what lies in a table's region, and its label and head. A run of several regions belongs to the nearest label above it."""
    # dealt by page once: what is made for regions and for the runs in them has the same columns, so that Spark reads one shuffle twice
    placed = items.select(*KEY, "seq", "str", F.col("transform")[4].alias("x"), F.col("transform")[5].alias("y"), F.col("width"), F.abs("height").alias("size"))
    widths = pages.select(*KEY, F.col("page_width"))
    rows = placed.unionByName(widths, allowMissingColumns=True).dropna(subset=KEY).repartition(*KEY)
    labelled = _on_labels(rows.withColumn("t", F.nullif(F.trim(text("str")), F.lit(""))), LABEL)
    # a region is a row beside its label's runs, and a window hands it to them
    region = ("left", "right", "top", "bottom", "head")
    regions = _small_tables(labelled).select(*KEY, "label", F.struct(*region).alias("region"))
    met = labelled.select(*KEY, "label", "seq", "x", "y", "width", "size", "str", "l_size").unionByName(regions, allowMissingColumns=True)
    met = met.withColumn("region", F.max("region").over(Window.partitionBy(*KEY, "label"))).where("region is not null and x is not null").select("*", "region.*")
    cell = F.col("y").between(F.col("bottom"), F.col("top")) & (F.col("x") + F.col("width") <= F.col("right")) & (F.col("size") <= F.col("l_size") * 0.85)
    head = (F.col("y") <= F.col("head")) & (F.col("y") > F.col("top")) & (F.col("size") <= F.col("l_size") * 1.1)
    return met.where((F.col("x") >= F.col("left")) & (cell | head)).groupBy(*KEY, "seq").agg(F.min_by("label", F.struct("head", "label")).alias("label"), F.first("str").alias("str"))


def table_lines(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of labelled tables as wide as a third of the page and of the label's type, kept together: pdf_id, page, label, row, x, y, width, text (cells parted by |) and seqs.

    Such a row begins with a word below the label and has two numbers or more that three rows have at the same place, within 3 points; a table has ROWS of them. Numbers alone are no table.
    """
    runs = runs_of(items)
    s = F.col("l_size")
    fits = (F.col("l_width") > F.col("page_width") * 0.3) & (F.col("x") >= F.col("l_x") - 2) & (F.col("y") < F.col("l_y") - s * 2) & F.col("size").between(s * 0.96, s * 1.04)
    rows = stored(_in_rows(_regions(runs, pages, WIDE_LABEL, fits), s * 0.25))
    number = like("t", NUMBER)
    named = like("t", r"\p{L}{3}") & (F.abs(F.col("x") - F.col("l_x")) < s)
    likely = rows.groupBy(*KEY, "label", "row").agg(F.count_if(number).alias("n"), F.bool_or(named).alias("named")).where("n >= 2 and named").drop("n", "named")
    numbers = rows.where(number).join(likely, [*KEY, "label", "row"], "left_semi")
    held = _supported(numbers, 3.0, 0, 1).where("support >= 3").groupBy(*KEY, "label", "row").agg(F.count("*").alias("n")).where("n >= 2")
    held = held.withColumn("rows", F.count("*").over(Window.partitionBy(*KEY, "label"))).where(F.col("rows") >= ROWS).select(*KEY, "label", "row")
    per = rows.join(held, [*KEY, "label", "row"]).groupBy(*KEY, "label", "row").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "t"))).alias("c"), F.min("x").alias("x"), F.max("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("end"))
    return per.select(*KEY, "label", "row", "x", "y", (F.col("end") - F.col("x")).alias("width"), F.array_join(F.transform("c", lambda c: c["t"]), " | ").alias("text"), F.transform("c", lambda c: c["seq"]).alias("seqs"))
