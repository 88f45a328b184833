"""Two plain ways to write citations and bibliographies: by number and by author and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import authors_parsed, reference_url
from ..functions.text import or_else, text
from .citations import lettered


def _family(a: Column) -> Column:
    return or_else(a["family"], a["literal"])


def short_names() -> Column:
    """One family name, two with &, or the first with et al.; the title stands in for nobody."""
    p = authors_parsed("authors")
    return F.when(F.size(p) == 0, text("title")).when(F.size(p) == 1, _family(F.get(p, F.lit(0)))).when(F.size(p) == 2, F.concat(_family(F.get(p, F.lit(0))), F.lit(" & "), _family(F.get(p, F.lit(1))))).otherwise(F.concat(_family(F.get(p, F.lit(0))), F.lit(" et al.")))


def long_names() -> Column:
    """Family, I., and so on."""
    initials = lambda g: F.array_join(F.transform(F.filter(F.split(text(g), r"[\s.-]+"), lambda w: w != ""), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("."))), " ")
    return F.array_join(F.transform(authors_parsed("authors"), lambda a: F.concat_ws(", ", _family(a), F.nullif(initials(a["given"]), F.lit("")))), ", ")


def author_date(resolved: DataFrame, aliases: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replacements, entries): doc_id, start, end, replacement of every resolved marker, as (Berg, 2020a; Cho & Noor, 2019), and doc_id, pos, entry of the bibliography by name, year and title.

    Works of equal names and year in one document get letters in title order.
    """
    first = aliases.groupBy("record_id").agg(F.min_by("paper_id", "pos").alias("id"))
    year = F.when(text("year") == "", F.lit("n.d.")).otherwise(F.col("year"))
    known = papers.select("id", short_names().alias("names"), long_names().alias("people"), year.alias("year"), text("title").alias("title"), text("journal").alias("journal"), reference_url().alias("url"))
    cites = resolved.where("resolved").select("doc_id", "start", "end", F.posexplode("records").alias("k", "record_id"))
    works = cites.select("doc_id", "record_id").distinct().join(first, "record_id").join(known, "id")
    same = Window.partitionBy("doc_id", "names", "year")
    works = works.withColumn("letter", F.when(F.count("*").over(same) > 1, lettered(F.row_number().over(same.orderBy("title", "id")))).otherwise(""))
    works = works.withColumn("dated", F.concat("year", "letter"))
    shown = cites.join(works.select("doc_id", "record_id", F.concat("names", F.lit(", "), "dated").alias("s")), ["doc_id", "record_id"])
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "k"))), lambda x: x["s"]), "; ")
    replacements = shown.groupBy("doc_id", "start", "end").agg(F.concat(F.lit("("), inside, F.lit(")")).alias("replacement"))
    entry = F.concat_ws(" ", F.nullif("people", F.lit("")), F.concat(F.lit("("), "dated", F.lit(").")), F.concat("title", F.lit(".")), F.concat(F.nullif("journal", F.lit("")), F.lit(".")), F.nullif("url", F.lit("")))
    order = Window.partitionBy("doc_id").orderBy(F.lower("people"), "dated", "title", "id")
    return replacements, works.select("doc_id", F.row_number().over(order).alias("pos"), entry.alias("entry"))
