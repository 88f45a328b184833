"""Reading caches: what a valid one is, the fields that are kept of it, and what they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE = (
    "struct<version:int,layoutVersion:int,pages:array<struct<number:int,paragraphs:array<string>,headings:array<struct<paragraph:int,title:string,level:int,synthetic:boolean>>,equations:array<struct<paragraph:int,image:string>>,image:string>>,"
    "figures:array<struct<page:int,label:string,caption:string,captionPage:int,crop:struct<x:double,y:double,width:double,height:double>>>,warnings:array<string>>"
)
_JPEG = r"^data:image/jpeg;base64,[A-Za-z0-9+/]+={0,2}$"


def _all(*rules: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules])


def _image(c: Column) -> Column:
    return (F.length(c) <= 4_000_000) & F.regexp_like(c, F.lit(_JPEG))


def valid_cache(c: Column) -> Column:
    """Whether a CACHE keeps all limits: page numbers in order, anchors inside their pages, JPEG images, figures on pages with an image, and crops inside the page."""
    within = lambda n, p: n.between(0, F.size(p["paragraphs"]) - 1)
    heading = lambda p: lambda h: _all(within(h["paragraph"], p), F.length(h["title"]) <= 1000, F.trim(h["title"]) != "", h["level"].isin(1, 2))
    equation = lambda p: lambda e: _all(within(e["paragraph"], p), _image(e["image"]))

    def page(p: Column, i: Column) -> Column:
        return _all(
            p["number"] == i + 1,
            F.size(p["paragraphs"]) <= 5000,
            F.forall(p["paragraphs"], lambda s: F.coalesce(F.length(s) <= 50_000, F.lit(False))),
            p["headings"].isNull() | ((F.size(p["headings"]) <= 500) & F.forall(p["headings"], heading(p))),
            p["equations"].isNull() | ((F.size(p["equations"]) <= 50) & F.forall(p["equations"], equation(p))),
            p["image"].isNull() | _image(p["image"]),
        )

    def figure(f: Column) -> Column:
        k = f["crop"]
        inside = _all(k["x"] >= 0, k["y"] >= 0, k["width"] > 0, k["height"] > 0, k["x"] + k["width"] <= 1.000001, k["y"] + k["height"] <= 1.000001)
        return _all(
            F.get(c["pages"], f["page"] - 1)["image"].isNotNull(),
            F.length(f["label"]) <= 200,
            F.length(f["caption"]) <= 50_000,
            k.isNull() | inside,
            f["captionPage"].isNull() | f["captionPage"].between(1, F.size(c["pages"])),
        )

    pages = F.transform(c["pages"], page)
    return _all(
        c["version"] == 1,
        F.size(c["pages"]).between(1, 500),
        F.size(c["figures"]) <= 200,
        F.size(c["warnings"]) <= 20,
        F.forall(c["warnings"], lambda w: F.coalesce(F.length(w) <= 1000, F.lit(False))),
        c["layoutVersion"].isNull() | c["layoutVersion"].between(1, 1000),
        F.forall(pages, lambda x: x),
        F.forall(c["figures"], figure),
    )


def kept_fields(c: Column) -> Column:
    """The cache as JSON with its known fields only; synthetic is left out where it is false."""
    pages = F.transform(c["pages"], lambda p: p.withField("headings", F.transform(p["headings"], lambda h: h.withField("synthetic", F.when(h["synthetic"], F.lit(True))))))
    return F.to_json(c.withField("pages", pages), {"ignoreNullFields": "true"})


def stats(files: DataFrame) -> DataFrame:
    """One row: how many caches there are among files (name, length), and their bytes."""
    return files.where(F.endswith("name", F.lit(".json.gz"))).agg(F.count("*").alias("cache_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("cache_bytes"))


def page_stats(pages: DataFrame, blank: int = 30, least: int = 50) -> DataFrame:
    """A row for each PDF of pages (pdf_id, page, paragraphs, omitted): characters (UTF-16 units, as the caches count them), blank_pages (fewer than blank characters), omitted_pages (whose figures were left out),
    usable (at least so many characters, so there is a text layer) and the warnings that a reader sees."""
    units = F.expr("aggregate(transform(paragraphs, p -> octet_length(encode(p, 'UTF-16BE')) div 2), 0L, (a, b) -> a + b)")
    per = pages.withColumn("_n", F.coalesce(units, F.lit(0))).groupBy("pdf_id").agg(F.sum("_n").alias("characters"), F.count_if(F.col("_n") < blank).alias("blank_pages"), F.count_if(F.coalesce("omitted", F.lit(False))).alias("omitted_pages"))
    says = lambda n, words: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(words)))
    warnings = F.array_compact(F.array(says("blank_pages", " page(s) hold little or no text."), says("omitted_pages", " page(s) are kept without their figures.")))
    return per.withColumns({"usable": F.col("characters") >= least, "warnings": warnings})
