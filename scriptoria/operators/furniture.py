"""Page furniture of publishers: running heads, footers, stamps and marks in the margins, taken out as whole lines.

A margin line is turned into its shape: lower case, years, numbers, months, the paper's own DOI and page numbers as signs, punctuation off. RULES is a table of whose shapes go where, EVIDENCE of what else a page must show.
Both are compiled to expressions, so a line meets the rules of its paper's publishers where it is; a rule that wants evidence holds on pages with a line that gives it. Unknown journals keep everything but what is general.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, like, text
from .sections import letters, profile

KEY = ["pdf_id", "page"]
#: Points from the top and the bottom within which lines are furniture, if at all.
MARGIN = 64.0
#: journals' names, and the beginnings of DOIs, of the publishers that have rules. Names are compared without full stops, in lower case.
FAMILIES = {
    "communications": (("nature communications", "nat commun"), ("10.1038/s41467-", "10.1038/ncomms")),
    "genome": (("genome biology", "genome biol"), ("10.1186/s13059-",)),
    "plos": (("plos one", "plos biology", "plos genetics", "plos computational biology", "plos medicine", "plos pathogens"), ("10.1371/journal.",)),
    "advances": (("science advances", "sci adv"), ("10.1126/sciadv.",)),
    "science": (("science", "science advances", "sci adv"), ("10.1126/science.", "10.1126/science/", "10.1126/sciadv.")),
    "cell": (("cell", "cell reports", "cell rep"), ("10.1016/j.cell.", "10.1016/j.celrep.")),
}
#: rule, family, edge, points from it, how shapes are tested (is, starts, ends, has), shapes that must all fit, evidence. N is a number, Y a year, M a month, DOI the paper's own one, PAGE the page's number.
RULES = [
    ("footer", "any", "both", 64, "has", ["| vol N", "Y"], ""),
    ("footer", "any", "both", 64, "has", ["| volume N", "Y"], ""),
    ("page number", "any", "bottom", 64, "is", ["PAGE"], ""),
    ("preprint", "any", "top", 48, "has", ["biorxiv preprint"], "preprint"),
    ("preprint", "any", "top", 48, "has", ["medrxiv preprint"], "preprint"),
    ("preprint", "any", "top", 48, "has", ["not certified by peer review", "license to display the preprint"], "preprint"),
    ("preprint", "any", "top", 48, "starts", ["available under a cc by"], "preprint"),
    ("in press", "any", "top", 64, "starts", ["please cite this article in press as"], "in press"),
    ("in press", "any", "top", 64, "is", ["DOI"], "in press"),
    ("communications footer", "communications", "bottom", 40, "starts", ["nature communications | Y N N"], ""),
    *[("kind of article", "nature", "top", 48, "is", [kind + more], "") for kind in ("article", "brief communication", "analysis", "review") for more in ("", " DOI")],
    ("genome head", "genome", "top", 64, "has", ["genome biology Y N N"], "genome masthead"),
    ("genome head", "genome", "top", 64, "is", ["page N of N"], "genome masthead"),
    ("genome head", "genome", "top", 64, "is", ["DOI"], "genome masthead"),
    ("genome head", "genome", "top", 64, "is", ["doi DOI"], "genome masthead"),
    *[("cell footer", "cell", "bottom", 64, test, [shape], "cell issue") for test, shape in (("has", "cell N"), ("has", "cell reports N"), ("starts", "this is an open access article under"), ("starts", "M N Y ©"), ("starts", "Y ©"), ("is", "ll"), ("is", "DOI"), ("is", "DOI ll"))],
    *[("science head", "science", "top", 64, "is", [shape], "") for shape in ("science advances | research article", "research articles", "research article", "reports", "research reports", "research | reports", "research | research article", "research | article")],
    ("science footer", "science", "bottom", 40, "has", ["science", "vol N", "Y", "www sciencemag org"], ""),
    ("science article footer", "science", "bottom", 30, "has", ["science N", "N M Y", "N of N"], ""),
    ("advances footer", "advances", "bottom", 40, "has", ["sci adv N", "Y"], ""),
    ("advances footer", "advances", "bottom", 40, "is", ["N of N"], ""),
    ("plos footer", "plos", "bottom", 48, "has", ["plos", "DOI", "Y", "N / N"], ""),
]
#: evidence, family, shapes that one margin line of the page must have.
EVIDENCE = [
    ("preprint", "any", ["biorxiv preprint", "10.1101"]), ("preprint", "any", ["medrxiv preprint", "10.1101"]), ("in press", "any", ["please cite this article in press as"]), ("genome masthead", "genome", ["genome biology Y N N"]),
    ("cell issue", "cell", ["cell N", "Y"]), ("cell issue", "cell", ["cell reports N", "Y"]),
]
MONTHS = "january february march april may june july august september october november december".split()


def families(journal: Column, doi: Column) -> Column:
    """The publishers' families whose rules a paper follows; any is one of all."""
    name = F.trim(F.regexp_replace(F.replace(F.lower(text(journal)), F.lit("."), F.lit("")), r"\s+", " "))
    own = [F.when(name.isin(*names) | F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(F.lower(text(doi)), s)), F.lit(family)) for family, (names, starts) in FAMILIES.items()]
    nature = F.when(profile(journal, doi) == "nature", F.lit("nature"))
    return F.filter(F.array(F.lit("any"), nature, *own), lambda f: f.isNotNull())


def shape(line: Column, doi: Column, page: Column) -> Column:
    """A line as signs and words, parted by single blanks."""
    t = F.lower(text(line))
    t = F.when(text(doi) != "", F.regexp_replace(F.replace(t, F.lower(text(doi)), F.lit("\u0001")), r"https?://(?:dx\.)?doi\.org/\x01", "\u0001")).otherwise(t)
    t = F.regexp_replace(t, r"10\.1101/\S*", " 10\u0002 ")  # the only other DOIs that count
    t = F.regexp_replace(t, r"\b(?:19|20)\d{2}\b", " \u0003 ")
    t = F.regexp_replace(t, r"\d+", " \u0004 ")
    t = F.regexp_replace(t, rf"\b(?:{'|'.join(MONTHS)})\b", " \u0005 ")
    t = F.regexp_replace(t, r"[^\p{L}\x01-\x05|/©]+", " ")
    for sign, shown in (("\u0004 \u0002", "10.1101"), ("\u0002", "10.1101"), ("\u0001", "DOI"), ("\u0003", "Y"), ("\u0004", "N"), ("\u0005", "M")):
        t = F.replace(t, F.lit(sign), F.lit(f" {shown} "))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.trim(line) == page.cast("string"), F.lit("PAGE")).otherwise(t)


def margin_lines(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Whole lines of the margins: pdf_id, page, line, y, top (points from the top), text and seqs. Upright and other runs whose baselines are under two points apart are a line."""
    rows = items.select(*KEY, "seq", "str", F.col("transform")[4].alias("x"), F.col("transform")[5].alias("y")).join(pages.select(*KEY, "page_height"), KEY)
    rows = rows.where((F.col("y") <= MARGIN) | (F.col("y") >= F.col("page_height") - MARGIN))
    down = Window.partitionBy(*KEY).orderBy(F.desc("y"), "x", "seq")
    new = F.coalesce(F.lag("y").over(down) - F.col("y") >= 2, F.lit(True))
    rows = rows.withColumn("line", F.sum(new.cast("int")).over(down))
    per = rows.groupBy(*KEY, "line").agg(F.max("y").alias("y"), F.first("page_height").alias("page_height"), F.array_sort(F.collect_list(F.struct("x", "seq", "str"))).alias("r"))
    return per.select(*KEY, "line", "y", (F.col("page_height") - F.col("y")).alias("top"), clean(F.array_join(F.transform("r", lambda r: r["str"]), " ")).alias("text"), F.transform("r", lambda r: r["seq"]).alias("seqs"))


def _fits(test: str, shapes: list[str]) -> Column:
    """Whether the line's shape, a blank at either end, is, starts with or has these shapes, as whole words."""
    if test == "is":
        return F.col("padded") == f" {shapes[0]} "
    if test == "starts":
        return F.startswith("padded", F.lit(f" {shapes[0]} "))
    return reduce(lambda a, b: a & b, [F.contains(F.col("padded"), F.lit(f" {s} ")) for s in shapes])


def _of_family(family: str) -> Column:
    return F.lit(True) if family == "any" else F.array_contains("families", family)


def _ruled(lines: DataFrame, papers: DataFrame, how: str) -> DataFrame:
    """lines with the rule that takes them out, null if none does. Each line's shape is made once; what else its page shows is a window of the page, so that lines meet papers and nothing else."""
    rows = lines.join(papers.select("pdf_id", "title", "journal", "doi"), "pdf_id", how)
    rows = rows.withColumns({"padded": F.concat(F.lit(" "), shape(F.col("text"), F.col("doi"), F.col("page")), F.lit(" ")), "families": families(F.col("journal"), F.col("doi"))})
    page = Window.partitionBy(*KEY)
    told = {name: reduce(lambda a, b: a | b, [_of_family(f) & _fits("has", shapes) for n, f, shapes in EVIDENCE if n == name]) for name in dict.fromkeys(n for n, _, _ in EVIDENCE)}
    rows = rows.withColumn("shown", F.struct(*[F.bool_or(told[name]).over(page).alias(name) for name in told]))

    def holds(family: str, edge: str, reach: int, test: str, shapes: list[str], evidence: str) -> Column:
        near = {"top": F.col("top") < reach, "bottom": F.col("y") < reach}
        zone = near["top"] | near["bottom"] if edge == "both" else near[edge]
        met = _of_family(family) & zone & _fits(test, shapes)
        return met & F.col("shown")[evidence] if evidence else met

    ruled = [F.when(holds(*rest), F.lit(rule)) for rule, *rest in RULES]
    # lines that repeat what is known of the paper itself
    number = F.col("page").cast("string")
    plain = F.lower(F.trim(F.regexp_replace(F.col("text"), r"\s*[|·•]\s*", " ")))
    plain = F.when(F.startswith(plain, F.concat(number, F.lit(" "))), F.substring(plain, F.length(number) + 2, F.length(plain))).when(F.endswith(plain, F.concat(F.lit(" "), number)), F.left(plain, F.length(plain) - F.length(number) - 1)).otherwise(plain)
    titled = text("title") != ""  # without a title there is nothing to compare letters with
    rows = rows.withColumn("l_text", letters(F.when(titled, F.col("text")))).withColumn("l_title", letters(text("title"))).withColumn("l_both", letters(F.when(titled, F.concat_ws(" ", "journal", "title"))))
    journal = (text("journal") != "") & (plain == F.lower(clean("journal")))
    title = (F.col("l_title") != "") & (F.col("l_text") == F.col("l_title")) & (F.col("page") > 1) & (F.col("top") < MARGIN)
    both = F.array_contains("families", "plos") & (F.col("l_title") != "") & (F.col("l_text") == F.col("l_both")) & (F.col("top") < MARGIN)
    own = F.when(journal, "journal").when(title, "running title").when(both, "plos head")
    return rows.withColumn("rule", F.least(*ruled, own)).select(*lines.columns, "rule")


def furniture_lines(lines: DataFrame, papers: DataFrame) -> DataFrame:
    """The margin lines that are furniture: pdf_id, page, line and rule. papers: pdf_id, title, journal, doi."""
    return _ruled(lines, papers, "inner").where("rule is not null").groupBy(*KEY, "line").agg(F.min("rule").alias("rule"))


def stamps(items: DataFrame, pages: DataFrame, papers: DataFrame, how: str = "inner") -> DataFrame:
    """pdf_id, page, seq and rule of upright-standing marks in the outer side margins: a preprint server's version stamp at the left, one publisher's download notice at the right. Horizontal texts that say the same stay."""
    m = F.col("transform")
    vertical = (F.abs(m[0]) < 0.01) & (F.abs(m[3]) < 0.01) & (m[1] != 0) & (m[2] != 0)
    rows = items.where(vertical).select(*KEY, "seq", m[4].alias("x"), F.lower(clean("str")).alias("t")).join(pages.select(*KEY, "page_width"), KEY).join(papers.select("pdf_id", "journal", "doi"), "pdf_id", how)
    words = F.split(F.col("t"), " ")
    year = F.element_at(words, -1)
    dated = (F.length(year) == 4) & year.try_cast("int").between(1900, 2099)
    archive = F.startswith(F.col("t"), F.lit("arxiv:")) & (F.col("x") < F.col("page_width") * 0.075) & F.contains(F.col("t"), F.lit("[")) & dated
    loaded = F.array_contains(families(F.col("journal"), F.col("doi")), "science") & (F.col("x") > F.col("page_width") - 40) & like("t", r"^downloaded from https?://(www\.)?science(mag)?\.org ") & dated
    return rows.withColumn("rule", F.when(archive, "archive stamp").when(loaded, "download notice")).where("rule is not null").select(*KEY, "seq", "rule")


def without_furniture(items: DataFrame, pages: DataFrame, papers: DataFrame) -> DataFrame:
    """items (pdf_id, page, seq, str, transform, ...) without their publishers' furniture. Papers without a row in papers, and nulls in it, have no journal that is known."""
    gone = _ruled(margin_lines(items, pages), papers, "left").where("rule is not null").select(*KEY, F.explode("seqs").alias("seq"))
    gone = gone.union(stamps(items, pages, papers, "left").select(*KEY, "seq"))
    return items.join(gone, [*KEY, "seq"], "left_anti")
