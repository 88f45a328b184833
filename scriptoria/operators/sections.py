"""Sections of a paper: front matter, wrapped headings and which headings are sections.

Paragraphs become a table of events (a section begins), and what is going on at a paragraph is the last event before it: windows by paper, in order.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import like, text
from .reading import REFERENCE_YEAR, canonical_section, one_of

_NUMBER, _LETTER = r"\d+(?:\.\d+)*[.)]?", r"[A-Z]\.(?:\d+(?:\.\d+)*\.?)?"
NUMBERED = rf"^(?:{_NUMBER}|{_LETTER})\s+\p{{L}}"
#: A numbered heading of the first level: one number or one letter.
MAJOR = r"^(?:\d+[.)]?|[A-Z]\.)\s"
LETTERED = r"^[A-Z]\.\s"
STAR_METHODS = r"(?i)^star\s*[★*+]\s*methods$"
#: What lines of the front matter begin with; headings outside of the main sections; what headings that are no sections begin with.
FRONT_STARTS = ("Received:", "Accepted:", "Published online:", "Check for updates", "Correspondence to", "Correspondence and", "E-mail:")
ASIDE = ("Author contributions", "Online content", "Reporting summary")
NO_SECTION_STARTS = ("Fig", "Fig.", "Figure", "Figure.", "Extended Data", "Supplementary Fig", "Supplementary Table", "Online content", "Author contributions", "Publisher", "Reporting summary")
#: Sections in which names of authors are no front matter; before which references may go without a heading; and which have headings of a second level.
LATE = ("Introduction", "Results", "Discussion", "Methods", "References")
BEFORE_REFERENCES = ("Discussion", "References", "Data availability", "Code availability")
WITH_HEADINGS = ("Results", "Methods", "Discussion")
IN_ABSTRACT = ("Results", "Methods", "Discussion", "Conclusion")
WRAPPED = 200
#: Abbreviated titles and DOI beginnings of one publisher's journals.
FAMILY = r"(?i)^Nat (?:Astron|Biomed Eng|Biotechnol|Cancer|Catal|Cell Biol|Chem(?: Biol| Eng)?|Clim Chang|Commun|Comput Sci|Ecol Evol|Electron|Energy|Food|Genet|Geosci|Hum Behav|Immunol|Mach Intell|Mater|Med|Metab|Methods|Microbiol|Nanotechnol|Neurosci|Photonics|Phys|Plants|Protoc|Rev .+|Sustain|Synth|Water)$"
FAMILY_DOI = r"(?i)^10\.1038/(?:s415(?:56|86|92)-|s43588-|s42256-|s41467-|ncomms|ncb\d|nmeth\.)"
FAMILY_INITIALS = ("NCB", "NMI")


def profile(journal: Column | str, doi: Column | str) -> Column:
    """nature or general: which publisher's habits a paper follows."""
    j = F.trim(F.regexp_replace(F.replace(text(journal), F.lit("."), F.lit("")), r"\s+", " "))
    return F.when(like(j, r"(?i)^nature(?:\s|$)") | like(j, FAMILY) | F.upper(j).isin(*FAMILY_INITIALS) | like(doi, FAMILY_DOI), "nature").otherwise("general")


def first_entry(c: Column | str) -> Column:
    """Whether a paragraph may be the first of a list of references: the number 1, a family name with a comma, and a capital."""
    words = F.split(F.trim(text(c)), r"\s+|(?<=\p{L},)(?=\p{L})")
    initial = F.left(F.get(words, F.lit(2)), F.lit(1))
    return F.coalesce(F.get(words, F.lit(0)).isin("1.", "1)") & F.endswith(F.get(words, F.lit(1)), F.lit(",")) & initial.between("A", "Z"), F.lit(False))


def is_review(journal: Column | str) -> Column:
    return like(text(journal), r"(?i)^(?:nature reviews|nat\.? rev\.?)(?:\s|$)")


#: Words for parts of institutions, for places, and for meetings; how notes on contributions and addresses begin.
UNITS = ("department", "school", "institute", "faculty", "laboratory", "centre", "center")
PLACES = ("department", "university", "institute", "school", "hospital", "laboratory", "centre", "center")
MEETINGS = ("conference", "symposium", "workshop")
ON_CONTRIBUTIONS = ("these authors contributed equally", "the following authors contributed equally", "equal contribution", "co corresponding author", "co corresponding authors", "cocorresponding author", "cocorresponding authors", "corresponding author", "corresponding authors")
ON_ADDRESSES = ("correspondence to", "correspondence and", "corresponding author", "e mail", "email")
RIGHTS = ("author", "authors", "publisher", "license")


def front_note(c: Column | str) -> Column:
    """Whether a paragraph of the first page is a note as a whole: on contributions, earlier work, addresses, affiliations, a meeting or its proceedings, or copyright. It goes by the paragraph's words, without marks before them."""
    whole = F.trim(text(c))
    bare = F.regexp_replace(whole, r"^[^\p{L}©]+", "")
    cut = lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}©]+"), lambda w: w != "")
    words, numbered = cut(bare), cut(whole)
    opens = lambda phrase, ws=words: F.slice(ws, 1, len(phrase.split())) == F.array(*map(F.lit, phrase.split()))
    either = lambda xs: reduce(lambda x, y: x | y, xs)
    has = lambda *ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    holds = lambda *signs: either([F.contains(whole, F.lit(x)) for x in signs])
    is_year = lambda w: (F.length(w) == 4) & (F.left(w, F.lit(2)).isin("19", "20")) & w.try_cast("int").isNotNull()
    first, mark = F.get(words, F.lit(0)), F.left(whole, F.lit(1))
    marked = mark.isin(*"*∗†‡§¶#") | mark.between("0", "9")
    ordinal = F.get(numbered, F.lit(0))
    meeting = F.slice(numbered, 2, 3) == F.array(*map(F.lit, ("annual", "conference", "on")))
    meeting = meeting | (F.slice(numbered, 2, 2) == F.array(F.lit("conference"), F.lit("on")))
    return F.coalesce(
        either([
            opens("equal contribution listing order is random"),
            mark.isin("†", "‡") & opens("work performed while at") & holds(".") & (F.length(bare) < 300),
            ordinal.substr(-2, 2).isin("st", "nd", "rd", "th") & ordinal.substr(1, 1).between("0", "9") & meeting & like(whole, r"\(\p{Lu}[^()]*\d{4}\)") & F.exists(numbered, is_year) & holds(",", ";"),
            either([opens(p) for p in ON_CONTRIBUTIONS]) & (has(*PLACES, "correspondence") | holds("@")),
            either([opens(p) for p in ON_ADDRESSES]) & holds("@"),
            marked & first.isin(*UNITS) & has("university", "hospital") & holds(",", "@"),
            opens("proceedings of") & has(*MEETINGS) & F.exists(words, is_year) & (has("copyright", "pmlr", "©") | holds("©")),
            first.isin("copyright", "©") & F.exists(F.slice(words, 2, 2), is_year) & (has(*RIGHTS) | F.contains(F.lower(bare), F.lit("rights reserved"))),
        ]),
        F.lit(False),
    )


def _letters(s: str) -> str:
    return " ".join("".join(c if c.isalpha() or c.isspace() else " " for c in unicodedata.normalize("NFKD", s)).split()).lower()


@F.pandas_udf(StringType())
def letters(v: pd.Series) -> pd.Series:
    """Letters only, decomposed, lower case, white space single."""
    return v.map(_letters, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def letters_of_each(v: pd.Series) -> pd.Series:
    return v.map(lambda xs: [_letters(x) for x in xs], na_action="ignore")


def author_line(line: Column, authors: Column) -> Column:
    """Whether at least 65 % of a line's words are of authors' names, two of them whole, or one in up to eight words. Both are letters(); authors an array of names."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    names = F.filter(F.transform(authors, lambda a: F.filter(F.split(a, " "), lambda t: F.length(t) > 1)), lambda n: (F.size(n) > 1) & (F.size(F.array_except(n, words)) == 0))
    known = F.flatten(names)
    share = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    return (F.length(line) <= 1000) & (F.size(words) > 0) & (share >= 0.65 * F.size(words)) & ((F.size(names) > 1) | (F.size(names) == 1) & (F.size(words) <= 8))


def unwrapped(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (pdf_id, page, paragraph, text, level and, where a template made headings, synthetic) with second-level headings that follow each other on a page made one, as long as it stays under WRAPPED characters; a numbered one begins anew."""
    page = Window.partitionBy("pdf_id", "page").orderBy("paragraph")
    goes_on = (F.col("level") == 2) & (F.lag("level").over(page) == 2) & ~like("text", NUMBERED)
    rows = paragraphs.withColumn("island", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(page))
    if "synthetic" not in rows.columns:
        rows = rows.withColumn("synthetic", F.lit(False))
    rows = rows.groupBy("pdf_id", "page", "island").agg(F.min("level").alias("level"), F.max("synthetic").alias("synthetic"), F.sort_array(F.collect_list(F.struct("paragraph", "text"))).alias("parts"))
    start = F.array().cast("array<struct<paragraph:int,text:string>>")

    def add(made, part):
        last = F.try_element_at(made, F.lit(-1))
        joined = F.concat(last["text"], F.when(F.endswith(last["text"], F.lit("-")), "").otherwise(" "), part["text"])
        fits = (F.size(made) > 0) & (F.length(last["text"]) + F.length(part["text"]) < WRAPPED)
        one = lambda p, t: F.array(F.struct(p.cast("int").alias("paragraph"), t.alias("text")))
        return F.when(fits, F.concat(F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))), one(last["paragraph"], joined))).otherwise(F.concat(made, one(part["paragraph"], part["text"])))

    return rows.select("pdf_id", "page", "level", "synthetic", F.inline(F.aggregate("parts", start, add)))


def organised(paragraphs: DataFrame, papers: DataFrame) -> DataFrame:
    """pdf_id, pos, page, text, level, title and synthetic: paragraphs (pdf_id, page, paragraph, text, level) with front matter gone and their sections named; level is null for prose. papers: pdf_id, title, authors, journal, doi.

    A heading of a main section counts where it comes first. Abstracts with headings of their own stay one section. In papers of the nature profile Results may begin, and references be listed, without a heading:
    synthetic rows then stand in for it.
    """
    names = letters_of_each(F.split(text("authors"), ";"))
    known = papers.select("pdf_id", letters(text("title")).alias("paper_title"), names.alias("names"), (profile("journal", "doi") == "nature").alias("nature"), is_review("journal").alias("review"))
    order = Window.partitionBy("pdf_id").orderBy("page", "paragraph")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, w=upto: F.last(c, ignorenulls=True).over(w)
    v = F.trim(F.col("text"))

    rows = unwrapped(paragraphs).join(known, "pdf_id", "left").withColumn("letters", letters("text"))
    by_authors = author_line(F.col("letters"), F.coalesce("names", F.array().cast("array<string>")))
    rows = rows.withColumns({"by_authors": by_authors, "nature": F.coalesce("nature", F.lit(False)), "review": F.coalesce("review", F.lit(False)), "main": canonical_section("text"), "candidate": F.col("level").isNotNull()})
    # front matter: notes anywhere on the first page, names and dates before the first late section
    late = F.coalesce(last(F.when(F.col("main").isin(*LATE), F.lit(True)), before), F.lit(False))
    front = (F.col("page") == 1) & (front_note("text") | ~late & (F.col("by_authors") | like("text", rf"(?i)^{one_of(FRONT_STARTS)}")))
    rows = rows.withColumn("front", front).where("not front")
    # headings inside of an abstract, and an abstract after something else, begin nothing
    place = F.struct("page", "paragraph")
    first = lambda cond: F.min(F.when(cond, place)).over(Window.partitionBy("pdf_id"))
    rows = rows.withColumns({"abstract_at": first(F.col("main") == "Abstract"), "introduction_at": first((F.col("main") == "Introduction") & F.col("candidate"))})
    in_abstract = (F.col("abstract_at") < place) & (place < F.col("introduction_at")) & F.col("main").isin(*IN_ABSTRACT)
    rows = rows.withColumn("main", F.when(~F.coalesce(in_abstract, F.lit(False)), F.col("main")))
    others = F.coalesce(F.max(F.when(F.col("main") != "Abstract", F.lit(True))).over(before), F.lit(False))
    rows = rows.withColumn("main", F.when(~((F.col("main") == "Abstract") & others), F.col("main")))
    # numbered headings begin sections of their own, but for those inside references, which only letters end
    lettered = F.when(F.col("candidate") & like("text", LETTERED) & F.col("main").isNull(), F.col("text"))
    in_references = F.coalesce(last(F.coalesce("main", lettered), before) == "References", F.lit(False))
    numbered = F.col("candidate") & like("text", NUMBERED) & F.col("main").isNull() & (~in_references | lettered.isNotNull())
    aside = F.when(like(v, rf"(?i)^{one_of(ASIDE)}[:.]?$"), "Other")
    rows = rows.withColumns({"numbered": numbered, "major": F.when(numbered & like("text", MAJOR), F.col("text")), "aside": aside})
    rows = rows.withColumn("event", F.coalesce("main", "major", "aside")).withColumn("chief", F.coalesce("main", "major"))
    # references without a heading
    listed = F.col("nature") & F.col("event").isNull() & first_entry("text") & (like("text", REFERENCE_YEAR) | F.contains("text", F.lit("et al.")))
    where = F.coalesce(last("event", before), F.lit(""))
    listed = listed & (where.isin(*BEFORE_REFERENCES) | (where == "Other") & (last("chief", before) == "Discussion"))
    rows = rows.withColumn("listed", F.coalesce(listed, F.lit(False))).withColumn("event", F.when(F.col("listed"), "References").otherwise(F.col("event")))
    # second-level headings; the first one that follows an introduction may begin the results
    heading = (F.col("level") == 2) & F.col("event").isNull() & ~F.col("numbered") & ~F.col("by_authors") & ~like("text", rf"(?i)^{one_of(NO_SECTION_STARTS)}\b") & (F.col("letters") != F.coalesce("paper_title", F.lit("")))
    rows = rows.withColumn("heading", heading).withColumn("active", F.coalesce(last("event"), F.lit("")))
    no_results = ~F.coalesce(F.max(F.when(F.col("event") == "Results", F.lit(True))).over(upto), F.lit(False))
    begins = F.col("heading") & F.col("nature") & ~F.col("review") & (F.col("active") == "Introduction") & (F.col("page") > 1) & no_results
    rows = rows.withColumn("begins", begins & (F.sum(begins.cast("int")).over(upto) == 1))
    rows = rows.withColumn("event", F.when(F.col("begins"), "Results").otherwise(F.col("event"))).withColumn("active", F.coalesce(last("event"), F.lit("")))
    # levels and titles
    named = F.coalesce("main", F.when(F.col("listed"), "References"), F.when(F.col("begins"), "Results"))
    earlier = F.row_number().over(Window.partitionBy("pdf_id", named).orderBy("page", "paragraph")) > 1
    opens = named.isNotNull() & (~earlier | (named == "Methods") & like(v, STAR_METHODS))
    rows = rows.withColumns({"opens": opens & F.col("main").isNotNull(), "stands_in": opens & F.col("main").isNull()})
    sub = F.col("heading") & (F.col("active").isin(*WITH_HEADINGS) | F.col("review") & (F.col("active") != "References"))
    level = F.when(F.col("opens"), 1).when(F.col("major").isNotNull(), 1).when(F.col("numbered") | sub, 2)
    title = F.when(F.col("opens"), F.col("main")).when(level.isNotNull(), F.col("text"))
    own = F.struct(F.lit(1).alias("k"), F.col("text").alias("text"), level.alias("level"), title.alias("title"), F.col("synthetic").alias("synthetic"))
    stand = F.when(F.col("listed"), "References").otherwise("Results")
    made = F.struct(F.lit(0).alias("k"), stand.alias("text"), F.lit(1).alias("level"), stand.alias("title"), F.lit(True).alias("synthetic"))
    rows = rows.select("pdf_id", "page", "paragraph", F.inline(F.when(F.col("stands_in"), F.array(made, own)).otherwise(F.array(own))))
    pos = F.row_number().over(Window.partitionBy("pdf_id").orderBy("page", "paragraph", "k")) - 1
    return rows.select("pdf_id", pos.alias("pos"), "page", "text", "level", "title", "synthetic")
