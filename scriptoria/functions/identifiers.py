"""Identifiers of references: normal forms, links and markers.

Six ways to normalise a DOI live side by side, as each source has its own; they must not be unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, like, once, or_else, stripped, text, uri_component, xml_escaped

#: The kinds of identifiers, in order; the first is a library's own ids, whose marker word a caller may choose.
LOCAL = "local"
TYPES = (LOCAL, "pmid", "doi", "arxiv")
CSL_TYPES = ("article-journal", "paper-conference", "article", "book", "chapter", "report", "thesis", "manuscript")
_RESOLVER = r"(?i)^https?://(?:dx\.)?doi\.org/"
_PREFIX = r"(?i)^doi:\s*"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _RESOLVER, ""), _PREFIX, "")


def doi_capture(c: Column | str) -> Column:
    """Of captures: resolver off, lower case; a doi: prefix stays."""
    return F.lower(F.regexp_replace(stripped(text(c)), _RESOLVER, ""))


def doi_client(c: Column | str) -> Column:
    """Of the library's client: resolver and prefix off, case kept."""
    return _bare(stripped(text(c)))


def doi_identifier(c: Column | str) -> Column:
    """Of citation identifiers: validated and lower-cased, else null."""
    return once(_bare(stripped(text(c))), lambda doi: F.when(like(doi, r"(?i)^10\.\d{4,9}/[^\s<>]+$"), F.lower(doi)))


def doi_pubmed(c: Column | str) -> Column:
    """Of PubMed records: white space made single, resolver and prefix off, lower case."""
    return F.lower(_bare(stripped(F.regexp_replace(text(c), r"(?U)\s+", " "))))


def doi_extension(c: Column | str) -> Column:
    """Of web pages: resolver and prefix off, nothing else."""
    return _bare(text(c))


def _preprint(csl_type: Column, journal: Column, source: Column) -> Column:
    return (text(csl_type) == "article") & (like(text(journal), r"(?i)\barxiv\b") | like(text(source), r"(?i)^https?://(?:www\.)?arxiv\.org/abs/"))


def is_preprint(p: Column | None = None) -> Column:
    f = _field(p)
    return _preprint(f("cslType"), f("journal"), f("sourceUrl"))


def _field(p: Column | None):
    return (lambda name: F.col(name)) if p is None else (lambda name: p[name])


def doi_citation(p: Column | None = None) -> Column:
    """Of bibliographies: empty for preprints and invalid DOIs; percent-decoded only if it came as a resolver's address; case kept."""
    f = _field(p)
    raw = stripped(text(f("doi")))
    bare = F.regexp_replace(F.regexp_replace(raw, _PREFIX, ""), _RESOLVER, "")
    value = F.when(like(raw, _RESOLVER), F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(bare)
    ok = like(value, r"(?i)^10\.\d{4,9}/[^\s\x00-\x1f]+$")
    return F.when(~is_preprint(p) & ok, value).otherwise("")


def pmid_identifier(c: Column | str) -> Column:
    return once(stripped(text(c)), lambda v: F.when(like(v, r"^[1-9]\d{0,8}$"), v))


def arxiv_identifier(c: Column | str) -> Column:
    v = F.regexp_replace(stripped(text(c)), r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", "")
    v = F.regexp_replace(F.regexp_replace(v, r"(?i)^arxiv:\s*", ""), r"(?i)\.pdf$", "")
    return once(v, lambda v: F.when(like(v, r"(?i)^(?:\d{4}\.\d{4,5}|[a-z][a-z.-]*/\d{7})(?:v[1-9]\d*)?$"), F.lower(F.regexp_replace(v, r"(?i)v\d+$", ""))))


def local_identifier(c: Column | str) -> Column:
    return once(stripped(text(c)), lambda v: F.when(like(v, r"(?i)^[a-z0-9][a-z0-9._:-]*$"), v))


def identifier(kind: Column, value: Column) -> Column:
    """The normal form of a value of the kind pmid, doi, arxiv or local; null if invalid."""
    return F.when(kind == "pmid", pmid_identifier(value)).when(kind == "doi", doi_identifier(value)).when(kind == "arxiv", arxiv_identifier(value)).when(kind == LOCAL, local_identifier(value))


def paper_identifiers() -> Column:
    """The identifiers of a papers row as structs (type, value, key), in the order of TYPES."""
    by = {
        LOCAL: local_identifier("id"),
        "pmid": pmid_identifier("pmid"),
        "doi": doi_identifier("doi"),
        "arxiv": arxiv_identifier(or_else("arxivId", F.when(like(text("sourceUrl"), r"(?i)arxiv\.org/"), F.col("sourceUrl")))),
    }
    # read by a lambda, so that each value is made once and not wherever it is named
    made = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), v.alias("value")) for k, v in by.items()]), lambda x: x["value"].isNotNull())
    return F.transform(made, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), F.concat(x["type"], F.lit(":"), x["value"]).alias("key")))


def inferred(c: Column | str) -> Column:
    """(type, value) of a typed-in identifier: explicit, else by its looks."""
    t = stripped(text(c))
    kind = F.lower(F.regexp_extract(t, r"(?i)^(pmid|doi|arxiv)\s*:\s*(.+)$", 1))
    by_looks = F.when(like(t, r"^[1-9]\d{0,8}$"), "pmid").when(like(t, r"(?i)^(?:10\.|https?://(?:dx\.)?doi\.org/)"), "doi").otherwise("arxiv")
    kind2 = F.when(kind != "", kind).otherwise(by_looks)
    value = F.when(kind != "", F.regexp_extract(t, r"(?i)^(pmid|doi|arxiv)\s*:\s*(.+)$", 2)).otherwise(t)
    return F.when(F.length(text(c)) <= 2048, F.struct(kind2.alias("type"), identifier(kind2, value).alias("value")))


def marker_text(local: str = LOCAL) -> Column:
    """The marker that cites a papers row; local is the marker word of library ids."""
    has = lambda c: text(c) != ""
    return (
        F.when(has("pmid"), F.concat(F.lit("(PMID: "), "pmid", F.lit(")")))
        .when(has("doi"), F.concat(F.lit("(doi:"), doi_client("doi"), F.lit(")")))
        .when(has("arxivId"), F.concat(F.lit("(arxiv:"), "arxivId", F.lit(")")))
        .otherwise(F.concat(F.lit(f"({local}:"), "id", F.lit(")")))
    )


def safe_url(c: Column | str) -> Column:
    """An address of http or https without user and password; else empty."""
    u = text(c)
    ok = F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull() & F.try_parse_url(u, F.lit("USERINFO")).isNull()
    return F.when(F.coalesce(ok, F.lit(False)), u).otherwise("")


def web_url(c: Column | str) -> Column:
    """safe_url without what follows #."""
    return F.regexp_replace(safe_url(c), r"#.*$", "")


def is_pubmed_url(c: Column | str) -> Column:
    host, path = F.lower(F.try_parse_url(text(c), F.lit("HOST"))), F.try_parse_url(text(c), F.lit("PATH"))
    return F.coalesce((host == "pubmed.ncbi.nlm.nih.gov") | (host.isin("ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov") & like(path, r"(?i)^/pubmed(?:/|$)")), F.lit(False))


def reference_url(p: Column | None = None, pubmed: bool = False) -> Column:
    """Where a reference leads: a preprint's page, the DOI, the source, arXiv, and PubMed if asked for."""
    f = _field(p)
    source = safe_url(f("sourceUrl"))
    own = F.when((source != "") & ~is_pubmed_url(source), source)
    arxiv_id = F.regexp_replace(stripped(text(f("arxivId"))), r"(?i)^arxiv:\s*", "")
    arxiv = F.when(like(arxiv_id, r"(?i)^(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?$"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv_id))
    preprint = F.coalesce(F.when(like(source, r"(?i)^https?://(?:www\.)?arxiv\.org/abs/"), source), arxiv, own, F.lit(""))
    doi = doi_citation(p)
    by_doi = F.when(doi != "", F.concat(F.lit("https://doi.org/"), F.array_join(F.transform(F.split(doi, "/"), uri_component), "/")))
    last = [F.nullif(source, F.lit("")), F.when(like(text(f("pmid")), r"^[1-9]\d{0,8}$"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), f("pmid"), F.lit("/")))] if pubmed else []
    return F.when(is_preprint(p), preprint).otherwise(F.coalesce(by_doi, own, arxiv, *last, F.lit("")))


def name_list(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), ";"), stripped), lambda x: x != "")


def authors_parsed(c: Column | str) -> Column:
    """Structs (family, given, literal) of a list of names parted by semicolons."""
    none = F.lit(None).cast("string")

    def one(n):
        at = F.locate(",", n)
        w = F.split(n, r"\s+")
        comma = F.struct(stripped(F.substring(n, F.lit(1), at - 1)).alias("family"), stripped(F.substring(n, at + 1, F.length(n))).alias("given"), none.alias("literal"))
        plain = F.struct(F.element_at(w, -1).alias("family"), F.array_join(F.slice(w, 1, F.size(w) - 1), " ").alias("given"), none.alias("literal"))
        return F.when(at > 0, comma).when(F.size(w) > 1, plain).otherwise(F.struct(none.alias("family"), none.alias("given"), n.alias("literal")))

    return F.transform(name_list(c), one)


def names_text(authors: Column) -> Column:
    return F.array_join(F.transform(authors, lambda a: or_else(a["literal"], F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit(""))))), "; ")


def display_authors(c: Column | str) -> Column:
    n = name_list(c)
    shown = F.when(F.size(n) > 2, F.concat(F.element_at(n, 1), F.lit("; …; "), F.element_at(n, -1))).otherwise(F.array_join(n, "; "))
    return F.when(F.size(n) == 0, F.lit("No authors added")).otherwise(shown)


def csl_item(columns: list[str], literal: bool = True) -> Column:
    """The bibliographic item of a papers row that has these columns; literal makes the metadata's own markup literal. What is missing is empty."""
    has = set(columns)
    lit = xml_escaped if literal else text
    of = lambda c: lit(c) if c in has else F.lit("")
    year = F.col("year").try_cast("int")
    dated = F.when(year > 0, F.array(year)).otherwise(F.array().cast("array<int>"))
    if "dateParts" in has:
        dated = F.when(F.coalesce(F.size("dateParts"), F.lit(0)) > 0, F.slice(F.transform("dateParts", lambda x: x.cast("int")), 1, 3)).otherwise(dated)
    people = authors_parsed("authors")
    if "cslAuthors" in has:
        people = F.when(F.coalesce(F.size("cslAuthors"), F.lit(0)) > 0, F.transform("cslAuthors", lambda a: F.struct(*[a[k].alias(k) for k in ("family", "given", "literal")]))).otherwise(people)
    return F.struct(
        F.when(F.col("cslType").isin(*CSL_TYPES), F.col("cslType")).otherwise("article-journal").alias("type") if "cslType" in has else F.lit("article-journal").alias("type"),
        of("title").alias("title"),
        F.transform(people, lambda a: F.struct(*[F.when(a[k].isNotNull(), lit(a[k])).alias(k) for k in ("family", "given", "literal")])).alias("author"),
        of("journal").alias("container_title"),
        of("journalAbbreviation").alias("container_title_short"),
        of("volume").alias("volume"),
        of("issue").alias("issue"),
        of("pages").alias("page"),
        lit(doi_citation()).alias("DOI"),
        lit(reference_url()).alias("URL"),
        of("pmid").alias("PMID"),
        of("publisher").alias("publisher"),
        of("publisherPlace").alias("publisher_place"),
        of("eventTitle").alias("event_title"),
        dated.alias("date_parts"),
    )


def metadata_warnings() -> Column:
    """What a cited row's metadata should be reviewed for."""
    missing = F.filter(F.array(*[F.when(text(c) == "", F.lit(c)) for c in ("title", "authors", "year", "journal")]), lambda x: x.isNotNull())
    made = F.array(
        F.when((reference_url() == "") & is_pubmed_url("sourceUrl"), F.lit("only a PubMed link")),
        F.when((text("doi") != "") & (doi_citation() == ""), F.lit("invalid DOI")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))),
        F.when((text("authors") != "") & ~F.contains(text("authors"), F.lit(",")), F.lit("inferred names")),
    )
    return F.filter(made, lambda x: x.isNotNull())


def bibtex() -> Column:
    """A papers row as a BibTeX entry."""

    def escaped(c):
        out = F.regexp_replace(c, r"([{}%&#_$])|(\\)|(\^)|(~)", "\u0001$0\u0002")
        for raw, shown in (("\\", r"\textbackslash{}"), ("^", r"\textasciicircum{}"), ("~", r"\textasciitilde{}")):
            out = F.replace(out, F.lit(f"\u0001{raw}\u0002"), F.lit(shown))
        return F.replace(F.replace(out, F.lit("\u0001"), F.lit("\\")), F.lit("\u0002"), F.lit(""))

    kind = F.when(F.col("cslType") == "paper-conference", "inproceedings").when(F.col("cslType") == "article", "misc").otherwise("article")
    key = F.array_join(F.transform(F.split("id", ""), lambda ch: F.lower(F.hex(F.ascii(ch)))), "x")
    venue = F.when(F.col("cslType") == "paper-conference", "booktitle").otherwise("journal")
    fields = [("title", text("title")), ("author", F.array_join(name_list("authors"), " and ")), ("year", text("year")), (venue, text("journal")), ("doi", doi_citation()), ("volume", text("volume")), ("number", text("issue")), ("pages", text("pages")), ("url", reference_url(pubmed=True))]
    lines = F.filter(F.array(*[F.when(v != "", F.concat(F.lit("  "), F.lit(k) if isinstance(k, str) else k, F.lit(" = {"), escaped(v), F.lit("}"))) for k, v in fields]), lambda x: x.isNotNull())
    return F.concat(F.lit("@"), kind, F.lit("{ref"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def crossref_type(c: Column | str) -> Column:
    #: The registry's types and the bibliographic ones.
    known = {"proceedings-article": "paper-conference", "posted-content": "article", "book-chapter": "chapter", "book": "book", "monograph": "book", "report": "report", "dissertation": "thesis"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[col(c)], F.lit("article-journal"))


def month_number(c: Column | str) -> Column:
    """1 to 12 for a number or an English month name by its first three letters, else 0."""
    t = text(c)
    names = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    return F.when(like(t, r"^\d{1,2}$"), t.try_cast("int")).otherwise(F.array_position(names, F.left(F.lower(t), F.lit(3))).cast("int"))


def date_parts(year: Column, month: Column, day: Column) -> Column:
    """[y], [y, m] or [y, m, d], as far as the parts are valid; empty without a year."""
    y, m, d = (c.cast("int") for c in (year, month, day))
    ok_m, ok_d = F.coalesce(m.between(1, 12), F.lit(False)), F.coalesce(d.between(1, 31), F.lit(False))
    return F.when(y.isNull(), F.array().cast("array<int>")).when(ok_m & ok_d, F.array(y, m, d)).when(ok_m, F.array(y, m)).otherwise(F.array(y))


def proxied(pdf: Column | str, page: Column | str) -> Column:
    """A PDF's address by way of the proxy that its page was read by: the page's host is the PDF's, with dashes for dots, before a proxy's name."""
    pdf, page = text(pdf), text(page)
    host, own = (F.lower(F.try_parse_url(u, F.lit("HOST"))) for u in (pdf, page))
    prefix = F.concat(F.replace(host, F.lit("."), F.lit("-")), F.lit("."))
    rest = F.substring(own, F.length(prefix) + 1, F.length(own))
    through = like(page, r"(?i)^https://") & F.startswith(own, prefix) & like(rest, r"(?:^|\.)(?:proxy|ezproxy)\.")
    port = lambda u: F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*?(:\d+)?(?:[/?#]|$)", 1)
    return F.when(F.coalesce(through, F.lit(False)), F.concat(F.lit("https://"), own, or_else(port(page), port(pdf)), F.regexp_extract(pdf, r"^[A-Za-z]+://[^/?#]*(.*)$", 1))).otherwise(pdf)


#: The region of a language that is named alone, as in the public locale files.
REGIONS = dict(
    pair.split("-")
    for pair in (
        "af-ZA bg-BG ca-AD cs-CZ da-DK de-DE el-GR en-US es-ES et-EE fa-IR fi-FI fr-FR he-IL hr-HR hu-HU is-IS it-IT ja-JP km-KH ko-KR lt-LT lv-LV mn-MN nb-NO nl-NL nn-NO pl-PL pt-PT ro-RO ru-RU sk-SK sl-SI sr-RS sv-SE th-TH tr-TR uk-UA vi-VN zh-CN"
    ).split()
)


def locale(c: Column | str) -> Column:
    """A locale with its region where the language has one; null where it is no locale."""
    region = F.try_element_at(F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair]), col(c))
    return F.when(like(c, r"^[a-z]{2}(?:-[A-Z]{2})?$"), F.concat_ws("-", col(c), region))
