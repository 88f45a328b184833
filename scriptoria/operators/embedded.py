"""Papers that travel with a request or inside a document: what is let in, and each of them once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import CSL_TYPES, arxiv_identifier, doi_identifier, local_identifier, paper_identifiers, pmid_identifier
from ..functions.text import like, stripped, text

#: The fields of an embedded paper.
FIELDS = "id pmid doi arxivId title authors cslAuthors journal journalAbbreviation year dateParts volume issue pages sourceUrl cslType arxiv publisher publisherPlace eventTitle".split()
LONGEST, MOST_TEMPORARY, TEMPORARY_BYTES = 20_000, 100, 1 << 20
_SCHEMA = ", ".join(f"{f} " + {"cslAuthors": "array<struct<family:string,given:string,literal:string>>", "dateParts": "array<int>"}.get(f, "string") for f in FIELDS)
_NORMAL = {"id": local_identifier, "pmid": pmid_identifier, "doi": doi_identifier, "arxivId": arxiv_identifier, "arxiv": arxiv_identifier}


def _all(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules])


def plain_address(c: Column | str) -> Column:
    """Whether a text is empty or an address of http or https without user and password."""
    return (text(c) == "") | (like(c, r"(?i)^https?://[^\s/?#@]+([/?#]|$)") & F.try_parse_url(c, F.lit("HOST")).isNotNull())


def _rules(names: list[str]) -> list[Column]:
    """A title, an identifier, no identifier that is none, no overlong text and a plain address."""
    normal = [(text(c) == "") | f(c).isNotNull() for c, f in _NORMAL.items() if c in names]
    short = [F.length(text(c)) <= LONGEST for c in names]
    return [stripped(text("title")) != "", F.size(paper_identifiers()) > 0, *normal, *short, plain_address("sourceUrl")]


def valid_temporary(papers: DataFrame) -> Column:
    """Whether a row of papers may join a request for citations."""
    return _all(_rules([c for c, t in papers.dtypes if c in FIELDS and t == "string"]))


def temporary_fits(papers: DataFrame, request: str) -> DataFrame:
    """A row for each request: n rows, bytes of their JSON, and whether all are valid and within the limits."""
    size = F.octet_length(F.to_json(F.struct(*[c for c in papers.columns if c in FIELDS])))
    # A JSON array has two brackets and a comma between rows.
    per = papers.groupBy(request).agg(F.count("*").alias("n"), (F.sum(size) + F.count("*") + 1).alias("bytes"), F.bool_and(valid_temporary(papers)).alias("valid"))
    return per.withColumn("fits", F.col("valid") & (F.col("n") <= MOST_TEMPORARY) & (F.col("bytes") <= TEMPORARY_BYTES))


def read_embedded(rows: DataFrame, json: str) -> DataFrame:
    """rows with the fields of the JSON text and valid: an object of known fields only, with a known type, at most three date parts and at most 1,000 authors of short names."""
    known = F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(f) for f in FIELDS]))) == 0
    rest = rows.withColumn("_known", known).withColumn("_p", F.from_json(json, _SCHEMA)).select(*rows.columns, "_known", "_p.*")
    names = [f for f in FIELDS if f not in ("cslAuthors", "dateParts")]
    author = lambda a: F.greatest(*[F.length(text(a[k])) for k in ("family", "given", "literal")]) <= 2000
    lists = [F.col("dateParts").isNull() | (F.size("dateParts") <= 3), F.col("cslAuthors").isNull() | ((F.size("cslAuthors") <= 1000) & F.forall("cslAuthors", author))]
    kind = (text("cslType") == "") | F.col("cslType").isin(*CSL_TYPES)
    return rest.withColumn("valid", _all([F.col("_known"), *_rules(names), kind, *lists])).drop("_known")


def snapshots(papers: DataFrame, document: str, order: str) -> DataFrame:
    """Of each document its papers as JSON of their known fields, equal ones once, in the place (order) of the first; ties go by the JSON."""
    known = F.to_json(F.struct(*[c for c in FIELDS if c in papers.columns]), {"ignoreNullFields": "true"})
    rows = papers.select(document, order, known.alias("json"))
    first = rows.groupBy(document, "json").agg(F.min(order).alias(order))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(document).orderBy(order, "json"))).drop(order)
