"""The engine's operations as one object: a library in versioned snapshots, its files, citations, reading views and metadata.

Every call reads the current revision lazily and returns DataFrames; a call that changes the library names the revision it saw and writes the next one, or fails if another writer was
first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import citations, library, retrieval, storage, styles, styles_text
from .sources import archives
from .sources import library as sources


class Conflict(RuntimeError):
    """Another writer took the revision."""


class Library:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- reading and writing revisions

    def create(self, papers: DataFrame) -> int:
        return sources.write_snapshot(papers, self.path, -1)

    def read(self, revision: int | None = None) -> tuple[DataFrame, int]:
        return sources.read_snapshot(self.spark, self.path, revision)

    def write(self, papers: DataFrame, revision: int) -> int:
        """Writes papers as the revision after `revision`; all must be valid and of distinct ids."""
        bad = papers.agg(F.count_if(~library.valid(papers)).alias("bad"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        if bad.bad or bad.n != bad.ids:
            raise ValueError("invalid or duplicate references")
        if self.read()[1] != revision:
            raise Conflict("the library changed; read it again before saving")
        try:
            return sources.write_snapshot(papers, self.path, revision)
        except Exception as e:
            if "exist" in str(e).lower():
                raise Conflict("the library changed; read it again before saving") from e
            raise

    def change(self, fn: Callable[[DataFrame], DataFrame], tries: int = 3) -> int:
        """Applies fn to the current papers and writes the result, again up to `tries` times if another writer was first."""
        for k in range(tries):
            papers, revision = self.read()
            try:
                return self.write(fn(papers), revision)
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    # ---- collections, imports and captures

    def create_collection(self, name: str, collections: DataFrame) -> DataFrame:
        name = name.strip()
        if not 0 < len(name) <= 200 or name == library.UNFILED:
            raise ValueError("use a collection name of 1 to 200 characters")
        if collections.where(F.lower("collection") == name.lower()).limit(1).count():
            raise Conflict("a collection with this name already exists")
        return collections.unionByName(self.spark.createDataFrame([(name,)], "collection string"))

    def rename_collection(self, old: str, new: str) -> int:
        papers, _ = self.read()
        if papers.where((F.lower("collection") == new.strip().lower()) & (F.col("collection") != old)).limit(1).count():
            raise Conflict("a collection with this name already exists")
        return self.change(lambda p: library.with_collection(p, old, new))

    def delete_collection(self, name: str) -> int:
        return self.change(lambda p: library.with_collection(p, name, None))

    def add(self, incoming: DataFrame) -> int:
        """Imports papers that the library does not have, before those it has."""

        def run(papers: DataFrame) -> DataFrame:
            new = library.deduplicated(papers, incoming)
            low, n = papers.agg(F.coalesce(F.min("lib_pos"), F.lit(0))).first()[0], incoming.agg(F.coalesce(F.max("lib_pos"), F.lit(0)) + 1).first()[0]
            return papers.unionByName(new.withColumn("lib_pos", F.col("lib_pos") - n + low), allowMissingColumns=True)

        return self.change(run)

    def match_captures(self, captures: DataFrame) -> DataFrame:
        return library.captured(self.read()[0], captures)

    def view(self, view: str = "All", status: str = "All", search: str = "", by: str = "Recent") -> DataFrame:
        return library.ranked(library.in_view(self.read()[0], view, status, search), by)

    def export_bibtex(self) -> DataFrame:
        from .functions.identifiers import bibtex

        return self.read()[0].select("lib_pos", bibtex().alias("entry"))

    # ---- files

    def storage(self, files: DataFrame) -> DataFrame:
        return storage.stats(files, self.read()[0].select(F.col("pdfId").alias("file_id")))

    def deletable(self, files: DataFrame) -> DataFrame:
        return storage.unreferenced(files, self.read()[0].select(F.col("pdfId").alias("file_id")))

    def backup(self, files: DataFrame, out) -> int:
        """Writes the given files (name, content) and the library itself as JSON lines to a compressed archive."""
        lines = library.exported(self.read()[0]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lib_pos", "json"))), lambda x: x["json"]), "\n").alias("j"))
        own = lines.select(F.lit("library.jsonl").alias("name"), F.encode("j", "utf-8").alias("content"))
        return archives.write_backup(files.select("name", "content").unionByName(own), out)

    # ---- citations and questions

    def cite(self, manuscripts: DataFrame, style: str = "numeric", temporary: DataFrame | None = None) -> DataFrame:
        """doc_id and text of manuscripts (doc_id, text) with their citations written in a style (numeric or author-date)."""
        papers = self.read()[0] if temporary is None else citations.with_temporary(self.read()[0], temporary)
        if style == "numeric":
            return citations.cited(manuscripts, papers).select("doc_id", "text")
        if style != "author-date":
            raise ValueError("unsupported citation style")
        aliases = citations.entity_records(papers)
        changes, _ = styles_text.author_date(citations.resolve_markers(citations.parse_markers(manuscripts), aliases), aliases, papers)
        return citations.spliced(manuscripts, changes)

    def write_word(self, manuscripts: DataFrame, style: str = "numeric") -> DataFrame:
        return archives.write_docx(self.cite(manuscripts, style))

    def passages(self, blocks: DataFrame, question: str, previous: str = "") -> DataFrame:
        """The passages of each document (pdf_id, page, ord, text) that answer a question, as one text with page tags."""
        import re

        from .functions.text import STOP_WORDS

        words = lambda s: [w for w in re.findall(r"[^\W_]{2,}", s.lower()) if w not in STOP_WORDS]
        follows = len(set(words(question))) < 2 or re.search(retrieval.FOLLOW_UP, question)
        rows = retrieval.scored(retrieval.unique_blocks(blocks), words(question), words(previous) if follows else [])
        return retrieval.context(retrieval.selected(rows, question))

    def find_style(self, catalogue: DataFrame, query: str) -> DataFrame:
        return styles.search(styles.catalogue(catalogue), query)
