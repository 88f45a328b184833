"""Changes to papers by id, their highlights, and papers made of or deleted with files. A change to something that is gone fails the job that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from .library import ranked_by
from .storage import unreferenced

#: What depends on a field: it is void once the field is edited.
DEPENDENTS = {"authors": "cslAuthors", "year": "dateParts"}
QUOTE = 10_000


def _gone(what: str, key: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what} was deleted elsewhere; the change was not saved: "), key)).cast("string")


def patched(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers with the fields that changes (id and some of their columns, one row an id) give; a null field is not given. An id that no paper has fails the job."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    rows = papers.join(new, F.col("id") == F.col("_id"), "full_outer")
    value = lambda c: F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)
    return rows.select(*[F.coalesce("id", _gone("paper", F.col("_id"))).alias("id") if c == "id" else value(c) for c in papers.columns])


def edited(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """patched, where a changed text of authors or year makes what was parsed of the old one void."""
    void = {c: d for c, d in DEPENDENTS.items() if c in changes.columns and d in papers.columns}
    rows = patched(papers.withColumns({f"_was_{c}": F.col(c) for c in void}), changes)
    return rows.withColumns({d: F.when(F.col(c).eqNullSafe(F.col(f"_was_{c}")), F.col(d)) for c, d in void.items()}).select(papers.columns)


def deleted(papers: DataFrame, ids: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers (with pdfId) without those of ids, and the files (file_id) of the latter that no other paper refers to."""
    kept = papers.join(ids.select("id"), "id", "left_anti")
    lost = papers.join(ids.select("id"), "id", "left_semi").select(F.col("pdfId").alias("file_id"))
    return kept, unreferenced(files.join(lost, "file_id", "left_semi"), kept.select(F.col("pdfId").alias("file_id")))


def pdf_titles(name: Column, single: bool = False) -> Column:
    """A paper's title from its file's name; a file that is imported alone has blanks for underscores."""
    title = F.regexp_replace(name, r"(?i)\.pdf$", "")
    return F.replace(title, F.lit("_"), F.lit(" ")) if single else title


def pdf_imported(papers: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers (id, title, pdfId, pdfName, lib_pos) with one for each PDF of files (file_id, name, is_pdf, pos), the last on top, and the names that were refused."""
    top = papers.agg(F.coalesce(F.min("lib_pos"), F.lit(0)).alias("_top"))
    new = ranked_by(files.where("is_pdf"), "pos").join(F.broadcast(top))  # one row
    made = new.select(F.col("file_id").alias("id"), pdf_titles(F.col("name"), False).alias("title"), F.col("file_id").alias("pdfId"), F.col("name").alias("pdfName"), (F.col("_top") - F.col("_rank")).alias("lib_pos"))
    return papers.select(made.columns).unionByName(made), files.where("not coalesce(is_pdf, false)").select("name")


def highlight_parts(selections: DataFrame) -> DataFrame:
    """selections (selection, pdf_id, color, note, parts: array of page, paragraph, start, end, quote) as highlights, one a part; the note is the first part's. A selection with a quote of over QUOTE characters gives none."""
    fits = F.forall("parts", lambda p: F.length(p["quote"]) <= QUOTE)
    rows = selections.where(fits).select("selection", "pdf_id", "color", "note", F.posexplode("parts").alias("k", "p"))
    note = F.when((F.col("k") == 0) & (text("note") != ""), F.col("note"))
    return rows.select("pdf_id", F.concat_ws("-", "selection", "k").alias("id"), "p.*", "color", note.alias("note"))


def with_highlights(papers: DataFrame, new: DataFrame) -> DataFrame:
    """papers (id, highlights) with the highlights of new (id, pos, highlight) behind their own, by pos. A paper that is gone fails the job."""
    per = new.groupBy(F.col("id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "highlight"))), lambda x: x["highlight"]).alias("_new"))
    rows = papers.join(per, F.col("id") == F.col("_id"), "full_outer")
    own = {"id": F.coalesce("id", _gone("paper", F.col("_id"))), "highlights": F.when(F.col("_new").isNull(), F.col("highlights")).otherwise(F.concat(F.coalesce("highlights", F.array()), "_new"))}
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in papers.columns])


def highlights_changed(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers (id, highlights: array with id, color, note) after changes (paper, id, color, note; null is not given), one row a highlight. A highlight that is gone fails the job."""
    per = changes.groupBy(F.col("paper").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("color", "note")))).alias("_by"))
    rows = papers.join(per, F.col("id") == F.col("_id"), "full_outer")
    ids = F.transform(F.coalesce("highlights", F.array()), lambda h: h["id"])
    lost = F.array_except(F.map_keys("_by"), ids)
    merged = lambda h, x: F.when(x.isNull(), h).otherwise(h.withField("color", F.coalesce(x["color"], h["color"])).withField("note", F.coalesce(x["note"], h["note"])))
    new = F.transform("highlights", lambda h: merged(h, F.try_element_at(F.col("_by"), h["id"])))
    fail = F.from_json(_gone("highlight", F.array_join(lost, ", ")), papers.schema["highlights"].dataType)
    own = {"id": F.coalesce("id", _gone("paper", F.col("_id"))), "highlights": F.when(F.col("_by").isNull(), F.col("highlights")).when(F.size(lost) > 0, fail).otherwise(new)}
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in papers.columns])


def highlights_removed(papers: DataFrame, removed: DataFrame) -> DataFrame:
    """papers without the highlights of removed (paper, id); what is gone already stays so."""
    per = removed.groupBy(F.col("paper").alias("_id")).agg(F.collect_set("id").alias("_out"))
    kept = F.when(F.col("_out").isNull(), F.col("highlights")).otherwise(F.filter("highlights", lambda h: ~F.array_contains(F.col("_out"), h["id"])))
    return papers.join(per, F.col("id") == F.col("_id"), "left").withColumn("highlights", kept).select(papers.columns)
