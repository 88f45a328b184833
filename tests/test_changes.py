import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptoria.functions.identifiers import locale, proxied
from scriptoria.operators import caches, changes, embedded, layout, storage, styles
from scriptoria.sources.library import append_chat, chat_rows, read_cache
from scriptoria.streaming import capture

H = "array<struct<id:string,color:string,note:string>>"


def test_a_patch_gives_fields_and_fails_for_what_is_gone(spark):
    p = spark.createDataFrame([("a", "x", "1990", "p", "d"), ("b", None, "1991", "q", "e")], "id string, authors string, year string, cslAuthors string, dateParts string")
    one = spark.createDataFrame([("a", "x", "2000"), ("b", "y", None)], "id string, authors string, year string")
    got = {r.id: tuple(r)[1:] for r in changes.edited(p, one).collect()}
    assert got == {"a": ("x", "2000", "p", None), "b": ("y", "1991", None, "e")}
    with pytest.raises(PySparkException):
        changes.patched(p, spark.createDataFrame([("z", "y")], "id string, authors string")).collect()
    assert changes.patched(p, one.limit(0)).count() == 2


def test_highlights(spark):
    p = spark.createDataFrame([("a", None), ("b", [("h1", "blue", "n")])], f"id string, highlights {H}")
    new = spark.createDataFrame([("a", 2, ("h3", "pink", None)), ("a", 1, ("h2", "pink", None)), ("b", 1, ("h4", "pink", None))], "id string, pos int, highlight struct<id:string,color:string,note:string>")
    more = changes.with_highlights(p, new)
    assert {r.id: [h.id for h in r.highlights] for r in more.collect()} == {"a": ["h2", "h3"], "b": ["h1", "h4"]}
    as_change = lambda *rows: spark.createDataFrame(rows, "paper string, id string, color string, note string")
    got = changes.highlights_changed(more, as_change(("b", "h1", None, "new")))
    assert [tuple(h) for h in got.where("id = 'b'").first().highlights] == [("h1", "blue", "new"), ("h4", "pink", None)]
    for lost in (("b", "h9", None, "x"), ("z", "h1", None, "x")):
        with pytest.raises(PySparkException):
            changes.highlights_changed(more, as_change(lost)).collect()
    with pytest.raises(PySparkException):
        changes.with_highlights(p, new.withColumn("id", F.lit("z"))).collect()
    left = changes.highlights_removed(more, as_change(("b", "h1", None, None), ("b", "h9", None, None)).select("paper", "id"))
    assert {r.id: len(r.highlights) for r in left.collect()} == {"a": 2, "b": 1}


def test_selections_of_several_paragraphs(spark):
    part = lambda q: (1, 0, 0, len(q), q)
    rows = spark.createDataFrame([("s", "f", "blue", "why", [part("one"), part("two")]), ("t", "f", "blue", "", [part("three")]), ("u", "f", "blue", "x", [part("q" * 10_001), part("r")])], "selection string, pdf_id string, color string, note string, parts array<struct<page:int,paragraph:int,start:int,end:int,quote:string>>")
    assert sorted((r.id, r.quote, r.note) for r in changes.highlight_parts(rows).collect()) == [("s-0", "one", "why"), ("s-1", "two", None), ("t-0", "three", None)]


def test_files_of_deleted_papers(spark):
    p = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g"), ("d", None)], "id string, pdfId string")
    files = spark.createDataFrame([("f",), ("g",), ("h",)], "file_id string")
    kept, unused = changes.deleted(p, spark.createDataFrame([("a",), ("c",), ("d",)], "id string"), files)
    assert [r.id for r in kept.collect()] == ["b"] and [r.file_id for r in unused.collect()] == ["g"]


def test_imported_pdfs(spark):
    p = spark.createDataFrame([("a", "A", "", "", 5)], "id string, title string, pdfId string, pdfName string, lib_pos long")
    files = spark.createDataFrame([("x", "One_two.PDF", True, 1), ("y", "notes.txt", False, 2), ("z", "Three.pdf", True, 3), ("n", "None.pdf", None, 4)], "file_id string, name string, is_pdf boolean, pos int")
    rows, refused = changes.pdf_imported(p, files)
    assert [(r.title, r.lib_pos) for r in rows.orderBy("lib_pos").collect()] == [("Three", 3), ("One_two", 4), ("A", 5)]
    assert sorted(r.name for r in refused.collect()) == ["None.pdf", "notes.txt"]
    assert files.limit(1).select(changes.pdf_titles(F.col("name"), True)).first()[0] == "One two"


def test_temporary_and_embedded_papers(spark):
    good = {"id": "k1", "title": "T", "doi": "10.1000/x", "sourceUrl": "https://example.org/a", "cslType": "book", "dateParts": [1999], "cslAuthors": [{"family": "F"}]}
    bad = [{"title": " "}, {"doi": "11.1/x"}, {"sourceUrl": "ftp://a.b/"}, {"sourceUrl": "https://me:pw@a.b/"}, {"cslType": "poem"}, {"dateParts": [1, 2, 3, 4]}, {"cslAuthors": [{"family": "x" * 2001}]}, {"title": "x" * 20_001}, {"secret": 1}]
    rows = spark.createDataFrame([(k, json.dumps(good | b)) for k, b in enumerate([{}, *bad])] + [(98, "[1]"), (99, "no json"), (100, None)], "k int, json string")
    got = embedded.read_embedded(rows, "json")
    assert [r.k for r in got.where("valid").collect()] == [0]
    assert got.count() == len(bad) + 4
    many = spark.range(101).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("T").alias("title"), F.lit("").alias("doi"), F.lit("").alias("pmid"), F.lit("").alias("arxivId"), F.lit("").alias("sourceUrl"), F.lit(1).alias("request"))
    assert not embedded.temporary_fits(many, "request").first().fits
    one = embedded.temporary_fits(many.limit(2), "request").first()
    assert one.fits and one.bytes == len(json.dumps([{c: r[c] for c in ("id", "pmid", "doi", "arxivId", "title", "sourceUrl")} for r in many.limit(2).collect()], separators=(",", ":")))


def test_proxies_and_locales(spark):
    pdf = "https://www.journal.org:8080/a.pdf?x=1#p"
    pages = {
        "https://www-journal-org.ezproxy.lib.edu/a": "https://www-journal-org.ezproxy.lib.edu:8080/a.pdf?x=1#p",
        "https://www-journal-org.lib.proxy.edu:90/a": "https://www-journal-org.lib.proxy.edu:90/a.pdf?x=1#p",
        "http://www-journal-org.ezproxy.lib.edu/a": pdf,
        "https://www-journal-org.myproxy.edu/a": pdf,
        "https://www-other-org.proxy.edu/a": pdf,
        "": pdf,
    }
    rows = spark.createDataFrame([(p,) for p in pages], "page string").withColumn("url", proxied(F.lit(pdf), "page"))
    assert {r.page: r.url for r in rows.collect()} == pages
    names = {"en": "en-US", "en-GB": "en-GB", "eu": "eu", "EN": None, "en_US": None, "eng": None}
    assert {r.n: r.v for r in spark.createDataFrame([(n,) for n in names], "n string").withColumn("v", locale("n")).collect()} == names


def test_chunks_in_any_order(spark):
    files = spark.createDataFrame([("a", bytearray(range(256)) * 3), ("e", bytearray()), ("n", None)], "file_id string, content binary")
    chunks = storage.chunked(files, 100)
    back = {r.file_id: (r.n_chunks, r.content) for r in storage.reassembled(chunks.orderBy(F.desc("pos"))).collect()}
    assert back["a"] == (8, bytearray(range(256)) * 3) and back["e"] == (1, bytearray())
    assert storage.reassembled(chunks.where("pos <> 3")).where("file_id = 'a'").first().content is None
    assert storage.reassembled(chunks.union(chunks.where("pos = 3"))).where("file_id = 'a'").first().content is None


def test_caches(spark, tmp_path):
    good = {"version": 1, "pages": [{"number": 1, "paragraphs": ["p"]}], "figures": [], "warnings": []}
    for name, value in (("a", good), ("b", good | {"version": 2})):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump(value, f)
    got = {r.file[-9]: r.cache for r in read_cache(spark, str(tmp_path)).collect()}
    assert got["a"].pages[0].paragraphs == ["p"] and got["b"] is None
    files = spark.createDataFrame([("a.json.gz", 3), ("b.txt", 5)], "name string, length long")
    assert tuple(caches.stats(files).first()) == (1, 3) and tuple(caches.stats(files.limit(0)).first()) == (0, 0)
    pages = spark.createDataFrame([("f", 1, ["a" * 29 + "\U0001f600"], False), ("f", 2, [], True), ("g", 1, None, None)], "pdf_id string, page int, paragraphs array<string>, omitted boolean")
    got = {r.pdf_id: (r.characters, r.blank_pages, r.omitted_pages, r.usable, len(r.warnings)) for r in caches.page_stats(pages).collect()}
    assert got == {"f": (31, 1, 1, False, 2), "g": (0, 1, 0, False, 1)}


def test_chats(spark, tmp_path):
    chats = spark.createDataFrame([("a", 0, "user", "q"), ("a", 1, "assistant", "r"), *[("full", k, "user", "x") for k in range(100)]], "paper string, pos int, role string, text string")
    turns = spark.createDataFrame([(p, "Q", "A") for p in ("a", "new", "full")], "paper string, question string, answer string")
    assert sorted(tuple(r) for r in chat_rows(chats, turns).collect()) == [("a", 2, "user", "Q"), ("a", 3, "assistant", "A"), ("new", 0, "user", "Q"), ("new", 1, "assistant", "A")]
    path = str(tmp_path / "chat")
    append_chat(chats, turns, path)
    assert spark.read.parquet(path).count() == 4


def test_choices_and_polls(spark):
    s = spark.createDataFrame([("apa", "APA", 1), ("nature", "Nature", 2), ("cell", "Cell", 3)], "id string, label string, rank int")
    assert [(r.id, r["rank"]) for r in styles.choices(s, " NAT ", "cell").orderBy("rank").collect()] == [("cell", 0), ("nature", 2)]
    assert [r.id for r in styles.choices(s, "", "gone").orderBy("rank").collect()] == ["apa", "nature", "cell"]
    polls = spark.createDataFrame([("l", 1, 4), ("l", 2, 3), ("l", 3, 4), ("l", 4, 9), ("m", 1, 0)], "library string, seq int, revision int")
    assert [r.accepted for r in capture.refreshed(polls).orderBy("library", "seq").collect()] == [True, False, True, True, True]
    assert sorted(tuple(r) for r in capture.newest(polls).collect()) == [("l", 9, 4), ("m", 0, 1)]


def test_polls_as_a_stream(spark, tmp_path):
    polls = spark.createDataFrame([("l", 1, 4), ("l", 2, 3), ("m", 1, 0)], "library string, seq int, revision int")
    polls.write.parquet(str(tmp_path / "in"))
    q = capture.newest(spark.readStream.schema(polls.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("newest_polls").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("newest_polls").collect()) == [("l", 4, 1), ("m", 0, 1)]


def test_tables_and_chains(spark):
    cell = lambda row, k, text: ("f", 1, row, 50.0 * k + row * 0.2, text)
    cells = [cell(r, k, str(k)) for r in range(5) for k in range(6)] + [cell(9, k, "word") for k in range(6)] + [("f", 1, 10, 1000.0 + 7 * k, "5") for k in range(6)]
    df = spark.createDataFrame(cells, "pdf_id string, page int, row int, x double, text string")
    assert sorted((r.row, r.n_cells) for r in layout.aligned_rows(df).collect()) == [(r, 6) for r in range(5)]
    brute = {(r, x): len({o[2] for o in cells if o[2] != 9 and abs(o[3] - x) < 2}) for _, _, r, x, _ in cells if r != 9}
    assert {(r.row, r.x): r.support for r in layout.table_support(df).collect()} == brute
    runs = spark.createDataFrame([("f", 1, 1, k, x, 10.0, 10.0, t) for k, (x, t) in enumerate([(0.0, "a"), (15.0, "b"), (34.0, "c"), (54.0, "x"), (65.0, "y")])], "pdf_id string, page int, baseline int, ord int, x double, width double, height double, text string")
    got = layout.spanning_chains(runs).collect()
    assert [(r.text, r.x, r.width) for r in got] == [("a b c", 0.0, 44.0)]
