import time

from scriptoria.operators import highlights as H
from scriptoria.operators import library as L
from scriptoria.operators import reading, retrieval, storage
from scriptoria.plans import fixtures
from scriptoria.sources import archives
from scriptoria.sources import library as sources
from scriptoria.streaming import capture

COLS = "id string, doi string, pmid string, sourceUrl string, lib_pos long"


def test_import_is_greedy(spark):
    none = spark.createDataFrame([], COLS)
    new = spark.createDataFrame([("a", "10.1/x", "1", "", 0), ("b", "https://doi.org/10.1/X", "2", "", 1), ("c", "", "2", "", 2), ("d", "", "2", "http://u", 3), ("a", "", "", "", 4)], COLS)
    assert {r.lib_pos for r in L.deduplicated(none, new).collect()} == {0, 2}
    old = spark.createDataFrame([("z", "doi: 10.1/x", "", "", 0)], COLS)
    assert {r.lib_pos for r in L.deduplicated(old, new).collect()} == {2, 4}


def test_highlight_rules(spark):
    good = ("h1", "12345678-1234-1234-1234-123456789abc", 1, 0, 0, 5, "quote", "2024-01-02T03:04:05Z", "yellow", None)
    bad = [good[:2] + (0, *good[3:]), good[:3] + (5000, *good[4:]), good[:5] + (6, *good[6:]), good[:6] + ("", *good[7:]), good[:7] + ("soon", *good[8:]), good[:8] + ("red", None), (" ", *good[1:]), ("h", "x", *good[2:])]
    schema = "hs array<" + sources.HIGHLIGHT + ">"
    df = spark.createDataFrame([([good],), ([],), *[([b],) for b in bad], ([good, good],)], schema)
    assert [r[0] for r in df.select(L.valid_highlights(df.hs)).collect()] == [True, True] + [False] * (len(bad) + 1)


def test_relocation(spark):
    h = spark.createDataFrame([(1, "d", 1, 0, 4, 9, "birds"), (2, "d", 1, 0, 0, 5, "reeds"), (3, "d", 1, 0, 0, 2, "aa"), (4, "d", 1, 0, 0, 4, "gone")], "hid int, pdf_id string, page int, paragraph int, start int, end int, quote string")
    p = spark.createDataFrame([("d", 1, 0, "the birds nest"), ("d", 1, 1, "in reeds aaa")], "pdf_id string, page int, paragraph int, text string")
    assert {r.hid: (r.paragraph, r.start, r.end) for r in H.relocated(h, p).collect()} == {1: (0, 4, 9), 2: (1, 3, 8), 3: (None, None, None), 4: (None, None, None)}


def test_segments(spark):
    r = spark.createDataFrame([("k", 0, 0, 5), ("k", 1, 3, 8), ("k", 2, 5, 99)], "key string, pos int, start int, end int")
    got = [(x.start, x.end, x.winner, x.ids) for x in H.segments(r, spark.createDataFrame([("k", 10)], "key string, length int")).orderBy("start").collect()]
    assert got == [(0, 3, 0, [0]), (3, 5, 1, [0, 1]), (5, 8, 1, [1]), (8, 10, None, [])]


def test_bibliography_goes_on_over_pages(spark):
    rows = [("d", 1, 0, "Text.", False), ("d", 1, 1, "References", True), ("d", 1, 2, "1. Smith, J. 2001.", False), ("d", 2, 0, "tail of it", False), ("d", 2, 1, "Methods", True), ("d", 2, 2, "1. Collect samples from the 2020 cohort.", False)]
    df = spark.createDataFrame(rows, "pdf_id string, page int, paragraph int, text string, is_heading boolean")
    assert [(r.page, r.paragraph, r.new_paragraph) for r in reading.without_bibliography(df).orderBy("page", "paragraph").collect()] == [(1, 0, 0), (2, 1, 0), (2, 2, 1)]


def test_captions_and_continuations(spark):
    p = spark.createDataFrame([("d", 1, 0, "Fig. 1 | Birds in reeds."), ("d", 1, 1, "Fig. 1d shows."), ("d", 2, 0, "Extended Data Figure 3: More.")], "pdf_id string, page int, paragraph int, text string")
    assert [(r.label, r.page) for r in reading.captions(p).orderBy("page").collect()] == [("Fig. 1", 1), ("Extended Data Figure 3", 2)]
    f = spark.createDataFrame([("d", 1, "Fig. 2", "", True), ("d", 2, "fig. 2", "Its legend", False), ("d", 4, "Fig. 5", "Own", True)], "pdf_id string, page int, label string, caption string, has_crop boolean")
    assert [tuple(r) for r in reading.continued_captions(f).collect()] == [("d", 1, "fig. 2", "Its legend", 2)]


def test_retrieval_budgets(spark):
    blocks = [("d", p, p * 3 + i, f"page {p} block {i} background " * 30 + ("thermal evidence" if (p, i) == (20, 1) else "")) for p in range(1, 31) for i in range(3)]
    df = retrieval.scored(spark.createDataFrame(blocks, "pdf_id string, page int, ord long, text string"), ["thermal", "evidence"])
    got = retrieval.selected(df, "where is thermal evidence").collect()
    assert sum(len(r.text) for r in got) <= retrieval.FOCUSED_BUDGET and {20} == {r.page for r in got} and len(got) == 3
    wide = retrieval.selected(df, "give an overview").collect()
    assert sum(len(r.text) for r in wide) <= retrieval.BROAD_BUDGET and {r.page for r in wide} == set(range(1, 31))


def test_chunks(spark):
    text = "word " * 700
    rows = retrieval.chunked(spark.createDataFrame([("d", 1, 0, text), ("d", 1, 1, "x" * 3000), ("d", 1, 2, "")], "pdf_id string, page int, ord long, text string")).orderBy("ord", "start").collect()
    assert "".join(r.text for r in rows if r.ord == 0) == text and all(len(r.text) <= 1201 for r in rows)
    assert [len(r.text) for r in rows if r.ord == 1] == [1200, 1200, 600]


def test_storage(spark):
    files = spark.createDataFrame([("a", 10, "h"), ("b", 10, "h"), ("c", 5, "i")], "file_id string, length long, sha256 string")
    refs = spark.createDataFrame([("a",), ("a",), (None,), ("lost",)], "file_id string")
    assert tuple(storage.stats(files, refs).first()) == (3, 25, 4, 20, 10, 15)
    assert {r.file_id: r.kept_id for r in storage.same_content(files).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r.file_id for r in storage.unreferenced(files, refs).collect()} == {"b", "c"}
    r = spark.createDataFrame([("bytes=0-4",), ("bytes=-3",), ("bytes=8-",), ("bytes=-",), ("bytes=20-",), ("x",)], "h string")
    from pyspark.sql import functions as F

    assert [x[0] and tuple(x[0]) for x in r.select(storage.byte_range(F.col("h"), F.lit(10))).collect()] == [(0, 4), (7, 9), (8, 9), None, None, None]


def test_word_documents(spark):
    import io
    import zipfile

    m = spark.createDataFrame([(1, "One & two\nthree", ["[1] Entry"])], "doc_id int, text string, bibliography array<string>")
    files = archives.write_docx(m)
    assert [r.text for r in archives.read_docx(files).orderBy("paragraph").collect()] == ["One & two", "three", "References", "[1] Entry"]
    raw = archives.docx_bytes(["x"])
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:ins/></w:p></w:body></w:document>')
    bad = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"no zip")), (3, bytearray(z.getvalue())), (4, bytearray(archives.docx_bytes(["x"], {"word/vbaProject.bin": b"x"})))], "doc_id int, content binary")
    assert {r.doc_id: r.problem for r in archives.read_docx(bad).collect()} == {1: None, 2: "not a Word document", 3: "tracked changes", 4: "macros"}


def test_backup(spark):
    import io
    import tarfile

    out = io.BytesIO()
    df = spark.createDataFrame([("b.txt", bytearray(b"two")), ("a.txt", bytearray(b"one"))], "name string, content binary")
    assert archives.write_backup(df, out) == 2
    with tarfile.open(fileobj=io.BytesIO(out.getvalue())) as t:
        assert [(m.name, t.extractfile(m).read()) for m in t] == [("a.txt", b"one"), ("b.txt", b"two")]


def test_references_and_snapshots(spark, tmp_path):
    import json

    import pytest

    ris = tmp_path / "x.ris"
    ris.write_text(fixtures.RIS)
    assert sources.read_references(spark, str(ris)).count() == 2
    base = {c: "" for c in L.REQUIRED} | {"id": "1", "title": "T", "status": "Reading", "collection": " ", "starred": True, "pdfId": "p"}
    (tmp_path / "x.json").write_text(json.dumps([base]))
    row = sources.read_references(spark, str(tmp_path / "x.json")).first()
    assert row.collection == "Unfiled" and "pdfId" not in row
    (tmp_path / "y.json").write_text(json.dumps([base | {"status": "Lost"}]))
    with pytest.raises(ValueError):
        sources.read_references(spark, str(tmp_path / "y.json"))
    (tmp_path / "lib.json").write_text(json.dumps({"papers": [base], "collections": [], "revision": 3}))
    papers = sources.read_library(spark, str(tmp_path / "lib.json"))
    assert papers.first().lib_pos == 0
    path = str(tmp_path / "snapshots")
    assert sources.write_snapshot(papers.select("id", "title"), path, 3) == 4
    with pytest.raises(Exception, match="(?i)exist"):
        sources.write_snapshot(papers.select("id", "title"), path, 3)
    assert sources.read_snapshot(spark, path)[1] == 4


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 1)], "event int, k string, ord int").coalesce(1).write.parquet(str(tmp_path / "one"))
    out = capture.dedup_stream_to_table(spark, str(tmp_path / "one"), ["k"], "ord")
    assert {(r.k, r.ord) for r in out.collect()} == {("a", 3), ("b", 1)}
    stream = spark.readStream.schema("event int, k string, ord int").parquet(str(tmp_path / "one"))
    q = capture.merging(stream.selectExpr("k", "cast(ord as string) as v"), "k", ["v"], 60_000).writeStream.format("memory").queryName("merged").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):  # with timers a query goes on making batches, so "all available" never comes
            if q.exception() or spark.table("merged").count() >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert {(r.k, r.known) for r in spark.table("merged").collect()} == {("a", False), ("b", False)}


def test_revisions_and_pacing(spark):
    w = spark.createDataFrame([("l", 1, 0), ("l", 2, 0), ("l", 3, 1), ("l", 4, 5), ("l", 5, 2)], "library string, seq long, revision long")
    assert {r.seq for r in capture.applied(w).where("accepted").collect()} == {1, 3, 5}
    r = spark.createDataFrame([("k", 0), ("k", 10), ("k", 2000)], "k string, ms long")
    assert [x.at_ms for x in capture.paced(r, "k", "ms", 350).orderBy("ms").collect()] == [0, 350, 2000]


def test_pdf_links_through_a_proxy(spark):
    from scriptoria.sources import html_meta

    html = '<meta name="citation_pdf_url" content="https://www.nests.org/a.pdf">'
    rows = spark.createDataFrame([(1, "https://www-nests-org.proxy.reeds.edu/a", html), (2, "https://www.nests.org/a", html), (3, "https://x.org/b.pdf", "")], "page_id int, url string, html string")
    got = {r.page_id: r.pdf_url for r in html_meta.extract(rows).collect()}
    assert got == {1: "https://www-nests-org.proxy.reeds.edu/a.pdf", 2: "https://www.nests.org/a.pdf", 3: "https://x.org/b.pdf"}


def test_broken_records_are_left_out(spark):
    from scriptoria.sources import records

    good = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>T &amp; <i>U</i></ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    rows = [("a", "<PubmedArticleSet>" + good.format(1) + good.format(2).replace("</i>", "") + good.format(3) + "</PubmedArticleSet>"), ("b", "no XML"), ("c", None), ("d", "<PubmedArticle a=1></PubmedArticle>")]
    assert [(r.pmid, r.title) for r in records.pubmed(spark.createDataFrame(rows, "response_id string, xml string")).orderBy("pmid").collect()] == [("1", "T & U"), ("3", "T & U")]
    entry = "<feed><entry><id>http://arxiv.org/abs/2101.0000{0}v1</id><title>N {0}</title></entry></feed>"
    rows = [("2101.00001", entry.format(1)), ("2101.00002", entry.format(2).replace("</title>", "")), ("2101.00003", None), ("2101.00004", "{}")]
    assert [r.title for r in records.arxiv(spark.createDataFrame(rows, "arxiv_id string, xml string")).collect()] == ["N 1"]


def test_checked_papers(spark):
    from scriptoria.operators import library

    row = dict(id="a", title="T", authors="", year="", journal="", doi="", collection="C", tags="", status="Reading", notes="", starred=False, pdfId=None, sourceUrl="", pdfUrl="", pmid="", cslType="")
    uuid = "0000000a-0000-4000-8000-000000000001"
    changes = [{}, {"pdfId": uuid}, {"pdfId": uuid.upper()}, {"pdfId": uuid[:-1] + "2"}, {"pdfId": "x"}, {"pdfId": ""}, {"collection": " "}, {"tags": None}, {"starred": None}, {"status": "Lost"}, {"pdfUrl": "https://me:pw@x.org/"}, {"sourceUrl": "https://x.org/"}, {"pmid": "0"}, {"cslType": "poem"}]
    want = [None, None, None, "pdf missing", "pdf id", "pdf id", "incomplete", "incomplete", "incomplete", "status", "address", None, "pmid", "type"]
    schema = "k int, " + ", ".join(f"{c} {'boolean' if c == 'starred' else 'string'}" for c in row)
    papers = spark.createDataFrame([(k, *(row | c).values()) for k, c in enumerate(changes)], schema)
    files = spark.createDataFrame([(uuid,), (uuid,)], "file_id string")
    assert [r.problem for r in library.checked_papers(papers, files).orderBy("k").collect()] == want
    assert library.checked_papers(papers.drop("pdfId", "pdfUrl").limit(0), files.limit(0)).count() == 0


def test_records_are_parsed_once(spark):
    from scriptoria.sources import records

    article = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>On <m:i>x</m:i> &amp; <![CDATA[<y>]]></ArticleTitle><AuthorList><Author/><Author><LastName>Berg</LastName><Initials>A</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    rows = records.pubmed(spark.createDataFrame([("1", f"<PubmedArticleSet>{article}</PubmedArticleSet>")], "response_id string, xml string"))
    assert [(r.pmid, r.title, r.authors) for r in rows.collect()] == [("7", "On x & <y>", "Berg, A")]
    entry = "<entry><id>http://arxiv.org/abs/2101.00001v1</id><published>2021-05-09T10:00:00Z</published><title>T</title><author><name>Ada &amp; Ida</name></author></entry>"
    feeds = records.arxiv(spark.createDataFrame([("2101.00001", f"<feed>{entry}</feed>")], "arxiv_id string, xml string"))
    assert [(r.title, r.authors, list(r.dateParts)) for r in feeds.collect()] == [("T", "Ada & Ida", [2021, 5, 9])]
    for df in (rows, feeds):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "xpath" not in plan and plan.count("from_xml") == 0


def test_word_files_are_made_and_read_a_few_at_a_time(spark):
    import pyarrow as pa

    from scriptoria.sources import archives

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(250))})
    assert [b.num_rows for b in archives._slices(iter([batch]))] == [100, 100, 50]
    docs = spark.createDataFrame([(k, None if k == 7 else f"a {k}\n\nb & <c>") for k in range(250)], "doc_id long, text string").coalesce(1)
    files = archives.write_docx(docs)
    broken = spark.createDataFrame([(-1, b"no file")], "doc_id long, content binary")
    got = {(r.doc_id, r.paragraph): (r.text, r.offset, r.problem is None) for r in archives.read_docx(files.union(broken)).collect()}
    assert len(got) == 249 * 3 + 1 + 1 and got[(9, 2)] == ("b & <c>", 5, True) and got[(7, 0)] == ("", 0, True) and got[(-1, 0)][2] is False
