import pytest

from scriptoria.operators import caches, sections, styles


def organised(spark, rows, **paper):
    p = {"title": "A title", "authors": "Berg, Ada; Cho, Min", "journal": "", "doi": ""} | paper
    paragraphs = spark.createDataFrame([("d", *r) for r in rows], "pdf_id string, page int, paragraph int, text string, level int")
    papers = spark.createDataFrame([("d", p["title"], p["authors"], p["journal"], p["doi"])], "pdf_id string, title string, authors string, journal string, doi string")
    return [(r.text, r.level, r.synthetic) for r in sections.organised(paragraphs, papers).orderBy("pos").collect()]


def test_sections(spark):
    rows = [(1, 0, "Ada Berg, Min Cho", None), (1, 1, "1 Department of Birds, University of Reeds, Town", None), (1, 2, "Abstract", 1), (1, 3, "We study birds.", None), (1, 4, "Introduction", 1), (1, 5, "Ada Berg and Min Cho studied this.", None), (2, 0, "Nests near", 2), (2, 1, "the water", 2), (2, 2, "Prose.", None), (2, 3, "Methods", 1), (2, 4, "Nets", 2)]
    got = organised(spark, rows, journal="Nat. Commun.")
    assert got == [("Abstract", 1, False), ("We study birds.", None, False), ("Introduction", 1, False), ("Ada Berg and Min Cho studied this.", None, False), ("Results", 1, True), ("Nests near the water", 2, False), ("Prose.", None, False), ("Methods", 1, False), ("Nets", 2, False)]
    assert "Results" not in [t for t, *_ in organised(spark, rows, journal="Other")]
    numbered = organised(spark, [(1, 0, "2. Setup", 2), (1, 1, "2.1. Nets", 2), (1, 2, "Text.", None)])
    assert [level for _, level, _ in numbered] == [1, 2, None]


def titles(spark, rows, **paper):
    p = {"title": "A title", "authors": "Berg, Ada; Cho, Min", "journal": "", "doi": ""} | paper
    paragraphs = spark.createDataFrame([("d", *r) for r in rows], "pdf_id string, page int, paragraph int, text string, level int")
    papers = spark.createDataFrame([("d", p["title"], p["authors"], p["journal"], p["doi"])], "pdf_id string, title string, authors string, journal string, doi string")
    return [(r.title, r.level, r.synthetic) for r in sections.organised(paragraphs, papers).orderBy("pos").collect() if r.level]


def pages(*own):
    return [(n + 1, k, t, level) for n, rows in enumerate(own) for k, (t, level) in enumerate(rows)]


def test_results_and_references_without_headings(spark):
    rows = pages(
        [("Introduction", 1), ("Birds nest.", None)],
        [("Reed beds hold most nests", 2), ("We counted them.", None), ("Discussion", 1), ("So it seems.", None), ("Online content", 2), ("1. Berg, A. et al. Nests (2020).", None), ("2. Cho, M. Reeds (2019).", None)],
        [("Methods", 1), ("Data availability", 1), ("1. Roe, K. Others (2021).", None)],
    )
    got = titles(spark, rows, journal="Nature")
    assert got == [("Introduction", 1, False), ("Results", 1, True), ("Reed beds hold most nests", 2, False), ("Discussion", 1, False), ("References", 1, True), ("Methods", 1, False), ("Data availability", 1, False)]
    assert [t for t, *_ in titles(spark, rows)] == ["Introduction", "Discussion", "Methods", "Data availability"]
    review = titles(spark, pages([("Introduction", 1), ("x", None)], [("Reeds", 2), ("y", None)]), journal="Nature Reviews Birds")
    assert review == [("Introduction", 1, False), ("Reeds", 2, False)]


def test_structured_abstracts_and_appendices(spark):
    rows = pages([("Abstract", 1), ("Methods", 1), ("We counted.", None), ("Results", 1), ("Many.", None), ("Introduction", 1), ("Prose.", None)], [("Results", 1), ("More.", None), ("Abstract", 1)])
    assert [t for t, *_ in titles(spark, rows)] == ["Abstract", "Introduction", "Results"]
    rows = pages([("1. Introduction", 1), ("1. A point of a list.", None)], [("2. Counting", 2), ("2.1. Nets", 2), ("x", None), ("References", 1), ("1. Smith et al. A work.", None), ("3. Not a section", 2), ("A. Details", 2), ("A.1. Nets again", 2)])
    assert [(t, n) for t, n, _ in titles(spark, rows)] == [("Introduction", 1), ("2. Counting", 1), ("2.1. Nets", 2), ("References", 1), ("A. Details", 1), ("A.1. Nets again", 2)]
    assert [t for t, *_ in titles(spark, pages([("Methods", 1), ("STAR★METHODS", 1)]))] == ["Methods", "Methods"]


def test_front_matter(spark):
    prose = "Ada Berg and Min Cho made a way to count nests that we try in many reed beds to learn where it is strong and where it is weak."
    rows = pages([("Ada Berg, Min Cho", 2), ("† Work performed while at Reed House.", None), ("Received: 1 May", None), ("* Equal contribution. Listing order is random.", None), ("Abstract", 1), (prose, None), ("© 2020 The Authors", None), ("Introduction", 1), ("Ada Berg, Min Cho", None)])
    kept = [t for t, *_ in organised(spark, rows)]
    assert kept == ["Abstract", prose, "Introduction", "Ada Berg, Min Cho"]
    long = pages([("x", None)], [("word " * 20 + "end-", 2), ("ing", 2), ("and " * 20, 2), ("more " * 30, 2)])
    assert [len(t) for t, *_ in organised(spark, long)] == [1, 104 + 3 + 1 + 80, 150]


def test_cache_rules(spark):
    jpeg = "data:image/jpeg;base64,QUJD"
    page = (1, ["text"], [(0, "Head", 1, False)], [(0, jpeg)], jpeg)
    good = (1, 15, [page], [(1, "Fig. 1", "Legend", 1, (0.0, 0.0, 1.0, 1.0))], ["w"])
    bad = [
        (2, *good[1:]),
        (1, 0, *good[2:]),
        (1, 15, [(2, *page[1:])], *good[3:]),
        (1, 15, [(1, ["text"], [(1, "Head", 1, None)], None, jpeg)], *good[3:]),
        (1, 15, [(1, ["text"], None, None, "data:image/png;base64,QUJD")], [], []),
        (1, 15, [page], [(1, "Fig", "L", 2, None)], []),
        (1, 15, [page], [(1, "Fig", "L", None, (0.5, 0.0, 0.6, 1.0))], []),
        (1, 15, [], [], []),
    ]
    df = spark.createDataFrame([(good,), *[(b,) for b in bad]], f"c {caches.CACHE}")
    assert [r[0] for r in df.select(caches.valid_cache(df.c)).collect()] == [True] + [False] * len(bad)
    assert "synthetic" not in df.limit(1).select(caches.kept_fields(df.c)).first()[0]


STYLE = '<style xmlns="http://x" version="1.0" class="in-text"><info><title>Plain</title></info><macro name="a"><text macro="b"/></macro><macro name="b"><text value="x"/></macro><citation><layout><text macro="a"/></layout></citation></style>'


def test_styles(spark):
    assert styles.inspect(STYLE) == {"label": "Plain", "parent": None, "locale": None}
    for change in (('<text value="x"/>', '<text macro="a"/>'), ('class="in-text"', 'class="note"'), ('macro="b"', 'macro="zz"'), ("<style ", "<!DOCTYPE x><style "), ("1.0", "2.0"), ("Plain", ""), ("</style>", "")):
        with pytest.raises(styles.StyleError):
            styles.inspect(STYLE.replace(*change))
    rows = spark.createDataFrame([("nature-x", "Nature X", "numeric"), ("notes", "Notes", "note"), ("Bad Id", "B", ""), ("plain", "Plain nature", "author")], "id string, title string, format string")
    found = styles.search(styles.catalogue(rows), "NATURE x", 1)
    assert [(r.id, r.truncated) for r in found.collect()] == [("nature-x", False)]
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "e")], "id string, parent string")
    assert {r.id: r.root for r in styles.parent_chain(chain).collect()} == {"a": "a", "b": "a", "c": "a", "d": None, "e": None}
