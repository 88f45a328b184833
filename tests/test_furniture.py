import pytest

from scriptoria.operators import furniture as U

ITEM = "pdf_id string, page int, seq int, str string, transform array<double>"
PAPER = "pdf_id string, title string, journal string, doi string"


def left(spark, runs, journal="", doi="", title="A title of birds", page=3):
    """Texts that stay of runs (text, y, x?, vertical?), and the rules of the lines that go."""
    up = lambda r: [0.0, 9.0, -9.0, 0.0] if len(r) > 3 and r[3] else [9.0, 0.0, 0.0, 9.0]
    items = spark.createDataFrame([("d", page, k, r[0], [*up(r), float(r[2]) if len(r) > 2 else 50.0, float(r[1])]) for k, r in enumerate(runs)], ITEM)
    pages = spark.createDataFrame([("d", page, 600.0, 800.0)], "pdf_id string, page int, page_width double, page_height double")
    papers = spark.createDataFrame([("d", title, journal, doi)], PAPER)
    return [r.str for r in U.without_furniture(items, pages, papers).orderBy("seq").collect()]


LINES = [
    ("Nature Communications", "", "Nature Communications | (2024) 15:1234", 30),
    ("Other", "10.1038/s41467-024-1", "Nature Communications | (2024) 15:1234 2", 30),
    ("Nature", "10.1038/s41586-1", "Article https://doi.org/10.1038/s41586-1", 770),
    ("Sci. Adv.", "", "Smith et al., Sci. Adv. 10, eadk1 (2024) 5 March 2024", 30),
    ("Science Advances", "", "3 of 12", 30),
    ("Science", "", "SCIENCE www.sciencemag.org VOL 300 9 MAY 2003", 30),
    ("Science", "", "Smith et al., Science 380, 12 (2023) 9 May 2023 1 of 8", 20),
    ("Science", "", "RESEARCH | REPORTS", 770),
    ("PLOS ONE", "10.1371/journal.pone.1", "PLOS ONE | https://doi.org/10.1371/journal.pone.1 May 9, 2024 3 / 12", 30),
    ("PLOS ONE", "", "PLOS ONE A title of birds", 770),
    ("Any", "", "NATURE | VOL 500 | 1 MAY 2013", 30),
    ("Any", "", "A Title of Birds", 770),
    ("Journal of Reeds", "", "3 | Journal of Reeds", 770),
    ("", "", "3", 30),
]


@pytest.mark.parametrize(("journal", "doi", "line", "y"), LINES)
def test_lines(spark, journal, doi, line, y):
    assert left(spark, [(line, y), ("Prose.", 400), (line, 400)], journal, doi) == ["Prose.", line]


@pytest.mark.parametrize(("journal", "line", "y"), [("", "Nature Communications | (2024) 15:1234", 30), ("Reeds", "3 of 12", 30), ("Reeds", "RESEARCH | REPORTS", 770), ("Science", "In Science 380 we said this.", 30), ("Genome Biology", "Page 3 of 9", 770), ("Cell", "ll", 30), ("", "4", 30), ("", "Available under a CC-BY 4.0 license", 770), ("Science", "3 of 12", 30)])
def test_lines_that_stay(spark, journal, line, y):
    assert left(spark, [(line, y)], journal) == [line]


def test_evidence_of_the_page(spark):
    genome = [("Berg et al. Genome Biology (2020) 21:12", 770), ("Page 3 of 9", 750), ("https://doi.org/10.1186/s13059-020-1", 741), ("Page 3 of 9", 500)]
    assert left(spark, genome, "Genome Biol.", "10.1186/s13059-020-1") == ["Page 3 of 9"]
    stamp = [("bioRxiv preprint doi: https://doi.org/10.1101/2020.01.02.3; this version posted", 790), ("(which was not certified by peer review) is the author, who has granted a license to display the preprint in perpetuity. It is made", 780), ("available under a CC-BY 4.0 International license.", 770), ("text", 400)]
    assert left(spark, stamp) == ["text"]
    cell = [("Cell Reports 30, 1–9, January 7, 2020", 40), ("This is an open access article under the CC BY license", 30), ("ll", 20), ("Cell 30 is not here", 400)]
    assert left(spark, cell, "Cell Reports") == ["Cell 30 is not here"]
    press = [("Please cite this article in press as: Berg", 780), ("https://doi.org/10.1000/x", 760)]
    assert left(spark, press, "Reeds", "10.1000/x") == [] and left(spark, press[1:], "Reeds", "10.1000/x") == ["https://doi.org/10.1000/x"]


def test_whole_lines(spark):
    assert left(spark, [("PLOS", 30, 50), ("https://doi.org/10.1371/journal.pone.1", 30.5, 100), ("May 9, 2024", 30, 300), ("3 / 12", 29.5, 500)], "PLOS ONE", "10.1371/journal.pone.1") == []
    assert left(spark, [("3", 30, 50), ("birds were counted", 30, 100)]) == ["3", "birds were counted"]
    assert left(spark, [("A Title of Birds", 770)], page=1) == ["A Title of Birds"]


def test_stamps(spark):
    stamp, notice = "arXiv:2101.00001v2 [q-bio.PE] 5 Mar 2021", "Downloaded from https://www.science.org at Reed House on March 05, 2021"
    assert left(spark, [(stamp, 300, 20, True), (stamp, 300, 20), (stamp, 300, 200, True)]) == [stamp, stamp]
    assert left(spark, [(notice, 300, 590, True), (notice, 300, 590)], "Science") == [notice]
    assert left(spark, [(notice, 300, 590, True)], "Reeds") == [notice]


def test_nothing(spark):
    pages = spark.createDataFrame([], "pdf_id string, page int, page_width double, page_height double")
    assert U.without_furniture(spark.createDataFrame([], ITEM), pages, spark.createDataFrame([], PAPER)).count() == 0
    unknown = spark.createDataFrame([("d", 1, 0, "3 of 12", [9.0, 0.0, 0.0, 9.0, 50.0, 30.0])], ITEM)
    assert U.without_furniture(unknown, spark.createDataFrame([("d", 1, 600.0, 800.0)], pages.schema), spark.createDataFrame([], PAPER)).count() == 1


def test_lines_meet_their_rules_where_they_are(spark):
    from scriptoria.operators import furniture

    lines = spark.createDataFrame([("d", 2, 1, 20.0, 780.0, "7")], "pdf_id string, page int, line int, y double, top double, text string")
    papers = spark.createDataFrame([("d", "", "Cell", "10.1016/j.cell.1")], "pdf_id string, title string, journal string, doi string")
    plan = furniture.furniture_lines(lines, papers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan  # only with papers; there were joins with rules and evidence, on lines made three times
