from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import openings as O
from scriptoria.operators import sections

ITEM = "pdf_id string, page int, seq int, str string, transform array<double>, width double, height double, fontName string"
PAGE = "pdf_id string, page int, page_width double, page_height double"


def frames(spark, runs, journal="", doi="", page=1, width=600.0):
    """Runs (text, x, y, width, size, font)."""
    items = spark.createDataFrame([("d", page, k, t, [float(s), 0.0, 0.0, float(s), float(x), float(y)], float(w), float(s), f) for k, (t, x, y, w, s, f) in enumerate(runs)], ITEM)
    return items, spark.createDataFrame([("d", page, width, 800.0)], PAGE), spark.createDataFrame([("d", journal, doi)], "pdf_id string, journal string, doi string")


def read(spark, runs, **about):
    return [(r.text, r.level, r.synthetic) for r in O.paragraphs(*frames(spark, runs, **about)).orderBy("paragraph").collect()]


def templates(spark, *cases):
    """The templates of pages (runs, about), all in one job."""
    made = [frames(spark, runs, **about) for runs, about in cases]
    one = lambda k: reduce(DataFrame.unionByName, [f[k].withColumn("pdf_id", F.lit(str(n))) for n, f in enumerate(made)])
    found = {r.pdf_id: r.template for r in O.parts(one(0), one(1), one(2)).select("pdf_id", "template").distinct().collect()}
    return [found[str(n)] for n in range(len(cases))]


def prose(n, what="reeds"):
    return f"sentence {n} of the text tells at some length what was seen of {what} in the spring"


def wide(lines=3):
    opening = [("Early Reeds", 40, 760, 200, 16, "r"), ("SUMMARY", 40, 720, 100, 10, "Sans-Bold"), *[(prose(k), 40, 700 - 12 * k, 510, 10, "r") for k in range(lines)], ("and ends here.", 40, 700 - 12 * lines, 130, 10, "r")]
    intro = [("INTRODUCTION", 40, 640, 130, 10, "Sans-Bold")]
    return opening + intro + [r for k in range(4) for r in ((prose(k, "the left"), 40, 620 - 12 * k, 240, 10, "r"), (prose(k, "the right"), 320, 620 - 12 * k, 240, 10, "r"))]


def test_a_wide_abstract_keeps_its_short_last_line(spark):
    got = read(spark, wide(), page=2)
    assert [t for t, level, _ in got if level] == ["Early Reeds", "SUMMARY", "INTRODUCTION"][-2:]
    texts = [t for t, _, _ in got]
    assert texts[texts.index("SUMMARY") + 1] == " ".join([*map(prose, range(3)), "and ends here."])
    body = " ".join(texts[texts.index("INTRODUCTION") + 1 :])
    assert body == " ".join([*(prose(k, "the left") for k in range(4)), *(prose(k, "the right") for k in range(4))])


def test_pages_without_evidence_have_no_template(spark):
    no_intro, at_right = [r for r in wide() if r[0] != "INTRODUCTION"], [(t, x + 200, *r) for t, x, *r in wide()]
    assert templates(spark, (wide(), {"page": 2}), (wide(), {"page": 3}), (wide(2), {}), (no_intro, {}), (at_right, {})) == ["wide", None, None, None, None]
    advances = {"journal": "Science Advances"}
    assert templates(spark, (set_off(), advances), (set_off(3), advances), (set_off(font="Times"), advances), (set_off(), {"journal": "Reeds"}), (set_off(), {**advances, "page": 2})) == ["set off", None, None, None, None]
    bigger = [(t, x, y, w, 12 if t == "applications." else s, f) for t, x, y, w, s, f in split()]
    assert templates(spark, (split(), {}), (split(2), {}), (split(), {"journal": "Nature"}), (bigger, {})) == ["split", None, None, None]
    older = inset(face="ABCDEF+AdvOTdd63dae3+fb")
    others = [(inset(), {"journal": "Reeds"}), (inset(2), {"journal": "Nature"}), (older, {"journal": "Nature Methods"}), (inset(), {"journal": "Nature", "page": 2})]
    assert templates(spark, (older, {"doi": "10.1038/s41467-024-1"}), *others) == ["inset", None, None, None, None]


def set_off(lines=4, font="ABCDEF+MyriadPro-Semibold"):
    heads = [("Ada Berg and Min Cho", 40, 740, 200, 12, "Sans"), ("published in the margin", 520, 690, 60, 7, "Sans")]
    text = [(prose(k) + " of the year", 40, 700 - 12 * k, 420, 10, font) for k in range(lines)]
    return [*heads, *text, ("INTRODUCTION", 40, 630, 150, 12, "Sans-Bold"), (prose(9), 40, 608, 255, 10, "r")]


def test_a_set_off_abstract_is_one_plain_paragraph(spark):
    for about in ({"journal": "Science Advances"}, {"journal": "Sci. Adv."}, {"doi": "10.1126/sciadv.abc1"}):
        got = read(spark, set_off(), **about)
        assert got == [("Abstract", 1, True), (" ".join(prose(k) + " of the year" for k in range(4)), None, False), ("INTRODUCTION", 1, False), (prose(9), None, False)]


def split(lines=3, last="applications.", notes=True):
    left = [("A paper about reeds", 70, 700, 400, 16, "r"), ("Abstract", 150, 570, 60, 12, "r"), *[(f"we describe part {k} of a useful model", 75, 550 - 12 * k, 200, 10, "r") for k in range(lines)]]
    below = [("Equal contribution", 65, 480, 90, 9, "r"), ("Department of Reeds at some place", 55, 468, 180, 9, "r")] if notes else []
    return [*left, (last, 327, 570, 80, 10, "r"), *below, ("1. Introduction", 307, 537, 90, 12, "r"), ("The text starts here with relevant matters.", 307, 515, 210, 10, "r")]


def test_a_split_abstract_goes_on_in_the_right_column(spark):
    got = read(spark, split())
    said = " ".join(f"we describe part {k} of a useful model" for k in range(3))
    assert [t for t, _, _ in got] == ["Abstract", f"{said} applications.", "1. Introduction", "The text starts here with relevant matters.", "Equal contribution Department of Reeds at some place"]
    assert [t for t, level, _ in got if level] == ["Abstract", "1. Introduction"]
    # a capital begins a paragraph of its own; without notes the rest is the same
    assert [t for t, _, _ in read(spark, split(last="Applications.", notes=False))] == ["Abstract", said, "Applications.", "1. Introduction", "The text starts here with relevant matters."]


def inset(lines=4, face="HardingText-Regular", short="github.io/tool)."):
    top = [("Ada Berg and Min Cho", 217, 760, 250, 9.25, "GraphikNaturel-Semibold"), *[(prose(k), 217, 700 - 12 * k, 250, 10, face) for k in range(lines)], (short, 217, 700 - 12 * lines, 80, 10, face)]
    body = [r for k in range(5) for r in ((prose(k, "the left"), 40, 580 - 11 * k, 250, 8.25, face), (prose(k, "the right"), 306, 580 - 11 * k, 250, 8.25, face))]
    return [*top, *body, ("2", 292, 580, 4, 5, "Symbols"), ("1Department of Reeds", 40, 300, 150, 6, "Graphik")]


def test_an_inset_abstract_and_its_text(spark):
    got = read(spark, inset(), journal="Nature Methods")
    assert got[0] == ("Abstract", 1, True) and got[1][0] == " ".join([*map(prose, range(4)), "github.io/tool)."])
    assert got[2] == ("Introduction", 1, True) and got[3][0].startswith("sentence 0 of the text tells at some length what was seen of the left")
    said = " ".join(t for t, _, _ in got)
    assert "Ada" not in said and "Department" not in said


def test_a_sign_within_a_line_of_prose_stays(spark):
    kept = O.parts(*frames(spark, inset(), journal="Nature Methods")).where("part is not null and fontName <> 'HardingText-Regular'").collect()
    assert [r.str for r in kept] == ["2"]


def test_faces_that_are_bold_for_one_publisher(spark):
    runs = [("Reeds of the north", 40, 700, 90, 10, "ABCDEF+AdvPSHN-HI"), ("Reeds of the south", 40, 600, 90, 10, "ABCDEF+AdvOT70e1938e")]
    bold = lambda **about: [r.bold for r in O.parts(*frames(spark, runs, **about)).orderBy("seq").collect()]
    assert bold() == [False, False] and bold(journal="Cell") == [True, False] and bold(journal="Nature Communications") == [False, True]


def test_sections_take_synthetic_headings(spark):
    items, pages, papers = frames(spark, inset(), journal="Nature Methods")
    papers = papers.selectExpr("pdf_id", "'' AS title", "'Berg, Ada; Cho, Min' AS authors", "journal", "doi")
    got = sections.organised(O.paragraphs(items, pages, papers), papers).orderBy("pos").collect()
    assert [(r.title, r.level, r.synthetic) for r in got if r.level] == [("Abstract", 1, True), ("Introduction", 1, True)]


def test_odd_rows(spark):
    items, pages, papers = frames(spark, [(None, 40, 700, 10, 10, None), ("Text.", 40, 650, 40, 10, None)])
    got = O.paragraphs(items, pages, papers.limit(0)).collect()
    assert [(r.text, r.level, r.synthetic) for r in got] == [("Text.", None, False)]
    assert O.paragraphs(items.limit(0), pages, papers).count() == 0
    assert O.parts(items.withColumn("x", items["seq"]), pages, papers).count() == 2


def test_pages_come_by_one_shuffle_of_their_runs(spark):
    plan = O.paragraphs(*frames(spark, wide()))._jdf.queryExecution().executedPlan().toString()  # as it is before it runs
    assert "Window" not in plan and plan.count("- Exchange hashpartitioning(pdf_id") <= 4


def test_names_of_bold_fonts(spark):
    from scriptoria.operators import layout

    names = ["Sans-Bold", "ABC+CMBX12", "lmbx10", "xcmbx", "Times-Medi", "medi", "Nimbus,Medi Italic", "AdvOT70e1938e.B", "AdvOT1 .b", "advot x.b", "SemiBold", "plain", "", " ", "İBLACK"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", layout.is_bold(F.col("n")).alias("bold"))
    assert {r.n: r.bold for r in df.collect()} == {n: layout.bold_name(n) for n in names}
