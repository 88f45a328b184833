"""Styles compiled to columns: what each element writes, held against hand-written texts."""

import pytest
from pyspark.sql import functions as F

from scriptoria.operators.csl import Style, initials, page_range, tidy
from scriptoria.operators.generate import generate, items_of
from scriptoria.operators.styles import StyleError
from scriptoria.plans.styles import AUTHOR_DATE, NUMERIC

HEAD = '<style xmlns="http://purl.org/net/xbiblio/csl" class="in-text" version="1.0" default-locale="en-US"><info><title>t</title></info>'
COLUMNS = "id title authors year journal journalAbbreviation doi pmid arxivId sourceUrl cslType volume issue pages publisher publisherPlace eventTitle".split()


def paper(i, **more):
    return {c: "" for c in COLUMNS} | {"id": f"p{i}", "lib_pos": i, "title": f"Title {i}", "authors": "Berg, Ada Maria; Cho, Min-Ho", "year": "2020", "journal": "Maps & Charts", "pmid": str(10000000 + i), "cslType": "article-journal"} | more


def wrote(spark, body, html=False, locale=None, macros="", **more):
    xml = f"{HEAD}{macros}<citation><layout><text value='x'/></layout></citation><bibliography><layout>{body}</layout></bibliography></style>"
    items = items_of(spark.createDataFrame([paper(1, **more)])).withColumn("number", F.lit(7)).withColumn("year_suffix", F.lit(more.get("suffix")).cast("string"))
    return items.select(Style(xml, locale).written("bibliography", html)).first()[0]


NAMES = "<names variable='author'><name {}/></names>"
CASES = [
    ("<text variable='title' prefix='[' suffix=']'/>", {}, "[Title 1]"),
    ("<group delimiter=', '><text variable='volume'/><text value='only with a value'/></group><text variable='title'/>", {}, "Title 1"),
    ("<group delimiter=', '><text variable='volume'/><text value='v'/></group>", {"volume": "3"}, "3, v"),
    ("<group delimiter=', '><text value='a'/><text value='b'/></group>", {}, "a, b"),
    ("<group delimiter='/'><choose><if variable='volume'><text variable='volume'/><text variable='issue'/></if><else><text value='none'/></else></choose></group>", {"volume": "3", "issue": "4"}, "3/4"),
    ("<group prefix='(' suffix=')'><choose><if variable='issued'><date variable='issued'><date-part name='year'/></date></if><else><text term='no date' form='short'/></else></choose></group>", {"year": ""}, "(n.d.)"),
    ("<choose><if type='book chapter' match='any'><text value='B'/></if><else-if type='article-journal' variable='DOI' match='all'><text value='D'/></else-if><else><text value='E'/></else></choose>", {"doi": "10.1000/x"}, "D"),
    ("<choose><if type='book' match='none'><text value='N'/></if></choose>", {}, "N"),
    ("<choose><if is-numeric='volume'><text value='n'/></if><else><text value='s'/></else></choose>", {"volume": "12-13"}, "n"),
    ("<choose><if is-numeric='volume'><text value='n'/></if><else><text value='s'/></else></choose>", {"volume": "XII"}, "s"),
    ("<text variable='container-title' form='short'/>", {"journalAbbreviation": "M. Ch."}, "M. Ch."),
    ("<text variable='container-title' form='short' strip-periods='true'/>", {"journalAbbreviation": "M. Ch."}, "M Ch"),
    ("<text variable='container-title' form='short'/>", {}, "Maps & Charts"),
    ("<text variable='title' text-case='uppercase'/>", {}, "TITLE 1"),
    ("<text variable='title' text-case='title'/>", {"title": "the map of a heart in PCR"}, "The Map of a Heart in PCR"),
    ("<text variable='title' quotes='true' suffix='.'/>", {}, "“Title 1.”"),
    ("<text variable='title' suffix='.'/>", {"title": "Why?"}, "Why?"),
    ("<text variable='title' suffix='.'/>", {"title": "Ends."}, "Ends."),
    ("<label variable='page' form='short' suffix=' '/><text variable='page'/>", {"pages": "12-19"}, "pp. 12–19"),
    ("<label variable='page' form='short' suffix=' '/><text variable='page'/>", {"pages": "12"}, "p. 12"),
    ("<number variable='volume' form='ordinal'/>", {"volume": "22"}, "22nd"),
    ("<number variable='volume' form='ordinal'/>", {"volume": "112"}, "112th"),
    ("<date variable='issued' form='text'/>", {"dateParts": [2020, 3, 9]}, "March 9, 2020"),
    ("<date variable='issued' form='text' date-parts='year-month'/>", {"dateParts": [2020, 3]}, "March 2020"),
    ("<date variable='issued' delimiter='-'><date-part name='year'/><date-part name='month' form='numeric-leading-zeros'/></date>", {"dateParts": [2020, 3]}, "2020-03"),
    ("<date variable='issued'><date-part name='month' form='short' strip-periods='true' suffix=' '/><date-part name='year'/></date>", {"dateParts": [2020, 9]}, "Sep 2020"),
    (NAMES.format(""), {}, "Ada Maria Berg, Min-Ho Cho"),
    (NAMES.format("and='text'"), {}, "Ada Maria Berg and Min-Ho Cho"),
    (NAMES.format("and='symbol' initialize-with='. ' name-as-sort-order='all' delimiter-precedes-last='always'"), {}, "Berg, A. M., & Cho, M.-H."),
    (NAMES.format("initialize-with='' name-as-sort-order='all' sort-separator=' ' initialize-with-hyphen='false'"), {}, "Berg AM, Cho MH"),
    (NAMES.format("name-as-sort-order='first' and='text'"), {"authors": "Berg, Ada; Roe, Kim; Noor, Ida"}, "Berg, Ada, Kim Roe, and Ida Noor"),
    (NAMES.format("form='short' et-al-min='3' et-al-use-first='1'"), {"authors": "Berg, Ada; Roe, Kim; Noor, Ida"}, "Berg et al."),
    (NAMES.format("form='short' et-al-min='3' et-al-use-first='2'"), {"authors": "Berg, Ada; Roe, Kim; Noor, Ida"}, "Berg, Roe, et al."),
    (NAMES.format("form='short' et-al-min='4' et-al-use-first='2' et-al-use-last='true'"), {"authors": "A, a; B, b; C, c; D, d"}, "A, B, … D"),
    (NAMES.format("initialize-with='.'"), {"authors": "World Health Team, "}, "World Health Team"),
    (NAMES.format("form='short'"), {"authors": "Consortium"}, "Consortium"),
    ("<names variable='editor author'><name form='short'/></names>", {}, "Berg, Cho"),
    ("<names variable='author'><name form='short'/><substitute><names variable='editor'/><text variable='title'/></substitute></names><text variable='title' prefix=' T:'/>", {"authors": ""}, "Title 1"),
    ("<names variable='editor'><name form='short' and='symbol'/><substitute><names variable='author'/></substitute></names>", {}, "Berg & Cho"),
    ("<text variable='citation-number' suffix='.'/><text variable='year-suffix'/>", {"suffix": "b"}, "7.b"),
    ("<date variable='issued'><date-part name='year'/></date>", {"suffix": "b"}, "2020b"),
    ("<text term='page' plural='true'/><text term='unheard of'/>", {}, "pages"),
]


@pytest.mark.parametrize(("body", "more", "want"), CASES)
def test_elements(spark, body, more, want):
    assert wrote(spark, body, **more) == want


def test_html(spark):
    body = "<names variable='author'><name and='symbol' form='short'><name-part name='family' font-variant='small-caps'/></name></names><text variable='container-title' font-style='italic' prefix=' '/><text variable='volume' font-weight='bold' prefix=' '/><text value='&lt;x&gt;' vertical-align='sup'/>"
    cap = '<span style="font-variant:small-caps">{}</span>'.format
    assert wrote(spark, body, html=True, volume="2") == f"{cap('Berg')} &amp; {cap('Cho')} <i>Maps &amp; Charts</i> <b>2</b><sup>&lt;x&gt;</sup>"
    assert wrote(spark, body, volume="2") == "Berg & Cho Maps & Charts 2<x>"


def test_locales(spark):
    locale = '<locale xmlns="http://purl.org/net/xbiblio/csl" xml:lang="de"><terms><term name="and">und</term><term name="page" form="short"><single>S.</single><multiple>SS.</multiple></term></terms><date form="text"><date-part name="day" suffix=". "/><date-part name="month" suffix=" "/><date-part name="year"/></date></locale>'
    body = "<names variable='author'><name and='text' form='short'/></names><label variable='page' form='short' prefix=', '/><date variable='issued' form='text' prefix=', '/>"
    assert wrote(spark, body, locale=locale, pages="1-2", dateParts=[2020, 3, 9]) == "Berg und Cho, SS., 9. March 2020"


def test_macros_and_helpers(spark):
    macros = "<macro name='a'><text macro='b'/></macro><macro name='b'><group delimiter=' '><text variable='volume'/><text variable='issue' prefix='(' suffix=')'/></group></macro>"
    assert wrote(spark, "<text macro='a' suffix='!'/>", macros=macros, volume="3", issue="4") == "3 (4)!"
    one = spark.range(1)
    pages = [("1001-1009", None, "1001–1009"), ("1001-1009", "minimal", "1001–9"), ("321-28", "expanded", "321–328"), ("321-28", "minimal", "321–8"), ("321-328", "minimal-two", "321–28"), ("e12", "minimal", "e12"), ("1-3, 7-9", None, "1–3, 7–9")]
    for given, form, want in pages:
        assert one.select(page_range(F.lit(given), form, "–")).first()[0] == want
    assert one.select(initials(F.lit("Jean-Paul  marie"), ". ")).first()[0] == "J.-P. M."
    for given, want in (("a.., b", "a., b"), ("x . y ,z", "x. y,z"), ("et al.</i>.", "et al.</i>"), ("wait...", "wait...")):
        assert one.select(tidy(F.lit(given), True)).first()[0] == want


@pytest.mark.parametrize("xml", ["<style/>", HEAD + "</style>", HEAD.replace("in-text", "note") + "<citation><layout/></citation></style>", HEAD + "<citation><layout><text macro='m'/></layout></citation></style>"])
def test_refused(xml):
    with pytest.raises(StyleError):
        Style(xml)


def papers(spark):
    return spark.createDataFrame([
        paper(1), paper(2, title="Alpha"), paper(3, authors="Roe, Kim", year="1999"), paper(4, authors="", journal=""), paper(5, authors="Roe, Kim", sourceUrl="https://pubmed.ncbi.nlm.nih.gov/10000005/"), paper(6, authors="Ann Lee", doi="x"),
        paper(7, doi="10.1000/same"), paper(8, doi="10.1000/same", year="2001"),
    ])


def test_manuscript_by_number(spark):
    docs = spark.createDataFrame([(1, "A (PMID: 10000003, 10000001; 10000002) b (10000004) c (10000001) d (99999999) [doi:10.1000/same]."), (2, "No marker (2020)."), (3, None)], "doc_id long, text string")
    g = generate(docs, papers(spark), Style(NUMERIC))
    assert {r.doc_id: (r.text, r.n_citations) for r in g.texts.collect()} == {1: ("A [1–3] b [4] c [2] d (99999999) [doi:10.1000/same].", 3), 2: ("No marker (2020).", 0), 3: (None, 0)}
    assert [(r.pos, r.entry) for r in g.bibliography.orderBy("pos").collect()] == [
        (1, "1. Roe K. Title 3. Maps & Charts. 1999."), (2, "2. Berg AM, Cho MH. Title 1. Maps & Charts. 2020."), (3, "3. Berg AM, Cho MH. Alpha. Maps & Charts. 2020."), (4, "4. Title 4. 2020."),
    ]
    assert [(r.doc_id, r.pos, r.identifier) for r in g.unresolved.orderBy("pos").collect()] == [(1, 1, "99999999"), (1, 2, "doi:10.1000/same")]
    assert [(r.pos, r.subject, r.warning) for r in g.warnings.orderBy("pos").collect()] == [(1, "doi:10.1000/same", "means several records"), (2, "10000004", "missing authors, journal")]


def test_manuscript_by_author(spark):
    docs = spark.createDataFrame([(1, "A (10000001) b (PMID: 10000003; 10000002) c (10000005; 10000006).")], "doc_id long, text string")
    g = generate(docs, papers(spark), Style(AUTHOR_DATE))
    assert g.texts.first().text == "A (Berg & Cho, 2020b) b (Berg & Cho, 2020a; Roe, 1999) c (Lee, 2020; Roe, 2020)."
    assert [r.entry for r in g.bibliography.orderBy("pos").collect()] == [
        "Berg, A. M., & Cho, M.-H. (2020a). Alpha. Maps & Charts.", "Berg, A. M., & Cho, M.-H. (2020b). Title 1. Maps & Charts.", "Lee, A. (2020). Title 6. Maps & Charts.", "Roe, K. (1999). Title 3. Maps & Charts.", "Roe, K. (2020). Title 5. Maps & Charts.",
    ]
    assert {(r.subject, r.warning) for r in g.warnings.collect()} == {("10000005", "only a PubMed link"), ("10000006", "invalid DOI"), ("10000006", "inferred names")}


def test_names_are_added_and_years_collapsed(spark):
    cite = "<citation et-al-min='3' et-al-use-first='1' disambiguate-add-names='true' disambiguate-add-year-suffix='true' collapse='year'><layout prefix='(' suffix=')' delimiter='; '><group delimiter=' '><names variable='author'><name form='short' delimiter=', '/></names><date variable='issued'><date-part name='year'/></date></group></layout></citation>"
    who = [paper(1, authors="A, a; B, b; C, c"), paper(2, authors="A, a; D, d; C, c"), paper(3, authors="E, e"), paper(4, authors="E, e", year="2001"), paper(5, authors="E, e", title="Twin")]
    docs = spark.createDataFrame([(1, "x (PMID: 10000001; 10000002) y (10000003; 10000001; 10000004; 10000005)")], "doc_id long, text string")
    g = generate(docs, spark.createDataFrame(who), Style(f"{HEAD}{cite}</style>"))
    assert g.texts.first().text == "x (A, B, et al. 2020; A, D, et al. 2020) y (E 2020a, 2001, 2020b; A, B, et al. 2020)"
    assert g.bibliography.count() == 0


def test_what_a_style_writes_nothing_for(spark):
    cite = "<citation><layout prefix='(' suffix=')' delimiter='; '><names variable='author'><name form='short'/></names></layout></citation>"
    docs = spark.createDataFrame([(1, "x (PMID: 10000001; 10000002; 10000003)")], "doc_id long, text string")
    who = [paper(1, authors="", title="A <b>"), paper(2, authors="", title=""), paper(3, authors="Roe, Kim")]
    g = generate(docs, spark.createDataFrame(who), Style(f"{HEAD}{cite}</style>"))
    assert [(r.replacement, r.replacement_html) for r in g.citations.collect()] == [("(A <b>; 10000002; Roe)", "(A &lt;b&gt;; 10000002; Roe)")]
