"""Queries and their SQL on small tables whose keys and groups are those of large ones."""

import os

import duckdb
import pytest

from scriptoria.plans.queries import QUERIES, SQL

from .test_oracles import rows


def _copied(sf_dir, folder, **sql):
    """A folder of the tables that sql makes of the given ones."""
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    for name, made in sql.items():
        con.execute(f"COPY ({made}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def _held(spark, d, name):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    df = QUERIES[name](spark, d)
    got = rows(df.columns, df.collect())
    assert got == rows(names, want.fetchall())
    return got


def test_titles_with_quotation_marks(spark, sf_dir, tmp_path):
    d = _copied(sf_dir, tmp_path, pages="SELECT 2::BIGINT AS page_id, 'https://x.org/a' AS url, '<title>On &quot;nests&quot; &amp; &#39;eggs&#39;</title>' AS html")
    assert any("On \"nests\" & 'eggs'" in r for r in _held(spark, d, "html_metadata_records"))


def test_late_writes_that_share_a_sequence_number(spark, sf_dir, tmp_path):
    d = _copied(sf_dir, tmp_path, events="SELECT * EXCLUDE (i) REPLACE (event_id + i * 1000000 AS event_id) FROM (SELECT * FROM events WHERE event_id < 50), range(3) t(i)")
    _held(spark, d, "optimistic_writes")


def test_letters_of_groups_past_three(spark, sf_dir, tmp_path):
    d = _copied(sf_dir, tmp_path, part="SELECT * EXCLUDE (i) REPLACE (p_partkey * 20000 + i AS p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 1), range(19000) t(i)")
    assert {len(r[1]) for r in _held(spark, d, "year_suffix")} == {1, 2, 3, 4}


@pytest.mark.parametrize("name", ["citation_numbering", "citation_splice", "markers_resolve", "bibliography_list", "unresolved_identifiers"])
def test_papers_that_share_an_arxiv_id(spark, sf_dir, tmp_path, name):
    # 560,000 keys on, a paper has the arXiv id again; some of these have neither PMID nor DOI and go to the record of the first that fits
    d = _copied(
        sf_dir, tmp_path, part="SELECT * EXCLUDE (i, k) REPLACE (35 + 7 * k + 560000 * i AS p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 1), range(8) a(i), range(12) b(k) WHERE i < 2 OR k % 8 = 0",
        lineitem="SELECT * EXCLUDE (i, k, n) REPLACE (k * 9 + i AS l_orderkey, n AS l_linenumber, 35 + 7 * k + 560000 * i AS l_partkey, 35 + 7 * k AS l_suppkey) FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1), range(8) a(i), range(12) b(k), range(1, 10) c(n) WHERE i < 2 OR k % 8 = 0",
    )
    assert len(_held(spark, d, name)) > 30


def test_contradicting_components_are_no_groups_of_their_own(spark):
    from scriptoria.operators import citations

    # in each of 500 components two papers of one preprint contradict each other, and a third fits the first
    papers = [(f"p{k}-{i}", 3 * k + i, pmid, "", f"2101.{10000 + k}", "") for k in range(500) for i, pmid in enumerate((str(1000 + k), str(5000 + k), ""))]
    out = citations.entity_records(spark.createDataFrame(papers, "id string, lib_pos long, pmid string, doi string, arxivId string, sourceUrl string"))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.key, r.paper_id) for r in out.collect()}
    assert {p for key, p in got if key == "arxiv:2101.10007"} == {"p7-0", "p7-1"}
    assert {p for key, p in got if key == "local:p7-2"} == {"p7-0"} and len(got) == 500 * (3 + 2 + 2)
