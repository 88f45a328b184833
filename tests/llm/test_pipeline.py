import re
from collections import Counter

import corpus_pipeline
from scriptoria.llm import decontamination, mixing, quality, stages

from .conftest import SCHEMA, prose, rows_of
from .test_decontamination import words
from .test_near_duplicates import brute as near


def test_stages_are_the_five():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_columns_and_decisions(spark, odd_docs, odd_texts):
    kept = stages.good_quality(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality.judged(odd_docs).collect()}
    at = odd_docs.columns.index("text")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r[0], r[at]) for r in kept.collect()) == Counter((d, t) for d, t, _ in odd_texts if verdict[d, size(t)])


def test_one_of_each(spark):
    rows = [(i, prose(i % 6, 80), "s") for i in range(30)] + [(40, None, "s"), (41, "", "s"), (None, prose(2, 80), "s"), (3, prose(3, 80), "s")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = Counter(r[0] for r in stages.one_of_each(df).collect())
    assert got == Counter([0, 1, None, 3, 4, 5, 40, 41])
    assert set(c for _, c, _ in near([(d, t) for d, t, _ in rows])) == {0, 1, 2, 3, 4, 5, 40, 41}


def test_decontaminated(spark, odd_docs, odd_texts):
    items = spark.createDataFrame([(1, odd_texts[9][1])], "item_id long, text string")
    hit = {(r.doc_id, r.n_words) for r in decontamination.report(odd_docs, items).where("contaminated").collect()}
    at = odd_docs.columns.index("text")
    got = Counter((r[0], r[at]) for r in stages.decontaminated(odd_docs, items).collect())
    assert got == Counter((d, t) for d, t, _ in odd_texts if (d, len(words(t))) not in hit) and hit


def test_remixed_takes_what_the_mix_reports(spark, odd_docs, odd_texts):
    at, n_chars = odd_docs.columns.index("text"), odd_docs.columns.index("n_chars")
    rows = stages.remixed(odd_docs).collect()
    got, want = Counter(), Counter()
    for r in rows:
        assert r[n_chars] == len(r[at])
        got[r[0]] += len(r[at].split())
    for r in mixing.mix_report(odd_docs).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_taken_words():
    pieces = [{"first": 0, "own": 2, "times": 1}, {"first": 2, "own": 2, "times": 2}, {"first": 6, "own": 1, "times": 1}]
    assert stages._taken("a b\tc d e f g", pieces) == ["a b\tc d\ng", "c d"]
    assert stages._taken(" a b ", [{"first": 0, "own": 2, "times": 1}]) == [" a b "]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert rows and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
