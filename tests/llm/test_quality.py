import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import quality as Q

WS = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WS, text)
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_against_brute_force(spark, sf_dir, odd_docs, odd_texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd_docs, [(d, t) for d, t, _ in odd_texts])):
        got = Q.judged(df).collect()
        assert Counter((r.doc_id, *[r[c] for c in names]) for r in got) == Counter((d, *brute(t)) for d, t in rows)
        assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("text", ["a b c d e a b c d e f", "x " * 50, "a b c d e f g a b c d e f g a b c d e", "a a a a a a", "a b c d"])
def test_repeats(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(Q.repeat_words(F.split(F.trim("t"), " ")).alias("n"))
    assert df.first().n == brute(text)[4]


def test_held_out_labels(spark):
    """Clean documents stay and labelled junk that the base rule lets through goes."""
    sf = "/root/testdata/sf0.01"
    rows = Q.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_expectation_maximisation():
    import random

    r = random.Random(0)
    counts, truth = Counter(), Counter()
    for _ in range(5000):
        good = r.random() < 0.85
        v = "".join(("g" if r.random() < 0.97 else "b") if good else ("b" if r.random() < p else "g") for p in (0.9, 0.8, 0.7, 0.6))
        counts[v] += 1
        truth[v] += good
    post = Q.estimated(counts)
    right = sum(truth[v] if post[v] >= 0.5 else counts[v] - truth[v] for v in counts)
    assert right / 5000 > 0.95
    assert Q.estimated({}) == {}


def test_empty(no_docs):
    assert Q.judged(no_docs).count() == 0
