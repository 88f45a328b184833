import hashlib
import re
from collections import Counter

from scriptoria.llm import decontamination as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, TEXT string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(max(0, len(w) - n + 1) if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def got(docs, items):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(docs, items).collect())


def test_odd_rows(spark, odd_docs, odd_texts, no_docs, monkeypatch):
    ten = " ".join(odd_texts[4][1].split()[200:215])
    items = [(1, ten, ""), (2, "One, TWO!", ""), (2, "One, TWO!", ""), (3, None, ""), (None, "naïve 日本", ""), (10, "ÉTÉ naïve", ""), (12, "", ""), (11, odd_texts[9][1], "")]
    docs = [(d, t) for d, t, _ in odd_texts]
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(docs, [x[:2] for x in items])
    assert sum(v for k, v in want.items() if k[-1]) >= 4
    assert got(odd_docs, bench) == want
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert got(odd_docs, bench) == want
    empty = spark.createDataFrame([], ITEMS)
    assert got(odd_docs, empty) == brute(docs, [])
    assert got(no_docs, bench) == Counter()


def test_data(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_spans_go(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Before it, {passage.upper()}! After it stays, with many more words than the passage itself had in it at all."), (2, passage), (3, "clean"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = {r.doc_id: r.text for r in D.cleaned(docs, items, drop_from=0.9).collect()}
    assert set(rows) == {1, 3, None} and rows[3] == "clean" and rows[None] is None
    assert "two" not in rows[1].lower() and rows[1].startswith("Before it, ") and rows[1].endswith("in it at all.")
    assert {r.doc_id for r in D.cleaned(docs, items).collect()} == {3, None}
