import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import common as C
from scriptoria.llm import neardup as N
from scriptoria.llm import ngram_join as G
from scriptoria.llm import passages as P

from .conftest import prose


def grams(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {}
    for _, t in docs:
        sets.setdefault(grams(t), len(sets))
    sets.pop(frozenset(), None)
    keys = list(sets)
    up = {k: k for k in keys}
    degree = Counter()

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                degree[a] += 1
                degree[b] += 1
                up[root(a)] = root(b)
    first = {}
    for d, t in docs:
        if grams(t) and d is not None:
            r = root(grams(t))
            first[r] = min(first.get(r, d), d)
    return Counter((d, first.get(root(g)) if (g := grams(t)) else d, degree[g] if g else 0) for d, t in docs)


def got(df):
    return Counter(tuple(r) for r in G.classes(df).select("doc_id", "class_id", "n_links").collect())


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edited" + str(r.random())
    return " ".join(w)


def test_join(spark, sf_dir, odd_docs, odd_texts, no_docs):
    assert got(odd_docs) == brute([(d, t) for d, t, _ in odd_texts])
    assert got(no_docs) == Counter()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_join_of_near_copies(spark):
    rows = []
    for k in range(60):
        base = prose(k, 150 + k)
        rows += [(100 * k + i, edited(base, i, 1000 * k + i)) for i in range(5)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_crowded_nodes_keep_classes(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_ROWS", 20)
    monkeypatch.setattr(N, "ALL_PAIRS", 4)
    rows = [(i, edited(prose(1, 300), 2, i)) for i in range(120)] + [(1000 + i, prose(2 + i, 100)) for i in range(30)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_links_of_400_and_2000_near_copies(spark):
    rows = [(i, edited(prose(1, 400), 3, i)) for i in range(400)] + [(1000 + i, edited(prose(2, 60), 1, i)) for i in range(2000)] + [(9000 + i, edited(prose(3, 300), 7, i)) for i in range(100)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    def rounds(n_edits, target):
        rows = [(i, edited(prose(i // 2, 300), n_edits * (i % 2), i)) for i in range(300)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        _, nodes, _, _ = G.joined(df)
        texts = df.select("text", "doc_id")
        texts_of = lambda ids: ids.join(nodes, "id").select("id", F.col("first.doc_id").alias("doc_id")).join(texts, "doc_id").select("id", "text")
        return N.forest_links(nodes, lambda p: G.forest_rows(nodes, p), texts_of, G.FLOOR, G.TREES, G.DEPTH, target)[2]

    close, far = rounds(1, 0.999), rounds(6, 0.99999)
    assert [p for p, _ in close] == [6] and close[-1][1] >= 0.999
    assert [p for p, _ in far][0] == 6 and len(far) > 1 and far[-1][1] >= 0.99999 and sorted(r for _, r in far) == [r for _, r in far]
    assert N.recall({}, 24, 5) == 1 - (1 - 0.8**5) ** 24 and N.recall({19: 5, 0: 5}, 24, 5) > N.recall({}, 24, 5)


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_LEAST", 5)
    monkeypatch.setattr(C, "HOT_KEYS", 4)
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("k" + str(i), i) for i in range(30)] + [("none", 1)], "k string, v int")
    right = left.where("k <> 'none'").groupBy("k").count().selectExpr("k", "count as n", "upper(k) as u")
    for how in ("inner", "left"):
        want = Counter(tuple(r) for r in left.join(right.drop("n"), "k", how).collect())
        assert Counter(tuple(r) for r in C.hot_join(left, right, "k", how).collect()) == want


def test_crowded_nodes_keep_all_links(spark):
    rows = [(i, edited(prose(1, 300), 3, i)) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_parts_of_a_split_node_all_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_ROWS", 9)
    rows = [(i, edited(prose(1, 300), 3, i)) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("last", [0, 20_000])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(N, "LAST_EDGES", last)
    monkeypatch.setattr(C, "HOT_LEAST", 5)
    monkeypatch.setattr(C, "HOT_KEYS", 10)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 112)] + [(0, i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)]
    key = lambda i: bytearray(i.to_bytes(4, "big"))
    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges if a != b], "a binary, b binary")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert {int.from_bytes(r.id, "big"): int.from_bytes(r.root, "big") for r in N.components(df).collect()} == {x: root(x) for x in list(up)}


def test_sketches():
    a = N.shingles(prose(1, 400))
    b = N.shingles(edited(prose(1, 400), 8, 3))
    s = N.signatures([a, b], 600)
    assert abs((s[0] == s[1]).mean() - N.jaccard(a, b)) < 0.08
    assert len(N.shingles("")) == 0 and len(N.shingles("one two")) == 1
    assert N.jaccard(np.zeros(0, np.uint64), a) == 0


def passages(df):
    return {r.doc_id: r for r in P.classes(df).collect()}


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(7)
    rows, held = [(i, prose(5000 + i, r.randint(60, 300))) for i in range(80)], []
    for k in range(20):
        passage = prose(9000 + k, r.randint(55, 80))
        own = [20 + k, 40 + k, 60 + k]
        for i in own:
            w = rows[i][1].split(" ")
            at = r.randrange(len(w))
            rows[i] = (i, " ".join([*w[:at], passage, *w[at:]]))
        held.append((own, passage))
    return rows, held, spark.createDataFrame(rows, "doc_id long, text string")


def test_passages_inside_lines(planted):
    rows, held, df = planted
    got = passages(df)
    for own, _ in held:
        assert {got[i].class_id for i in own} == {min(own)}
        assert got[min(own)].n_removed == 0 and all(got[i].n_removed for i in own[1:])
    assert all(got[i].class_id == i and got[i].n_repeated == 0 for i in range(20))


def test_passages_are_cut_out(planted):
    rows, held, df = planted
    texts = {r.doc_id: r.text for r in P.without_repeats(df).collect()}
    for own, passage in held:
        middle = passage[len(passage) // 3 : 2 * len(passage) // 3]
        assert middle in texts[own[0]] and all(middle not in texts[i] for i in own[1:])
    assert all(texts[i] == rows[i][1] for i in range(20))


def test_similar_lines(spark):
    line = prose(3, 90)
    rows = [(1, f"{prose(11, 40)}\n{line}"), (2, f"{edited(line, 2, 1)}\n{prose(12, 40)}"), (3, prose(13, 90)), (None, line), (4, None), (5, "")]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1].class_id == got[2].class_id is None or got[1].class_id == got[2].class_id
    assert got[1].n_removed and got[2].n_removed and not got[3].n_removed and got[3].class_id == 3
    assert got[4].class_id == 4 and got[5].n_repeated == 0


def test_passages_odd_rows(odd_docs, odd_texts, no_docs):
    rows = P.classes(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in odd_texts)
    got = {r.doc_id: r for r in rows}
    assert got[8].class_id == got[9].class_id == got[10].class_id == 8 and got[8].n_removed == 0 and got[10].n_removed
    assert P.classes(no_docs).count() == 0


def test_similar_lines_in_a_crowd(spark):
    base, rows = prose(1, 100), []
    for k in range(120):
        line = edited(base, 2, k)
        rows += [(2 * k, f"{line}\n{prose(500 + k, 20)}"), (2 * k + 1, f"{edited(line, 2, 1000 + k)}\n{prose(800 + k, 20)}")]
    lines = {d: t.split("\n")[0] for d, t in rows}
    texts = P.keyed(spark.createDataFrame(rows, "doc_id long, text string")).select("doc", "fp", "text")
    roots = {r.doc: bytes(r.root) for r in P.clustered(texts).where("line").collect()}
    sets = {d: grams(t) for d, t in lines.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) >= 60 and sum(roots[a] == roots[b] for a, b in pairs) >= 0.98 * len(pairs)


def common_runs(a, b, least):
    """(i, j, n): the maximal runs of at least least equal words of a from i and b from j on."""
    out, last = [], {}
    for i in range(len(a)):
        now = {}
        for j in range(len(b)):
            if a[i] == b[j]:
                now[j] = last.get(j - 1, 0) + 1
                if now[j] >= least and (i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]):
                    out.append((i + 1 - now[j], j + 1 - now[j], now[j]))
        last = now
    return out


def words_in(text, removed):
    """Which words of a text lie in the places."""
    spans = [tuple(map(int, x.split(":"))) for x in removed.split(",") if x]
    return [any(s <= m.start() and m.end() <= e for s, e in spans) for m in P._TOKEN.finditer(text)]


def test_every_common_run_of_51_words_is_found(spark):
    """Against all pairs: passages beside shared sentences, at ends, in pieces, wrapped anew, and in texts without capitals, stops or spaces."""
    r = random.Random(11)
    plain = lambda k, n: re.sub("[.]", "", prose(k, n)).lower()
    han = lambda k, n: "".join(chr(0x4E00 + random.Random(1000 * k + i).randrange(3000)) for i in range(n))
    rows = [(i, prose(100 + i, r.randint(60, 200))) for i in range(40)]
    for k in range(12):
        passage, near, tail = plain(300 + k, r.randint(51, 60)), prose(400 + k, 30), plain(500 + k, 52)
        one, two, three = r.sample(range(40), 3)
        put = lambda i, t: rows.__setitem__(i, (i, f"{rows[i][1]} {t} {prose(600 + 40 * k + i, 12)}"))  # noqa: B023, E731
        put(one, f"{near} {passage} {tail}")
        put(two, f"{near} {passage} {prose(900 + k, 9)} {tail}")
        put(three, passage.replace(" ", "\n" if k % 2 else " \t"))
    rows += [(50 + i, han(i, 40) + han(99, 55) + han(i + 10, 40)) for i in range(2)] + [(60, plain(1, 51)), (61, "x " * 3 + plain(1, 51)), (62, "same word " * 300), (63, "same word " * 200)]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    words = {d: P.tokens(t) for d, t in rows}
    linked = set()
    for a in words:
        for b in words:
            if a < b and (runs := common_runs(words[a], words[b], 51)):
                linked |= {a, b}
                assert got[a].class_id == got[b].class_id and got[a].n_repeated and got[b].n_removed, (a, b)
                if b < 50:
                    gone = words_in(texts[b], got[b].removed)
                    assert all(all(gone[j + 18 : j + n - 18]) for _, j, n in runs)
    assert {60, 61, 62, 63, 50, 51} < linked and len(linked) > 25
    near = {(a, b) for a in words for b in words if a < b and common_runs(words[a], words[b], 25)}
    alone = set(words) - {x for p in near for x in p}
    assert len(alone) > 2 and all(got[d].class_id == d and got[d].n_repeated == 0 for d in alone)


def test_whole_passages_go(spark):
    passage = prose(77, 60)
    rows = [(i, f"{prose(700 + i, 80)} {passage} {prose(800 + i, 80)}") for i in range(5)]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, text in rows:
        spans = [tuple(map(int, x.split(":"))) for x in got[i].removed.split(",") if x]
        assert [text[s:e] for s, e in spans] == ([passage] if i else []) and got[i].n_repeated == 1


def test_near_copies_of_wrapped_paragraphs(spark):
    wrapped = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = []
    for k in range(10):
        base = prose(40 + k, 160)
        rows += [(2 * k, f"{prose(60 + k, 8)}\n\n{wrapped(base, 12)}\n\n{prose(80 + k, 9)}"), (2 * k + 1, f"{wrapped(edited(base, 3, k), 9)}\n\n{prose(90 + k, 9)}")]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[2 * k + 1].class_id == 2 * k and got[2 * k + 1].n_removed == 1 and got[2 * k].n_removed == 0 for k in range(10))


def test_paragraphs_of_lines():
    assert P.long_paragraphs([50, 3, 3, 0, 20, 20, 0, 39, 40, 12, 30]) == [(0, 50), (56, 96), (135, 175), (175, 217)]
    assert P.long_paragraphs([]) == [] and P.long_paragraphs([39]) == []
    assert P.tokens("Ab 日本語 c") == [b"ab", *(c.encode() for c in "日本語"), b"c"]
