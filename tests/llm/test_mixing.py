import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptoria.llm import mixing as M

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes, weights=M.WEIGHTS, most=M.MAX_REPEATS):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > most * sizes[s]]
        if not full:
            return out | share
        out |= {s: float(most * sizes[s]) for s in full}
        free = [s for s in free if s not in out]
    return out


def check(df, rows):
    got = M.mix_report(df).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((d, size(t), s) for d, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * M.BLOCK_WORDS + 0.01 * want[s], s
    assert Counter(map(tuple, got)) == Counter(map(tuple, M.mix_report(df).collect()))
    return got


def test_data(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df, [(r.doc_id, r.text, r.source) for r in df.collect()])


def test_odd_rows(odd_docs, odd_texts, no_docs):
    check(odd_docs, odd_texts)
    assert M.mix_report(no_docs).count() == 0


def test_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken, r.target) for r in M.mix_report(df).collect()] == [(0, 0, 0.0)] * 2


def test_targets(spark):
    r = random.Random(3)
    cases = [{"a": 100, "b": 100, "c": 100, None: 100}, {"a": 10, "b": 1000, "c": 1000}, {"é": 1, "z": 1, None: 1, "": 0}, {}, {"a": 0, "b": 0}]
    cases += [{("s%03d" % r.randrange(1000) if r.random() < 0.9 else None): int(10 ** r.uniform(0, 5)) for _ in range(r.randint(2, 60))}]
    for sizes in cases:
        rows = spark.createDataFrame([("n" if s is None else "s" + s, s, n) for s, n in sizes.items()], "src string, source string, n long").repartition(3)
        assert {x.source: x.target for x in M.targeted(rows).collect()} == pytest.approx(targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_permutation(n):
    assert sorted(M.permuted(np.arange(n), n, 5)) == list(range(n))


@pytest.mark.parametrize("total", [0, 1, 37, 5000])
def test_shards_of_ranges_agree(total):
    whole = M.shards_of(0, total, total, 7, 1)
    assert (np.diff(whole) >= 0).all() and set(whole) <= set(range(7))
    cuts = sorted({0, total, *np.random.default_rng(2).integers(0, total + 1, 5).tolist()})
    assert np.concatenate([M.shards_of(a, b, total, 7, 1) for a, b in zip(cuts, cuts[1:])] or [whole]).tolist() == whole.tolist()


def test_counts_are_multinomial():
    n, shards = 6000, 6
    counts = np.array([np.bincount(M.shards_of(0, n, n, shards, k), minlength=shards) for k in range(400)])
    assert (counts.sum(1) == n).all() and np.abs(counts.mean(0) - n / shards).max() < 8
    assert np.abs(counts.var(0) / (n / shards * (1 - 1 / shards)) - 1).max() < 0.4
    assert (M.shards_of(0, 10**6, 5 * 10**12, 10**9, 3) < 1000).all()  # far beyond what one array could hold


def test_no_block_more_than_three_times(spark):
    sources = spark.createDataFrame([("sa", 640, 1920.0), ("sb", 64_000, 62_720.0), ("sc", 0, 0.0)], "src string, n long, target double")
    drawn = M.drawn_slots(sources).collect()
    rows = Counter((r.src, r.idx) for r in drawn)
    assert max(rows.values()) <= 3 and all(rows["sa", i] == 3 for i in range(10)) and sum(v for (s, _), v in rows.items() if s == "sb") == 980
    assert len({r.place for r in drawn}) == len(drawn)


def test_places_in_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DOCS", 3)
    df = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2] if i % 7 else None) for i in range(200)], "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in M.laid_out(M.stored(M.sized(df), "t")).collect():
        by[r.source].append((r.off, r["size"]))
    for rows in by.values():
        at = 0
        for off, n in sorted(rows):
            assert off == at
            at += n
