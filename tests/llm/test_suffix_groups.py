import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import suffix_groups as S

from .conftest import prose


def brute(rows, length=400) -> Counter:
    datas = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in datas for i in range(len(b) - length + 1))
    out = Counter()
    for d, b in datas:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def found(df) -> Counter:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return Counter(tuple(r) for r in S.without_repeats(df).select("doc_id", "n_bytes", size, F.size("removed"), F.sha2("kept", 256)).collect())


def test_suffix_order():
    r = random.Random(1)
    for _ in range(4000):
        k = r.randint(1, 4)
        s = [r.randint(1, k) for _ in range(r.randint(0, 16))] + [0]
        assert S.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:]), s
    for s in ([1] * 500, [2, 1] * 300, [1, 2] * 300, list(range(1, 400)), list(range(400, 0, -1)), [1, 1, 2] * 100 + [1, 2] * 100):
        s = [*s, 0]
        assert S.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_windows_of_strings():
    r = random.Random(2)
    for width in (1, 2, 5, 8):
        strings = []
        for core in range(12):
            for _ in range(r.randint(1, 6)):
                left = bytes(r.randrange(2) for _ in range(r.randrange(width)))
                right = bytes(r.randrange(2) for _ in range(r.randint(width - 1 - len(left), width - 1)))
                strings.append((core, left, right, 1 + (r.random() < 0.1)))
        flat = [[*left, 300 + core, *right] for core, left, right, _ in strings]
        seen = Counter()
        for s, x in zip(flat, strings):
            for i in range(len(s) - width + 1):
                seen[tuple(s[i : i + width])] += x[3]
        want = [sum((seen[tuple(s[i : i + width])] > 1) << i for i in range(len(s) - width + 1)) for s in flat]
        assert S.repeated_windows(strings, width) == want


def passages(seed: int) -> list:
    """Passages of about LENGTH bytes and more among other words, cut and joined at any byte; copies with edits; a text that repeats itself; runs of one letter; other scripts."""
    r = random.Random(seed)
    shared = [prose(100 + k, 90) for k in range(6)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(shared)
            a = r.randint(0, 60)
            parts += [prose(1000 * seed + 10 * i + len(parts), r.randint(1, 30)), p[a : a + r.choice([398, 399, 400, 401, 402, 430, 10_000])]]
        out.append((i, "".join(parts)))
    base = prose(7, 900)
    out += [(100, base), (101, base[:1500] + "#" + base[1501:]), (102, base[3:]), (103, base + base[:700]), (104, "a" * 1500), (105, "a" * 399 + "b"), (106, "ab" * 300), (107, "日本語éß🙂" * 70), (108, "x日本語éß🙂" * 70)]
    return out


@pytest.mark.parametrize(("widths", "crowd", "piece"), [((32, 8, 1), 500, 1 << 18), ((32, 8, 1), 2, 1500), ((4, 1), 1, 700), ((1,), 1, 5000)])
def test_against_all_windows(spark, monkeypatch, widths, crowd, piece):
    for name, x in (("WIDTHS", widths), ("CROWD", crowd), ("PIECE", piece), ("SYMBOLS", 300)):
        monkeypatch.setattr(S, name, x)
    rows = passages(3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_crowd_of_near_copies(spark, monkeypatch):
    """One passage of 398 bytes in hundreds of texts: no window is equal but where the bytes beside it are."""
    monkeypatch.setattr(S, "CROWD", 20)
    p = prose(5, 200)[:398]
    rows = [(i, f"{i * 7919 % 1000:03d}" * 3 + p + f"{i * 104729 % 1000:03d}" * 40) for i in range(300)]
    got, want = found(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows)
    assert got == want and sum(x[2] > 0 for x in want) > 50


def test_odd_rows(odd_docs, odd_texts, no_docs):
    rows = [(d, t) for d, t, _ in odd_texts]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == Counter()


def test_repeated_rows(spark):
    text = prose(1, 300)
    rows = [(1, text), (1, text), (None, prose(2, 300)), (None, prose(3, 300)), (2, prose(4, 300)), (None, None)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and sum(n for x, n in got.items() if x[2] == x[1] > 0) == 2


def test_places(spark):
    a, b, c = prose(1, 40), prose(2, 120), prose(3, 50)
    df = spark.createDataFrame([(1, a + b + c), (2, b)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept).decode()) for r in S.without_repeats(df).collect()}
    assert got == {1: ([(len(a), len(a + b))], a + c), 2: ([(0, len(b))], "")}


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = S.op13_suffix_dedup(spark, sf_dir)
    want = con.execute(S.OP13_SQL)
    assert [c[0] for c in want.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
