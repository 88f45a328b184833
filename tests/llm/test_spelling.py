import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from scriptoria.llm import spelling as S


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_words(rows) -> dict:
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute(rows) -> set:
    words = brute_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def typo_texts(seed: int, n: int) -> list:
    r = random.Random(seed)
    base = ["".join(r.choice("abcéø") for _ in range(r.randint(6, 10))) for _ in range(12)]
    out = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.5)), 11)]
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abc") + w[k:], w[:k] + r.choice("abc") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.2 else w)
        out.append((i, " 1,".join(words)))
    return out


@pytest.mark.parametrize("crowd", [100, 3])
def test_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rows = typo_texts(4, 60)
    got = rows_of(S.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert sum(x[1] is not None for x in got) > 20


def test_crowds_of_one_segment(spark, monkeypatch):
    """Hundreds of words behind one prefix, and before one suffix: cut again and again, every near pair is found once."""
    monkeypatch.setattr(S, "CROWD", 8)
    r = random.Random(1)
    words = sorted({"prefix" + "".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(150)} | {"".join(r.choice("ab") for _ in range(r.randint(2, 7))) + "suffix" for _ in range(150)} | {"aaaaaaa" + "a" * k for k in range(30)})
    pairs = S.near_pairs(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")).collect()
    got = [tuple(sorted((p.a, p.b))) for p in pairs]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    assert all(p.a_n == len(p.a) and p.b_n == len(p.b) for p in pairs)


def test_chain_of_forms(spark):
    words = {"abcdefgh": 100_000, "abcdefgx": 5000, "abcdefyx": 400, "abcdezyx": 30, "abcdwzyx": 2, "abcdefgi": 100_000, "abcdefg": 9999}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root) for r in S.with_roots(S.forms(rows)).collect()}
    assert got == {
        "abcdefgh": (None, "abcdefgh"), "abcdefgi": (None, "abcdefgi"), "abcdefgx": ("abcdefgh", "abcdefgh"), "abcdefyx": ("abcdefgx", "abcdefgh"), "abcdezyx": ("abcdefyx", "abcdefgh"), "abcdwzyx": ("abcdezyx", "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"),
    }


def test_odd_rows(odd_docs, odd_texts, no_docs):
    rows = [(d, t) for d, t, _ in odd_texts]
    assert set(rows_of(S.variants(odd_docs))) == brute(rows)
    assert S.variants(no_docs).count() == 0


def test_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 5)
    rows = typo_texts(9, 20) + [(100, "x" * 100_000 + " " + "Straße" * 3), (101, "Straße" * 3 + "Ā" + "straßestraßestraße × " + "×" * 8), (102, None)]
    got = {r.word: r.n for r in S.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_words(rows)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(S.OP11_SQL).fetchall()
    assert [c[0] for c in con.description] == S.op11_spelling_variants(spark, sf_dir).columns
    assert set(rows_of(S.op11_spelling_variants(spark, sf_dir))) == set(want)
