import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from scriptoria.llm import line_dedup as L

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(STRIP).translate(LOWER)
    rank = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or rank(doc) == max(map(rank, held[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def got(docs):
    rows = L.deduplicated(docs, L.build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    return Counter(map(tuple, rows))


def test_against_brute_force(odd_docs, odd_texts):
    assert got(odd_docs) == brute([(d, t) for d, t, _ in odd_texts])


def test_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(no_docs):
    assert L.deduplicated(no_docs, L.build(no_docs)).count() == 0


def test_salted_shards(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_ROWS", 8)
    docs = spark.createDataFrame([(i, f"the very same line everywhere\nown line of number {i % 40:05d} here") for i in range(200)], "doc_id long, text string")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def state_of(s):
    refs = {(bytes(r.key), r.n_docs, r.max_doc) for r in s.refs.collect()}
    shards = {r.shard: (bytes(r["keys"]), bytes(r.max_docs)) for r in s.shards.collect() if r["keys"]}
    return refs, shards


def test_reversible(spark):
    one = spark.createDataFrame([(i, f"line that three documents share\nanother shared line number {i % 3:03d}") for i in range(9)], "doc_id long, text string")
    two = spark.createDataFrame([(i, f"line that three documents share\nanother shared line number {i % 5:03d}") for i in range(20, 30)], "doc_id long, text string")
    first = L.build(one)
    both = L.updated(first, inserted=two)
    whole = L.State(*[getattr(L.build(one.union(two)), k) for k in ("ledger", "refs", "shards", "n_shards")])
    assert state_of(both) == state_of(whole)
    back = L.updated(both, deleted=two.select("doc_id"))
    assert state_of(back) == state_of(first)
    for r in back.shards.collect():
        keys = bytes(r["keys"])
        if keys:
            assert L.Cuckoo.from_bytes(bytes(r["filter"])).holds(L._hash([keys[i : i + 16] for i in range(0, len(keys), 16)])).all()
    assert Counter(map(tuple, L.deduplicated(one, back).collect())) == Counter(map(tuple, L.deduplicated(one, first).collect()))


def test_cuckoo():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = L.Cuckoo.of(keys)
    assert f.holds(keys).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert f.holds(others).mean() < 0.001
    assert all(f.remove(int(k)) for k in keys)
    assert not f.table.any()
