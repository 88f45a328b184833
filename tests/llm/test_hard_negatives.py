import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, VEC_ID string, score int"


def brute(rows, positives=5, negatives=3) -> list:
    known = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in known:
        if a[0] % 50:
            continue
        scored = sorted(((dot(a[2], b[2]), b) for b in known if b != a), key=lambda x: (-x[0], x[1][0]))
        for ps, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            fit = [x for x in scored if x[1][1] != a[1] and 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(a[0], p[0], k, n[0], ps, ns) for k, (ns, n) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, **more).collect()))


def vectors(seed: int, n: int, dim: int = 6, step: float = 1 / 256, ids=None) -> list:
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        v = [round((x + r.gauss(0, 0.7)) / step) * step for x in c]
        out.append((ids(i) if ids else i, v, r.randrange(3)))
    return out


@pytest.mark.parametrize(("block", "digit", "slack"), [(4096, 12, 32), (37, 3, 0)])
def test_against_all_scores(spark, monkeypatch, block, digit, slack):
    for name, x in (("BLOCK", block), ("DIGIT", digit), ("SLACK", slack), ("SLICE", 5)):
        monkeypatch.setattr(H, name, x)
    rows = vectors(1, 260)
    want = brute(rows)
    assert found(spark, rows) == want and len(want) > 30


def test_ties_are_cut_by_id(spark, monkeypatch):
    """Hundreds of equal vectors on both sides, with ids far apart and below zero: the bucket of one score is refined by the digits of ids."""
    for name, x in (("BLOCK", 64), ("DIGIT", 4), ("SLACK", 2)):
        monkeypatch.setattr(H, name, x)
    ids = [(-1) ** i * (i * i * 977 % 4001) * 10**13 - i for i in range(120)]
    rows = [(50 * k, [1.0, 0.5], 1) for k in (-3, 0, 9)] + [(i, [1.0, 0.5], 1) for i in ids] + [(i + 10**16, [0.8, 0.4], 2 + i % 2) for i in ids]
    rows += [(2**63 - 8, [0.8, 0.4], 5), (-(2**63) + 1, [0.8, 0.4], 5), (-(2**63) + 2, [1.0, 0.5], 1)]
    want = brute(rows)
    assert found(spark, rows) == want and want


def test_odd_rows(spark):
    rows = vectors(3, 60) + [(None, [1.0] * 6, 1), (50, None, 1), (51, [1.0] * 6, None), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (53, [float("nan")] * 6, 0), (54, [float("inf")] * 6, 0), (55, [], 1), (56, [3.0], 2), (100, [2.0] * 9, 2)]
    rows += rows[:20]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1)]) == [] and found(spark, [(50, [1.0], 1)]) == []


def test_fewer_than_asked(spark):
    rows = [(0, [1.0], 0), (1, [2.0], 1), (2, [1.5], 3), (50, [-1.0], 4), (51, [0.0], 4), (53, [0.0], 5)]
    want = brute(rows)
    assert found(spark, rows) == want and {x[:2] for x in want} == {(0, 1), (50, 51)}


def test_other_numbers_and_anchors(spark):
    rows = vectors(8, 120)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = H.hard_negatives(df, positives=1, negatives=1, anchor=F.col("vec_id") == 50).collect()
    assert [tuple(r) for r in got] == [x for x in brute(rows, 1, 1) if x[0] == 50] and len(got) == 1


def test_too_large(spark):
    with pytest.raises(Exception, match="exact"):
        found(spark, [(0, [1e30], 1), (1, [1.0], 1)])
    with pytest.raises(ValueError, match="exact"):
        found(spark, [(0, [4e6] * 30, 1), (1, [1.0], 1)])


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = H.op12_hard_negatives(spark, sf_dir)
    want = con.execute(H.OP12_SQL)
    assert [c[0] for c in want.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_tiles_shuffle_no_rows(spark):
    rows = spark.range(200).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding", "cast(id % 10 as int) as label")
    known = H.stored(H.taking_part(rows), "negatives_rows")
    chosen = H.Selection(known)
    windows = known.where("vec_id % 50 = 0").selectExpr("vec_id as a_id", "uid as a_uid", "0L as p_id", "0L as p_uid", "-9L as top", "-9L as lo", "9L as hi", "0L as u_lo", "0L as u_hi", "3L as need")
    tiles = list(chosen._tiles(windows, True, False))
    assert len(tiles) == 1
    plan = tiles[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastNestedLoopJoin" in plan
