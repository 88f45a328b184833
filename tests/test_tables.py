from scriptoria.operators import tables as T

ITEM = "pdf_id string, page int, seq int, str string, transform array<double>, width double, height double, fontName string"


def frames(spark, runs, page=1):
    """runs: (text, x, y, size, width)."""
    items = [("d", page, k, t, [s, 0.0, 0.0, s, float(x), float(y)], float(w), float(s), "f") for k, (t, x, y, s, w) in enumerate(runs)]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame([("d", page, 600.0, 800.0)], "pdf_id string, page int, page_width double, page_height double")


def cells(rows, top=650, size=7.0, columns=6, left=60):
    return [(f"{r}{c}", left + 60 * c, top - 12 * r, size, 20) for r in range(rows) for c in range(columns)]


def texts(spark, runs):
    items, pages = frames(spark, runs)
    got = T.table_texts(items, pages).join(items, ["pdf_id", "page", "seq"]).orderBy("seq").collect()
    return [(r.str, r.label) for r in got]


def test_small_tables(spark):
    label, head = ("Table 1. Nests", 58, 700, 10.0, 100), ("Reed bed", 60, 685, 7.0, 30)
    runs = [label, head, *cells(4), ("beside", 500, 640, 7.0, 30), ("below", 60, 500, 7.0, 30), ("prose of the article", 60, 640, 10.0, 100)]
    assert texts(spark, runs) == [(t, 0) for t in ["Table 1. Nests", "Reed bed", *(c[0] for c in cells(4))]]
    assert texts(spark, [label, *cells(3)]) == [] and texts(spark, [("Table of nests", 58, 700, 10.0, 100), *cells(4)]) == []
    assert texts(spark, [label, *[(t, x + 3 * k, y, s, w) for k, (t, x, y, s, w) in enumerate(cells(4))]]) == []
    assert texts(spark, [label, *cells(4, columns=4)]) == []
    words = [(t if c % 6 < 2 else "many", x, y, s, w) for c, (t, x, y, s, w) in enumerate(cells(4))]
    assert texts(spark, [label, *words]) == []


def test_two_labels(spark):
    runs = [("Table 1. A", 58, 700, 10.0, 100), *cells(4), ("Table 2: B", 58, 500, 10.0, 100), *cells(5, top=470)]
    got = texts(spark, runs)
    assert [t for t, k in got if k == 25] == ["Table 2: B", *(c[0] for c in cells(5))]
    assert len(got) == len(runs)


def wide(rows):
    return [x for r in range(rows) for x in ((f"Reed bed {r}", 60, 650 - 12 * r, 10.0, 50), (f"{r}.5", 200 + r % 2, 650 - 12 * r, 10.0, 20), (f"−{r}%", 260, 650 - 12 * r, 10.0, 20))]


def test_wide_tables(spark):
    label = ("Table 3. Nests of all the reed beds that were seen", 60, 700, 10.0, 300)
    items, pages = frames(spark, [label, *wide(4), ("as said (12, 13)", 60, 500, 10.0, 80)])
    got = T.table_lines(items, pages).orderBy("row").collect()
    assert [r.text for r in got] == [f"Reed bed {r} | {r}.5 | −{r}%" for r in range(4)]
    assert (got[0].x, got[0].width, got[0].seqs) == (60.0, 220.0, [1, 2, 3])
    assert T.table_lines(*frames(spark, [label, *wide(3)])).count() == 0
    assert T.table_lines(*frames(spark, [(*label[:4], 100), *wide(4)])).count() == 0
    assert T.table_lines(*frames(spark, wide(6))).count() == 0
    assert T.table_lines(*frames(spark, [label, *[x for x in wide(5) if not x[0].startswith("Reed")]])).count() == 0


def test_nothing(spark):
    items, pages = frames(spark, [("x", 1, 1, 1.0, 1)])
    assert T.table_texts(items.limit(0), pages).count() == 0 and T.table_lines(items.limit(0), pages.limit(0)).count() == 0


def test_rows_and_supports_share_one_shuffle(spark):
    from scriptoria.operators import layout

    df = spark.createDataFrame([("d", 1, r, 60.0 * c + r % 2, str(r)) for r in range(5) for c in range(6)], "pdf_id string, page int, row int, x double, text string")
    got = layout.table_support(df.repartition("pdf_id", "page"))
    plan = got._jdf.queryExecution().executedPlan().toString()  # as it is before it runs
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert [r.support for r in got.collect()] == [5] * 30


def test_texts_of_tables_share_one_shuffle_of_runs(spark):
    items, pages = frames(spark, [("Table 1. Nests", 58, 700, 10.0, 100), *cells(4)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = T.table_texts(items, pages)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("- Exchange hashpartitioning") == plan.count("ReusedExchange") == 1 and "Join" not in plan
    assert got.count() == 25


def test_pages_without_a_key_or_a_width_have_no_tables(spark):
    items, pages = frames(spark, [("Table 1. Nests", 58, 700, 10.0, 100), *cells(4)])
    unnamed = items.selectExpr("CAST(NULL AS STRING) AS pdf_id", *items.columns[1:])
    assert T.table_texts(items.union(unnamed), pages.union(pages.selectExpr("CAST(NULL AS STRING) AS pdf_id", *pages.columns[1:]))).count() == 25
    assert T.table_texts(items, pages.where("page = 2")).count() == 0
