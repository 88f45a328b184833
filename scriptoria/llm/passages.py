"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

Paragraphs are of three kinds. Words are as elsewhere, but each letter of a script without spaces is a word by itself.

* lines of at least MIN_WORDS words;
* blocks of shorter lines that follow each other without a blank or long one between, of at least MIN_WORDS words together;
* windows of WINDOW_WORDS words anywhere in a text, line breaks or not, for passages that repeat inside lines which differ. Their places follow from the content: of each REACH starts in
  a row the window with the smallest hash of its first shingle is taken. A passage of PASSAGE_WORDS words has REACH starts, so whatever stands
  around it, all documents that hold it take one window at least from within it.

Lines and blocks have BANDS bands of ROWS MinHash values (a pair of Jaccard similarity 0.8 collides with probability 0.9968), windows WINDOW_BANDS bands (0.76 for a pair at the threshold, 1 for equal
ones, and a passage has a window for every REACH / 2 words or so). Colliding paragraphs are joined, verified by the exact Jaccard similarity of their
five-word shingles, and clustered by connected components.

In each cluster the smallest document keeps its paragraph and the others lose theirs; a window grows first over the words at both its sides that the kept one has too (up to REACH, as far as
a passage can reach beyond its outermost windows). Documents that share clusters, directly or over others, are one class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import neardup as N
from .common import dropped, hot_join, kernel_starts, sliced, stored, table
from .line_dedup import NO_DOC, keyed

MIN_WORDS = 40
PASSAGE_WORDS = 51
WINDOW_WORDS = 30
WINDOW = WINDOW_WORDS - N.SHINGLE + 1
REACH = PASSAGE_WORDS - WINDOW_WORDS + 1
BANDS, ROWS = 8, 3
VALUES = BANDS * ROWS
WINDOW_BANDS = 2
#: Share of equal signature values below which a pair of lines or blocks is put aside: a pair at the threshold is with probability 1e-6. All pairs of windows are verified.
FLOOR = 0.375
#: Words that are taken together in one go of the window kernel.
GO_WORDS = 1 << 21

#: Letters of scripts that set no spaces between words: Thai, Lao, Burmese, Khmer, Kana, Han.
_DENSE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
_DENSE_ONE = re.compile(f"[{_DENSE}]")
_TOKEN = re.compile(rf"[{_DENSE}]|[^{_DENSE}\x20\x09-\x0D]+")


def tokens(text: str) -> list[bytes]:
    if _DENSE_ONE.search(text):
        text = _DENSE_ONE.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass").lower().split()


def long_paragraphs(counts: list[int]) -> list[tuple[int, int]]:
    """(first word, end) of the long lines, and of the blocks of short ones, of a text whose lines have that many words."""
    out: list[tuple[int, int]] = []
    at = begin = lines = 0
    for n in [*counts, 0]:
        if 0 < n < MIN_WORDS:
            lines += 1
        else:
            if lines > 1 and at - begin >= MIN_WORDS:
                out.append((begin, at))
            if n >= MIN_WORDS:
                out.append((at, at + n))
            begin, lines = at + n, 0
        at += n
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n values in a row."""
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


_BAND_KEYS = np.random.default_rng(5).integers(1, 1 << 63, WINDOW_BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WINDOW_BANDS 64-bit values of each window that begins at a place of shingles in order."""
    out = np.zeros((len(at), WINDOW_BANDS), np.uint64)
    for j, m in enumerate(_BAND_KEYS):
        out[:, j // ROWS] = N.mixed(out[:, j // ROWS] + _least(N.spread(flat, m), WINDOW)[at] + np.uint64(j))
    return out


def ids_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that know a window by its shingles."""
    sums = []
    for k in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(N.mixed(flat * np.uint64(2 * k + 1) + np.uint64(k)), dtype=np.uint64)])
        sums.append(total[at + WINDOW] - total[at])
    return np.stack(sums, 1)


def windows(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, first word, bands) of the windows of texts, given their shingles in order."""
    sizes = np.array([len(s) for s in shingles])
    which = np.flatnonzero(sizes >= WINDOW + REACH - 1)
    if not len(which):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, WINDOW_BANDS), np.uint64)
    flat = np.concatenate([shingles[k] for k in which])
    sizes = sizes[which]
    begins = np.cumsum(sizes) - sizes
    order = (N.spread(flat, np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(flat), dtype=np.uint64)
    best = (_least(order, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.zeros(len(flat) + 1, np.int32)  # rows of REACH starts, each with its whole window inside one text
    np.add.at(ends, begins, 1)
    np.add.at(ends, begins + sizes - (WINDOW + REACH - 2), -1)
    at = np.unique(best[np.cumsum(ends)[: len(best)] > 0])
    text = np.searchsorted(begins, at, "right") - 1
    return which[text], at - begins[text], bands_at(flat, at)


_UNITS = pa.schema([("line", pa.bool_()), ("doc", pa.int64()), ("fp", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("id", pa.binary()), ("b0", pa.int64()), ("b1", pa.int64()), ("sig", pa.binary()), ("size", pa.int64())])
UNITS = "line boolean, doc long, fp long, first int, last int, id binary, b0 long, b1 long, sig binary, size long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[int] = []
    fps: list[int] = []
    inside: list[np.ndarray] = []
    held = 0
    for b in batches:
        for i in range(0, b.num_rows, 500):
            some = b.slice(i, 500)
            sets: list[np.ndarray] = []
            places: list[tuple] = []
            for doc, fp, text in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                counts, words = [], []
                for line in text.split("\n"):
                    own = tokens(line)
                    counts.append(len(own))
                    words += own
                shingles = N.in_order(N.hashed(words))
                for first, last in long_paragraphs(counts):
                    sets.append(np.unique(shingles[first : last - N.SHINGLE + 1]))
                    places.append((True, doc, fp, first, last))
                if len(shingles) >= WINDOW + REACH - 1:
                    docs.append(doc)
                    fps.append(fp)
                    inside.append(shingles)
                    held += len(shingles)
                if held >= GO_WORDS:
                    yield _window_rows(docs, fps, inside)
                    docs, fps, inside, held = [], [], [], 0
            if sets:
                rows = [(*p, b"l" + xxhash.xxh3_128_digest(s.tobytes()), None, None, g.tobytes(), len(s)) for p, s, g in zip(places, sets, N.signatures(sets, VALUES), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _UNITS, strict=True)], schema=_UNITS)
    if docs:
        yield _window_rows(docs, fps, inside)
    N.forget()


def _window_rows(docs: list[int], fps: list[int], shingles: list[np.ndarray]) -> pa.RecordBatch:
    text, first, bands = windows(shingles)
    n = len(text)
    cols = [pa.array(np.zeros(n, bool)), pa.array(np.array(docs, np.int64)[text]), pa.array(np.array(fps, np.int64)[text]), pa.array(first.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    cols += [pa.array(np.ascontiguousarray(bands[:, k]).view(np.int64)) for k in range(WINDOW_BANDS)]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=_UNITS)


def _window_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows again, from their texts and first words: with their ids and, as sig, their bands."""
    kernel_starts("shingles")
    for b in sliced(batches, N.TEXTS):
        for doc, fp, text, firsts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = np.array(firsts)
            flat = N.in_order(N.hashed(tokens(text)))
            n = len(at)
            ids, sigs = (pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(f(flat, at)).tobytes())]) for f in (ids_at, bands_at))
            cols = [pa.array(np.zeros(n, bool)), pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, fp, np.int64)), pa.array(at.astype(np.int32)), pa.array((at + WINDOW_WORDS).astype(np.int32)), ids, sigs]
            yield pa.RecordBatch.from_arrays(cols, names=["line", *SPAN])
    N.forget()


def _unit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, N.TEXTS):
        for text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = tokens(text)
            texts = [b" ".join(words[x["first"] : x["last"]]).decode("utf-8", "surrogatepass") for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x in asked], pa.binary()), pa.array(texts, pa.string())], names=["id", "text"])


SPAN = ("doc", "fp", "first", "last", "id", "sig")


def repeated_windows(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Those windows that share a band with one of another document: line, and the columns of SPAN, with their bands as sig.

    Only bands and places of all windows are shuffled; the few that are left are made anew from their texts.
    """
    of = F.explode(F.array("b0", "b1")).alias("bucket")
    seen = units.select("doc", of).groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    seen = stored(seen.select("bucket"), "passage_bands")
    met = units.select("doc", "fp", "first", of).join(seen, "bucket", "left_semi").groupBy("doc", "fp").agg(F.collect_set("first").alias("firsts"))
    met = stored(met, "passage_met")
    made = texts.join(met, ["doc", "fp"]).select("doc", "fp", "text", "firsts").mapInArrow(_window_facts, "line boolean, doc long, fp long, first int, last int, id binary, sig binary")
    out = stored(made, "passage_windows")  # rows of equal doc_id and text come as often as they are there, which changes no place
    dropped(units.sparkSession, seen)
    dropped(units.sparkSession, met)
    return out


def window_bands(windows: DataFrame) -> DataFrame:
    """bucket, tree, id, size of the windows."""
    nodes = windows.select("id", "sig").dropDuplicates(["id"])
    trees = nodes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(WINDOW_BANDS - 1))).alias("tree"))
    return trees.select(F.xxhash64("tree", F.substring("sig", F.col("tree") * 8 + 1, F.lit(8))).alias("bucket"), "tree", "id", F.lit(WINDOW).cast("long").alias("size"))


def line_bands(units: DataFrame) -> DataFrame:
    """bucket, tree, id, size of the lines and blocks."""
    trees = units.select("id", "size", "sig").dropDuplicates(["id"]).select("id", "size", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("tree"))
    return trees.select(F.xxhash64("tree", F.substring("sig", F.col("tree") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"), "tree", "id", "size")


def clustered(texts: DataFrame) -> DataFrame:
    """line, doc, fp, first, last and root of the paragraphs of texts (doc, fp, text): root is that of the component of verified links that a paragraph is in, or its own id. Windows that share no band with another document's are left out."""
    spark = texts.sparkSession
    units = stored(texts.mapInArrow(_units, UNITS), "passage_units")
    windows = repeated_windows(units.where("not line"), texts)
    lines = stored(units.where("line").select("line", *SPAN, "size"), "passage_lines")
    dropped(spark, units)
    spans = lines.drop("size").unionByName(windows)
    nodes = stored(spans.groupBy("id").agg(F.min("sig").alias("sig"), F.min(F.struct("doc", "fp", "first", "last")).alias("at"), F.count("*").alias("n")), "passage_nodes")
    both = [N.candidates(line_bands(lines), nodes, FLOOR, (BANDS, ROWS, ROWS)), N.candidates(window_bands(windows), nodes, 0.0, (WINDOW_BANDS, 4, 4))]
    needed = both[0].ids().union(both[1].ids()).join(nodes, "id").select("id", "at.*")
    per = stored(needed.groupBy("doc", "fp").agg(F.collect_list(F.struct("id", "first", "last")).alias("asked")), "passage_needed")
    own = stored(texts.join(per, ["doc", "fp"]).select("text", "asked").mapInArrow(_unit_texts, "id binary, text string").dropDuplicates(["id"]), "passage_texts")
    one, two = (N.verified_links(c, own)[0] for c in both)
    roots = stored(nodes.select("id", "n").join(N.components(one.union(two)), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "n"), "passage_roots")
    out = stored(hot_join(spans.drop("sig"), roots, "id").select("line", "doc", "fp", "first", "last", "root"), "passage_spans")
    for df in (lines, windows, nodes, per, own, roots):
        dropped(spark, df)
    return out


def found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, repeats, pairs): the rows of docs under their keys; doc, fp, start, end (code points) and goes of repeated places, where goes says that a smaller document keeps them; and doc, keep of documents that share clusters.

    Null and empty texts have no paragraphs. Rows of one doc_id are one document; a null doc_id is one of its own, smaller than all others. An empty table gives empty results.
    """
    rows = keyed(docs)
    texts = rows.select("doc", "fp", "text")
    spans = clustered(texts)
    held = stored(spans.groupBy("root").agg(F.min(F.struct("doc", "fp", "first")).alias("kept"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("kept.doc < hi").drop("hi"), "passage_held")
    spans = stored(hot_join(spans, held, "root").withColumn("goes", F.col("kept.doc") < F.col("doc")), "passage_repeated")
    pairs = stored(spans.where("goes").select("doc", F.col("kept.doc").alias("keep")).distinct(), "passage_pairs")
    # runs of paragraphs that overlap, and the windows at their ends, which grow
    order = Window.partitionBy("doc", "fp", "goes").orderBy("first", "last")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = spans.repartition("doc", "fp").withColumn("reach", F.max("last").over(upto)).withColumn("before", F.lag("reach").over(order)).withColumn("next", F.lead("first").over(order))
    ends = ends.withColumn("starts", F.coalesce(F.col("first") > F.col("before"), F.lit(True))).withColumn("ends", F.coalesce(F.col("next") > F.col("reach"), F.lit(True)) & (F.col("last") == F.col("reach")))
    ends = stored(ends.withColumn("run", F.sum(F.col("starts").cast("int")).over(upto)).select("doc", "fp", "goes", "first", "last", "run", "starts", "ends", "line", "root"), "passage_ends")
    runs = ends.groupBy("doc", "fp", "goes", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    grow = ends.where("goes and not line and (starts or ends)")
    kept = grow.groupBy("root").agg(F.count("*").alias("n")).join(held.select("root", "kept.*"), "root")
    none = F.lit(None)
    asked = runs.select("doc", "fp", none.cast("binary").alias("root"), "goes", "first", "last", F.lit(False).alias("starts"), F.lit(False).alias("ends"), none.cast("long").alias("n"))
    asked = asked.unionByName(grow.select("doc", "fp", "root", F.lit(True).alias("goes"), "first", "last", "starts", "ends", none.cast("long").alias("n")))
    asked = asked.unionByName(kept.select("doc", "fp", "root", F.lit(False).alias("goes"), "first", (F.col("first") + WINDOW_WORDS).alias("last"), F.lit(True).alias("starts"), F.lit(True).alias("ends"), "n"))
    per = stored(asked.groupBy("doc", "fp").agg(F.collect_list(F.struct("root", "goes", "first", "last", "starts", "ends", "n")).alias("asked")), "passage_asked")
    placed = stored(texts.join(per, ["doc", "fp"]).select("doc", "fp", "text", "asked").mapInArrow(_placed, PLACED), "passage_placed")
    kept = stored(placed.where("n is not null").groupBy("root").agg(F.min("before").alias("kept_before"), F.min("after").alias("kept_after"), F.max("n").alias("n")), "passage_contexts")
    grown = hot_join(placed.where("root is not null and n is null").drop("n"), kept, "root").select("doc", "fp", "start", "end", "before", "after", "kept_before", "kept_after").mapInArrow(_grown, "doc long, fp long, start int, `end` int")
    repeats = stored(placed.where("root is null").select("doc", "fp", "start", "end", "goes").unionByName(grown.withColumn("goes", F.lit(True))), "passage_repeats")
    for df in (spans, held, ends, per, placed, kept):
        dropped(docs.sparkSession, df)
    return rows, repeats, pairs


_PLACED = pa.schema([("root", pa.binary()), ("goes", pa.bool_()), ("n", pa.int64()), ("doc", pa.int64()), ("fp", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("after", pa.string())])
PLACED = "root binary, goes boolean, n long, doc long, fp long, start int, `end` int, before string, after string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is asked of a text, with its places in code points and, where it starts or ends a run, the REACH words there."""
    for b in batches:
        for doc, fp, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = [m.span() for m in _TOKEN.finditer(text)]
            rows = []
            for x in asked:
                first, last = x["first"], x["last"]
                start, end = at[first][0], at[last - 1][1]
                before = text[at[max(0, first - REACH)][0] : start] if x["starts"] else None
                after = text[end : at[min(len(at), last + REACH) - 1][1]] if x["ends"] else None
                rows.append((x["root"], x["goes"], x["n"], doc, fp, start, end, before, after))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACED, strict=True)], schema=_PLACED)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with the words at their sides that the kept window has there too; a side without words asked for stays."""
    low = lambda m: m[0].encode("utf-8", "surrogatepass").lower()

    def alike(own: list, other: list) -> int:
        k = 0
        while k < min(len(own), len(other)) and low(own[k]) == low(other[k]):
            k += 1
        return k

    for b in batches:
        rows = []
        for doc, fp, start, end, before, after, kept_before, kept_after in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = list(_TOKEN.finditer(before or ""))[::-1]
            if k := alike(own, list(_TOKEN.finditer(kept_before))[::-1]):
                start -= len(before) - own[k - 1].start()
            own = list(_TOKEN.finditer(after or ""))
            if k := alike(own, list(_TOKEN.finditer(kept_after))):
                end += own[k - 1].end()
            rows.append((doc, fp, start, end))
        cols = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 2, strict=True)], names=["doc", "fp", "start", "end"])


def places(repeats: DataFrame) -> DataFrame:
    """doc, fp, repeated and gone: the places of repeated paragraphs of each text, and of those that a smaller document keeps, overlapping ones as one."""
    both = repeats.select("doc", "fp", "start", "end", F.explode(F.when(F.col("goes"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("goes"))
    order = Window.partitionBy("doc", "fp", "goes").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    both = both.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = both.groupBy("doc", "fp", "goes", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at = lambda goes: F.sort_array(F.collect_list(F.when(F.col("goes") == goes, F.struct("start", "end"))))
    return parts.groupBy("doc", "fp").agg(at(False).alias("repeated"), at(True).alias("gone"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text without the repeated paragraphs that a smaller document keeps. Nulls and empty texts stay as they are."""
    rows, repeats, _ = found(docs)
    gone = stored(places(repeats).where("size(gone) > 0").select("doc", "fp", "gone"), "passage_gone")
    from_ = lambda k: F.when(k == 0, 1).otherwise(F.get("gone", k - 1)["end"] + 1)
    pieces = F.transform("gone", lambda x, k: F.substring("text", from_(k), x["start"] + 1 - from_(k)))
    left = F.concat(F.array_join(pieces, ""), F.substring("text", F.element_at("gone", -1)["end"] + 1, F.length("text")))
    return rows.join(gone, ["doc", "fp"], "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of its class), n_repeated (its places that other documents hold, overlapping ones as one), n_removed (those that a smaller document keeps) and removed (the latter, start:end in code points)."""
    rows, repeats, pairs = found(docs)
    # an order-keeping binary form of a document's number
    node = lambda c: F.unhex(F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(NO_DOC))), 16, "0"))
    edges = pairs.select(node("doc").alias("a"), node("keep").alias("b"))
    number = lambda c: F.conv(F.hex(c), 16, -10).cast("long").bitwiseXOR(F.lit(NO_DOC))
    of = N.components(edges).select(number("id").alias("doc"), number("root").alias("root"))
    rows = rows.select("doc_id", "doc", "fp").join(places(repeats), ["doc", "fp"], "left").join(of, "doc", "left")
    root = F.coalesce("root", "doc")
    return rows.select(
        "doc_id",
        F.when(root != NO_DOC, root).alias("class_id"),
        F.coalesce(F.size("repeated"), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("gone", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit("")).alias("removed"),
    )


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
