"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else, found with suffix arrays built by linear grouping.

Equal strings have to meet, and no text as a whole has to move. Each window of LENGTH bytes has an anchor, its ``GRAM`` bytes of the smallest hash, so equal windows have equal anchors at equal offsets. A run is all windows in
a row that have one anchor, about 170 of them. Equal runs are counted first: whatever has copies is settled here, however many they are. Runs whose anchor other runs have too may still share windows. They are cut by the
anchor's offset into parts of ``WIDTHS[0]`` windows, which all contain one core of LENGTH + 1 - width bytes. Only parts of equal core can share windows, and they can differ only in the few bytes at its
two sides, so each part is a short string: the bytes to its left, one symbol for the core, the bytes to its right. A window of LENGTH bytes is a substring of width symbols of it.

The strings of equal cores are laid end to end, their suffix array is built (``suffix_order``), and neighbours in it that agree in width symbols are repeated windows. Parts of a core with more than ``CROWD`` different strings
are cut again at the next width; at width 1 the window is its core. So no task sorts more than CROWD strings together, and nothing is capped or left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_set, dropped, has_bit, hot_join, kernel_starts, release_memory, sliced, stored, table
from .line_dedup import keyed
from .neardup import mixed

LENGTH = 400
GRAM = 64
#: Windows of a part; the next width is for cores with more than CROWD different strings.
WIDTHS = (32, 8, 1)
CROWD = 500
#: Bytes that are hashed together; a longer text is taken in pieces.
PIECE = 1 << 18
TEXTS = 64
#: Symbols that one suffix array is built of, but for a core with more.
SYMBOLS = 1 << 15
#: Bits for each document that is to be read, and the most that there are of them (8 MB), in the set that keeps other texts out of the shuffle.
DOC_BITS, MAX_BITS = 16, 26


def suffix_order(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in their order, in time linear in its length. text ends with a symbol smaller than all others.

    Suffixes are grouped by their first symbol, and groups are taken from the largest on. What is taken leaves the chain of suffixes that are not yet done, so the left neighbour of a suffix in the
    chain is its previous smaller one; there its own Lyndon prefix is appended to that one's. Hence the previous smaller suffixes of a group, those that are it of more members last, become groups of their own, right behind the
    groups that they leave. When all are done, groups hold the suffixes of equal Lyndon prefixes. Then, from the smallest suffix on, whatever has a Lyndon prefix that ends where a suffix starts is the next of its group.
    """
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable")
    ranked = np.asarray(text)[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    start_of = np.repeat(begins, np.diff(np.concatenate([begins, [n]])))
    group_at = np.empty(n, np.int64)
    group_at[order] = start_of
    place_at = np.empty(n, np.int64)
    place_at[order] = np.arange(n)
    group, place, rows = group_at.tolist(), place_at.tolist(), order.tolist()
    size = [0] * (n + 1)
    for b, k in zip(begins.tolist(), np.diff(np.concatenate([begins, [n]])).tolist(), strict=True):
        size[b] = k
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # the chain; before is the previous smaller suffix at last
    end = n - 1
    while end >= 0:
        g = group[rows[end]]
        if g == end:
            i = rows[end]
            p, q = before[i], after[i]
            if q < n:
                before[q] = p
            if p >= 0:
                after[p] = q
                own = group[p]
                last = own + size[own] - 1
                if last > own:  # else it is alone in its group already
                    size[own] -= 1
                    other = rows[last]
                    rows[place[p]], place[other] = other, place[p]
                    rows[last], place[p], group[p], size[last] = p, last, last, 1
        else:
            members = rows[g : end + 1]
            for i in members:
                p, q = before[i], after[i]
                if p >= 0:
                    after[p] = q
                if q < n:
                    before[q] = p
            times: dict[int, int] = {}
            for i in reversed(members):
                p = before[i]
                if p >= 0:
                    if group[p] == g:  # left the chain after i did
                        before[i] = p = before[p]
                    if p >= 0:
                        times[p] = times.get(p, 0) + 1
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                left: dict[int, int] = {}
                for p in by_times[k]:
                    own = group[p]
                    size[own] -= 1
                    last = own + size[own]
                    other = rows[last]
                    rows[place[p]], place[other] = other, place[p]
                    rows[last], place[p] = p, last
                    left[own] = last
                for p in by_times[k]:
                    group[p] = left[group[p]]
                for own, new in left.items():
                    if new != own:
                        size[new] = 0
                for p in by_times[k]:
                    size[group[p]] += 1
        end = g - 1
    head, done, out = list(range(n)), [False] * (n + 1), [n - 1] * n
    done[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            k = head[g]
            out[k], head[g], done[j] = j, k + 1, True
            j = before[j]
    return out


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    odd = 0x9E3779B97F4A7C15
    out = []
    for x in (odd, pow(odd, -1, 2**64)):
        factors = np.full(n, x, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


_BYTES = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, its hash) of each window of data: the place of the gram with the smallest hash, the first one of several. data: bytes, LENGTH at least."""
    power, inverse = _powers(1 << max(PIECE + LENGTH, len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    n = len(data) - GRAM + 1
    hashes = mixed((sums[GRAM:] - sums[:n]) * inverse[:n])
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    grams, k = LENGTH - GRAM + 1, 1
    while 2 * k <= grams:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if grams > k:
        low = np.minimum(low[: len(low) - (grams - k)], low[grams - k :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, hashes


_RUNS = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("m", pa.int64()), ("f", pa.binary())])
RUNS = "doc long, fp long, start long, n int, off int, m long, f binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc, fp, first byte, bytes) of texts; two pieces of a long text have LENGTH - 1 bytes in common, so each window is in one."""
    for some in sliced(batches, TEXTS):
        for doc, fp, text in zip(*(c.to_pylist() for c in some.columns[:3]), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                yield doc, fp, at, data[at : at + PIECE + LENGTH - 1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        flat = b"".join(x[3] for x in held)
        at, hashes = anchors(np.frombuffer(flat, np.uint8))
        sizes = np.array([len(x[3]) for x in held])
        ends = np.cumsum(sizes)
        first = np.zeros(len(at), bool)
        first[0] = True
        first[1:] = at[1:] != at[:-1]
        first[(ends - sizes)[1:]] = True
        cuts = ends[:-1] - LENGTH + 1  # windows from here on reach into the next text
        first[cuts] = True
        begin = np.flatnonzero(first)
        n = np.diff(np.append(begin, len(at)))
        which = np.searchsorted(ends, begin, "right")
        good = begin + LENGTH <= ends[which]
        begin, n, which = begin[good], n[good], which[good]
        found = at[begin]
        f = [xxhash.xxh3_128_digest(flat[b : b + k + LENGTH - 1]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
        doc, fp, base = (np.array([x[c] for x in held], np.int64) for c in range(3))
        cols = [doc[which], fp[which], base[which] + begin - (ends - sizes)[which], n.astype(np.int32), (found - begin).astype(np.int32), hashes[found].view(np.int64)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(f, pa.binary())], schema=_RUNS)

    kernel_starts("suffixes")
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for x in _pieces(batches):
        if len(x[3]) < LENGTH:
            continue
        held.append(x)
        size += len(x[3])
        if size >= PIECE:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


_PARTS = pa.schema([("s", pa.binary()), ("key", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("times", pa.int64()), ("m", pa.int64()), ("doc", pa.int64()), ("fp", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32())])
PARTS = "s binary, key binary, left binary, right binary, times long, m long, doc long, fp long, start long, n int, off int"


def _parts(width: int):
    """The parts of the asked windows of texts: start, n and off (the anchor's offset in the first window) are a part's own, s knows its string with its core, key the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_starts("suffixes")
        for some in sliced(batches, TEXTS):
            rows = []
            for doc, fp, text, asked in zip(*(c.to_pylist() for c in some.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in asked:
                    m, times = x["m"], x["times"]
                    anchor, last = x["start"] + x["off"], x["off"] - x["n"] + 1
                    high = x["off"]
                    while high >= last:
                        least = high // width * width
                        low = max(least, last)
                        core = anchor - least
                        end = core + LENGTH + 1 - width
                        left, right = data[core - (high - least) : core], data[end : end + least + width - 1 - low]
                        key = xxhash.xxh3_128_digest(struct.pack("<qi", m, least) + data[core:end])
                        s = xxhash.xxh3_128_digest(key + struct.pack("<i", len(left)) + left + right)
                        rows.append((s, key, left, right, times, m, doc, fp, anchor - high, high - low + 1, high))
                        high = low - 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)

    return run


def repeated_windows(strings: list[tuple[int, bytes, bytes, int]], width: int) -> list[int]:
    """For each string (core, left, right, times) the windows that start anywhere else too, as bits: bit k is the one that begins k bytes after the first. Cores are numbers; equal ones come one after another."""
    text: list[int] = []
    starts, owner, bits = [], [], []
    for i, (core, left, right, _) in enumerate(strings):
        n = len(left) + 1 + len(right) - width + 1
        starts += range(len(text), len(text) + n)
        owner += [i] * n
        bits += range(n)
        text += [b + 2 for b in left]
        text.append(258 + core)
        text += [b + 2 for b in right]
        text.append(1)
    text.append(0)
    is_start = np.full(len(text), -1)
    is_start[starts] = np.arange(len(starts))
    order = is_start[np.array(suffix_order(text))]
    order = order[order >= 0]
    at = np.asarray(starts)[order]
    own = np.asarray(text)[at[:, None] + np.arange(width)]
    alike = (own[1:] == own[:-1]).all(1)
    again = np.zeros(len(starts), bool)
    again[order[1:][alike]] = True
    again[order[:-1][alike]] = True
    out = [(1 << (len(left) + len(right) + 2 - width)) - 1 if times > 1 else 0 for _, left, right, times in strings]
    for k in np.flatnonzero(again).tolist():
        out[owner[k]] |= 1 << bits[k]
    return out


def _sorted_parts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_starts("suffixes")

        def found(held: list[tuple], cores: list[int]) -> pa.RecordBatch:
            masks = repeated_windows([(c, x[2], x[3], x[4]) for c, x in zip(cores, held, strict=True)], width)
            rows = [(x[1], m, x[5]) for x, m in zip(held, masks, strict=True) if m]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["s", "mask", "n"])

        held: list[tuple] = []
        cores: list[int] = []
        symbols = 0
        for some in sliced(batches, 4096):
            for x in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if held and x[0] != held[-1][0] and symbols >= SYMBOLS:
                    yield found(held, cores)
                    held, cores, symbols = [], [], 0
                cores.append(cores[-1] + (x[0] != held[-1][0]) if held else 0)
                held.append(x)
                symbols += len(x[2]) + len(x[3]) + 2
        if held:
            yield found(held, cores)

    return run


def _read(texts: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """doc, fp, text and asked (list of structs) of the documents that rows of asked (doc, fp, ...) name. A bit set keeps the texts of others out of the shuffle."""
    per = stored(asked.groupBy("doc", "fp").agg(F.collect_set(F.struct(*[c for c in asked.columns if c not in ("doc", "fp")])).alias("asked")), name)
    return texts.where(_maybe(per)).join(per, ["doc", "fp"]).select("doc", "fp", "text", "asked")


def _maybe(per: DataFrame):
    size = 1 << min(MAX_BITS, max(6, (DOC_BITS * per.count()).bit_length()))
    return has_bit(bit_set(per.select(F.xxhash64("doc", "fp")), size), size, F.xxhash64("doc", "fp"))


def repeats(texts: DataFrame) -> DataFrame:
    """doc, fp, start, n and mask of windows of texts (doc, fp, text) that start anywhere else too: all n from start on where mask is null, else those whose bit is set. Rows may come more than once."""
    spark = texts.sparkSession
    runs = stored(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_runs, RUNS), "suffix_runs")
    strings = stored(runs.groupBy("m", "f").agg(F.count("*").alias("times"), F.min(F.struct("doc", "fp", "start", "n", "off")).alias("at")), "suffix_strings")
    copied = stored(strings.where("times > 1").select("f", F.col("times").alias("n")), "suffix_copied")
    whole = hot_join(runs.select("f", "doc", "fp", "start", F.col("n").alias("many")), copied, "f")
    out = [stored(whole.select("doc", "fp", "start", F.col("many").alias("n"), F.lit(None).cast("long").alias("mask")), "suffix_whole")]
    met = strings.groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    asked = stored(hot_join(strings.select("m", "at", "times"), stored(met, "suffix_met"), "m").select("at.*", "m", "times"), "suffix_asked")
    for df in (runs, strings, copied):
        dropped(spark, df)
    for width in WIDTHS:
        parts = stored(_read(texts, asked, "suffix_per").mapInArrow(_parts(width), PARTS), "suffix_parts")
        different = stored(parts.groupBy("s").agg(F.first("key").alias("key"), F.first("left").alias("left"), F.first("right").alias("right"), F.sum("times").alias("times"), F.count("*").alias("n")), "suffix_different")
        cores = stored(different.groupBy("key").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where("times > 1"), "suffix_cores")
        few = hot_join(different.withColumnRenamed("n", "rows"), cores.where(F.col("n") <= CROWD).select("key", "n"), "key").select("key", "s", "left", "right", "times", "rows")
        masks = stored(few.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_parts(width), "s binary, mask long, n long"), "suffix_masks")
        once = parts.where("times = 1").select("s", "doc", "fp", "start", F.col("n").alias("many"))
        out.append(stored(hot_join(once, masks, "s").select("doc", "fp", "start", F.col("many").alias("n"), "mask"), "suffix_found"))
        crowded = stored(hot_join(different.select("key", "s", F.col("n").alias("rows")), cores.where(F.col("n") > CROWD).select("key", "n"), "key").select("s", F.col("rows").alias("n")), "suffix_crowded")
        more = hot_join(parts.select("s", "doc", "fp", "start", F.col("n").alias("many"), "off", "m", "times"), crowded, "s")
        asked = stored(more.select("doc", "fp", "start", F.col("many").alias("n"), "off", "m", "times"), "suffix_asked")
        for df in (parts, different, cores, masks, crowded):
            dropped(spark, df)
        if asked.isEmpty():
            break
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def covered(size: int, asked: list[dict]) -> np.ndarray:
    """(start, end) of the maximal runs of bytes that windows cover, for the windows that repeats() gives of one text."""
    edges = np.zeros(size + 1, np.int32)
    for x in asked:
        if x["mask"] is None:
            edges[x["start"]] += 1
            edges[x["start"] + x["n"] - 1 + LENGTH] -= 1
        else:
            at = x["start"] + np.flatnonzero([x["mask"] >> k & 1 for k in range(x["n"])])
            edges[at] += 1
            edges[at + LENGTH] -= 1
    gone = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).view(np.int8), [0]])
    return np.flatnonzero(np.diff(gone)).reshape(-1, 2)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel_starts("suffixes")
    for some in sliced(batches, TEXTS):
        rows = []
        for doc_id, text, asked in zip(*(c.to_pylist() for c in some.columns), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans = covered(len(data), asked or []).tolist()
            cuts = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((doc_id, len(data), [{"start": a, "end": b} for a, b in spans], kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)
    release_memory()


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (start and end, in bytes, of maximal removed runs) and kept (the remaining bytes) of each row of docs (doc_id, text).

    A null text counts as empty and has nothing to remove, as has one of fewer than LENGTH bytes. Each row is a document, also one that repeats another in all columns or has a null doc_id. An empty table gives no rows.
    """
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc").cast("long").alias("doc"), "fp", "text")
    found = repeats(rows.select("doc", "fp", "text"))
    per = stored(found.groupBy("doc", "fp").agg(F.collect_set(F.struct("start", "n", "mask")).alias("asked")), "suffix_repeats")
    touched = _maybe(per)
    cut = rows.where(touched).join(per, ["doc", "fp"], "left").select("doc_id", "text", "asked").mapInArrow(_kept, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    whole = rows.where(~touched).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("removed"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT r, j, x[800 * j + 1:800 * j + 1598] AS p FROM (SELECT r, x, unnest(range(0, length(x) // 800)) AS j FROM docs)),
starts AS (SELECT r, j, p, unnest(range(0, length(p) // 2 - 399)) AS k FROM pieces),
windows AS MATERIALIZED (SELECT r, 400 * j + k AS i, hash(p[2 * k + 1:2 * k + 800]) AS h FROM starts),
again AS (SELECT r, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)),
parts AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, -1) AS new FROM again),
numbered AS (SELECT r, i, count(*) FILTER (WHERE new) OVER (PARTITION BY r ORDER BY i) AS k FROM parts),
spans AS (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY r, k),
edges AS (SELECT r, list(a ORDER BY k) AS a, list(b ORDER BY k) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
kept AS (
  SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: x[2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1:2 * (CASE WHEN k = len(a) THEN length(x) // 2 ELSE a[k + 1] END)]), '') END AS left_over
  FROM docs LEFT JOIN edges USING (r)
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM kept
"""
