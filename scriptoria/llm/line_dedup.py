"""Line dedup: sharded cuckoo filters over exact reference counts, open to insertions and deletions.

The state of a corpus is three tables:

* ``ledger``: one row for each line whose key is long enough (document, text fingerprint, line number, 128-bit key);
* ``refs``: one row for each key: the number of documents that hold it and the largest of them;
* ``shards``: one row for each shard of the keys: a cuckoo filter of its frequent keys, and their exact entries.

A line is first put to its shard's filter, which turns nearly all lines away, and only then to the exact
entries. Deleting documents takes their lines off the ledger, lowers the counts and takes keys that are no longer
frequent out of their shard's filter, so that inserting and then deleting documents gives back the same state.

A shard holds about ``SHARD_ROWS`` lines; a shard that one key makes larger is read in salted parts, each with its
own copy of the shard's row. Counts are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_ROWS = 1 << 15
#: Stands for a null document id: smaller than every other.
NO_DOC = -(1 << 63)
_STRIP = b" \t\n\x0b\x0c\r"


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints; a key's two buckets differ by a hash of its fingerprint. Equal keys may be added repeatedly and deleted as often."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, hashes: np.ndarray) -> Cuckoo:
        size = 1
        while size * cls.SLOTS * 0.9 < max(1, len(hashes)):
            size *= 2
        while True:
            out = cls(np.zeros((size, cls.SLOTS), np.uint16))
            if all(out.add(int(h)) for h in hashes):
                return out
            size *= 2

    @staticmethod
    def _jump(fp):
        return (np.asarray(fp, np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & np.uint64(0xFFFFFFFF)

    def places(self, hashes: np.ndarray):
        h = np.asarray(hashes, np.uint64)
        fp = ((h >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.uint16)
        fp = np.where(fp == 0, np.uint16(1), fp)
        mask = np.uint64(len(self.table) - 1)
        one = h & mask
        return fp, one.astype(np.int64), ((one ^ self._jump(fp)) & mask).astype(np.int64)

    def add(self, h: int) -> bool:
        fp, one, two = (int(x[0]) for x in self.places(np.array([h], np.uint64)))
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        at = two
        for k in range(self.KICKS):
            slot = (h + k) % self.SLOTS
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at = (at ^ int(self._jump(fp))) & (len(self.table) - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        return False

    def remove(self, h: int) -> bool:
        fp, one, two = (int(x[0]) for x in self.places(np.array([h], np.uint64)))
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == fp)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(hashes)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[int], list[bytes]]:
    """Numbers and 128-bit keys of a text's lines whose stripped form has min_chars code points; only A-Z are lower-cased."""
    at, keys = [], []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) < min_chars:
            continue
        key = line.strip(_STRIP).lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            at.append(i)
            keys.append(xxhash.xxh3_128_digest(key))
    return at, keys


def _ledger_rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            some = b.slice(i, 2000)
            docs, prints, texts = (some.column(k).to_pylist() for k in range(3))
            d, f, p, k = [], [], [], []
            for doc, fp, text in zip(docs, prints, texts, strict=True):
                at, keys = line_keys(text or "", min_chars)
                d += [doc] * len(at)
                f += [fp] * len(at)
                p += at
                k += keys
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(p, pa.int32()), pa.array(k, pa.binary())], names=["doc", "fp", "pos", "key"])


@dataclass
class State:
    """The tables of a corpus, and how its keys are dealt and counted."""

    ledger: DataFrame
    refs: DataFrame
    shards: DataFrame
    n_shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the two columns that name a row: doc, never null, and fp, its text's fingerprint."""
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.xxhash64("text").alias("fp"), "text")


def ledger_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return keyed(docs).select("doc", "fp", "text").mapInArrow(lambda b: _ledger_rows(b, min_chars), "doc long, fp long, pos int, key binary")


def counted(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("key", "doc").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))


def _shard(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n))


_SHARD_SCHEMA = "shard long, filter binary, keys binary, max_docs binary"


def _state_row(shard: int, cuckoo: Cuckoo, keys: list[bytes], max_docs: list[int]) -> pd.DataFrame:
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return pd.DataFrame({"shard": [shard], "filter": [cuckoo.to_bytes()], "keys": [b"".join(keys[i] for i in order)], "max_docs": [np.array([max_docs[i] for i in order], "<i8").tobytes()]})


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["key"].tolist()
    return _state_row(int(pdf["shard"].iloc[0]), Cuckoo.of(_hash(keys)), keys, pdf["max_doc"].tolist())


def _changed(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """A shard's row after some keys' counts changed: keys that became frequent go into its filter, others leave it."""
    shard = int((old if len(old) else new)["shard"].iloc[0])
    held: dict[bytes, int] = {}
    raw = bytes(old["keys"].iloc[0]) if len(old) else b""
    if raw:
        held = dict(zip([raw[i : i + 16] for i in range(0, len(raw), 16)], np.frombuffer(old["max_docs"].iloc[0], "<i8").tolist(), strict=True))
        cuckoo = Cuckoo.from_bytes(bytes(old["filter"].iloc[0]))
    else:
        cuckoo = Cuckoo.of(np.zeros(0, np.uint64))
    whole = True
    for key, frequent, max_doc in zip(new["key"], new["frequent"], new["max_doc"], strict=True):
        if frequent and key not in held:
            whole &= cuckoo.add(int(_hash([key])[0]))
        if frequent:
            held[key] = max_doc
        elif key in held:
            cuckoo.remove(int(_hash([key])[0]))
            del held[key]
    if not whole:
        cuckoo = Cuckoo.of(_hash(list(held)) if held else np.zeros(0, np.uint64))
    return _state_row(shard, cuckoo, list(held), list(held.values()))


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> State:
    """The state of a corpus from nothing."""
    ledger = stored(ledger_of(docs, min_chars), "line_ledger")
    n = max(1, -(-ledger.count() // SHARD_ROWS))
    refs = stored(counted(ledger), "line_refs")
    frequent = refs.where(F.col("n_docs") >= min_docs).withColumn("shard", _shard(n))
    shards = stored(frequent.groupBy("shard").applyInPandas(_build, _SHARD_SCHEMA), "line_shards")
    return State(ledger, refs, shards, n, min_chars, min_docs)


def updated(state: State, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> State:
    """The state after documents went (deleted: a table of doc_id) and others came; a document that is in both is replaced.

    Only the counts of the keys in question, and their shards, are made anew.
    """
    ledger, touched = state.ledger, []
    if deleted is not None:
        gone = deleted.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc")).distinct()
        touched.append(ledger.join(gone, "doc", "left_semi").select("key"))
        ledger = ledger.join(gone, "doc", "left_anti")
    if inserted is not None:
        new = stored(ledger_of(inserted, state.min_chars), "line_inserted")
        touched.append(new.select("key"))
        ledger = ledger.unionByName(new)
    if not touched:
        return state
    ledger = stored(ledger, "line_ledger")
    keys = touched[0]
    for t in touched[1:]:
        keys = keys.union(t)
    keys = stored(keys.distinct(), "line_touched")
    fresh = counted(ledger.join(keys, "key", "left_semi"))
    refs = stored(state.refs.join(keys, "key", "left_anti").unionByName(fresh), "line_refs")
    news = keys.join(refs, "key", "left").select(_shard(state.n_shards).alias("shard"), "key", (F.coalesce("n_docs", F.lit(0)) >= state.min_docs).alias("frequent"), F.coalesce("max_doc", F.lit(NO_DOC)).alias("max_doc"))
    moved = state.shards.join(news.select("shard").distinct(), "shard", "left_semi").groupBy("shard").cogroup(news.groupBy("shard")).applyInPandas(_changed, _SHARD_SCHEMA)
    still = state.shards.join(news.select("shard").distinct(), "shard", "left_anti")
    return State(ledger, refs, stored(still.unionByName(moved), "line_shards"), state.n_shards, state.min_chars, state.min_docs)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and part, each part's state before its lines."""
    cuckoo = known = max_docs = None
    for b in batches:
        kind = np.asarray(b.column("line"))
        cuts = [*np.flatnonzero(~kind).tolist(), b.num_rows]
        if cuts[0] > 0:
            cuts = [-1, *cuts]
        for a, e in zip(cuts, cuts[1:], strict=False):
            if a >= 0:
                cuckoo = Cuckoo.from_bytes(b.column("filter")[a].as_py())
                known = np.frombuffer(b.column("key")[a].as_py() or b"\xff" * 16, "S16")
                max_docs = np.frombuffer(b.column("max_docs")[a].as_py() or bytes(8), "<i8")
            own = b.slice(a + 1, e - a - 1)
            if not own.num_rows or cuckoo is None:
                continue
            keys = own.column("key").to_pylist()
            at = np.flatnonzero(cuckoo.holds(_hash(keys)))
            if not len(at):
                continue
            asked = np.array([keys[i] for i in at], "S16")
            found = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            doc = np.asarray(own.column("doc"))[at]
            drop = (known[found] == asked) & (doc < max_docs[found])
            if drop.any():
                rows = own.take(pa.array(at[drop]))
                yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("fp"), rows.column("pos")], names=["doc", "fp", "pos"])


def dropped_lines(state: State) -> DataFrame:
    """doc, fp and pos of every line that goes: its key is frequent and a larger document holds it too."""
    lines = state.ledger.withColumn("shard", _shard(state.n_shards))
    parts = lines.groupBy("shard").count().select("shard", F.ceil(F.col("count") / SHARD_ROWS).alias("parts"))
    states = state.shards.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    empty = F.lit(None)
    states = states.select("shard", "part", F.lit(False).alias("line"), empty.cast("long").alias("doc"), empty.cast("long").alias("fp"), empty.cast("int").alias("pos"), F.col("keys").alias("key"), "filter", "max_docs")
    lines = lines.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc", "fp", "pos"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("line"), "doc", "fp", "pos", "key", empty.cast("binary").alias("filter"), empty.cast("binary").alias("max_docs"))
    both = states.unionByName(lines).repartition("shard", "part").sortWithinPartitions("shard", "part", "line")
    return both.mapInArrow(_probe_by_part, "doc long, fp long, pos int")


def _probe_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard without frequent keys has no state; its lines must not meet the state of the shard before."""
    last = None

    def marked():
        nonlocal last
        for b in batches:
            shard, part, line = (np.asarray(b.column(k)) for k in ("shard", "part", "line"))
            name = shard.astype(np.int64) * (1 << 20) + part
            new = np.concatenate([[last is None or name[0] != last], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
            last = name[-1] if len(name) else last
            at = np.flatnonzero(new & line)
            if not len(at):
                yield b
                continue
            begin = 0
            for a in at.tolist():
                if a > begin:
                    yield b.slice(begin, a - begin)
                yield _NOTHING
                begin = a
            yield b.slice(begin)

    yield from _probe(marked())


_NOTHING = pa.RecordBatch.from_arrays(
    [pa.array([False]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([b"\xff" * 16]), pa.array([Cuckoo.of(np.zeros(0, np.uint64)).to_bytes()]), pa.array([np.zeros(1, "<i8").tobytes()])],
    names=["line", "doc", "fp", "pos", "key", "filter", "max_docs"],
)


def deduplicated(docs: DataFrame, state: State) -> DataFrame:
    """doc_id, text without the lines that go, n_lines and n_dropped, one row for each row of docs.

    Null and empty texts are one empty line. Rows of one doc_id are one document: none of their lines
    counts as another document's. A null doc_id is a document of its own, smaller than all others.
    """
    gone = dropped_lines(state).groupBy("doc", "fp").agg(F.collect_set("pos").alias("gone"))
    rows = keyed(docs).join(gone, ["doc", "fp"], "left")
    both = F.array(F.struct(F.split("text", "\n", -1).alias("lines"), F.col("gone").alias("gone")))
    left = F.transform(both, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: F.get(s["lines"], i)), "\n"))
    return rows.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left[0]).alias("text"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicated(docs, build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.pos, f.m IS NOT NULL AND k.doc_id < f.m AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
