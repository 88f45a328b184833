"""Token-ID output: raw id payloads under a minimal perfect hash index.

Documents are encoded, laid out in ascending key order and cut into segments of
about ``SEGMENT_TOKENS`` ids. A segment is one row of a Parquet table: its payload (ids
as little-endian unsigned 32-bit integers) and its index. The index is a minimal
perfect hash in levels of bits: a key sets a bit in the first level where no other
key of the segment claims the same bit, and the number of set bits before it is its
slot. A slot stores a fingerprint of its key, and the offset and the length of its
ids, so a keyed read costs a constant number of steps, and a key that was never
written is turned away by the fingerprint (wrongly let in once in 2**32).

Segments are the unit of recovery and of memory: both grow with a segment or with
one document, not with the table. The driver sees one number for each partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kernel_starts, new_path, pick, release_memory, sliced, table

SEGMENT_TOKENS = 1 << 20
END = b"\0\0\0\0"
MAGIC = b"SCRMPH01"
CACHE = 700_000
SEGMENTS = "part int, seg int, local_start long, n_docs int, n_tokens long, first_key string, last_key string, payload binary, index binary"

_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    rest = [b for b in range(256) if b not in own]
    return own | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts as bytes, equal to encode(text, add_special_tokens=False).

    A byte-level pre-tokenizer never joins what stands before a single space or
    newline between other characters with what follows it, nor a run of letters with the
    full stop or comma after it. Texts whose white space is of that kind are therefore put
    together from pieces; this dictionary holds the ids of up to ``limit`` of them, by
    the piece with a mark of what stands before it (newline, return for the text's start, or nothing for
    a space). All other texts are encoded whole.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.bpe = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline, self.marks = self.whole("\n"), {c: self.whole(c) for c in ".,"}
        kind = self.tokenizer.pre_tokenizer
        self.split = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex and self.tokenizer.normalizer is None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, own: str) -> bytes:
        """Ids of letters after an optional space: one run for the pre-tokenizer, so the model alone is asked."""
        if own.isascii():
            own = own.replace(" ", self.space)
        else:
            own = own.encode().decode("latin-1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.bpe(own)])

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            got = self.word(" " + piece)
        elif piece[-1] in self.marks and len(piece) > 1 and piece[:-1].isalpha():
            got = self[piece[:-1]] + self.marks[piece[-1]]
        elif piece[0] in "\r\n":
            own = piece[1:]
            if own[-1:] in self.marks and own[:-1].isalpha():
                got = self[piece[:-1]] + self.marks[own[-1]]
            else:
                got = self.word(own) if own.isalpha() else self.whole(own)
                if piece[0] == "\n":
                    got = self.newline + got
        else:
            got = self.whole(" " + piece)
        if len(self) < self.limit:
            self[piece] = got
        return got

    def __call__(self, text: str) -> bytes:
        flat = text.replace("\n", " ").split(" ")
        if not self.split or not text or flat != text.split() or any(s in text for s in self.specials):
            return self.whole(text)
        own = text.replace("\n", " \n").split(" ")
        own[0] = "\r" + own[0]
        return b"".join(map(self.__getitem__, own))


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_hash(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits to place a key by, and 32 others as its fingerprint."""
    both = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    wide = np.frombuffer(both, dtype="<u8").reshape(-1, 2)
    return wide[:, 0], (wide[:, 1] >> np.uint64(32)).astype("<u4")


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class HashIndex:
    """A minimal perfect hash of distinct keys, and what is stored at its slots."""

    def __init__(self, levels, words, before, prints, offsets, lengths):
        self.levels, self.words, self.before = levels, words, before
        self.prints, self.offsets, self.lengths = prints, offsets, lengths

    @classmethod
    def build(cls, keys: list[str], lengths: np.ndarray) -> HashIndex:
        h, prints = key_hash(keys)
        left, levels, bits = h, [], []
        while len(left):
            if len(levels) > 60:
                raise ValueError("keys repeat")
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            bits.append(count == 1)
            levels.append(size)
            left = left[count[at] > 1]
        flat = np.concatenate(bits) if bits else np.zeros(64, bool)
        words = np.packbits(flat, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(flat.reshape(-1, 64).sum(1))[:-1]]).astype("<u4")
        out = cls(levels, words, before, None, None, None)
        slot = out.slots(h)
        ends = np.cumsum(lengths)
        out.prints, out.offsets, out.lengths = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u8"), np.empty(len(keys), "<u8")
        out.prints[slot], out.offsets[slot], out.lengths[slot] = prints, ends - lengths, lengths
        return out

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that no level holds."""
        out, base = np.full(len(h), -1, np.int64), 0
        for level, size in enumerate(self.levels):
            at = (_mixed(h, level) % np.uint64(size)).astype(np.int64) + base
            word = self.words[at >> 6]
            bit = (at & 63).astype(np.uint64)
            hit = (out < 0) & ((word >> bit) & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[hit] = self.before[at[hit] >> 6].astype(np.int64) + np.bitwise_count(below[hit]).astype(np.int64)
            base += size
        return out

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key's ids; the offset of an unknown key is -1."""
        if not len(self.prints) or not keys:
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        h, prints = key_hash(keys)
        slot = self.slots(h)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == prints[known]
        slot[~known] = 0
        return np.where(known, self.offsets[slot].astype(np.int64), -1), np.where(known, self.lengths[slot].astype(np.int64), 0)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<III", len(self.prints), len(self.levels), len(self.words))
        return head + b"".join(x.tobytes() for x in (np.array(self.levels, "<u4"), self.words, self.before, self.prints, self.offsets, self.lengths))

    @classmethod
    def from_bytes(cls, raw: bytes) -> HashIndex:
        if raw[:8] != MAGIC:
            raise ValueError("not an index of this format")
        n, n_levels, n_words = struct.unpack_from("<III", raw, 8)
        at, parts = 20, []
        for kind, k in (("<u4", n_levels), ("<u8", n_words), ("<u4", n_words), ("<u4", n), ("<u8", n), ("<u8", n)):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        return cls([int(x) for x in parts[0]], *parts[1:])


def document_keys(ids: list) -> list[str]:
    """A key for each row of a segment: the document's key, its rank among equal ones in this segment; null has a key of its own."""
    seen: dict = {}
    out = []
    for x in ids:
        k = seen[x] = seen.get(x, -1) + 1
        out.append(f"{'n' if x is None else 'k'}{x}\x1f{k}")
    return out


def _encode(path: str, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_starts("encoder", _encoders.clear)
        own, part = encoder(path), TaskContext.get().partitionId()
        seg = start = 0
        ids: list = []
        parts: list[bytes] = []
        size = 0

        def flush():
            nonlocal seg, start, ids, parts, size
            lengths = np.array([len(x) // 4 for x in parts], np.int64)
            index = HashIndex.build(document_keys(ids), lengths)
            row = [part, seg, start, len(ids), size, *(None if x is None else str(x) for x in (ids[0], ids[-1])), b"".join(parts), index.to_bytes()]
            keys = pa.array(ids)
            seg, start, ids, parts, size = seg + 1, start + size, [], [], 0
            return row, keys

        def batch(row, keys):
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            cols = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([keys.to_pylist()], pa.list_(key_type))], names=["part", "seg", "local_start", "n_docs", "n_tokens", "first_key", "last_key", "payload", "index", "keys"])

        for b in batches:
            key_type = b.schema.field(0).type
            for i in range(0, b.num_rows, 128):
                some = b.slice(i, 128)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    got = own(text or "")
                    ids.append(key)
                    parts.append(got + END)
                    size += len(got) // 4 + 1
                    if size >= segment_tokens:
                        yield batch(*flush())
        if ids:
            yield batch(*flush())
        release_memory()

    return run


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes the ids of every text, in ascending key order (nulls first; equal keys by their texts' hash), as segments under path.

    Null and empty texts have no ids but their end id, 0. Rows that repeat are written each. An empty
    table gives an empty table of segments.
    """
    rows = pick(docs, key, text)
    kind = rows.schema[0].dataType.simpleString()
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text).asc()]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encode(tokenizer, segment_tokens), f"{SEGMENTS}, keys array<{kind}>")
    out.write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a written table: key, start (ids of all documents before it), n_tokens and ids_crc32, each found by its key in its segment's index."""
    segments = spark.read.parquet(path)
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row for each partition written
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part], total = total, total + totals[part]
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            key_type = b.schema.field("keys").type.value_type
            for row in b.to_pylist():
                index, payload = HashIndex.from_bytes(row["index"]), memoryview(row["payload"])
                at, length = index.find(document_keys(row["keys"]))
                if (at < 0).any():
                    raise ValueError("a written key is missing from its index")
                first = bases[row["part"]] + row["local_start"]
                crc = [zlib.crc32(payload[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], key_type), pa.array(at + first), pa.array(length), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "local_start", "payload", "index", "keys").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, keys: list) -> dict:
    """The id lists of a few keys: segments are chosen by their first and last key, each key then takes one look-up (and one for each further row of that key)."""
    segments = spark.read.parquet(path)
    kind = segments.schema["keys"].dataType.elementType
    out: dict = {k: [] for k in keys}
    for k in keys:
        hold = F.lit(k).cast(kind)
        near = segments.where(F.col("first_key").isNull() | (F.col("first_key").cast(kind) <= hold)).where(F.col("last_key").cast(kind) >= hold) if k is not None else segments.where(F.col("first_key").isNull())
        for r in near.select("payload", "index").toLocalIterator():
            index, n = HashIndex.from_bytes(r["index"]), 0
            while True:
                at, length = index.find([f"{'n' if k is None else 'k'}{k}\x1f{n}"])
                if at[0] < 0:
                    break
                out[k].append(np.frombuffer(r["payload"], "<u4", int(length[0]), 4 * int(at[0])).tolist())
                n += 1
    return out


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(spark, "token_shards")
    write_token_shards(docs, path, tokenizer)
    return read_documents(spark, path).withColumnRenamed("key", "doc_id")
