"""What the training-data operators share: exact column choice and tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: See hot_join.
HOT_KEYS = 1000
HOT_LEAST = 1000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact case; other columns, even ones whose names differ only by case, are dropped."""
    at = []
    for name in names:
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        at.append(df.columns.index(name))
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(name) for i, name in zip(at, names, strict=True)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where that is unset, a temporary one for a local master, as in tests, and an error on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = getattr(spark.sparkContext, "_scriptoria_dir", None)
        if not conf:
            conf = "file://" + tempfile.mkdtemp(prefix="scriptoria-")
            spark.sparkContext._scriptoria_dir = conf
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scriptoria/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage is cut, and a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote and nothing will read again."""
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/scriptoria/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key, with n, the rows of left (or more) that have it. n goes.

    Keys with over a HOT_KEYS-th of all rows are joined by broadcast, so that their rows stay where they are: there are fewer than HOT_KEYS of them. All others are joined by shuffle.
    Both sides are read twice, so they should be stored.
    """
    total, most = right.agg(F.sum("n"), F.max("n")).first()
    limit = max((total or 0) // HOT_KEYS, HOT_LEAST)
    if (most or 0) <= limit:
        return left.join(right.drop("n"), key, how)
    hot = right.where(F.col("n") > limit).drop("n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= limit).drop("n"), key, how)
    return left.join(F.broadcast(hot), key).select(rest.columns).unionByName(rest)


def bit_set(hashes: DataFrame, size: int) -> Column:
    """One scalar array of longs with a bit for each hash (the first column of hashes, a long): size bits, a power of two."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(size))
    words = hashes.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    every = hashes.sparkSession.range(size // 64).select(F.col("id").alias("i")).join(words, "i", "left").select("i", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    flat = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("bits"))
    return flat.scalar()


def has_bit(bits: Column, size: int, h: Column) -> Column:
    """Whether the bit of the hash h is set in a bit_set of that size."""
    b = F.pmod(h, F.lit(size))
    return F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), F.expr("0") + (b % 64).cast("int")) == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a kernel keeps in this worker process between its partitions: who keeps it, and how it is given back.
_kept: dict[str, Callable[[], None]] = {}


def kernel_starts(owner: str, give_back: Callable[[], None] | None = None) -> None:
    """Called where a kernel's partition begins: what kernels of other owners kept in this worker, which Spark uses again for any stage, is given back. Its own stays until another's turn."""
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        release_memory()
    if give_back:
        _kept[owner] = give_back


def release_memory() -> None:
    """Hands freed memory back to the system, which glibc and Arrow would keep; elsewhere only Arrow's."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most that many rows, so that no more texts than these are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def trimmed(text):
    """text without the white space of WS at both ends."""
    return F.btrim(text, F.lit(WS))


def words(text):
    """Maximal runs of other than WS; null and empty texts have none."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))
