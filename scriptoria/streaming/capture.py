"""Streams of captures and edits: duplicates over time, revisions, bursts of edits and paced requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def debounced(rows: DataFrame, key: str, ts: str, event: str, gap: str) -> DataFrame:
    """Bursts of events of a key that are less than gap apart: first_ts, n and last_event, the last one, which wins. For batches and streams (with a watermark) alike."""
    return rows.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.count("*").alias("n"), F.max(F.struct(ts, event))[event].alias("last_event")).drop("session_window")


def deduplicated(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first row of each key, and again once the watermark has passed: state is bounded by the delay."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def upsert_batches(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps, of each key, the row of the smallest order, in one new version of the table for each batch.

    Versions are folders named by batch; a batch that is run again after a failure finds its version and writes it anew from the one before, so it is idempotent.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={batch_id - 1}"))
        rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("x")).select("x.*").write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return run


def dedup_stream_to_table(spark: SparkSession, source: str, keys: list[str], order: str) -> DataFrame:
    """Runs a stream over the files at source until it has seen them all, and returns the table that it leaves: a row of keys and order for each key."""
    base = f"{shared_dir(spark)}/scriptoria/{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    # A file source takes folders; a single file is named as a pattern.
    folder, name = source.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if "." in name and not _is_folder(spark, source) else spark.readStream.schema(schema).parquet(source)
    query = stream.select(*keys, order).writeStream.foreachBatch(upsert_batches(f"{base}/table", keys, order)).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{base}/table/version={last}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def applied(writes: DataFrame) -> DataFrame:
    """Optimistic writes (library, seq, revision): in sequence, a write is accepted if its revision is the current one, which then rises by one; else it conflicts.

    Of the writes that name revision r only the first can be accepted, and only if r - 1 was: acceptance is a chain, found by windows over each library's first writes.
    Writes of different revisions may share a seq; each is decided for itself.
    """
    first = Window.partitionBy("library", "revision").orderBy("seq")
    rows = writes.withColumn("_first", F.row_number().over(first) == 1)
    chain = Window.partitionBy("library").orderBy("revision")
    heads = rows.where("_first").withColumn("_rank", F.row_number().over(chain) - 1).withColumn("_order", F.max("seq").over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    good = heads.withColumn("_ok", (F.col("revision") == F.col("_rank")) & F.coalesce(F.col("seq") > F.col("_order"), F.lit(True)))
    good = good.withColumn("_ok", F.min("_ok").over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    won = good.where("_ok").select("library", "revision", F.lit(True).alias("_won"))
    return rows.join(won, ["library", "revision"], "left").select("library", "seq", "revision", (F.col("_first") & F.coalesce("_won", F.lit(False))).alias("accepted"))


def paced(requests: DataFrame, key: str, ts: str, pause_ms: int) -> DataFrame:
    """requests with at_ms, when each may go out: in order, at least pause_ms after the one before of its key. at = max over earlier ones of (arrival + pauses since)."""
    w = Window.partitionBy(key).orderBy(ts)
    n = F.row_number().over(w)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = requests.withColumn("_n", n)
    return rows.withColumn("at_ms", F.max(F.col(ts) - F.col("_n") * pause_ms).over(up_to) + F.col("_n") * pause_ms).drop("_n")


def merging(stream: DataFrame, key: str, fields: list[str], ttl_ms: int) -> DataFrame:
    """A stream of captures merged by key for as long as ttl_ms after the last one: each batch gives, for every key in it, the fields filled so far (first non-empty value wins) and whether the key was known."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = f"{key} string, " + ", ".join(f"{f} string" for f in fields) + ", known boolean"
    kept = ", ".join(f"{f} string" for f in fields)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        held = list(state.get) if known else [""] * len(fields)
        for b in batches:
            for r in b[fields].itertuples(index=False):
                held = [h or (v or "") for h, v in zip(held, r, strict=True)]
        state.update(tuple(held))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([[k[0], *held, known]], columns=[key, *fields, "known"])

    return stream.select(key, *fields).groupBy(key).applyInPandasWithState(run, schema, kept, "update", GroupStateTimeout.ProcessingTimeTimeout)


def refreshed(polls: DataFrame) -> DataFrame:
    """polls (library, seq, revision) with accepted: a poll is taken unless its revision is older than one taken before, which is to say, than any before."""
    before = Window.partitionBy("library").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return polls.withColumn("accepted", F.coalesce(F.col("revision") >= F.max("revision").over(before), F.lit(True)))


def newest(polls: DataFrame) -> DataFrame:
    """The newest revision of each library and the poll that brought it first; of a stream, in update mode, a row each time that it rises."""
    return polls.groupBy("library").agg(F.max(F.struct("revision", (-F.col("seq")).alias("s"))).alias("m")).select("library", "m.revision", (-F.col("m.s")).alias("seq"))
