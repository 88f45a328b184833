"""Stored files: statistics, equal contents, references, ranges and comparing two copies of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PDF_SIGNATURE = b"%PDF-"


def scan(spark, path: str, content: bool = False) -> DataFrame:
    """Files under path: file_id, length and, if asked for, their SHA-256 and whether they are PDFs; the content column isn't read otherwise."""
    rows = spark.read.format("binaryFile").load(path).withColumn("file_id", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    if not content:
        return rows.select("file_id", "length")
    return rows.select("file_id", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(PDF_SIGNATURE)).alias("is_pdf"))


def stats(files: DataFrame, references: DataFrame) -> DataFrame:
    """One row: file_count, bytes, reference_count, logical_bytes (each reference's file), saved_bytes and unused_bytes. references: file_id, null where there is no file."""
    total = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    per = references.groupBy("file_id").agg(F.count("*").alias("n")).join(files, "file_id", "left")
    used = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reference_count"), F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("length"), F.lit(0)).alias("referenced"))
    return total.join(F.broadcast(used)).select(  # one row each
        "file_count", "bytes", "reference_count", "logical_bytes", F.greatest(F.lit(0), F.col("logical_bytes") - F.col("referenced")).alias("saved_bytes"), (F.col("bytes") - F.col("referenced")).alias("unused_bytes")
    )


def same_content(files: DataFrame) -> DataFrame:
    """files (file_id, length, sha256) with kept_id, the smallest id of equal size and hash, and reused. Only sizes that repeat compare hashes."""
    w = Window.partitionBy("length", "sha256")
    return files.withColumn("kept_id", F.min("file_id").over(w)).withColumn("reused", F.col("kept_id") != F.col("file_id"))


def unreferenced(files: DataFrame, references: DataFrame) -> DataFrame:
    return files.join(references.where("file_id is not null"), "file_id", "left_anti")


def referenced(files: DataFrame, references: DataFrame) -> DataFrame:
    return files.join(references.where("file_id is not null"), "file_id", "left_semi")


def manifest_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """Files (name, length, sha256) that two manifests do not agree on: name and problem."""
    a, b = (df.select("name", *[F.col(c).alias(f"{c}_{k}") for c in ("length", "sha256")]) for df, k in ((one, "a"), (two, "b")))
    both = a.join(b, "name", "full_outer")
    problem = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256_a").isNull(), "unexpected").when(F.col("length_a") != F.col("length_b"), "size").when(F.col("sha256_a") != F.col("sha256_b"), "content")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def byte_range(header: Column, size: Column) -> Column:
    """(start, end) of an HTTP range header, both inclusive; null where it is invalid or outside the file."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k) for k in (1, 2))
    ok = F.regexp_like(header, F.lit(r"^bytes=(\d*)-(\d*)$")) & ((a != "") | (b != ""))
    start = F.when(a != "", a.try_cast("long")).otherwise(F.greatest(F.lit(0), size - b.try_cast("long")))
    end = F.when((a != "") & (b != ""), F.least(b.try_cast("long"), size - 1)).otherwise(size - 1)
    return F.when(ok & (start <= end) & (start < size), F.struct(start.alias("start"), end.alias("end")))


def slice_of(content: Column, span: Column) -> Column:
    return F.substring(content, (span["start"] + 1).cast("int"), (span["end"] - span["start"] + 1).cast("int"))


def manifest_totals(files: DataFrame, manifest: str) -> DataFrame:
    """Files and bytes of each manifest."""
    return files.groupBy(manifest).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


CHUNK, CHUNK_TEXT = 32_768, 44_000


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """files (file_id, content) as chunks (file_id, pos, data), base64 of size bytes each; an empty file is one empty chunk."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length("content") - 1) / size)).cast("int")
    rows = files.select("file_id", "content", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return rows.select("file_id", "pos", F.base64(F.substring("content", (F.col("pos") * size + 1).cast("int"), F.lit(size))).alias("data"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """(file_id, n_chunks, content) of chunks in any order; content is null if one is missing, doubled or too long."""
    per = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("c"), F.max("pos").alias("last"), F.count_distinct("pos").alias("n"), F.max(F.length("data")).alias("longest"))
    whole = (F.col("n_chunks") == F.col("last") + 1) & (F.col("n") == F.col("n_chunks")) & (F.col("longest") <= CHUNK_TEXT)
    return per.select("file_id", "n_chunks", F.when(whole, F.unhex(F.array_join(F.transform("c", lambda x: F.hex(F.unbase64(x["data"]))), ""))).alias("content"))
