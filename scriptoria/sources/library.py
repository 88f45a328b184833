"""Reading and writing libraries: portable JSON, RIS, and versioned snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import doi_client
from ..functions.text import or_else, stripped, text
from ..operators.library import UNFILED, valid

HIGHLIGHT = "struct<id:string,pdfId:string,page:int,paragraph:int,start:int,`end`:int,quote:string,createdAt:string,color:string,note:string>"
PAPER = (
    "id string, title string, authors string, year string, journal string, doi string, collection string, tags string, status string, notes string, starred boolean, "
    "pdfId string, pdfName string, sourceUrl string, pdfUrl string, pmid string, arxivId string, cslType string, publisher string, publisherPlace string, eventTitle string, "
    f"volume string, issue string, pages string, journalAbbreviation string, cslAuthors array<struct<family:string,given:string,literal:string>>, dateParts array<int>, highlights array<{HIGHLIGHT}>"
)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a library file {papers, collections, revision} with lib_pos; raises if a row is invalid or an id repeats."""
    rows = spark.read.option("multiLine", True).schema(f"papers array<struct<{PAPER.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>, revision long").json(path)
    papers = rows.select(F.posexplode("papers").alias("lib_pos", "p")).select("p.*", F.col("lib_pos").cast("long").alias("lib_pos"))
    bad = papers.agg(F.count_if(~valid(papers)).alias("bad"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if bad.bad or bad.n != bad.ids:
        raise ValueError("invalid or repeated library records; restore a backup")
    return papers


def read_portable(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a portable JSON array: attachments are dropped, blank collections are UNFILED; raises if any row is invalid."""
    papers = spark.read.option("multiLine", True).schema(PAPER).json(path)
    if papers.where(~valid(papers)).limit(1).count():
        raise ValueError("choose a reference backup")
    return papers.drop("pdfId", "pdfName").withColumn("collection", or_else(stripped("collection"), F.lit(UNFILED)))


def parse_ris(files: DataFrame) -> DataFrame:
    """Papers of RIS texts (file, text), in order (file, record). A record goes from TY to ER and needs a title; of tags that repeat, authors and
    key words are joined and for the others the last one counts."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    tag, value = (F.regexp_extract("line", r"^([A-Z0-9]{2})\s{2}-\s?(.*)$", k) for k in (1, 2))
    rows = lines.select("file", "pos", tag.alias("tag"), value.alias("value")).where("tag <> ''")
    from pyspark.sql import Window

    up_to = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("record", F.count_if(F.col("tag") == "TY").over(up_to)).where("record > 0")
    has = lambda *tags: F.col("tag").isin(*tags)
    last = lambda *tags: text(F.max_by("value", F.when(has(*tags), F.col("pos"))))
    joined = lambda by, *tags: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(has(*tags), F.struct("pos", "value")))), lambda x: x["value"]), by)
    web = F.when(has("UR") & F.col("value").rlike("^https?://"), F.col("pos"))
    note = F.when(has("N1") & F.col("value").rlike(r"(?i)^PMID:\s*[1-9]\d{0,8}$"), F.col("pos"))
    linked = F.when(has("UR") & F.col("value").rlike(r"^https?://pubmed\.ncbi\.nlm\.nih\.gov/([1-9]\d{0,8})/?$"), F.col("pos"))
    any_pmid = F.greatest(note, linked)
    per = rows.groupBy("file", "record").agg(
        F.bool_or(has("ER")).alias("ended"),
        last("TI", "T1").alias("title"),
        joined("; ", "AU", "A1").alias("authors"),
        F.left(last("PY", "Y1"), F.lit(4)).alias("year"),
        last("JO", "JF", "T2").alias("journal"),
        doi_client(last("DO")).alias("doi"),
        joined(", ", "KW").alias("tags"),
        last("VL").alias("volume"),
        last("IS").alias("issue"),
        F.concat_ws("-", F.nullif(last("SP"), F.lit("")), F.nullif(last("EP"), F.lit(""))).alias("pages"),
        text(F.max_by("value", web)).alias("sourceUrl"),
        F.regexp_extract(text(F.max_by("value", any_pmid)), r"([1-9]\d{0,8})/?$", 1).alias("_pmid"),
        last("AN").alias("_an"),
        last("DB").alias("_db"),
        last("TY").alias("_ty"),
    )
    own = F.col("_db").rlike("(?i)pubmed") & F.col("_an").rlike(r"^[1-9]\d{0,8}$")
    return per.where(F.col("ended") & (stripped("title") != "")).select(
        "file", "record", "title", "authors", "year", "journal", "doi", "tags", "volume", "issue", "pages", "sourceUrl",
        F.when(own, F.col("_an")).otherwise(F.col("_pmid")).alias("pmid"),
        F.when(stripped("_ty").isin("CONF", "CPAPER"), F.lit("paper-conference")).alias("cslType"),
    )


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """References of a .ris or .json file by its name's ending."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".json":
        return read_portable(spark, path)
    if kind == ".ris":
        rows = parse_ris(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")))
        if not rows.limit(1).count():
            raise ValueError("no complete references found in this RIS file")
        return rows
    raise ValueError("choose a .ris or .json reference file")


def write_snapshot(papers: DataFrame, path: str, revision: int) -> int:
    """Writes the library's next revision beside the ones before it; fails if it is there already, so of two writers of one revision one loses. A revision counts once its _SUCCESS is there."""
    papers.write.mode("error").parquet(f"{path}/revision={revision + 1}")
    return revision + 1


def read_snapshot(spark: SparkSession, path: str, revision: int | None = None) -> tuple[DataFrame, int]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if revision is None:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/revision=*/_SUCCESS")
        found = p.getFileSystem(conf).globStatus(p)
        revision = max(int(x.getPath().getParent().getName().split("=")[1]) for x in found)
    return spark.read.parquet(f"{path}/revision={revision}"), revision


def write_cache(pages: DataFrame, path: str) -> None:
    """Reading caches as compressed JSON, a row each."""
    pages.write.mode("overwrite").option("compression", "gzip").json(path)


CACHE_BYTES, CHAT_MOST = 32 << 20, 100


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Reading caches (file, cache) under path, gzip or plain, one JSON object a file; cache is null where it is invalid or larger than CACHE_BYTES."""
    from ..operators.caches import CACHE, valid_cache

    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    rows = rows.withColumn("cache", F.when(F.octet_length("value") <= CACHE_BYTES, F.from_json("value", CACHE)))
    return rows.select("file", F.when(valid_cache(F.col("cache")), F.col("cache")).alias("cache"))


def chat_rows(chats: DataFrame, turns: DataFrame) -> DataFrame:
    """What an answered question adds to chats (paper, pos, role, text): for each of turns (paper, question, answer, one a paper) a user and an assistant row behind the last; a chat of CHAT_MOST rows takes no more."""
    at = chats.groupBy("paper").agg((F.max("pos") + 1).alias("_at"), F.count("*").alias("_n"))
    rows = turns.join(at, "paper", "left").where(F.coalesce("_n", F.lit(0)) < CHAT_MOST)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return rows.select("paper", F.coalesce("_at", F.lit(0)).alias("_at"), F.posexplode(pair).alias("k", "m")).select("paper", (F.col("_at") + F.col("k")).alias("pos"), "m.role", "m.text")


def append_chat(chats: DataFrame, turns: DataFrame, path: str) -> None:
    chat_rows(chats, turns).write.mode("append").parquet(path)
