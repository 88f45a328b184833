"""Papers, manuscripts, blocks and the like made of the benchmark tables.

The texts are read by Spark and by DuckDB alike; {table} stands for a table of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAMES = "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Berg, Ada' WHEN 2 THEN 'Ida Noor; Cho, Min' WHEN 3 THEN 'Roe, Kim;  Li Wei ;Plato' ELSE 'Consortium' END"
PAPERS = f"""
SELECT 'p' || CAST(p_partkey AS STRING) AS id, p_name AS title, {_NAMES} AS authors, CAST(1975 + p_size AS STRING) AS year, p_brand AS journal,
       CASE p_partkey % 4 WHEN 3 THEN '' ELSE '10.1000/part.' || CAST(p_partkey AS STRING) END AS doi, p_type AS collection, 'tag' || CAST(p_size % 9 AS STRING) AS tags,
       CASE p_size % 3 WHEN 0 THEN 'To read' WHEN 1 THEN 'Reading' ELSE 'Finished' END AS status, '' AS notes, p_size % 5 = 0 AS starred,
       CASE p_partkey % 6 WHEN 5 THEN '' ELSE CAST(10000000 + p_partkey AS STRING) END AS pmid,
       CASE p_partkey % 7 WHEN 0 THEN '2101.' || CAST(10000 + p_partkey % 80000 AS STRING) ELSE '' END AS "arxivId",
       CASE p_partkey % 5 WHEN 0 THEN 'https://example.org/item/' || CAST(p_partkey AS STRING) WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || CAST(10000000 + p_partkey AS STRING) || '/' ELSE '' END AS "sourceUrl",
       CASE p_size % 4 WHEN 0 THEN 'paper-conference' WHEN 1 THEN 'article' ELSE '' END AS "cslType", CAST(p_size AS STRING) AS volume, '' AS issue, CASE p_size % 2 WHEN 0 THEN '1-9' ELSE '' END AS pages,
       CAST(p_partkey AS BIGINT) AS lib_pos
FROM {{part}}
"""
INCOMING = """
SELECT 'q' || CAST(p_partkey AS STRING) AS id, 'Import ' || p_name AS title, '' AS authors, CAST(1975 + p_size AS STRING) AS year, p_brand AS journal,
       CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.1000/PART.' || CAST(p_partkey AS STRING) WHEN 1 THEN 'doi: 10.1000/Part.' || CAST(p_partkey + 777777 AS STRING) WHEN 2 THEN 'http://dx.doi.org/10.1000/new' || CAST(p_partkey % 400 AS STRING) WHEN 3 THEN '' ELSE ' 10.1000/n ew' END AS doi,
       'Imports' AS collection, '' AS tags, 'To read' AS status, '' AS notes, false AS starred,
       CASE p_partkey % 3 WHEN 0 THEN CAST(10500000 + p_partkey % 900 AS STRING) ELSE '' END AS pmid, '' AS "arxivId",
       CASE p_partkey % 2 WHEN 0 THEN 'https://example.org/item/' || CAST(p_partkey % 700 AS STRING) ELSE '' END AS "sourceUrl", '' AS "cslType", '' AS volume, '' AS issue, '' AS pages,
       CAST(p_partkey AS BIGINT) AS lib_pos
FROM {part}
"""
#: One marker for each line item: PMIDs, DOIs, groups, a preprint, prose in brackets and an unknown id.
CITE = """
SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'seen (' || CAST(10000000 + l_partkey AS STRING) || ') before' WHEN 1 THEN 'shown (PMID: ' || CAST(10000000 + l_partkey AS STRING) || ', ' || CAST(10000000 + l_suppkey AS STRING) || ')'
            WHEN 2 THEN 'as in [doi:10.1000/part.' || CAST(l_partkey AS STRING) || ']' WHEN 3 THEN 'in 2020 (n=12)' WHEN 4 THEN 'also (pmid:' || CAST(10000000 + l_partkey AS STRING) || '; doi:10.1000/PART.' || CAST(l_partkey AS STRING) || ')'
            WHEN 5 THEN 'not (PMID: 99999999)' WHEN 6 THEN 'square [12345678] stays' WHEN 7 THEN 'both (' || CAST(10000000 + l_partkey AS STRING) || ', ' || CAST(10000001 + l_suppkey AS STRING) || ')'
            ELSE 'ref (arxiv:2101.' || CAST(10000 + l_partkey % 80000 AS STRING) || 'v2)' END AS piece
FROM {lineitem}
"""
MANUSCRIPTS_SPARK = f"SELECT doc_id, array_join(transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, piece))), x -> x.piece), '. ') AS text FROM ({CITE}) GROUP BY doc_id"
MANUSCRIPTS_DUCK = f"SELECT doc_id, string_agg(piece, '. ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, piece) AS text FROM ({CITE}) GROUP BY doc_id"
BLOCKS_SPARK = "SELECT doc_id AS pdf_id, CAST(1 + floor(pos / 10) AS INT) AS page, CAST(pos AS BIGINT) AS ord, text FROM (SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (pos, text) FROM {documents})"
BLOCKS_DUCK = "SELECT doc_id AS pdf_id, CAST(1 + floor(pos / 10) AS INT) AS page, CAST(pos AS BIGINT) AS ord, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


def spark_table(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False, dealt_by: dict[str, str] | None = None) -> DataFrame:
    """sql over the tables; spread deals their rows, which are small, over all tasks before larger ones are made of them. dealt_by has tables that are dealt by a column before anything is made of them, so that Spark knows what stays dealt by it."""
    import re

    names = set(re.findall(r"\{(\w+)\}", sql))
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if spread:
        tables = {n: t.repartition(max(2, spark.sparkContext.defaultParallelism)) for n, t in tables.items()}
    tables |= {n: tables[n].repartition(c) for n, c in (dealt_by or {}).items()}
    return spark.sql(sql.replace('"', "`"), **tables)


def duck(sql: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", sql)
