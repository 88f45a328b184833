"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of l code points is cut into two even segments, of l // 2 and the other code points. One edit leaves one of the two whole, so a near word of equal length has a segment in common at the same place, and
one that is a code point longer has the first segment at its beginning or the second one at its end, shifted by one. Words are indexed under their two segments and their length, and probe with the four
substrings that this allows. Candidates are verified by their edit distance, and pairs that meet under both segments are taken once.

A segment that many words share is a crowd. All its words differ in what the segment leaves over, by one edit at most, so this rest is cut into two segments in its turn, and so on until no crowd has more than
``CROWD`` words or its rest is a single code point. No pair is lost and no crowd is paired with itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kernel_starts, pick, sliced, stored, table

MIN_LENGTH = 7
MIN_COUNT = 2
#: One of so many runs loses a code point.
LOSES = 31
#: A form is so many times as frequent as the word.
FORM_RATIO = 10
#: Words that share a segment and are paired with each other; more are cut again.
CROWD = 100
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
TEXTS = 256

#: Lower case for A-Z, a blank for all but A-Z, a-z and U+00C0 to U+00FF, by Latin-1 code.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def runs(doc_id: int | None, text: str | None, least: int = MIN_LENGTH) -> Iterator[tuple[bytes, int]]:
    """(word, times) of a text, as Latin-1: lower-cased runs of letters after their loss, those of at least so many code points. A null text has none; a null id is written as nothing."""
    seed = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    seed = zlib.crc32(b":", seed)
    # what is beyond U+00FF becomes a question mark, which ends a run as well
    seen = Counter(w for w in (text or "").encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= least)
    for word, n in seen.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
        if h % LOSES == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        yield word, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    kernel_starts("spelling")
    counts: Counter = Counter()
    for some in sliced(batches, TEXTS):
        for doc_id, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
            for word, n in runs(doc_id, text):
                counts[word] += n
            if len(counts) >= COUNTED:
                yield handed(counts)
                counts = Counter()
    yield handed(counts)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n (occurrences) of all documents' words of at least MIN_LENGTH code points and MIN_COUNT occurrences. Rows that repeat count each."""
    counts = pick(docs, "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _cut(rows: DataFrame, roles: tuple) -> DataFrame:
    """rows (key, longer, word, n, rest) under the two segments of their rest: key becomes one of key, length and segment. longer: the row probes for words whose rest is one code point shorter."""
    piece = lambda start, size: F.substring(F.col("rest"), start, size)
    made = []
    for longer in roles:
        own = F.length("rest") - int(longer)
        half = F.floor(own / 2).cast("int")
        head, tail = piece(F.lit(1), half), piece(half + 1 + int(longer), own)
        for seg, (shared, left) in enumerate(((head, piece(half + 1, own + 1)), (tail, piece(F.lit(1), half + int(longer))))):
            made.append(F.when(F.col("longer").isNull() | (F.col("longer") == longer), F.struct(F.xxhash64("key", own, F.lit(seg), shared).alias("key"), F.lit(longer).alias("longer"), left.alias("rest"))))
    out = rows.select("word", "n", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return out.select("x.key", "x.longer", "word", "n", "x.rest")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n; distinct words) that differ by exactly one inserted, deleted or replaced code point, once."""
    spark = words.sparkSession
    rows = stored(_cut(words.select(F.lit(0).cast("long").alias("key"), F.lit(None).cast("boolean").alias("longer"), "word", "n", F.col("word").alias("rest")), (False, True)), "spelling_segments")
    found = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("held"), F.count_if(~F.col("longer")).alias("indexed")).where("held > 1 and indexed > 0").select("key", "held")
        met = stored(rows.join(sizes, "key"), "spelling_met")
        dropped(spark, rows)
        crowded = (F.col("held") > CROWD) & (F.length("rest") - F.col("longer").cast("int") > 1)
        few = met.where(~crowded)
        a = few.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = few.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
        one_edit = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
        found.append(stored(a.join(b.hint("merge"), "key").where(one_edit).select("a", "a_n", "b", "b_n"), "spelling_pairs"))
        rows = stored(_cut(met.where(crowded).drop("held"), (False, True)), "spelling_crowds")
        dropped(spark, met)
        if rows.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """words (word, n) with n_near, form and form_n: its near word of largest n, the smallest in code-point order of several, if its n is at least ratio times the word's."""
    pairs = stored(near_pairs(words), "spelling_near")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )


def with_roots(rows: DataFrame) -> DataFrame:
    """rows with root: from word, forms followed to the last. A form is more frequent than its word, so there are no circles; each round doubles the steps that are taken."""
    steps = stored(rows.where("form is not null").select("word", F.col("form").alias("root")), "spelling_steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        after = stored(steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling_steps")
        moved = not after.where("moved").isEmpty()
        dropped(rows.sparkSession, steps)
        steps = after.drop("moved")
        if not moved:
            break
    return rows.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of docs (doc_id, text). Null and empty texts have no words; an empty table gives no rows."""
    words = stored(vocabulary(docs), "spelling_words")
    return with_roots(stored(forms(words), "spelling_forms")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
),
own AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_transform(range(0, length(x) // 2), lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295)) AS h
  FROM own, crc_table
),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2
),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, word[:i - 1] || '_' || word[i + 1:] AS hole, word[:i - 1] || word[i + 1:] AS short FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.short = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.short = w.word
),
ranked AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1
),
walk(word, root, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL
  SELECT walk.word, formed.form, step + 1 FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) r ON f.word = r.word
"""
