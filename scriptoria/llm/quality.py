"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. The votes of all documents are counted by pattern (at most
3 ** rules of them, whatever the corpus), and expectation-maximisation over these
counts estimates how often each rule is right about good and about bad documents, and how many are good.
A document is kept where its posterior probability of being good reaches ``KEEP``; a rule that fails does not
by itself reject it. What the driver sees is the counts, which the number of rules bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table, words

KEEP = 0.5
ROUNDS = 50
WINDOW = 5
#: Where a rule's measure lies for it to vote bad; where for it to vote good. It abstains elsewhere.
RULES = {
    "symbols": (lambda m: m["symbols"] >= 0.1, lambda m: m["symbols"] < 0.02),
    "letters": (lambda m: m["others"] >= 0.14, lambda m: m["others"] < 0.06),
    "capitals": (lambda m: m["capitals"] >= 0.25, lambda m: m["capitals"] < 0.1),
    "lines": (lambda m: m["dup_lines"] >= 0.3, lambda m: m["dup_lines"] < 0.05),
    "repeats": (lambda m: m["repeats"] >= 0.1, lambda m: m["repeats"] < 0.02),
    "word_length": (lambda m: (m["word_length"] > 7.5) | (m["word_length"] < 3), lambda m: m["word_length"].between(4, 6.5)),
    "variety": (lambda m: m["variety"] < 0.2, lambda m: m["variety"] >= 0.4),
    "sentences": (lambda m: (m["stops"] > 0.4) | (m["stops"] < 0.005), lambda m: m["stops"].between(0.02, 0.25)),
}


def bound(expr: Column, fn) -> Column:
    """fn of expr, which is worked out once however often fn names it."""
    return F.get(F.transform(F.array(expr), fn), F.lit(0))


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words of array w in windows that occur twice or more in it, the first occurrence included.

    Windows are hashed; only where hashes repeat are they sorted with their places, so that equal ones are neighbours.
    """
    n = F.size(w) - window + 1
    hashes = bound(w, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - window), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(window)])))

    def covered(h):
        at = bound(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))), lambda x: x["i"])),
        )
        return bound(at, lambda a: F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(a, k + 1) - x, F.lit(window)))), F.lit(0), lambda s, x: s + x))

    return F.when(n < 2, F.lit(0)).otherwise(bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a hash of the text) and, of its whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' measures.

    Null and empty texts have no words and no lines.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("fp"), text.alias("text"), words(text).alias("w"))
    lines = bound(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("dup")))
    odd = F.regexp_replace("text", r"[\p{L}\p{M}\x20\x09-\x0D&&[^A-Z]]+", "")  # what is left: A-Z, digits and signs
    count = lambda keep: (F.length("odd") - F.length(F.regexp_replace("odd", keep, ""))).cast("long")
    rows = rows.select(
        "doc_id",
        "fp",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        odd.alias("odd"),
        lines.alias("lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    one = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.select("*", count(r"[#*$%&|<>]").alias("n_symbols"), count(r"[A-Z]").alias("n_capitals"), count(r"[.!?]").alias("n_stops"))
    return rows.select(
        "doc_id",
        "fp",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.struct(
            (F.col("n_symbols") / one).alias("symbols"),
            ((F.length("odd") - F.col("n_capitals")) / F.greatest(F.col("word_chars"), F.lit(1))).alias("others"),
            (F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capitals"),
            (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_lines"),
            (F.col("n_repeat_words") / one).alias("repeats"),
            (F.col("word_chars") / one).alias("word_length"),
            (F.col("n_distinct") / one).alias("variety"),
            (F.col("n_stops") / one).alias("stops"),
        ).alias("m"),
    )


def voted(rows: DataFrame, rules: dict = RULES) -> DataFrame:
    """rows with votes: a text of one letter for each rule, b(ad), g(ood) or - where it abstains. Documents without words get no votes."""
    m = F.col("m")
    one = [F.when(F.col("n_words") == 0, "-").when(bad(m), "b").when(good(m), "g").otherwise("-") for bad, good in rules.values()]
    return rows.withColumn("votes", F.concat(*one))


def estimated(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """The posterior probability of good for each pattern of votes.

    right[j] is how often rule j's vote is good for a good document, and bad for a bad one, given that it votes. Rules start as
    seldom wrong about good documents (0.95) while missing most bad ones (0.4), with a prior worth 10 votes; good and bad can't change places, as
    a rule is held to vote bad more often for bad documents than for good ones.
    """
    n_rules = len(next(iter(counts), ""))
    right, prior = [(0.95, 0.4)] * n_rules, 0.8
    post: dict[str, float] = {}
    for _ in range(rounds):
        for v in counts:
            odds = math.log(prior) - math.log(1 - prior)
            for c, (g, b) in zip(v, right, strict=True):
                odds += math.log(g / (1 - b)) if c == "g" else math.log((1 - g) / b) if c == "b" else 0.0
            post[v] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        total = sum(counts.values())
        prior = min(0.95, max(0.05, (8 + sum(n * post[v] for v, n in counts.items())) / (10 + total)))
        new = []
        for j in range(n_rules):
            gg = sum(n * post[v] for v, n in counts.items() if v[j] == "g")
            gb = sum(n * post[v] for v, n in counts.items() if v[j] == "b")
            bg = sum(n * (1 - post[v]) for v, n in counts.items() if v[j] == "g")
            bb = sum(n * (1 - post[v]) for v, n in counts.items() if v[j] == "b")
            good = min(0.9995, max(0.6, (9.5 + gg) / (10 + gg + gb)))
            new.append((good, min(0.99, max(1.02 - good, (4 + bb) / (10 + bb + bg)))))
        right = new
    return post


def judged(docs: DataFrame, keep: float = KEEP, rules: dict = RULES) -> DataFrame:
    """One row for each document: doc_id, fp, its counts, base_failed, votes, p_good and kept.

    Votes are counted over the documents that pass the base rule. base_failed: fewer than ten words, or over a fifth of them in repeated windows. Rows that repeat are judged each; an empty table gives an empty one.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stored(voted(measured(docs), rules).withColumn("base_failed", failed).drop("m"), "quality_votes")
    counts = {r.votes: r.n for r in rows.where("not base_failed").groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** rules rows
    post = docs.sparkSession.createDataFrame(sorted(estimated(counts).items()), "votes string, p_good double")
    return (
        rows.join(F.broadcast(post), "votes", "left")
        .select("doc_id", "fp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes", "p_good")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_good") >= keep, F.lit(False)))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("fp")
