"""Citation styles: catalogues, and checking a style's macros before it is used. Styles come from a path; none are kept here."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

BYTES, ELEMENTS, DEPTH, CHAIN, MACRO_COST, STYLE_COST = 1 << 20, 20_000, 40, 80, 50_000, 100_000
SLUG = r"^[a-z0-9][a-z0-9-]{0,199}$"


class StyleError(ValueError):
    pass


def catalogue(rows: DataFrame) -> DataFrame:
    """Rows (id, title, format) of a catalogue that can be used: a slug, a title of up to 300 characters, no note style."""
    return rows.where(F.regexp_like("id", F.lit(SLUG)) & (F.length("title").between(1, 300)) & (F.coalesce("format", F.lit("")) != "note")).select("id", F.col("title").alias("label"))


def search(styles: DataFrame, query: str, most: int = 80) -> DataFrame:
    """The first styles whose label or id holds every word of query, with truncated, whether there are more."""
    hay = F.lower(F.concat_ws(" ", text("label"), text("id")))
    hits = styles
    for w in query.lower().split():
        hits = hits.where(F.contains(hay, F.lit(w)))
    top = hits.orderBy("label", "id").limit(most + 1)
    n = top.agg((F.count("*") > most).alias("truncated"))
    return top.limit(most).join(F.broadcast(n))  # one row


def listed(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in styles (id, label, pos) in their order, then custom ones by label, with rank."""
    rows = builtin.select("id", "label", F.lit(0).alias("group"), F.col("pos").cast("string").alias("key")).unionByName(custom.select("id", "label", F.lit(1).alias("group"), F.lower("label").alias("key")))
    return rows.orderBy("group", F.when(F.col("group") == 0, F.col("key").try_cast("int")), F.collate("key", "UNICODE"), "id")


def parent_chain(styles: DataFrame, most: int = 5) -> DataFrame:
    """(id, root, depth) of styles (id, parent): dependent styles follow their parents up to most steps; a chain that is longer, or broken, has no root."""
    links = styles.select(F.col("id").alias("p_id"), F.col("parent").alias("p_parent"))
    rows = styles.select("id", F.col("id").alias("at"), F.col("parent").alias("next"), F.lit(0).alias("depth"))
    for _ in range(most):
        rows = rows.join(links, F.col("next") == F.col("p_id"), "left").select("id", F.coalesce("p_id", "at").alias("at"), F.when(F.col("next").isNotNull() & F.col("p_id").isNull(), F.col("next")).otherwise(F.col("p_parent")).alias("next"), (F.col("depth") + F.col("p_id").isNotNull().cast("int")).alias("depth"))
    return rows.select("id", F.when(F.col("next").isNull(), F.col("at")).alias("root"), "depth")


def inspect(xml: str, costly: bool = False) -> dict:
    """Label, parent and default locale of a style's XML; raises for one that is unsafe, of another class or, unless that is asked for, too costly to expand."""
    if len(xml.encode()) > BYTES or re.search(r"(?i)<!DOCTYPE|<!ENTITY", xml):
        raise StyleError("choose a style under 1 MB without entities")
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        raise StyleError("malformed XML") from None
    ns = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
    if root.tag != f"{ns}style":
        raise StyleError("not a style")
    todo, n = [(root, 0)], 0
    while todo:
        e, depth = todo.pop()
        n += 1
        if n > ELEMENTS or depth > DEPTH:
            raise StyleError("too complex")
        todo += [(c, depth + 1) for c in e]
    if not re.fullmatch(r"1\.0(?:\.[12])?", root.get("version", "")):
        raise StyleError("unsupported version")
    if root.get("class") == "note":
        raise StyleError("footnote styles are not supported")
    info = root.find(f"{ns}info")
    title = (info.findtext(f"{ns}title") or "").strip() if info is not None else ""
    if not 0 < len(title) <= 300:
        raise StyleError("a title is needed")
    parents = [x.get("href", "") for x in info.iter(f"{ns}link") if x.get("rel") == "independent-parent"]
    if len(parents) > 1:
        raise StyleError("several parents")
    parent = None
    if parents:
        parent = parents[0].rstrip("/").rpartition("/")[2]
        if not re.match(SLUG, parent):
            raise StyleError("unknown parent")
    elif root.get("class") != "in-text" or root.find(f"{ns}citation") is None:
        raise StyleError("no in-text citation")
    macros: dict = {}
    for m in root.iter(f"{ns}macro"):
        if not m.get("name") or m.get("name") in macros:
            raise StyleError("invalid or repeated macros")
        macros[m.get("name")] = m
    calls = lambda e: [t.get("macro") for t in e.iter(f"{ns}text") if t.get("macro")]
    if any(c not in macros for c in calls(root)):
        raise StyleError("a macro is missing")
    cost: dict[str, int] = {}
    open_: list[str] = []

    def price(name: str) -> int:
        if name in open_:
            raise StyleError("macros call themselves")
        if len(open_) >= CHAIN:
            raise StyleError("too complex")
        if name not in cost:
            open_.append(name)
            total = sum(1 for _ in macros[name].iter()) + sum(map(price, calls(macros[name])))
            open_.pop()
            if total > MACRO_COST and not costly:
                raise StyleError("too complex")
            cost[name] = total
        return cost[name]

    for name in macros:
        price(name)
    if not costly and sum(cost[c] for c in calls(root)) > STYLE_COST:
        raise StyleError("too complex")
    return {"label": title, "parent": parent, "locale": root.get("default-locale")}


def choices(styles: DataFrame, words: str, value: str) -> DataFrame:
    """styles (id, label, rank) whose label and id hold words, in their order; the chosen one (value) is there in any case, in front of them if it doesn't match."""
    match = F.contains(F.lower(F.concat_ws(" ", text("label"), text("id"))), F.lit(words.strip().lower()))
    rows = styles.withColumn("_match", match).where(F.col("_match") | (F.col("id") == value))
    return rows.withColumn("rank", F.when(F.col("_match"), F.col("rank")).otherwise(F.lit(0))).drop("_match")
