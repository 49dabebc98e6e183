"""Ranking: task terms, TF-IDF packs, block relevance, budgets."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

# Weights of a term by its shape.
SPAN, CODE, PLAIN, PART = 2.0, 1.5, 1.0, 0.6
MOST_TERMS = 24
STOP = frozenset("the and for with that this from into when what which where should must not are was has have can will does".split())
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _parts(word: str) -> list[str]:
    found = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", word.replace("_", " "))
    return [p for p in found if len(p) > 2 and not p.isdigit() and p.lower() != word.lower()]


def terms(task: str) -> list[tuple[str, float]]:
    """(term, weight) of a task, the heaviest first: words in backticks, words shaped like code, plain ones, and parts."""
    best: dict[str, float] = {}
    seen: dict[str, int] = {}

    def add(word: str, weight: float) -> None:
        key = word.lower()
        if len(key) > 2 and key not in STOP:
            seen[key] = seen.get(key, 0) + 1
            best[key] = max(best.get(key, 0.0), weight)

    def visit(text: str, weight_of) -> None:
        for word in WORD.findall(text):
            weight = weight_of(word)
            add(word, weight)
            if weight > PLAIN:
                for p in _parts(word):
                    add(p, PART)

    for span in re.findall(r"`([^`]+)`", task):
        visit(span, lambda w: SPAN)
    visit(task, lambda w: CODE if "_" in w or any(c.isdigit() for c in w) or re.search(r"[a-z][A-Z]", w) else PLAIN)
    weighed = [(k, w * (1 + 0.25 * math.log(seen[k]))) for k, w in best.items()]
    return sorted(weighed, key=lambda x: (-x[1], x[0]))[:MOST_TERMS]


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def pack(docs: DataFrame, key: str, weighed: list[tuple[str, float]], text: str = "text", common: float = 0.4) -> DataFrame:
    """(file, score, size) of documents with any term: sum of weight * idf * (1 + ln tf), less for long texts.

    idf = ln(1 + N / (1 + df)); a term in more than `common` of the documents says nothing.  One pass makes all counts;
    df comes from an aggregate of one row.
    """
    words = F.split(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9_]+", " "), " ")
    keep = F.filter(words, lambda w: w.isin([t for t, _ in weighed]))
    rows = docs.select(F.col(key).cast("string").alias("file"), F.octet_length(text).alias("size"), keep.alias("w"))
    rows = rows.select("file", "size", *[_count("w", t).alias(f"t{i}") for i, (t, _) in enumerate(weighed)])
    df = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(weighed))])
    rows = rows.crossJoin(F.broadcast(df))  # one row
    score = F.lit(0.0)
    for i, (_, w) in enumerate(weighed):
        d, tf = F.col(f"d{i}"), F.col(f"t{i}")
        part = w * F.log(1 + F.col("n") / (1 + d)) * (1 + F.log(tf))
        score = score + F.when((tf > 0) & (d <= common * F.col("n")), part).otherwise(0.0)
    out = rows.select("file", (score / (1 + 0.15 * F.log(1 + F.col("size") / 20000.0))).alias("score"), F.col("size").cast("long").alias("size"))
    return out.where("score > 0")


def fit(rows: DataFrame, cost: str, room: int, order: list[Column]) -> DataFrame:
    """The longest prefix of a total order whose costs fit: running sums over ranges of the order.

    Rows are written in ranges; the driver gets one sum a range.
    """
    parts = settled(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before, total = [], 0
    for p, n in sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.sum(cost).alias("n")).collect()):
        if total <= room:
            before += [F.lit(p), F.lit(total)]
        total += n or 0
    if not before:
        return rows.withColumn("used", F.lit(0).cast("long")).limit(0)
    by = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.try_element_at(F.create_map(*before), F.col("_p"))
    return parts.withColumn("used", start + F.sum(cost).over(by)).where(F.col("used") <= room).drop("_p")


def block_relevance(blocks: DataFrame, wanted: list[str]) -> DataFrame:
    """(file, block, relevance): the sum of 1 / df over the wanted terms of a block, df within its file."""
    words = blocks.select("file", "block", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9_]+", " "), " "))).alias("term"))
    words = words.where(F.col("term").isin(wanted))
    df = words.groupBy("file", "term").agg(F.count(F.lit(1)).alias("df"))
    return words.join(df, ["file", "term"]).groupBy("file", "block").agg(F.sum(1 / F.col("df")).alias("relevance"))
