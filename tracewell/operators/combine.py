"""Combinators over any stream: where, group, top, count, distinct, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bucket
from ..functions.text import text_value


def where(df: DataFrame, field: str, op: str, value: str) -> DataFrame:
    """field = value, != value or ~ value (holds it); null and missing are the empty string."""
    v = text_value(F.col(field)) if field in df.columns else F.lit("")
    test = {"=": v == value, "!=": v != value, "~": v.contains(value)}[op]
    return df.where(test)


def sizes(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(text_value(F.col(field)).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))


def grouped(df: DataFrame, field: str) -> DataFrame:
    """Rows with their group (_group) and its size (_n); groups are ordered by size, the largest first, then by key.

    Sizes are aggregated and joined back, so that a hot group is no single task, and groups are not ranked: they may be many.
    """
    return df.withColumn("_group", text_value(F.col(field))).join(sizes(df, field), "_group")


def top_groups(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the first n groups, and the count of the rest."""
    s = df.groupBy("_group").agg(F.max("_n").alias("_n"))
    first = s.orderBy(F.desc("_n"), "_group").limit(n).select("_group")
    gone = s.join(first, "_group", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    return df.join(first, "_group", "left_semi"), gone


def top_rows(df: DataFrame, n: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first n rows of a total order, and the count of the rest."""
    first = (df.orderBy(*order) if order else df).limit(n)
    return first, df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n"))


def count(df: DataFrame, group: str | None = None) -> DataFrame:
    if group is None:
        return df.agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(text_value(F.col(group)).alias("group")).agg(F.count(F.lit(1)).alias("n"))


def distinct(df: DataFrame, field: str) -> DataFrame:
    return df.select(text_value(F.col(field)).alias("value")).distinct()


def histogram(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """(bucket, lo, hi, n) of equal width, empty buckets included; one bucket if all values are equal."""
    v = F.col(field).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    at = df.select(v.alias("v")).crossJoin(F.broadcast(ends)).where("v is not null")  # one row
    found = at.groupBy(bucket(F.col("v"), F.col("lo"), F.col("hi"), n).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    last = F.when(F.col("hi") > F.col("lo"), F.lit(n - 1)).otherwise(0)
    every = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bucket")) if n else ends.limit(0).select("lo", "hi", F.lit(0).cast("long").alias("bucket"))
    width = (F.col("hi") - F.col("lo")) / F.lit(max(n, 1))
    out = every.join(F.broadcast(found), F.col("bucket") == F.col("b"), "left")  # n rows at most
    return out.select("bucket", (F.col("lo") + F.col("bucket") * width).alias("from_value"), F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bucket") + 1) * width).otherwise(F.col("hi")).alias("to_value"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def top_values(df: DataFrame, field: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(value, n) of the most frequent values, and the count of the rows of the others."""
    s = sizes(df, field).select(F.col("_group").alias("value"), F.col("_n").alias("n"))
    shown = s.orderBy(F.desc("n"), "value").limit(n)
    gone = s.join(F.broadcast(shown.select("value")), "value", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return shown, gone


def files(df: DataFrame) -> DataFrame:
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first of a total order."""
    columns = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_r")).select(*keys, "_r.*").select(*df.columns)
