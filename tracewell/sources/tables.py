"""Scans: whole documents as lines, and the fact tables that the queries derive from the star schema.

Lines split at \\n alone; an empty last line is dropped and one trailing \\r stripped; numbers start at 1.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this process in the one that all executors see; where the session names none, in a temporary one.

    It holds what `settled` writes; only a local session may do without one.  A local one is removed when the process ends; in a store, it may go at any time after.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = (top or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")
    if top not in _FOLDERS:
        _FOLDERS[top] = f"{top}/tracewell-{uuid.uuid4().hex}"
        if top.startswith(("/", "file:")):
            atexit.register(shutil.rmtree, _FOLDERS[top].removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    return _FOLDERS[top]


def settled(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage of loops, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(file, line, text) of every line of a text column."""
    pieces = F.split(F.col(text), "\n", -1)
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    rows = df.select(F.col(key).cast("string").alias("file"), F.posexplode(kept).alias("i", "t"))
    return rows.select("file", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("t", "\r$", "").alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"), "doc_id")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags and texts of pages, one a line: what stands in for program output."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "><", ">\n<").alias("text"))
    return lines(pages, "page_id")


def fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fail(test, failure_class, file, line, run_id, generation): error events."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(
        F.col("event_id").cast("string").alias("test"),
        F.concat(F.lit("E"), F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(7)).cast("string")).alias("failure_class"),
        F.col("user_id").cast("string").alias("file"),
        F.floor("value").cast("long").alias("line"),
        F.dayofmonth("ts").cast("long").alias("run_id"),
        F.when(F.dayofmonth("ts") <= 15, "g1").otherwise("g2").alias("generation"),
    )


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changed(file, generation): users with more than one signup in a half month."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    e = e.select(F.col("user_id").cast("string").alias("file"), F.when(F.dayofmonth("ts") <= 15, "g1").otherwise("g2").alias("generation"))
    return e.groupBy("file", "generation").count().where("count > 6").select("file", "generation")


def decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decl(symbol, kind, file, line_a, line_b): intervals of orders, nested where they happen to be."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0")
    a = F.pmod(F.col("o_orderkey"), F.lit(150))
    return o.select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("symbol"), F.col("o_orderpriority").alias("kind"),
        F.col("o_custkey").cast("string").alias("file"), a.alias("line_a"), (a + 5 + F.pmod(F.col("o_orderkey"), F.lit(40))).alias("line_b"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, line, tier): parts call the part that stands for their supplier; a third of them is out of scope (repo)."""
    li = table(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_returnflag") == "A", "local").when(F.col("l_returnflag") == "N", "import").otherwise("repo")
    return li.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst"), F.col("l_linenumber").cast("long").alias("line"), tier.alias("tier")).distinct()


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, symbol): an exact index of words; files whose number 3 divides have changed since it was made."""
    rows = document_lines(spark, sf_dir).where(F.col("file").cast("long") % 3 != 0)
    return rows.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0))).alias("symbol"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, at, author, text): orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("author"), F.col("o_orderpriority").alias("text"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, commit, at): the files of each commit."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").cast("string").alias("file"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))
