"""10. Mixing sources to target weights: pivotal dependent rounding.

A source's target is its share, by weight, of all sizes, at most `most` times its own size; what is cut off is shared
again by weight.  Each document of a source gets target / size copies: the whole part surely, the fraction by the
pivotal method.  Two fractional documents meet, one gives the other as much of its probability as either can take, at
random so that expectations hold, until one of them is integral; the other goes on.  At most one fractional document is
left of a group, and these residuals meet in the next level of a reduction tree.  Groups hold about `fan` rows: first
documents of one source and size (dealt by a hash of the id where there are many), then the residuals of such groups,
then those of neighbouring sizes.  So mass moves only between documents of like size, and a source's words stay within
about the size of one document of its target.

All random numbers are hashes of ids and a seed, and groups depend on the rows alone, so reruns and other partitionings
give the same copies.  Only DataFrame functions are used; the tree has a fixed number of levels for a range of sizes.

Defined cases: a null text has size 0 and gets copies like any other; a null source is a source of its own, the last
one; equal rows (same id and text) are drawn one by one; a source of size 0 has target 0 and no copies of it are
taken; sources of equal weight are told apart by their names; a very long text is one document, whose copies are drawn like
others'; an empty table gives an empty result; other columns, whatever their names, are kept by `mix`.  Sources are few: their
targets take one task and one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, with_columns_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
FAN = 64
EPS = 1e-9


def words() -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target; sizes has a row (source, source_size) for each source."""
    w = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    by = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(sizes.select("source", "source_size", by.alias("weight"), (F.col("source_size") * most).alias("top")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words a unit of weight gets; sources whose top is lower take their top
    while True:
        full = F.col("top") <= level * F.col("weight")
        left = rows.agg(F.sum(F.when(full, F.col("top")).otherwise(0.0)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not left["w"]:
            break
        risen = (total - left["given"]) / left["w"]
        if risen <= level * (1 + 1e-15):
            break
        level = risen
    return rows.select("source", "source_size", F.least(F.col("top"), F.lit(float(level)) * F.col("weight")).alias("target"))


def uniform(*cols) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def pivotal(items: Column, seed: int) -> Column:
    """Runs the pivotal method over an array of (k, p), in order.

    Gives done (k and copy 0 or 1 of each that became integral) and the one that stayed fractional (k, p), if any.
    """
    none = F.lit(None).cast("struct<k:string,p:double>")
    start = F.struct(F.array().cast("array<struct<k:string,c:int>>").alias("done"), none.alias("rest"))

    def settle(done: Column, k: Column, p: Column) -> Column:
        """The state once k has probability p: integral ones are done."""
        whole = (p < EPS) | (p > 1 - EPS)
        return F.struct(
            F.when(whole, F.concat(done, F.array(F.struct(k.alias("k"), F.when(p > 0.5, 1).otherwise(0).alias("c"))))).otherwise(done).alias("done"),
            F.when(~whole, F.struct(k.alias("k"), p.alias("p"))).otherwise(none).alias("rest"),
        )

    def meet(s: Column, x: Column) -> Column:
        r = s["rest"]
        a, b = r["p"], x["p"]
        total, u = a + b, uniform(F.lit(seed), r["k"], x["k"])
        low = total < 1
        # below 1: one takes all, the other is out; else one is in, the other keeps what is above 1
        x_on = F.when(low, u < b / total).otherwise(u >= (1 - b) / (2 - total))
        on_k, off_k = F.when(x_on, x["k"]).otherwise(r["k"]), F.when(x_on, r["k"]).otherwise(x["k"])
        out = F.struct(off_k.alias("k"), F.lit(0).alias("c"))
        sure = F.struct(on_k.alias("k"), F.lit(1).alias("c"))
        met = F.when(low, settle(F.concat(s["done"], F.array(out)), on_k, total)).otherwise(settle(F.concat(s["done"], F.array(sure)), off_k, total - 1))
        return F.when(r.isNull(), settle(s["done"], x["k"], b)).otherwise(met)

    return F.aggregate(items, start, meet)


def copies(docs: DataFrame, seed: int = 10, fan: int = FAN, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs (doc_id, source, size and any key column k, unique to a row) with source_size, target and n copies."""
    sized = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(targets(sized, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = goal.withColumn("rate", F.least(rate, F.lit(most)))
    plan = plan.withColumn("whole", F.floor(F.col("rate") + EPS).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    drawn = plan.where(F.col("p") > EPS).select(F.col("source").alias("s0"), "p")
    per = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("m"))
    per = per.join(drawn, F.col("source").eqNullSafe(F.col("s0")), "inner").select(F.col("source").alias("s0"), F.col("size").alias("z0"), "p", F.ceil(F.col("m") / fan).alias("deal"))
    per = written(per)
    on = F.col("source").eqNullSafe(F.col("s0")) & (F.col("size") == F.col("z0"))
    level = docs.join(per, on).select("k", "source", "size", "p", F.pmod(F.xxhash64(F.lit(seed), "k"), F.col("deal")).alias("deal"), "deal").toDF("k", "source", "size", "p", "d", "deals")
    top = per.agg(F.max("deal").alias("d"), F.max("z0").alias("z")).first()
    deals, sizes, done, step = top["d"] or 0, top["z"] or 0, [], 0
    while True:
        groups = level.groupBy("source", "size", "d").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("items"))  # about `fan` rows each
        now = written(groups.select("source", "size", "d", pivotal(F.col("items"), seed + step).alias("x")))
        done.append(now.select(F.explode("x.done").alias("y")).select("y.k", "y.c"))
        rest = now.where("x.rest is not null").select(F.col("x.rest.k").alias("k"), "source", "size", F.col("x.rest.p").alias("p"), "d")
        step += 1
        if deals > 1:  # residuals of one size meet first
            deals = -(-deals // fan)
            level = rest.withColumn("d", F.floor(F.col("d") / fan))
        elif sizes > 0:  # then those of neighbouring sizes
            sizes //= fan
            level = rest.withColumn("d", F.lit(0)).withColumn("size", F.floor(F.col("size") / fan))
        else:  # one is left of a source: its last draw
            last = F.when(uniform(F.lit(seed + step), F.col("k")) < F.col("p"), 1).otherwise(0)
            done.append(rest.select("k", last.alias("c")))
            break
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionByName(d)
    extra = extra.withColumnRenamed("k", "k0")
    out = docs.join(plan.select(F.col("source").alias("s0"), "source_size", "target", "whole"), F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    out = out.join(extra, F.col("k") == F.col("k0"), "left").drop("k0")
    return out.withColumn("n", F.col("whole") + F.coalesce(F.col("c"), F.lit(0))).drop("whole", "c")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows of docs packed into __row, with source, size and a key k that tells also equal rows apart.

    Rows of one id and text get numbers by their place; which of the equal rows has which number does not matter.
    """
    t = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string").alias("source"),
        words().alias("size"),
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")))).alias("__k"),
    )
    return t


def number_equal(t: DataFrame) -> DataFrame:
    """k of each row: __k, and for keys of several rows a number more.  Only the repeated keys are ranked."""
    t = written(t.withColumn("__place", F.monotonically_increasing_id()))
    again = t.groupBy("__k").count().where("count > 1").select("__k")
    twice = t.join(again, "__k", "left_semi").select("__k", "__place")
    n = F.row_number().over(Window.partitionBy("__k", F.pmod("__place", F.lit(1024))).orderBy("__place"))
    twice = twice.select("__place", F.concat_ws(":", F.col("__k"), F.pmod("__place", F.lit(1024)).cast("string"), n.cast("string")).alias("__k2"))
    return t.join(twice, "__place", "left").withColumn("k", F.coalesce("__k2", "__k")).drop("__k", "__k2", "__place")


def mix(docs: DataFrame, seed: int = 10) -> DataFrame:
    """docs with each row repeated as often as the mix takes it: same columns."""
    t = copies(number_equal(keyed(docs)), seed)
    t = t.where("n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return t.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string"), ("source", "string"))
    t = keyed(docs).withColumn("__row", F.struct(F.col("__row.doc_id")))
    out = copies(number_equal(t))
    return out.select(F.col("__row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("n") * F.col("size")).cast("long").alias("taken"), "n")
