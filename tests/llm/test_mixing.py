from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing as M


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing of what is cut off."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        target = {s: most * sizes[s] for s in full} | share
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 1, "b": 1, "c": 1000}, {"z": 5}, {"b": 30, "ü": 20, "é": 10, "": 4}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def corpus(spark):
    rows = [(i, ("w " * (1 + i % 37 if i % 5 else 4)).strip(), "a" if i % 3 == 0 else "b" if i % 7 == 0 else "c") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_are_near_targets_and_reruns_agree(spark):
    docs = corpus(spark)
    run = lambda df: M.copies(M.number_equal(M.keyed(df))).select("__row.doc_id", "source", "size", "source_size", "target", "n").collect()
    rows = run(docs)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["n"] * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["n"] <= int(rate) + 1 <= 4 and r["n"] <= 3
    assert len(rows) == 3000 and target == pytest.approx(water(size))
    assert all(abs(taken[s] - target[s]) <= 2 * 37 for s in size)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(docs.repartition(7))))


def test_copies_are_drawn_with_equal_chances(spark):
    items = F.array(*[F.struct(F.concat(F.lit(f"k{i}:"), F.col("id").cast("string")).alias("k"), F.lit(0.3).alias("p")) for i in range(10)])
    got = spark.range(600).select(M.pivotal(items, 7).alias("x")).select("x.done", "x.rest").collect()
    n = Counter()
    for r in got:
        taken = [d["k"].split(":")[0] for d in r["done"] if d["c"]]
        assert len(r["done"]) == 10 and r["rest"] is None and len(taken) == 3
        n.update(taken)
    assert all(120 < n[f"k{i}"] < 240 for i in range(10))


def test_mixed_rows(spark, hard, empty):
    out = M.mix(hard)
    assert out.columns == hard.columns
    got, have = Counter(map(str, out.collect())), Counter(map(str, hard.collect()))
    assert set(got) <= set(have) and all(got[k] <= 3 * have[k] for k in got)
    assert M.mix(empty).collect() == []
