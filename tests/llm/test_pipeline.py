import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
import test_decontam
import test_mixing
import test_neardup
import test_quality
from tracewell.llm import neardup as N
from tracewell.llm import registry


def test_stages_keep_columns_and_run(spark, tmp_path, hard):
    d = str(tmp_path)
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("1", "no such words in any of the texts here at all, not one of them")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    assert 4 <= len(P.STAGES) <= 5 and P.STAGES[1][0] == "near_dedup"
    rows = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, d)
        assert out.columns == docs.columns, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
    final = P.run(spark, d)
    assert final.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    assert final.count() > 0


def test_every_operator_has_a_query():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))


# -- each stage, and the chain, against brute force ---------------------------------------------------------------


def shape(rows):
    return sorted(map(repr, rows))


def brute_quality(rows):
    """Too few labelled rows for any cutoff: the base rules alone."""
    out = []
    for r in rows:
        n, _, _, _, repeated = test_quality.brute(r["text"])
        if n >= 20 and 100 * repeated <= 30 * n:
            out.append(r)
    return out


def brute_dedup(spark, rows, schema):
    """One row of each component over all pairs: the least doc_id, null last."""
    texts = [r["text"] for r in rows]
    idf, _ = N.document_frequency(N.key_columns(spark.createDataFrame(rows, schema).select("text")))

    def idf_of(w):
        h, _, _ = N.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        return idf[int(h[0]) >> 48]

    root = test_neardup.brute(texts, idf_of)
    ids = {}
    for r, c in zip(rows, root):
        ids.setdefault(c, []).append((r["doc_id"] is None, r["doc_id"] or 0))
    return sorted(repr(min(x)) for x in ids.values())


def brute_decontamination(rows, items):
    out = []
    for r in rows:
        t = r["text"] or ""
        n, hit, _, _, bad = test_decontam.brute(t, items)
        if bad:
            continue
        places = [m.span() for m in test_decontam.WORD.finditer(t.translate(test_decontam.LOWER))]
        w = [t.translate(test_decontam.LOWER)[a:b] for a, b in places]
        gone = set()
        for _, x in items:
            x = test_decontam.words(x)
            k = min(13, len(x))
            for a in range(len(x) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        gone |= set(range(b, b + k))
        runs, cut = [], set()
        for i in sorted(gone):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        for a, b in runs:
            if b - a >= 13:
                cut |= set(range(places[a][0], places[b - 1][1]))
        out.append((r["doc_id"], "".join(c for i, c in enumerate(t) if i not in cut) if cut else r["text"]))
    return shape(out)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory, hard):
    """Hard rows, copies with few changes, and passages of an item."""
    d = str(tmp_path_factory.mktemp("small"))
    r = random.Random(2)
    rows = [tuple(x) for x in hard.collect()]
    item = " ".join(f"item{i} of" for i in range(20))
    for i in range(30):
        w = [f"v{r.randrange(400)}" for _ in range(r.randint(30, 90))]
        at = r.randrange(len(w))
        text = " ".join(w[:at]) + (" " + item if i % 5 == 0 else f" {item[:60]}" if i % 5 == 1 else "") + " " + " ".join(w[at:]) + " w" * (600 if i == 10 else 0)
        if i == 10:
            text = " ".join(f"long{k}" for k in range(900)) + " " + item
        rows += [(500 + i, text, "en", "a", None, "x", "y", 1), (600 + i, text + " end", "en", "b", None, "x", "y", 1), (700 + i, text, "en", None, 5, "x", "y", 1)]
    spark.createDataFrame(rows, hard.schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (500, 1, 0), (501, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [("1", item), ("2", "short one"), (None, None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_each_stage_against_brute_force(spark, small):
    d, items = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    schema = docs.schema
    stages = dict(P.STAGES)
    rows = docs.collect()
    good = stages["quality_rules"](spark, docs, d)
    assert good.columns == docs.columns and shape(good.collect()) == shape(brute_quality(rows))

    rows = good.collect()
    one = stages["near_dedup"](spark, spark.createDataFrame(rows, schema), d)
    kept = one.collect()
    assert set(map(repr, kept)) <= set(map(repr, rows))
    assert sorted(repr((r["doc_id"] is None, r["doc_id"] or 0)) for r in kept) == brute_dedup(spark, rows, schema)

    clean = stages["decontamination"](spark, spark.createDataFrame(kept, schema), d)
    rows = clean.collect()
    assert clean.columns == docs.columns and shape((r["doc_id"], r["text"]) for r in rows) == brute_decontamination(kept, items)
    assert len(rows) < len(kept) and any(r["doc_id"] == 510 and "item3" not in r["text"] for r in rows)

    mixed = stages["mix_sources"](spark, spark.createDataFrame(rows, schema), d)
    got = mixed.collect()
    size = lambda r: len(test_quality.WORD.findall(r["text"] or ""))
    have, took, most = Counter(), Counter(), Counter()
    for r in rows:
        have[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    for r in got:
        took[r["source"]] += size(r)
    goal = test_mixing.water(have)
    for s in have:
        assert abs(took[s] - goal[s]) <= 2 * most[s], (s, took[s], goal[s])
    assert max(Counter(map(repr, got)).values()) <= 3 * max(Counter(map(repr, rows)).values())

    last = stages["shard"](spark, spark.createDataFrame(got, schema), d).collect()
    assert shape(tuple(x[c] for c in docs.columns if c != "size") for x in last) == shape(tuple(x[c] for c in docs.columns if c != "size") for x in got)
    slots: dict = {}
    for x in last:
        assert x["size"] == len((x["text"] or "").encode()) + 8
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    of: dict = {}
    for x in last:
        of.setdefault(x["text"] or "", set()).add(x["shard"])
    assert all(len(v) == 1 for v in of.values())


def test_chain_is_its_stages(spark):
    """run() over given tables: what the stages give one after the other, and nothing that was not there."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = P.run(spark, d).collect()
    known = {r["doc_id"] for r in docs.collect()}
    assert out and {r["doc_id"] for r in out} <= known
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) >= sum(sizes.values()) / 24
    again = P.run(spark, d).collect()
    assert shape(out) == shape(again)


def test_empty_and_textless_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, __row string, k int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, rows in enumerate(([], [(1, None, None, None, None, "s", 1, "r", 2), (2, "", "en", "a", 0, "s", 1, "r", 2)])):
        d = f"{tmp_path}/{i}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        assert P.run(spark, d).collect() == []
        for name, stage in P.STAGES[1:]:
            stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()
