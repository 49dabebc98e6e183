import re
from collections import Counter, defaultdict

import pytest

from tracewell.llm import sentences as S

END = re.compile(r"(?<=[.!?…。])(?=[ \t\n\x0b\f\r])|(?<=\n)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(t):
    cuts = [0, *sorted({m.start() for m in END.finditer(t)} - {0, len(t)}), len(t)]
    return [t[a:b] for a, b in zip(cuts, cuts[1:]) if t[a:b]]


def normal(s):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", s.translate(LOWER)).strip(" ")


def brute(rows, least):
    """Sentences of each (id, text) in any run of two sentences or more that is not the run's first occurrence."""
    places, order = defaultdict(set), {}
    for (d, t), tid in rows:
        p = [(i, normal(s)) for i, s in enumerate(pieces(t))]
        p = [x for x in p if x[1]]
        for k in range(len(p)):
            for m in range(k + 2, len(p) + 1):
                if sum(len(x[1].split(" ")) for x in p[k:m]) >= least:
                    key = (d is not None, d or 0, tid, p[k][0])
                    order[key] = (d, t)
                    places[hash(tuple(x[1] for x in p[k:m]))].add((key, p[m - 1][0]))
    cut = defaultdict(set)
    for where in places.values():
        for key, j in sorted(where)[1:]:
            cut[order[key]] |= set(range(key[3], j + 1))
    return cut


@pytest.mark.parametrize("least", [20, 3])
def test_removed_sentences_match_brute_force(spark, hard, least):
    from pyspark.sql import functions as F

    tids = {r[0]: r[1] for r in hard.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    rows = [((r["doc_id"], r["text"] or ""), tids[r["text"]]) for r in hard.collect()]
    cut = brute(rows, least)
    want = Counter()
    for (d, t), _ in rows:
        p = pieces(t)
        gone = sorted(cut[d, t])
        want[d, len(p), len(gone), tuple(gone), "".join(s for i, s in enumerate(p) if i not in cut[d, t])] += 1
    got = Counter((r["doc_id"], r["n_sentences"], r["n_removed"], tuple(r["cut"]), r["kept"]) for r in S.remove(hard, least).collect())
    assert got == want


def test_empty(empty):
    assert S.remove(empty).collect() == []


def covered(docs, least):
    """Numbers of the sentences in any repeated run, of 2 sentences and `least` words or more, that is not its first."""
    places = defaultdict(list)
    for d, t in enumerate(docs):
        p = [(i, x) for i, x in enumerate(map(normal, pieces(t))) if x]
        for a in range(len(p)):
            for b in range(a + 2, len(p) + 1):
                if sum(len(x.split(" ")) for _, x in p[a:b]) >= least:
                    places[tuple(x for _, x in p[a:b])].append((d, p[a][0], p[b - 1][0]))
    cut = defaultdict(set)
    for where in places.values():
        for d, i, j in sorted(where)[1:]:
            cut[d] |= set(range(i, j + 1))
    return [sorted(cut[d]) for d in range(len(docs))]


def test_runs_of_every_length(spark):
    import random

    r = random.Random(6)
    some = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(7)) for _ in range(n)) + ". "
    four, tail = "".join(some(6) for _ in range(4)), "".join(some(n) for n in (30, 5, 5, 5, 6))
    many, last = "".join(some(2) for _ in range(11)), some(25)
    docs = [some(9) + x + some(8) for x in (four, four, tail, tail, many, many)] + [some(4) + last, some(3) + last]
    pool = [some(n) for n in (1, 2, 3, 4, 6, 9, 15, 22)]
    docs += ["".join(r.choice(pool) for _ in range(r.randint(1, 14))).upper() for _ in range(40)]
    got = {x["doc_id"]: x["cut"] for x in S.remove(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    want = covered(docs, S.LEAST)
    assert want[1] == [1, 2, 3, 4] and want[3] == [1, 2, 3, 4, 5] and want[7] == []
    assert [got[d] for d in range(len(docs))] == want
