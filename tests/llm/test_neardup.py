import functools
import random
import re
from collections import Counter

import numpy as np

from tracewell.llm import neardup as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute(texts, idf_of):
    """Least row number of the component of each text, over all pairs."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (texts[i] or "") == (texts[j] or "")
            if not same and a.keys() & b.keys():
                w = lambda s, c: c * sum(idf_of(x) for x in s) / len(s)
                both = sum(w(s, min(a[s], b[s])) for s in a.keys() & b.keys())
                total = sum(w(s, c) for s, c in a.items()) + sum(w(s, c) for s, c in b.items()) - both
                same = both >= 0.8 * total or len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys())
            if same:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def classes_of(values):
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(v, []).append(i)
    return sorted(map(tuple, groups.values()))


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice(("an", "the", "re", "on", "é", "ing", "ou", "tel")) for _ in range(3))
    texts = [" ".join(word() for _ in range(r.randint(120, 250))) for _ in range(12)] + ["", None, "a b", "A, b!", "a b", "... !", "...", "x"]
    for base in texts[:6]:
        for k in (1, 2, 3, 12):
            for _ in range(4):
                w = base.split(" ")
                for _ in range(k):
                    w[r.randrange(len(w))] = word()
                texts.append(" ".join(w))
    return texts


def test_classes_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    idf, n = N.document_frequency(N.key_columns(docs.select("text")))
    assert n == len(texts)

    @functools.cache
    def idf_of(w):
        h, _, _ = N.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        return idf[int(h[0]) >> 48]

    got = {r["doc_id"]: r for r in N.dedup(docs).collect()}
    assert classes_of([got[i]["class_id"] for i in range(len(texts))]) == classes_of(brute(texts, idf_of))
    assert all(got[r["class_id"]]["class_id"] == r["class_id"] for r in got.values())


def test_sampling_estimates_weighted_similarity():
    table = N.samples_table()
    rng = np.random.default_rng(3)
    mult = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sh = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    wa, wb = rng.choice([1.0, 1.5, 2.0, 4.0], 300), rng.choice([1.0, 1.5, 2.0, 4.0], 300)
    a, b = slice(0, 250), slice(60, 300)

    def sample(s, w):
        level = np.minimum((np.log(w) / N.STEP).astype(np.int64), N.LEVELS - 1) * N.ENTRIES
        return [int((table[level + ((s * m) >> np.uint64(52)).astype(np.int64)] ^ (s & np.uint64(0xFFFFFFFF))).min()) & 0xFFFFFFFF for m in mult]

    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = wa[a], wb[b]
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    got = np.mean(np.array(sample(sh[a], wa[a])) == np.array(sample(sh[b], wb[b])))
    assert abs(got - want) < 0.06


def test_hard_rows(hard, empty):
    rows = N.dedup(hard).collect()
    assert len(rows) == hard.count()
    kept = N.keep_one(hard)
    assert kept.columns == hard.columns
    got = kept.collect()
    ids = Counter(r["class_id"] for r in rows)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i in ids)
    assert N.dedup(empty).collect() == [] and N.keep_one(empty).collect() == []


def test_star_of_copies_is_one_class(spark):
    """Copies that are each like the original, but not like one another, in buckets where another text may lead."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(("an", "the", "re", "on", "é", "ing", "ou", "tel")) for _ in range(4))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(120):
            w = list(base)
            for _ in range(6):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["class_id"] for x in N.dedup(docs).collect()}
    idf, _ = N.document_frequency(N.key_columns(docs.select("text")))
    sets = [N.shingle_set(t.encode(), idf) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and N.similar(sets[i], sets[j], N.SIMILAR):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert classes_of([got[i] for i in range(len(texts))]) == classes_of(root)


def test_cells_find_every_link_between_components():
    """Against all pairs, with repeated shingles, rare and frequent ones and dense blocks of few columns."""
    r = random.Random(8)
    pool = [f"w{i}" for i in range(60)]
    base = [[r.choice(pool) for _ in range(r.randint(8, 60))] for _ in range(6)]
    texts = []
    for _ in range(90):
        w = list(r.choice(base)) * r.choice((1, 1, 1, 2))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(pool)
        texts.append(" ".join(w).encode())
    texts += [b"", b"one", b"one", b"one two one two one two one two one two"]
    y = np.array([r.random() < 0.6 for _ in texts])
    root = np.array([r.randrange(40) for _ in texts])
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 2, N.CLASSES)
    sets = [N.shingle_set(t, idf) for t in texts]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def joined(pairs):
        at = {x: x for x in root.tolist()}
        for i, j in pairs:
            a, b = at[int(root[i])], at[int(root[j])]
            at = {k: min(a, b) if v in (a, b) else v for k, v in at.items()}
        return at

    good = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if not y[i] and y[j] and N.similar(sets[i], sets[j], 0.8)]
    want = joined(good)
    assert len(set(want.values())) > 5
    dense, few = N.DENSE, N.FEW
    try:
        for N.DENSE, N.FEW in ((dense, few), (200, 3), (1, 1)):
            got = N.links_of(raw, off, y, root, idf, 0.8)
            assert set(got) <= set(good)
            assert joined(got) == want
    finally:
        N.DENSE, N.FEW = dense, few
