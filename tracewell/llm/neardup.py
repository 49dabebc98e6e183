"""1. Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A shingle is a run of five words (lower-cased letters, digits and non-ASCII characters); its weight is its count in the
text times the mean idf of its words, 1 + log((N + 1) / (df + 1)) / log(N + 1), where df is counted over all documents in
2^16 hashed word classes, a table of fixed size.

1. Each distinct text gets `BANDS * ROWS` samples (shingle, t).  Two texts share a sample with a probability of their
   weighted Jaccard similarity.  ROWS samples make a band; texts of one band hash share a bucket.
2. In a bucket each text is paired with the bucket's leader, the text of the least hash, by aggregates that are combined
   before the shuffle.  So a group of n copies gives at most BANDS * n pairs, never all; copies that share all their buckets
   have one leader in all of them.
3. These pairs are verified on the whole texts: similar means a weighted Jaccard similarity of `SIMILAR` or more, or the same
   for the plain one.  Verified pairs make components.
4. In a bucket whose texts still lie in several components, the texts outside the bucket's largest component meet all texts
   of the bucket in cells of bounded size.  A cell holds its texts' shingles as two matrices; their product gives the
   similarities, and only links that join two components leave the cell, never its pairs.  So each pair that shares
   a bucket lies in one component or has been verified.  Buckets of the same texts are met once.
   Each text of a bucket goes to as many cells as the bucket has blocks of `CELL` bytes: few for a group of thousands, but
   a group of n texts, pairwise not similar and yet sharing buckets, takes time that grows with n * n.
5. Classes are the connected components of verified pairs and of equal texts.

A pair of similarity 0.8 misses all bands with a probability of 0.0002; 0.9, of 10^-7.

Defined cases: a null text is an empty one; texts without words are alike only if equal; a text of fewer than five words
is one shingle; repeated rows share a class; class_id is the least doc_id of the class (null if it has none); an empty
table gives an empty result; other columns are ignored; a very long text is taken whole, alone in its chunk, and its memory
grows with its length; ties between equal samples fall to a hash of the shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, mix64, shingles_of, table, text_of, with_columns_of, words_of, written
from .components import components
from .substrings import key_columns, packed

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Bytes of one side of a cell, TEXT more for each text; entries of a dense matrix; texts of a shingle up to which it is rare.
CELL, TEXT, DENSE, FEW = 3 << 18, 1024, 1 << 22, 16
CLASSES = 1 << 16
ENTRIES, LEVELS, STEP = 1 << 12, 160, 0.08


def samples_table() -> np.ndarray:
    """For a weight level and an entry of random (r, c, beta): ln a in the high half, a hash of entry and t in the low.

    t = floor(ln S / r + beta) and ln a = ln c - r (t - beta + 1), with r and c of Gamma(2, 1) and beta uniform.
    """
    rng = np.random.default_rng(1)
    r, c, beta = rng.gamma(2, 1, ENTRIES), rng.gamma(2, 1, ENTRIES), rng.random(ENTRIES)
    weight = ((np.arange(LEVELS) + 0.5) * STEP)[:, None]
    t = np.floor(weight / r + beta)
    a = np.log(c) - r * (t - beta + 1)
    high = ((np.clip(a, -100, 20) + 100) * (2**32 / 121)).astype(np.uint64) << np.uint64(32)
    low = mix64((t.astype(np.int64).astype(np.uint64) << np.uint64(16)) ^ np.arange(ENTRIES, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return (high | low).ravel()


def counted(h: np.ndarray, ws: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with the weight of one and their counts, and the first shingle of each row (with end)."""
    sh, at, length, first = shingles_of(h, ws, SHINGLE)
    if not len(sh):
        return sh, np.zeros(0), np.zeros(0, np.int64), first
    total = np.concatenate([[0.0], np.cumsum(idf[(h >> np.uint64(48)).astype(np.int64)])])
    w = (total[at + length] - total[at]) / length
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix64(sh + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    count = np.ones(len(sh), np.int64)
    if not len(twice):
        return sh, w, count, first
    place = np.searchsorted(twice, key)
    place[place == len(twice)] = 0
    again = np.flatnonzero(twice[place] == key)
    _, one, n = np.unique(key[again], return_index=True, return_counts=True)
    keep = np.ones(len(sh), bool)
    keep[again] = False
    keep[again[one]] = True
    count[again[one]] = n
    return sh[keep], w[keep], count[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def weights(h: np.ndarray, ws: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their weights, and the first shingle of each row (with end)."""
    sh, w, n, first = counted(h, ws, idf)
    return sh, w * n, first


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """idf of the word classes and the number of documents: one row a class comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(CLASSES, np.int64), 0
        for b in batches:
            raw, off = text_of(b, "t")
            n += len(off) - 1
            for i, j in chunks(off):
                h, s, _ = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                row = np.searchsorted(off[i : j + 1] - off[i], s, side="right") - 1
                key = np.unique((row << 16) | (h >> np.uint64(48)).astype(np.int64))
                df += np.bincount(key & (CLASSES - 1), minlength=CLASSES)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()]), pa.array([n, *df[used].tolist()])], names=["c", "n"])

    out = np.zeros(CLASSES + 1, np.int64)
    for r in arrow_map(texts.select("t"), run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[r["c"]] = r["n"]
    n = int(out[-1])
    return 1 + np.log((n + 1) / (out[:-1] + 1)) / math.log(n + 2), n


def signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(tid, bands): the band hashes of each distinct text that has words."""
    lookup = samples_table()
    mult = np.random.default_rng(2).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tid = b.column("tid").to_numpy()
            raw, off = text_of(b, "t")
            ids, bands = [], []
            for i, j in chunks(off):
                new = [k for k in range(i, j) if tid[k] not in seen and not seen.add(tid[k])]
                if not new:
                    continue
                h, s, _ = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                sh, w, first = weights(h, np.searchsorted(s, off[i : j + 1] - off[i]), idf)
                rows = np.array([k - i for k in new])
                rows = rows[first[rows + 1] > first[rows]]
                if not len(rows):
                    continue
                # the shingles of the rows wanted, side by side
                n = first[rows + 1] - first[rows]
                start = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(first[rows] - start[:-1], n) + np.arange(start[-1])
                sh, w, start = sh[at], w[at], start[:-1]
                level = np.minimum((np.log(w) / STEP).astype(np.int64), LEVELS - 1) * ENTRIES
                low = sh & np.uint64(0xFFFFFFFF)
                sig = np.empty((len(rows), BANDS * ROWS), np.uint64)
                for k, m in enumerate(mult):
                    v = lookup[level + ((sh * m) >> np.uint64(52)).astype(np.int64)] ^ low
                    sig[:, k] = np.minimum.reduceat(v, start) & np.uint64(0xFFFFFFFF)
                x = np.zeros((len(rows), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    x = mix64(x * np.uint64(31) + sig[:, k::ROWS])
                ids.append(tid[i:j][rows])
                bands.append(x)
            if ids:
                flat = np.concatenate(bands).ravel().view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), lists], names=["tid", "bands"])

    return arrow_map(texts.select("t", "tid"), run, "tid long, bands array<long>").dropDuplicates(["tid"])


def buckets(sig: DataFrame) -> DataFrame:
    """(h, tid, l): the texts of each bucket of two or more and the bucket's leader."""
    rows = sig.select("tid", F.explode("bands").alias("h"))
    drawn = F.struct(F.xxhash64(F.lit(1), "tid"), F.col("tid"))
    lead = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("l")).where("n > 1")
    return rows.join(lead.select("h", F.col("l.tid").alias("l")), "h")


def candidates(near: DataFrame) -> DataFrame:
    """(a, b), a < b: each text with the leaders of its buckets."""
    return near.where("tid <> l").select(F.least("tid", "l").alias("a"), F.greatest("tid", "l").alias("b")).distinct()


def cells(near: DataFrame, roots: DataFrame, need: DataFrame) -> DataFrame:
    """(h, p, q, y, tid, r, z): the texts of each cell, on its first (y false) or second side, with their components r."""
    at = near.select("h", "tid").join(roots.toDF("node", "r"), F.col("tid") == F.col("node"), "left").select("h", "tid", F.coalesce("r", "tid").alias("r"))
    at = written(at.join(need.select(F.col("tid").alias("t0"), (F.col("size") + TEXT).alias("w")), F.col("tid") == F.col("t0")).drop("t0"))
    mark = F.bit_xor(F.xxhash64("tid", F.lit(7)))
    of = at.groupBy("h", "r").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"), mark.alias("x"), F.min("tid").alias("m")).groupBy("h")
    of = of.agg(F.max(F.struct("w", "r")).alias("most"), F.sum("w").alias("w"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.bit_xor("x").alias("x"), F.min("m").alias("m"))
    # the pair of a bucket of two is verified already; buckets of the same texts give the same links
    of = of.where("k > 1 and n > 2").groupBy("n", "x", "m").agg(F.min(F.struct("h", "most", "w")).alias("b")).select("b.*")
    blocks = lambda w: F.ceil(w / CELL).cast("int")
    of = written(of.select("h", F.col("most.r").alias("major"), blocks(F.col("w")).alias("all"), blocks(F.col("w") - F.col("most.w")).alias("few")))
    block = lambda n: F.pmod(F.xxhash64("tid", "h"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda p, q, y: F.struct(p.alias("p"), q.alias("q"), F.lit(y).alias("y"))
    first = F.when(F.col("r") != F.col("major"), F.transform(every("all"), lambda q: cell(block("few"), q, False)))
    second = F.transform(every("few"), lambda p: cell(p, block("all"), True))
    met = at.join(of, "h").select("h", "tid", "r", F.explode(F.concat(F.coalesce(first, F.array().cast("array<struct<p:int,q:int,y:boolean>>")), second)).alias("c"))
    return met.select("h", "c.*", "tid", "r").join(need.select(F.col("tid").alias("t0"), "z"), F.col("tid") == F.col("t0")).drop("t0")


def shared(sh: np.ndarray, w: np.ndarray, n: np.ndarray, first: np.ndarray):
    """Shingles found in two or more rows as numbered columns, the frequent ones first: rows and columns of the entries, in
    the order of columns, the number of frequent columns, whether a column is the first of its shingle, and weights.

    A shingle found k times in a row is k columns, so that sums of products are sums of least weights.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    more = np.repeat(np.arange(len(sh)), n)
    level = np.arange(len(more)) - np.repeat(np.cumsum(n) - n, n)
    key, row = mix64(sh[more] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), row[more]
    _, one, col, df = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    two = np.flatnonzero(df > 1)
    two = two[np.argsort(df[two] <= FEW, kind="stable")]
    number = np.full(len(df), -1)
    number[two] = np.arange(len(two))
    col = number[col]
    order = np.argsort(col, kind="stable")[np.count_nonzero(col < 0) :]
    return row[order], col[order], np.count_nonzero(df[two] > FEW), level[one[two]] == 0, w[more][one[two]]


def links_of(raw: np.ndarray, off: np.ndarray, y: np.ndarray, root: np.ndarray, idf: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows (of the first side, of the second) that are similar: enough to join all components that have any."""
    parts = []
    for i, j in chunks(off):
        o = off[i : j + 1] - off[i]
        h, s, _ = words_of(raw[off[i] : off[j]], o)
        parts.append(counted(h, np.searchsorted(s, o), idf))
    sh, w, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
    weight, kinds = np.diff(np.concatenate([[0.0], np.cumsum(w * n)])[first]), np.diff(first)
    row, col, often, kind, of = shared(sh, w, n, first)
    up, down = np.flatnonzero(~y), np.flatnonzero(y)
    place = np.empty(len(y), np.int64)
    place[up], place[down] = np.arange(len(up)), np.arange(len(down))
    wide = max(1, DENSE // max(1, len(down)))
    step = max(1, DENSE // max(1, len(down), min(wide, often)))
    dense = np.searchsorted(col, [*range(0, often, wide), often])
    joined: dict[int, int] = {}

    def end(r: int) -> int:
        while (up := joined.get(r, r)) != r:
            r = up
        return r

    # entries of rare columns, paired across the sides
    rare_i, rare_j, rare_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    r, c = row[dense[-1] :], col[dense[-1] :]
    for gap in range(1, FEW):
        at = np.flatnonzero((c[gap:] == c[:-gap]) & (y[r[gap:]] != y[r[:-gap]]))
        p, q = r[at], r[at + gap]
        rare_i.append(place[np.where(y[p], q, p)])
        rare_j.append(place[np.where(y[p], p, q)])
        rare_c.append(c[at])
    rare_i, rare_j, rare_c = (np.concatenate(x) for x in (rare_i, rare_j, rare_c))

    out = []
    for a in range(0, len(up), step):
        few = up[a : a + step]
        size = (len(few), len(down))
        mine = (rare_i >= a) & (rare_i < a + step)
        flat, c = (rare_i[mine] - a) * len(down) + rare_j[mine], rare_c[mine]
        both = np.bincount(flat, of[c], minlength=size[0] * size[1]).astype(float).reshape(size)
        same = np.bincount(flat, kind[c], minlength=size[0] * size[1]).astype(float).reshape(size)
        for k in range(len(dense) - 1):
            r, c = row[dense[k] : dense[k + 1]], col[dense[k] : dense[k + 1]] - k * wide
            m = min(wide, often - k * wide)
            right, x = np.zeros((len(down), m)), np.zeros((len(few), m))
            right[place[r[y[r]]], c[y[r]]] = 1
            mine = ~y[r] & (place[r] >= a) & (place[r] < a + step)
            x[place[r[mine]] - a, c[mine]] = 1
            same += (x * kind[k * wide : k * wide + m]) @ right.T
            both += (x * of[k * wide : k * wide + m]) @ right.T
        like = both >= least * (weight[few][:, None] + weight[down][None, :] - both) - 1e-9
        like |= same >= least * (kinds[few][:, None] + kinds[down][None, :] - same)
        like &= (root[few][:, None] != root[down][None, :]) & (same > 0)
        i, j = np.nonzero(like)
        if len(i):
            _, one = np.unique(np.stack([root[few[i]], root[down[j]]]), axis=1, return_index=True)
            for p, q in zip(few[i[one]].tolist(), down[j[one]].tolist()):
                e, f = end(int(root[p])), end(int(root[q]))
                if e != f:
                    joined[max(e, f)] = min(e, f)
                    out.append((p, q))
    return out


def links(met: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """(a, b) of cells: components with similar texts, enough to join all that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell."""
        d = zstandard.ZstdDecompressor()
        now, group = None, []

        def flush():
            if len({g[1] for g in group}) > 1:
                texts = [d.decompress(g[2]) for g in group]
                off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                y, root = (np.array([g[k] for g in group]) for k in (0, 1))
                got = links_of(np.frombuffer(b"".join(texts), np.uint8), off, y.astype(bool), root, idf, least)
                if got:
                    p, q = (root[list(x)] for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        for batch in batches:
            key = zip(*(batch.column(c).to_pylist() for c in ("h", "p", "q")))
            for k, *g in zip(key, *(batch.column(c).to_pylist() for c in ("y", "r", "z"))):
                if k != now:
                    yield from flush()
                    now, group = k, []
                group.append(g)
        yield from flush()

    met = met.select("h", "p", "q", "y", "r", "z").repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
    return arrow_map(met, run, "a long, b long")


def similar(x: tuple, y: tuple, least: float) -> bool:
    """Is the weighted or the plain Jaccard similarity of two weighted shingle sets (sorted, with weights) `least` or more?"""
    (a, wa), (b, wb) = x, y
    if not len(a) or not len(b):
        return False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return both >= least * (wa.sum() + wb.sum() - both) - 1e-9 or len(i) >= least * (len(a) + len(b) - len(i))


def shingle_set(t: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _ = words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    sh, w, _ = weights(h, np.array([0, len(h)]), idf)
    order = np.argsort(sh)
    return sh[order], w[order]


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (tid, z) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        now, of = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (p, za, zb) in enumerate(zip(a, batch.column("za"), batch.column("zb"))):
                if p != now:
                    now, of = p, shingle_set(d.decompress(za.as_py()), idf)
                if similar(of, shingle_set(d.decompress(zb.as_py()), idf), least):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    both = pairs.join(texts.toDF("b", "zb"), "b").join(texts.toDF("a", "za"), "a")
    return arrow_map(both.select("a", "za", "b", "zb"), run, "a long, b long")


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(tid, root) of the texts that have a similar one; tid is the hash of a text."""
    texts = key_columns(docs.select("text"))
    idf, _ = document_frequency(texts)
    near = written(buckets(signatures(texts, idf)))
    pairs = written(candidates(near))
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct())
    need = packed(texts.select("t", "tid", F.octet_length("t").alias("size")), ["tid", "size"], "tid").join(nodes, "tid", "left_semi")
    need = written(need.groupBy("tid").agg(F.first("z").alias("z"), F.first("size").alias("size")))
    bodies = need.select("tid", "z")
    roots = written(components(verified(pairs, bodies, idf, least)))
    over = written(components(links(cells(near, roots, need), idf, least))).toDF("part", "over")  # components of components
    joined = roots.join(over, F.col("root") == F.col("part"), "left").select(F.col("node").alias("tid"), F.coalesce("over", "root").alias("root"))
    alone = over.join(roots, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("tid"), F.col("over").alias("root"))
    return joined.unionByName(alone)


def labelled(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """id, tid and root (of the class) of every row of docs."""
    roots = written(classes(docs, least)).toDF("tid0", "root")
    t = docs.select(F.col("doc_id").alias("id"), text_hash().alias("tid"))
    return written(t.join(roots, F.col("tid") == F.col("tid0"), "left").select("id", "tid", F.coalesce("root", "tid").alias("root")))


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def dedup(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size (rows) and n_texts (different texts of the class) of every row of docs."""
    t = labelled(docs, least)
    by_text = t.groupBy("root", "tid").agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n"))
    of = by_text.groupBy(F.col("root").alias("root0")).agg(F.min("i").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    of = written(of)  # a plain side, so that the join can split a hot class
    return t.join(of, F.col("root") == F.col("root0")).select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_texts")


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of each class, of the least doc_id (not null, if there is one), then of the least text hash: same columns.

    Of rows with the same doc_id and text, the one whose JSON has the least hash stays.  Rows are found again by doc_id
    and text hash, so that a second scan of docs need not give them in the same order.
    """
    t = labelled(docs, least)
    lead = t.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("x"))
    lead = written(lead.select(F.col("x.id").alias("__id0"), F.col("x.tid").alias("__tid0")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), text_hash().alias("__tid"))
    rows = rows.join(lead.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__id0")) & (F.col("__tid") == F.col("__tid0")), "left_semi")
    rows = rows.groupBy("__id", "__tid").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string")))
