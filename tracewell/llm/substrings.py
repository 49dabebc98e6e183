"""2. Exact substring dedup with an enhanced suffix array.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in this or another text.

Which places can repeat?  Every window of `length` bytes has an anchor: the place of the least hash among its strings of
`gram` bytes, the leftmost of equals.  Equal windows have equal anchors, so only places whose anchor gram occurs twice
matter, and texts need comparing only around these.  An anchor's span is all that its windows cover.

1. Count anchor grams; keep the occurrences of those found twice (a shuffle of hashes, combined before).
2. Equal spans fold into one.  A span found twice is a repeat as a whole.
3. Different spans of one gram meet in one task: their suffixes from the anchor on are sorted (a sparse suffix array with
   common-prefix lengths), a stack scan gives the common-prefix intervals, and in each interval a second scan, over the
   reversed left sides, gives sets of occurrences that agree on m bytes to the left and l to the right, with diverse
   neighbours on both ends: maximal repeats, each with all its occurrences.
4. Grams with more than `hot` different spans are not brought to one task: their windows are counted by hash instead,
   combined before the shuffle.
5. Each text gets its repeats back and loses what they cover.

Nothing is capped, and no pair of copies is formed.  Texts travel compressed.

Defined cases: a null text is an empty one; a text shorter than `length` loses nothing; equal texts of at least that length
lose everything, in every copy; repeated rows are copies; null ids are kept; an empty table gives an empty result; other
columns are ignored; a very long text is searched in pieces of `PIECE` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, arrow_map, chunks, mix64, prefix_hash, schema_of, table, text_of, with_columns_of, written

LENGTH, GRAM, HOT = 200, 48, 4096
#: Texts above this many bytes are searched in overlapping pieces.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 26) - 1)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of w values, by runs of doubled length."""
    k, m = 1, x
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    n = len(x) - w + 1
    return np.minimum(m[:n], m[w - k : w - k + n])


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For each anchor of rows raw[off[i]:off[i+1]]: row, place, first and last window start, hashes of gram and span."""
    n = len(raw)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    p, q = prefix_hash(raw, _BYTE)
    grams = mix64((p[gram:] - p[: n - gram + 1]) * q[: n - gram + 1])
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    key = window_min(key, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.concatenate([first[1:], [len(key)]]) - 1
    place = (key[first] & _PLACE).astype(np.int64)
    # only the windows that lie in the row of their anchor
    row = np.searchsorted(off, place, side="right") - 1
    first, last = np.maximum(first, off[row]), np.minimum(last, off[row + 1] - length)
    use = first <= last
    row, place, first, last = row[use], place[use], first[use], last[use]
    end = last + length
    span = (p[end] - p[first]) * q[first]
    span = mix64(span ^ mix64((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - first).astype(np.uint64)))
    return row, place, first, last, grams[place], span


def text_anchors(raw: np.ndarray, off: np.ndarray, length: int, gram: int):
    """anchors(), and for a very long row in pieces, so that memory stays bounded; places are offsets in the row."""
    for i, j in chunks(off):
        a, b = int(off[i]), int(off[j])
        piece = PIECE if j - i == 1 else max(1, b - a)
        for s in range(a, max(b, a + 1), piece):
            e = min(b, s + piece + length - 1)
            o = off[i : j + 1] - a if e == b and s == a else np.array([0, e - s])
            row, place, first, last, h, sh = anchors(raw[s:e], o, length, gram)
            base = (o[row] if len(o) > 2 else 0) - (s - a)
            yield row + i, place - base, first - base, last - base, h, sh
            if e == b:
                break


def key_columns(docs: DataFrame) -> DataFrame:
    """docs with t (text, null as empty) and the key of the text: tid (long) and crc (long, 16 bits)."""
    t = docs.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return t.withColumns({"tid": F.xxhash64("t"), "crc": F.crc32("t").bitwiseAND(0xFFFF)})


def occurrences(docs: DataFrame, length: int, gram: int, hashes_only: bool = False) -> DataFrame:
    """Anchors of the texts.  loc packs crc, place, bytes left of the anchor and bytes from it on.

    A task passes on two copies of a text and leaves out the others, which tell nothing new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            tid = b.column("tid").to_numpy()
            crc = b.column("crc").to_numpy()
            raw, off = text_of(b, "t")
            use = np.zeros(len(tid), bool)
            for i, k in enumerate(tid.tolist()):
                seen[k] = c = seen.get(k, 0) + 1
                use[i] = c <= 2
            for row, place, first, last, h, sh in text_anchors(raw, off, length, gram):
                u = use[row]
                row, place, first, last, h, sh = row[u], place[u], first[u], last[u], h[u], sh[u]
                cols = [pa.array(h.view(np.int64))]
                if not hashes_only:
                    loc = (crc[row] << 47) | (place << 16) | ((place - first) << 8) | (last + length - place)
                    cols += [pa.array(sh.view(np.int64)), pa.array(tid[row]), pa.array(loc)]
                yield pa.RecordBatch.from_arrays(cols, ["h", "sh", "tid", "loc"][: len(cols)])

    return arrow_map(docs.select("t", "tid", "crc"), run, "h long" if hashes_only else "h long, sh long, tid long, loc long")


def packed(docs: DataFrame, keep: list[str], once: str | None = None) -> DataFrame:
    """The kept columns and the text compressed, z.  A task passes on the first row of each value of the column `once`."""
    schema = schema_of(docs, keep, "z binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        seen: set = set()
        for b in batches:
            if once:
                b = b.filter(pa.array([k not in seen and not seen.add(k) for k in b.column(once).to_pylist()], pa.bool_()))
            raw, off = text_of(b, "t")
            z = [c.compress(raw[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(z, pa.binary())], names=schema.names)

    return arrow_map(docs.select(*keep, "t"), run, schema)


# -- the suffix array of one gram's spans --------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, end) of sorted strings, by a stack scan; lcp[i] is of i-1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            if length >= least:
                yield length, left, i
        if not stack or stack[-1][0] < now:
            stack.append((now, left))


def maximal_repeats(spans: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(m, l, occurrences): sets of spans (left side, right side from the anchor on) that agree on m bytes before the
    anchor and l from it on, m + l >= length, and cannot all be extended on either end."""
    right = sorted(range(len(spans)), key=lambda i: spans[i][1])
    lcp = [0] + [common(spans[a][1], spans[b][1]) for a, b in zip(right, right[1:])]
    back = [s[0][::-1] for s in spans]
    most = max(len(b) for b in back)
    rank = {i: r for r, i in enumerate(sorted(range(len(spans)), key=lambda i: back[i]))}
    for l, lo, hi in intervals(lcp, length - most):  # noqa: E741
        child, c = {right[lo]: 0}, 0
        for i in range(lo + 1, hi):
            c += lcp[i] == l
            child[right[i]] = c
        left = sorted(child, key=rank.__getitem__)
        llcp = [0] + [common(back[a], back[b]) for a, b in zip(left, left[1:])]
        for m, a, b in intervals(llcp, max(0, length - l)):
            group = left[a:b]
            if len(group) > 1 and len({child[i] for i in group}) > 1:
                yield m, l, group


def covers(spans: list[tuple[bytes, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """What maximal repeats cover of each span, as [first, end) from the anchor."""
    out: list[set] = [set() for _ in spans]
    for m, l, group in maximal_repeats(spans, length):  # noqa: E741
        for i in group:
            out[i].add((-m, l))
    return [merge(x) for x in out]


def merge(spans) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(tid, crc, spans): the merged repeated stretches [first, end) of each text that has any."""
    texts = key_columns(docs)
    twice = occurrences(texts, length, gram, True).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    twice = written(twice)  # a plain side, so that the join can split a hot gram
    found = written(occurrences(texts, length, gram).join(twice, "h", "left_semi"))
    spans = written(found.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "loc")).alias("x")))
    many = spans.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    whole = spans.where("n > 1").select("h", "sh", F.lit(None).cast("array<array<int>>").alias("iv"))
    left, size = F.shiftright("loc", 8).bitwiseAND(0xFF), F.col("loc").bitwiseAND(0xFF)
    place = F.shiftright("loc", 16).bitwiseAND((1 << 31) - 1)
    crc = F.shiftright("loc", 47)
    # the bytes of the different spans of one gram
    want = spans.join(many, "h").select("h", "sh", "d", "n", F.col("x.tid").alias("tid"), F.col("x.loc").alias("loc"))
    want = want.groupBy("tid", crc.alias("crc")).agg(F.collect_list(F.struct("h", "sh", (F.col("d") > hot).alias("hot"), place.alias("at"), left.alias("l"), size.alias("r"), (F.col("n") > 1).alias("done"))).alias("want"))
    one = packed(texts, ["tid", "crc"]).groupBy("tid", "crc").agg(F.first("z").alias("z"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            rows = [[], [], [], [], [], []]
            for z, want in zip(b.column("z"), b.column("want")):
                t = d.decompress(z.as_py())
                for w in want.as_py():
                    p = w["at"]
                    for c, v in zip(rows, (w["h"], w["sh"], w["hot"], w["done"], t[p - w["l"] : p], t[p : p + w["r"]])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()))], names=["h", "sh", "hot", "done", "l", "r"])

    pieces = written(arrow_map(want.join(one, ["tid", "crc"]).select("z", "want"), cut, "h long, sh long, hot boolean, done boolean, l binary, r binary"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by h; a group is at most `hot` spans."""
        now, group = None, []

        def flush():
            if len(group) > 1:
                got = covers([(g[1], g[2]) for g in group], length)
                rows = [(g[0], iv) for g, iv in zip(group, got) if iv and not g[3]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([now] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([[list(x) for x in r[1]] for r in rows], pa.list_(pa.list_(pa.int32())))], names=["h", "sh", "iv"])

        for b in batches:
            for h, sh, done, l, r in zip(*(b.column(c).to_pylist() for c in ("h", "sh", "done", "l", "r"))):  # noqa: E741
                if h != now:
                    yield from flush()
                    now, group = h, []
                group.append((sh, l, r, done))
        yield from flush()

    few = pieces.where("not hot").select("h", "sh", "done", "l", "r").repartition("h").sortWithinPartitions("h")
    some = arrow_map(few, scan, "h long, sh long, iv array<array<int>>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, sh, l, r in zip(*(b.column(c).to_pylist() for c in ("h", "sh", "l", "r"))):  # noqa: E741
                t = l + r
                n = len(t) - length + 1
                raw = np.frombuffer(t, np.uint8)
                p, q = prefix_hash(raw, _BYTE)
                w = mix64((p[length:] - p[:n]) * q[:n])
                start = (np.arange(n) - len(l)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, sh)), pa.array(w.view(np.int64)), pa.array(start)], names=["h", "sh", "w", "s"])

    each = arrow_map(pieces.where("hot").select("h", "sh", "l", "r"), windows, "h long, sh long, w long, s int")
    again = each.groupBy("h", "w", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hot_ones = each.join(again, ["h", "w", "s"], "left_semi").groupBy("h", "sh").agg(F.collect_list(F.array(F.col("s"), F.col("s") + length)).alias("iv"))
    iv = whole.unionByName(some).unionByName(hot_ones.join(whole.select("h", "sh"), ["h", "sh"], "left_anti"))
    hits = found.join(written(iv), ["h", "sh"]).select("tid", crc.alias("crc"), place.alias("at"), left.alias("l"), size.alias("r"), "iv").distinct()
    full = F.array(F.array((-F.col("l")).cast("int"), F.col("r").cast("int")))
    hits = hits.select("tid", "crc", "at", F.explode(F.coalesce("iv", full)).alias("v"))
    return hits.groupBy("tid", "crc").agg(F.collect_set(F.struct((F.col("at") + F.col("v")[0]).alias("a"), (F.col("at") + F.col("v")[1]).alias("b"))).alias("spans"))


COLUMNS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """The kept columns of docs and COLUMNS for each row; with_text: also what is left of the text (bytes, kept)."""
    cover = written(repeats(docs, length, gram, hot))
    texts = packed(key_columns(docs), [*keep, "tid", "crc"])
    both = texts.join(cover, ["tid", "crc"], "left").select(*keep, "z", "spans")
    schema = schema_of(docs, keep, COLUMNS + ", kept binary" * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, spans in zip(b.column("z"), b.column("spans")):
                t = d.decompress(z.as_py())
                cut = merge((s["a"], s["b"]) for s in spans.as_py() or ())
                left, at = [], 0
                for x, y in cut:
                    left.append(t[at:x])
                    at = y
                left = b"".join([*left, t[at:]])
                rows.append((len(t), len(t) - len(left), len(cut), hashlib.sha256(left).hexdigest(), *[left] * with_text))
            cols = list(zip(*rows)) or [[]] * (4 + with_text)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return arrow_map(both, run, schema)


def op2_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string")))
