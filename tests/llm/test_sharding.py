import random
import zlib

import pytest

from tracewell.llm import sharding as S


def best(sizes, shards):
    """The least capacity for contiguous shards, by the plain greedy over every size."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards,bits", [(1, 4), (3, 4), (7, 1), (24, 12), (200, 2)])
def test_capacity_is_the_smallest(spark, shards, bits):
    r = random.Random(shards)
    sizes = {r.getrandbits(64) - 2**63: r.choice((8, 9, 50, 700, 4000)) for _ in range(150)}
    groups = spark.createDataFrame(list(sizes.items()), "h long, bytes long")
    capacity, cuts = S.partition(groups, shards, bits)
    ordered = [sizes[h] for h in sorted(sizes)]
    assert capacity == best(ordered, shards)
    loads = [sum(b for h, b in sizes.items() if a < h <= e) for a, e in zip([-(2**63) - 1, *cuts], [*cuts, 2**63])]
    assert max(loads) == capacity and len(loads) <= shards


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_rows_slots_and_groups(hard, shards):
    rows = S.assign(hard, shards).collect()
    assert len(rows) == hard.count()
    home = {}
    for r in rows:
        assert home.setdefault(r["text"] or "", r["shard"]) == r["shard"]
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
    for s in {r["shard"] for r in rows}:
        assert 0 <= s < shards
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_empty(empty):
    assert S.assign(empty, 24).collect() == []
