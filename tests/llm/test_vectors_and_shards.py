"""Vector near-dedup and shards against brute force."""

import random
import zlib

import numpy as np
import pytest

from daygrain.llm import sharding, vector_dedup
from tests.llm.data import ROWS
from tests.llm.test_dedup import components_by_hand

NAN, INF = float("nan"), float("inf")


def vectors():
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(6, 12))
    for i in range(160):
        v = centres[i % 6] + rng.normal(scale=0.25, size=12) * (1 + i % 3)
        rows.append((i, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)], int(i % 2)))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1)]
    rows += [(210, None, 0), (211, [0.0] * 12, 0), (212, [1.0, None] + [0.0] * 10, 0), (213, [NAN] * 12, 0)]
    rows += [(214, [INF] + [0.0] * 11, 0), (215, [], 0), (216, rows[0][1], None), (217, rows[0][1][:6], 0), (218, [0.0] * 12, 0)]
    rows += [(220, [1e200, 0.0] + [0.0] * 10, 0), (221, [1e-200, -0.0] + [0.0] * 10, 0), (None, rows[5][1], 1)]
    return rows


def links_by_hand(rows, threshold):
    unit = []
    for _, v, label in rows:
        fine = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.array(v) / np.abs(v).max() if fine else None)
        if fine:
            unit[-1] /= np.linalg.norm(unit[-1])
    out = []
    for i, a in enumerate(unit):
        for j in range(i + 1, len(rows)):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                out.append((i, j))
    return out


@pytest.mark.parametrize("tile", [7, 1024])
def test_vectors_match_brute_force(spark, tile):
    rows = vectors()
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int, root int")
    got = vector_dedup.similar_vectors(df, tile=tile).collect()
    links = links_by_hand(rows, 0.93)
    root = components_by_hand(list(range(len(rows))), links)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(root[i], []).append(r[0])
    expected = []
    for i, r in enumerate(rows):
        component = min((m for m in members[root[i]] if m is not None), default=None)
        expected.append((r[0], sum(i in x for x in links), component, r[0] == component))
    order = lambda x: str(x)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert len(links) > 200


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 2100):
        a = vector_dedup.Quantised(rng.normal(size=(80, dim)) * 10.0 ** rng.integers(-5, 5, (80, 1)))
        b = vector_dedup.Quantised(rng.standard_cauchy(size=(90, dim)))
        cosine = a.unit @ b.unit.T
        for threshold in np.quantile(cosine, [0.5, 0.99]):
            left, right = vector_dedup.doubtful_pairs(a, b, threshold)
            assert {tuple(x) for x in np.argwhere(cosine >= threshold)} <= set(zip(left.tolist(), right.tolist()))
            if dim == 64:
                assert len(left) < (cosine >= threshold - 0.1).sum()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.similar_vectors(df).count() == 0


# --- shards ------------------------------------------------------------------------------------------


def least_by_hand(sizes, shards):
    def fits(capacity):
        used, at = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if at + s > capacity:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def check_shards(got, rows, shards):
    assert len(got) == len(rows)
    size = {r[1] or "": len((r[1] or "").encode()) + 16 for r in rows}
    for r in got:
        assert r.size in size.values()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(shards))
    for x in by_shard.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    return {k: sum(r.size for r in x) for k, x in by_shard.items()}


@pytest.mark.parametrize("buckets,finer", [(4, 3), (1 << 14, 64)])
def test_capacity_is_the_least(spark, monkeypatch, buckets, finer):
    monkeypatch.setattr(sharding, "BUCKETS", buckets)
    monkeypatch.setattr(sharding, "FINER", finer)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.minimax_shards(docs, 9).collect()
    totals = check_shards(got, rows, 9)
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    shard_of = {}
    for r in got:
        assert shard_of.setdefault(text[r.doc_id], r.shard) == r.shard
    sizes, last = [], None
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        if text[r.doc_id] == last:
            sizes[-1] += r.size
        else:
            sizes.append(r.size)
        last = text[r.doc_id]
    assert max(totals.values()) == least_by_hand(sizes, 9)


def test_search_over_partly_known_ends():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))]
        ends = sharding.Ends(np.cumsum(sizes), np.arange(1, len(sizes) + 1))
        shards = rng.randrange(1, 12)
        low = max(-(-sum(sizes) // shards), max(sizes))
        least = ends.least_capacity(shards, low, hopeful=False)
        assert least == least_by_hand(sizes, shards) == ends.least_capacity(shards, low, hopeful=True)
        cuts = [0, *ends.cuts(shards, least)]
        assert cuts[-1] == sum(sizes) and all(0 <= b - a <= least for a, b in zip(cuts, cuts[1:]))
        known = sorted({*rng.sample(range(len(sizes)), rng.randrange(len(sizes))), len(sizes) - 1})
        some = sharding.Ends(ends.totals[known], ends.numbers[known])
        assert some.least_capacity(shards, low, hopeful=True) <= least <= some.least_capacity(shards, low, hopeful=False)


def test_awkward_rows(docs, no_docs):
    got = sharding.minimax_shards(docs, 4).collect()
    totals = check_shards(got, ROWS, 4)
    assert max(totals.values()) == max(r.size for r in got)  # the long text alone
    assert sharding.minimax_shards(no_docs, 4).count() == 0
