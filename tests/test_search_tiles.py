"""Searches by tiles of a bounded size against plain sorting, with many ties and over the tiles' borders."""

import numpy as np
import pyarrow as pa

from facetlake.operators import classify, search


def test_tiles_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000))})
    parts = list(search.slices(batch))
    assert max(len(p) for p in parts) <= 2048 and sum(len(p) for p in parts) == 10_000
    at = list(search.blocks(5000))
    assert max(len(b) for b in at) <= 1024 and np.concatenate(at).tolist() == list(range(5000))


def test_best_of_many_tied_rows():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 6, (1300, 4000)) / 4, rng.permutation(4000).tolist()
    best = search.Best(ids[:1300], 3)
    for lo in range(0, 4000, 999):
        for at in search.blocks(1300):
            best.offer(at, scores[at, lo : lo + 999], ids[lo : lo + 999])
    want = [(ids[q], *r) for q in range(1300) for r in sorted(((s, i) for s, i in zip(scores[q].tolist(), ids, strict=True) if i != ids[q]), key=lambda r: (-r[0], r[1]))[:3]]
    assert best.rows() == want


def test_euclidean_shares_over_tiles(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (2300, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist(), i % 7) for i, x in enumerate(v)], "id long, v array<double>, label int").coalesce(1)
    got = {(r.query_id, r.cluster): r.share for r in classify.euclidean_shares(rows.where("id % 2 = 0"), rows, "id", "v", "label", 5).collect()}
    want = {}
    for q in range(0, 2300, 2):
        near = sorted((round(float(np.sqrt(((v[q] - v[i]) ** 2).sum())), 6), i) for i in range(2300) if i != q)[:5]
        own = {}
        for d, i in near:
            own[i % 7] = own.get(i % 7, 0.0) + 1 / (d + 1e-6)
        want |= {(q, c): w / sum(own.values()) for c, w in own.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
