"""Near-duplicate vectors against all cosines."""

import numpy as np

from facetlake.llm.embedding_dedup import near_duplicates, sketches, tables

SHAPE = "vec_id long, embedding array<float>, n long, label int"


def plain(rows, threshold=0.9):
    """{row number: (n_links, component, kept)} of rows (id, vector)."""
    ok = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = {i: [] for i in range(len(rows))}
    for i, (_, v) in enumerate(rows):
        for j, (_, w) in enumerate(rows[:i]):
            if ok[i] and ok[j] and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in links[k] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((name, len(links[i]), least, name == least))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SHAPE)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **options).collect()), key=str)


def floats(v):
    return [float(c) for c in np.float32(v)]


def groups(rng, dims, sizes, noise):
    out = []
    for size in sizes:
        centre = rng.standard_normal(dims)
        out += [floats((centre + noise * rng.standard_normal(dims)) * rng.uniform(0.1, 9)) for _ in range(size)]
    return out


def test_groups_against_all_cosines(spark):
    rng = np.random.default_rng(1)
    vectors = groups(rng, 24, [1] * 60 + [2] * 15 + [5] * 4 + [30], 0.12)
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1000, rows[3][1]), (rows[5][0], rows[5][1]), (None, rows[70][1]), (None, floats(rng.standard_normal(24)))]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] + [1.0] * 23), (2005, [None] + [1.0] * 23), (2006, [-0.0] * 24)]
    rows += [(2007, [1.0, 0.5]), (2008, [2.0, 1.0]), (2009, [2.0])]
    want = plain(rows)
    assert got(spark, rows) == want
    # The same in blocks of three rows, and with kernels wherever more than four nodes share a bucket.
    assert got(spark, rows, block=3) == want
    assert got(spark, rows, block=3, crowd=4) == want


def test_wide_groups_against_all_cosines(spark):
    """Chains and kernels with a rim: pairs on both sides of the threshold, many tables to lose none."""
    rng = np.random.default_rng(2)
    vectors = groups(rng, 16, [60, 40, 20, 10], 0.3) + groups(rng, 16, [50], 0.05)
    rows = [(i, v) for i, v in enumerate(vectors)]
    want = plain(rows)
    assert len({w[1] for w in want}) > 20
    assert got(spark, rows, recall=1 - 1e-9, block=16, crowd=12) == want
    assert got(spark, rows, recall=1 - 1e-9) == want


def test_a_third_of_all_rows_is_one_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else floats(rng.standard_normal(3) * 100)) for i in range(3000)]
    out = {r[0]: r for r in got(spark, rows, threshold=0.9999999)}
    same = [r for i, r in out.items() if i % 3 == 0]
    assert {r[1:] for r in same} == {(999, 0, True), (999, 0, False)} and sum(r[3] for r in same) == 1


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.9, over 50,000 nodes: some table finds nearly all, and the sketch keeps them all."""
    rng = np.random.default_rng(4)
    plan = tables(50_000, 0.9)
    a, b = rng.standard_normal((2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = lambda c: sketches(a).view(np.uint64) ^ sketches(c * a + np.sqrt(1 - c * c) * b).view(np.uint64)
    for cosine, least in ((0.9, 0.997), (0.95, 0.9998)):
        gap = near(cosine)
        assert (np.bitwise_count(gap).sum(1) <= plan.differ).all()
        assert (((gap[:, None] & plan.masks) == 0).all(2).any(1)).mean() >= least
    assert len(tables(10**6, 0.9).places) > len(plan.places)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, None)]) == [(1, 0, 1, True), (2, 0, 2, True)]
