import corpus_pipeline
import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from facetlake.llm.storage import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        out.append((name, docs))
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in steps[1:]] == ["quality_classifier", "exact_dedup", "jaccard_join", "decontaminate", "sentencepiece"]
    for _, df in steps[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    sizes = [df.count() for _, df in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_each_stage_against_brute_force(spark, steps):
    from tests.llm.test_joins import brute_components

    rows = [{r.doc_id: r.text for r in df.collect()} for _, df in steps[:-1]]
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SMALL}/labels.parquet'").fetchall())
    held = [i for i in labels if i in rows[0]]
    assert sum((i in rows[1]) == (labels[i] == 1) for i in held) >= 0.9 * len(held)
    first = {}
    for i in sorted(rows[1]):
        first.setdefault(" ".join(rows[1][i].split()), i)
    assert set(rows[2]) <= set(first.values()) and len(rows[2]) >= len(first) - 1
    ids = sorted(rows[2])
    _, label = brute_components([rows[2][i] for i in ids], 5, 80, 100)
    assert set(rows[3]) == {ids[k] for k, x in enumerate(label) if x == k}
    items = [t.lower() for (t,) in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
    gone = set(rows[3]) - set(rows[4])
    assert all(any(t in rows[3][i].lower() for t in items) for i in gone)
    assert not any(t in rows[4][i].lower() for i in rows[4] for t in items if len(t.split()) >= 5)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SMALL).count() == steps[-1][1].count()
