import corpus_pipeline
import pytest

PROSE = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ash", "birch", "cedar", "elm", "fir")]


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup_stage, corpus_pipeline.jaccard_stage])
def test_one_row_of_each_group(spark, stage):
    """Ids that are missing or repeat, with one text or several."""
    rows = [
        (None, PROSE[0]),  # clean, without an id
        (None, PROSE[1]), (4, PROSE[1]), (9, PROSE[1]),  # the smallest id stays
        (None, PROSE[2]), (None, PROSE[2]),  # no id at all: one stays
        (1, PROSE[3]), (1, PROSE[3]), (1, PROSE[3]),  # repeated rows: one stays
        (2, PROSE[3]), (2, PROSE[4]),  # one id, two texts: the copy goes
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = stage(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == [(PROSE[0], None), (PROSE[1], 4), (PROSE[2], None), (PROSE[3], 1), (PROSE[4], 2)]
