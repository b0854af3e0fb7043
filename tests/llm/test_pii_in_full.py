import hashlib

from facetlake.llm.pii import find_pii, pii_report

from . import test_pii

#: A character that each plain pattern cannot match without.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def test_long_texts_in_full(spark, monkeypatch):
    """Texts of up to 200,000 characters; the plain patterns are tried where the characters that they need occur."""
    base = dict(test_pii.BASE)
    texts = ["a" * 200_000, "1" * 100_000, "1 " * 60_000, "a." * 60_000 + "@" + "b." * 30_000, "1." * 60_000, "+1" * 20_000, "x@y.z " * 3000]
    got = {r.doc_id: r for r in pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        monkeypatch.setattr(test_pii, "BASE", {k: p for k, p in base.items() if NEEDS[k] in t})
        want = test_pii.brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for k in base:
            assert got[i][f"n_{k}"] == sum(x.startswith(k) for x in want)


def test_learning_ends_where_nothing_moves(spark):
    """More rounds and steps than the query's change no score."""
    texts = ["mail jo.doe [at] example [dot] com", "call 415-555-0100 now", "x 115-555-0100y", "id 215.555.0101", "x@y.zz at 10.0.0.1", "a.b (at) c.dot", "+1 (415) 555-0100"]
    rows = spark.createDataFrame([(i, texts[i % 7] + " ok" * (i % 3)) for i in range(140)], "doc_id long, text string")
    scores = lambda **more: {(r._id, r.kind, r.start): r.score for r in find_pii(rows, threshold=0.0, **more).collect()}
    usual, longer = scores(), scores(em_rounds=60, train_steps=60)
    assert usual.keys() == longer.keys() and len(usual) > 100
    assert max(abs(usual[k] - longer[k]) for k in usual) < 1e-6
