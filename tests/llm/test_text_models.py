import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from facetlake.llm import language_id, quality
from facetlake.llm.textarrays import MAX_BYTES, SIGN_CLASS, WORD_CLASS, chunks, lowered, tokens, windows

EN = "the cat sat on the mat and then it ran to the house with another dog that was there"
DE = "der hund lief durch den garten und die katze schlief auf dem warmen ofen während es regnete"


def sentences(words, count, rnd):
    return [" ".join(rnd.choice(words.split()) for _ in range(rnd.randint(5, 30))) for _ in range(count)]


def test_tokens_match_a_plain_split():
    texts = ["", None, " a  b\tc", "x" * 50, "é ü\nab", "a\x0b\x0c b ", "no", " "]
    for row, end, data, offsets in chunks(pa.array(texts, pa.string()), 20):
        hashes, starts, ends, bounds = tokens(lowered(data), offsets, WORD_CLASS)
        for i in range(end - row):
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])]
            assert got == (texts[row + i] or "").split()
    _, _, data, offsets = next(chunks(pa.array(["foo bar foo BAR foo"])))
    h = tokens(lowered(data), offsets, WORD_CLASS)[0]
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    w = windows(h, 2)
    assert w[0] == w[2] and w[1] == w[3] and w[0] != w[1]
    assert len(windows(h, 6)) == 0
    assert tokens(data[:0], np.zeros(2, np.int64), SIGN_CLASS)[3].tolist() == [0, 0]
    assert MAX_BYTES > 0


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(t, "en") for t in sentences(EN, 60, rnd)] + [(t, "de") for t in sentences(DE, 60, rnd)] + [(None, "en"), ("x", None), ("", "de")]
    return language_id.train(spark.createDataFrame(rows, "text string, lang string"), order=3)


def plain_kneser_ney(texts, order):
    """p(sign | signs before it) by the definition, for one language, in dictionaries."""
    def row(t):
        out = [0]
        for ch in t.lower():
            x = ord(ch) if ch.isalpha() else 0
            if x or out[-1]:
                out.append(x)
        return out + [0] if out[-1] else out

    count = {n: {} for n in range(1, order + 1)}
    for t in texts:
        signs_ = row(t)
        for i in range(1, len(signs_)):
            gram = tuple(([0] * order + signs_[: i + 1])[-order:])
            count[order][gram] = count[order].get(gram, 0) + 1
    for n in range(order - 1, 0, -1):
        for gram in count[n + 1]:
            count[n][gram[1:]] = count[n].get(gram[1:], 0) + 1
    spread = len({x for g in count[order] for x in g}) + 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / spread
        values = list(count[n].values())
        once, twice = values.count(1), values.count(2)
        d = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
        same = [c for g, c in count[n].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(count[n].get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p, row


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_like_a_plain_one(spark, order):
    texts = {"a": ["The cat sat, on a mat!", "a cat; the hat", "日本 語"], "b": ["der hund läuft", "DIE Katze 7 schläft hund"]}
    rows = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts], "text string, lang string")
    counted = language_id.count_grams(rows, order).toArrow()
    rest = counted.column("rest").to_numpy()
    columns = [rest >> (21 * k) & (2**21 - 1) for k in range(min(order, 3))] + [counted.column("first").to_numpy()] * (order > 3)
    which = np.array([{"a": 0, "b": 1}[x] for x in counted.column("lang").to_pylist()])
    model = language_id.kneser_ney(["a", "b"], order, columns, which, counted.column("n").to_numpy())
    spread = model.spread
    for k, lang in enumerate("ab"):
        p, row = plain_kneser_ney(texts[lang], order)
        for text in ["the cat", "katze über 日 x", "sat sat"]:
            signs_ = row(text)
            _, _, data, offsets = next(chunks(pa.array([text])))
            symbols, bounds = language_id.signs(data, offsets)
            assert symbols.tolist() == signs_
            got = model.log_probabilities(language_id._before(symbols, bounds, order))[1:, k]
            want = []
            for i in range(1, len(signs_)):
                gram = tuple(([0] * order + signs_[: i + 1])[-order:])
                want.append(float(np.log(p_with(p, gram, spread, texts[lang], order, row))))
            assert np.allclose(got, want, atol=1e-4), (lang, text)


def p_with(p, gram, spread, texts, order, row):
    """The plain model's even spread is over its own signs; the joint model's is over those of all languages."""
    return p(gram) + (1 / spread - p(())) * leftover(p, gram, texts, order, row)


def leftover(p, gram, texts, order, row):
    """How much of the even spread reaches p(gram): its derivative, by asking for a sign that no text has."""
    unseen = gram[:-1] + (0x10FFFF,)
    return p(unseen) / p(())


def test_language_probabilities_sum_to_one(model):
    letters = np.unique(np.array([ord(c) for c in (EN + DE).replace(" ", "")]))
    signs_ = np.concatenate([[0, 0x10FFFF], letters]).astype(np.uint32)
    assert len(signs_) == model.spread
    for before in ([0, 0], [ord("t"), 0], [ord("h"), ord("t")], [ord("q"), ord("q")]):
        columns = [signs_] + [np.full(len(signs_), x, np.uint32) for x in before]
        p = np.exp(model.log_probabilities(columns)).sum(0)
        assert np.allclose(p, 1, atol=1e-4)


def test_language_ties_and_limits(spark):
    """Languages with the same text tie: the first by name. Too many languages or grams are an error."""
    same = spark.createDataFrame([("abc abd " * 5 + str(i), lang) for i in range(40) for lang in ("zz", "aa")], "text string, lang string")
    model = language_id.train(same)
    row = language_id.identify(spark.createDataFrame([(1, "abc abd")], "doc_id long, text string"), model).first()
    assert row.lang_pred == "aa" and abs(row.score - 0.5) < 1e-6 and not row.rejected
    with pytest.raises(ValueError, match="languages"):
        language_id.train(same, max_languages=1)
    with pytest.raises(ValueError, match="grams"):
        language_id.train(same, max_grams=3)


def test_language_held_out_and_edges(spark, model):
    rnd = random.Random(2)
    rows = [(i, t, "en", i) for i, t in enumerate(sentences(EN, 20, rnd))] + [(100 + i, t, "de", 0) for i, t in enumerate(sentences(DE, 20, rnd))]
    rows += [(900, None, "x", 0), (901, "", "x", 0), (902, "12 !!", "x", 0), (903, "the cat " * 30_000, "x", 0), (904, "漢字", "x", 0), (904, "漢字", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score long")
    got = language_id.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].lang_pred == r[2] for r in rows if r[0] < 900)
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "en"
    assert by[904].rejected and not by[0].rejected
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = language_id.train(empty)
    assert language_id.identify(empty, none).count() == 0
    row = language_id.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), none).first()
    assert row.lang_pred == "und" and row.score == 0


def test_quality_held_out_and_edges(spark):
    rnd = random.Random(3)
    good = sentences(EN, 150, rnd)
    bad = [" ".join(w + rnd.choice(["!!", "%%%", " |"]) for w in t.split()) for t in sentences(EN, 150, rnd)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)] + [(5000, "x", None), (5001, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.where("doc_id % 5 <> 0"))
    held = df.where("doc_id % 5 = 0 and quality is not null")
    got = {r.doc_id: r for r in quality.score_quality(held, model).collect()}
    right = [got[r[0]].predicted == r[2] for r in rows if r[0] in got]
    assert len(right) > 50 and np.mean(right) > 0.95
    edge = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "the cat " * 50_000, "c"), (3, "é", "d")], "doc_id long, text string, score string")
    scores = quality.score_quality(edge, model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    assert quality.keep_good(edge, model).columns == ["doc_id", "text", "score"]
    same = quality.train(df.where("doc_id % 5 <> 0"))
    assert np.allclose(same.weights, model.weights)


def test_leader_like_a_plain_one():
    """The same steps, a place at a time, in dictionaries."""
    import math

    rnd = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        place = np.sort(rnd.choice(40, rnd.integers(0, 12), replace=False))
        rows.append((place, rnd.random(len(place)), int(rnd.integers(0, 2))))
    alpha, beta, l1, l2 = 0.7, 1.0, 0.8, 0.01
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(3):
        for place, value, label in rows:
            x = [*zip(place.tolist(), value.tolist()), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got, bias = quality.ftrl(rows, 40, alpha, beta, l1, l2, 3)
    assert np.allclose(got, [weight(i) for i in range(40)]) and abs(bias - weight("bias")) < 1e-9
    assert 0 < (got == 0).sum() < 40


def test_quality_sample(spark):
    """At most so many ids, one row of each that repeats, the largest of several labels; a score at the threshold passes."""
    rows = [(i % 50, i % 2) for i in range(400)] + [(None, 1), (7, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    some = quality.sample_rows(labels, max_rows=20).collect()
    assert len(some) == len({r.doc_id for r in some}) == 20
    every = {r.doc_id: r.quality for r in quality.sample_rows(labels, max_rows=10**12).collect()}
    assert every == {i: i % 2 for i in range(50)}
    twice = spark.createDataFrame([(1, "good text here", 1)] * 30 + [(2, "|| ## ||", 0)], "doc_id long, text string, quality int")
    once = twice.dropDuplicates()
    assert np.allclose(quality.train(twice).weights, quality.train(once).weights)
    flat = quality.QualityModel(4, np.zeros(16, np.float32), float(np.log(0.3 / 0.7)))
    scored = quality.score_quality(once, flat, threshold=float(1 / (1 + np.exp(-flat.bias)))).collect()
    assert [r.predicted for r in scored] == [1, 1]


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = quality.train(empty)
    row = quality.score_quality(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()
    assert row.score == 0.5
    assert quality.score_quality(empty, model).count() == 0


def test_sentencepiece_like_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from facetlake.llm.catalog import tokenizer_path
    from facetlake.llm.sentencepiece_bpe import encode_texts

    path = tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(4)
    alphabet = "aeinorst  \n▁éß日😀.,-<>0A\t\x00"
    texts = ["", None, " ", "  a", "a  b ", "\n a", "▁", "a▁b", "<s> </s>", "x\r\n", "a" * 3000, "a b " * 20_000, "日本 語" * 50, "ab" * 400 + " " * 40]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in encode_texts(df, path, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids, repr(t)[:80]
        assert got[i].decoded == library.decode(ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_texts(df.limit(0), path).count() == 0
