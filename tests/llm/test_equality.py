"""Equality is decided by bytes: texts that a polynomial hash modulo a power of two confuses, and forced clashes."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from facetlake.llm import textarrays
from facetlake.llm.jaccard_join import jaccard_components
from facetlake.llm.textarrays import distinct_runs, run_hashes


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


WORD = thue_morse(2048)
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def test_hashes_of_runs():
    rnd = np.random.default_rng(1)
    runs = [WORD.encode(), OTHER.encode(), b"", b"a", b"a\0", b"\0", b"x" * 513, b"x" * 512, b"x" * 514]
    runs += [rnd.integers(97, 99, rnd.integers(1, 40), np.uint8).tobytes() for _ in range(3000)]
    data = np.frombuffer(b"".join(r for r in runs if r), np.uint8)
    kept = [r for r in runs if r]
    starts = np.cumsum([0, *[len(r) for r in kept]])[:-1]
    hashes = run_hashes(data, starts)
    assert len(set(hashes.tolist())) == len(set(kept))
    assert len({(h, r) for h, r in zip(hashes.tolist(), kept)}) == len(set(kept))


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_distinct_runs_under_clashes(bits):
    rnd = np.random.default_rng(bits)
    kept = [rnd.integers(97, 99, rnd.integers(1, 9), np.uint8).tobytes() for _ in range(400)]
    data = np.frombuffer(b"".join(kept), np.uint8)
    starts = np.cumsum([0, *[len(r) for r in kept]])[:-1]
    hashes = run_hashes(data, starts) & np.uint64((1 << bits) - 1)
    first, which = distinct_runs(data, starts, hashes)
    assert [kept[first[w]] for w in which] == kept
    assert len(first) == len(set(kept))


def test_sentencepiece_of_confusable_words(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from facetlake.llm.catalog import tokenizer_path
    from facetlake.llm.sentencepiece_bpe import encode_texts

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = [f"{WORD} {OTHER}", f"{OTHER} {WORD}", WORD, OTHER, WORD, f"{WORD} {OTHER}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in encode_texts(df, tokenizer_path(), keep_ids=True).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_sentencepiece_under_clashes(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    from facetlake.llm.catalog import tokenizer_path
    from facetlake.llm.sentencepiece_bpe import vocabulary

    monkeypatch.setattr(textarrays, "run_hashes", lambda data, starts: np.zeros(len(starts), np.uint64))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = ["a house and a horse", "", "the the cat  sat", "é 日"]
    _, _, data, offsets = next(textarrays.chunks(pa.array(texts)))
    ids, bounds = vocabulary(tokenizer_path()).encode_chunk(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t) for t in texts]


def test_jaccard_of_confusable_words(spark):
    texts = [f"{WORD} one two three", f"{OTHER} one two three", f"{WORD} one two three", WORD, OTHER]
    got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
