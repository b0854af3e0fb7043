"""Greedy string tiling against a plain version, repetitive and very long texts, repeated rows and ids."""

import random
import re
import time

import pytest
from facetlake.llm.decontaminate import clean, contaminated, load_tests


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute_tiles(item, text, tile):
    """The longest common run of unmarked tokens, leftmost in the item and then in the text, again and again."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and p + n not in used_i and t + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < tile:
            return sorted(out)
        out.append((p, t, n))
        used_i |= set(range(p, p + n))
        used_t |= set(range(t, t + n))


@pytest.mark.parametrize("letters", [2, 5, 40])
def test_tiles_like_brute_force(spark, letters):
    rnd = random.Random(letters)
    make = lambda n: [f"w{rnd.randrange(letters)}" for _ in range(n)]
    items = [make(rnd.randint(1, 40)) for _ in range(8)] + [["w0"] * 12, ["w0"] * 3]
    texts = [make(rnd.randint(0, 60)) for _ in range(12)]
    for k in range(12):
        item = items[k % len(items)]
        cut = rnd.randrange(len(item) + 1)
        texts.append(make(4) + item[cut:] + make(rnd.randint(0, 3)) + item[:cut] + make(2))
    texts += [["w0"] * 50, []]
    benchmark = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(i, ", ".join(w).upper(), 0) for i, w in enumerate(texts)], "doc_id long, text string, item_id int")
    tests = load_tests(benchmark, block_tokens=100)
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, tests, threshold=0.4).collect()}
    want = {}
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            found = brute_tiles(item, text, min(5, len(item)))
            if found and sum(n for _, _, n in found) >= 0.4 * len(item):
                want[i, k] = found
    assert got.keys() == want.keys() and len(want) > 8
    for key, found in want.items():
        assert [(t.item_start, t.doc_start, t.length) for t in got[key].tiles] == found
        assert got[key].covered_tokens == sum(n for _, _, n in found) and got[key].item_tokens == len(items[key[1]])


def test_long_and_repetitive_texts(spark):
    """Matches are paired where they begin alone, so equal tokens do not multiply."""
    benchmark = spark.createDataFrame([(1, "be " * 100), (2, "to be or " * 30)], "item_id long, text string")
    texts = ["be " * 200_000, "to be or " * 60_000, "or be to " * 50_000, "be"]
    tests = load_tests(benchmark)
    began = time.time()
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tests).collect()}
    assert got == {(0, 1), (1, 2)} and time.time() - began < 60


def test_repeated_rows_and_ids(spark):
    text = "one two three four five six seven"
    benchmark = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (None, "x y"), (4, "!?")], "item_id long, text string")
    tests = load_tests(benchmark)
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (8, None), (9, "x y")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in contaminated(docs, tests).collect()))
    assert got == sorted([(7, 1), (7, 1), (7, 2)] * 2 + [(0, 1), (0, 1), (0, 2)] + [(9, 0)])
    assert [r.doc_id for r in clean(docs, tests).collect()] == [8]
    assert load_tests(benchmark.limit(0)) == []


def test_items_that_share_a_template(spark):
    """A template pairs no document with every item; documents that hold an item's own part are found, over several blocks."""
    template = "answer the following question with one of the options given below and explain why"
    rnd = random.Random(9)
    own = [" ".join(f"q{rnd.randrange(10**6)}" for _ in range(20)) for _ in range(2000)]
    benchmark = spark.createDataFrame([(i, f"{template} {w}") for i, w in enumerate(own)], "item_id long, text string")
    texts = [f"{template} nothing of the test {i} " * 3 for i in range(200)] + [f"so {own[7]} and {own[1999]} {template}", f"{template} {own[5][: len(own[5]) // 3]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4_000_000, 20_000):
        tests = load_tests(benchmark, block_tokens=block)
        assert (len(tests) > 1) == (block == 20_000)
        assert {(r.doc_id, r.item_id) for r in contaminated(docs, tests).collect()} == {(200, 7), (200, 1999)}
    texts = docs.select("text").toArrow().column(0).combine_chunks()
    began = time.time()
    block = load_tests(benchmark)[0]
    assert {(r, k) for r, k, _ in block.found(texts, 0.6, block.rare(0.6))} == {(200, 7), (200, 1999)}
    assert time.time() - began < 20
