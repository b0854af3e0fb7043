"""The audit against a plain walk through every order, document by document."""

import random
import re
from itertools import permutations

from facetlake.llm.filter_audit import audit, first_failures

DOCS = "doc_id long, text string, source string, lang string"


def plain(docs, labels):
    texts = [d[1] or "" for d in docs]
    rows = {}
    for i, (doc_id, _, source, _) in enumerate(docs):
        t = texts[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if doc_id is not None and any(texts[j] == t and d[0] is not None and d[0] < doc_id for j, d in enumerate(docs)):
            fails.add("E")
        good = any(x[0] == doc_id and x[1] == 1 for x in labels if doc_id is not None)
        toxic = any(x[0] == doc_id and x[2] == 1 for x in labels if doc_id is not None)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                r = rows.setdefault((source or "", order, step), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0))
                r["unique_fails"] += fails == {f}
                if f in fails and gone:
                    r["redundant"] += 1
                if f in fails and not gone:
                    gone = True
                    r["removed"] += 1
                    r["good_lost"] += good
                    r["toxic_lost"] += toxic
                r["kept"] += not gone
    for (part, order, step), r in rows.items():
        r["shapley"] = sum(x["removed"] for (p, o, s), x in rows.items() if p == part and o[s - 1] == order[step - 1])
    return rows


def got(spark, docs, labels):
    rows = audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in rows}


def test_audit_against_a_plain_walk(spark):
    rnd = random.Random(3)
    pool = ["", None, "\t \n", "#", "A" * 30, "x " * 60, "é　ß " * 60, " ".join(f"w{i}" for i in range(55)), " ".join(f"W{i}|" for i in range(80)), "a\x0bb\x1cc " * 17 + "Q" * 20]
    pool += [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(rnd.randint(40, 90))) for _ in range(6)]
    docs = [(i, rnd.choice(pool), rnd.choice(["one", "two", "", None]), "x") for i in range(90)]
    docs += [(None, pool[5], "one", "x"), (None, pool[5], "one", "x"), (3, docs[3][1], docs[3][2], "x"), (3, docs[3][1], "three", "x"), (500, "long " * 200_000 + "text", "three", "x")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (10_000, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_audit_of_a_text_that_fills_the_table(spark):
    """A third of all rows are one text: one row stays under E; sources differ among its copies."""
    docs = [(i, "same words here" if i % 3 else f"own words of {i}", f"s{i % 4}", "x") for i in range(3000)]
    rows = got(spark, docs, [(1, 1, 0), (2, 0, 1)])
    assert sum(rows[f"s{p}", "EABCD", 1]["removed"] for p in range(4)) == 1999
    assert [rows[f"s{p}", "EABCD", 1]["good_lost"] for p in range(4)] == [0, 0, 0, 0]
    assert rows["s2", "EABCD", 1]["toxic_lost"] == 1 and rows["s1", "ABCDE", 1]["good_lost"] == 1


def test_audit_of_nothing(spark):
    assert got(spark, [], []) == {}
    assert first_failures().shape == (32, 120) and (first_failures()[0] == 5).all() and (first_failures()[31] == 0).all()
