import hashlib
import random
import re

from facetlake.llm.pii import pii_report

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                (kind == "ip" and max(map(int, m[0].split("."))) > 255)
                or (kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)))
                or (kind == "phone" and not 10 <= len(digits) <= 15)
            ):
                continue
            spans.append((m.start(), rank, m.end(), kind))
    spans.sort()
    return [f"{k}:{s}:{e}" for s, _, e, k in spans]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x", i, 0) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start long, _x int")
    got = {r.doc_id: r for r in pii_report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i])
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
        for k in BASE:
            assert got[i][f"n_{k}"] == sum(x.startswith(k) for x in want)
        assert (got[i].n_base, got[i].n_spans) == (len(want), len(list(filter(None, got[i].spans.split(",")))))
    return got


def test_edges(spark):
    check(
        spark,
        [
            None, "", "no data here", "a@b.c@d.e", "a@b.c_d@e.f x", "é a.b@c.de 😀 x+y@z.co.uk", "1.2.3.4.5.6.7.8", "1.2.3.300 01.002.3.4",
            "4111 1111 1111 1111", "4111-1111-1111-1111 4", "+1 (375) 555-4393", "+12345", "+1 (375) 555-4393.", "4111111111111111 4111111111111111",
            "1.2.3.4 +1.2.3.4.5.6.7.8.9.0", "@@@ a@ @b a@b a@b. a@b.c.", "0000000255.1.1.1 256.1.1.1 9999999999999.1.1.1",
        ],
    )


def test_long_texts(spark):
    long = lambda n: ["a" * 20 * n, "1" * 10 * n, "1 " * 6 * n, "a." * 6 * n + "@" + "b." * 3 * n, "1." * 6 * n, "+1" * 2 * n, "x@y.z " * n]
    check(spark, long(300))  # the plain patterns need the square of these sizes
    rows = pii_report(spark.createDataFrame(list(enumerate(long(10_000))), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_email for r in rows] == [0, 0, 0, 1, 0, 0, 10_000] and rows[4].n_ip == 15_000


def test_random(spark):
    rnd = random.Random(3)
    check(spark, ["".join(rnd.choice("0123456789.-+@ ()ab%_é") for _ in range(rnd.randint(5, 400))) for _ in range(150)])


def test_method_adds_and_keeps(spark):
    got = check(spark, ["mail me: jo.doe [at] example [dot] com", "call 415-555-0100 now", "x415-555-01000", "+1 (415) 555-0100"] * 3)
    assert got[0].spans.startswith("email:9:")
    assert got[1].spans == "phone:5:17"
    assert got[2].spans == "" and got[3].spans == "phone:0:17"


def test_empty_table_and_repeats(spark):
    schema = "doc_id long, text string"
    assert pii_report(spark.createDataFrame([], schema)).count() == 0
    rows = pii_report(spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, "none"), (None, "x d@e.f")], schema)).collect()
    assert sorted(r.n_email for r in rows) == [0, 1, 1, 1]
