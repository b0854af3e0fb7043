import hashlib
import random
import re
import time
from collections import Counter

import pytest

from facetlake.llm.components import components
from facetlake.llm.decontaminate import contaminated, clean, load_tests
from facetlake.llm.exact_dedup import build_directory, exact_dedup
from facetlake.llm.jaccard_join import jaccard_components
from facetlake.llm.sharding import cut_links, homes_of, propagate, quotas, shard_documents
from facetlake.llm.url_filter import build, judge_urls
from facetlake.llm.warc import _unzipped, archive_report, parse, read_warc, resolve, write_warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, _id int, n string, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, "x", "y") for i, t in enumerate(texts)], DOCS)


def words(rnd, n, size=400):
    return [f"w{rnd.randint(0, size)}" for _ in range(n)]


def edited(rnd, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[rnd.randrange(len(ws))] = f"e{rnd.randint(0, 10**6)}"
    return ws


# -- connected components ---------------------------------------------------------


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- exact deduplication ----------------------------------------------------------


def test_exact_dedup(spark):
    texts = [None, "", "a  b", "a b", "a\t\nb", "a b ", "é", "x" * 100_000, "x" * 100_000, "a\u00a0b", " ", "\n\n"] + ["copy me"] * 50
    got = {r.doc_id: r for r in exact_dedup(docs(spark, texts), capacity=2).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), i == min(same))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup(docs(spark, [])).count() == 0
    again = exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert len(again) == 3 and all(r.kept for r in again)


@pytest.mark.parametrize("bits", [0, 2])
def test_exact_dedup_under_clashes(spark, bits):
    """One or four hashes for all texts: bytes alone tell them apart."""
    texts = [f"text {i % 40}" + " " * (1 + i % 3) + "end" for i in range(200)] + [None, "", "alone"]
    got = {r.doc_id: r for r in exact_dedup(docs(spark, texts), capacity=2, key_bits=bits).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size) == (min(same), len(same))


def test_unique_texts_stay_in_the_scan(spark):
    """What goes past the bitmap is what has copies."""
    from facetlake.llm.filters import flagged

    rows = spark.range(5000).selectExpr("id", "xxhash64(id) as key")
    told = flagged(rows, rows.key, rows.where("id < 50"), "key", "hit").where("hit").select("id").collect()
    assert {r.id for r in told} >= set(range(50)) and len(told) < 60


def test_directory_doubles(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) as key").unionByName(spark.range(500).selectExpr("id as key"))
    directory, depth = build_directory(keys, capacity=200, start_depth=2, max_depth=12)
    rows = directory.collect()
    assert depth == 12 and len(rows) == 2**depth and len({r.slot for r in rows}) == 2**depth
    counts = Counter()
    buckets = {r.slot: (r.bucket, r.depth) for r in rows}
    for r in keys.collect():
        counts[buckets[(r.key % 2**64) >> (64 - depth)]] += 1
    assert all(n <= 200 or d == depth for (_, d), n in counts.items())
    assert len({b for b, _ in buckets.values()}) < 2**depth


# -- n-gram Jaccard join ----------------------------------------------------------


def shingles(text, width):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(ws) >= width:
        return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)}
    return {tuple(ws)} if ws else set()


def brute_components(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard_like_brute_force(spark, width, num):
    rnd = random.Random(width)
    texts = [None, "", "one", "One", "one two", " \n", "a b c d", "A B C D", "a b c d e"]
    for _ in range(12):
        base = words(rnd, rnd.randint(30, 220), 5000)
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 7))) for _ in range(rnd.randint(1, 14))]
    line = " ".join(words(rnd, 15))
    texts += [line + "\n" + " ".join(words(rnd, 60, 9000)) for _ in range(60)] + [line] * 5
    texts += [" ".join(["be"] * 5000), "be " * 40]
    rnd.shuffle(texts)
    got = {r.doc_id: r for r in jaccard_components(docs(spark, texts), width, num, 100).collect()}
    sizes, label = brute_components(texts, width, num, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert len(set(label)) < len(texts) - 20


@pytest.mark.parametrize(("region", "block"), [(12, 8)])
def test_jaccard_in_divided_regions(spark, region, block):
    """Crowded regions of copies that do not link, and of copies that do; a pair exactly at the threshold."""
    rnd = random.Random(region)
    base = words(rnd, 60, 10**6)
    texts = [" ".join(edited(rnd, base, rnd.choice([0, 1, 2, 3, 5, 9]))) for _ in range(60)]
    other = words(rnd, 40, 10**6)
    texts += [" ".join(other[: 36 + k % 5] + words(rnd, k % 7, 10**6)) for k in range(40)]
    at = words(rnd, 20, 10**6)
    texts += [" ".join(at), " ".join(at + words(rnd, 3, 10**6))]  # 17 of 20 shingles: exactly 85 / 100
    texts += [" ".join(words(rnd, 50, 10**6) + base[:4]) for _ in range(30)]  # one shingle in a fifth of all rows
    sizes, label = brute_components(texts, 4, 85, 100)
    got = {r.doc_id: r for r in jaccard_components(docs(spark, texts), 4, 85, 100, region=region, block=block).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert label[101] == label[100] and 30 < len(set(label)) < len(texts) - 20


def test_jaccard_of_names_that_clash(spark, monkeypatch):
    """Two sets with one 64-bit name get others."""
    from facetlake.llm import jaccard_join

    real = jaccard_join._fingerprint
    monkeypatch.setattr(jaccard_join, "_fingerprint", lambda own, salt=0: (7, real(own)[1]) if salt == 0 else real(own, salt))
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", None]
    got = {r.doc_id: r.component_id for r in jaccard_components(docs(spark, texts), 4, 85, 100).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def test_jaccard_empty(spark):
    assert jaccard_components(docs(spark, [])).count() == 0
    assert [r.component_id for r in jaccard_components(docs(spark, [None, ""])).orderBy("doc_id").collect()] == [0, 1]


def test_jaccard_many_repeated_rows(spark):
    """Thousands of rows of one id, and of none, with two near texts: one set is compared for each."""
    a = " ".join(f"w{i}" for i in range(400))
    b = a.replace("w200 ", "x ")
    rows = [(1, a)] * 3000 + [(1, b)] * 3000 + [(None, a)] * 500 + [(None, b)] * 500 + [(2, "w1 w2 w3 w4 w5 w6")]
    began = time.time()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in got} == {(1, 1, 6000), (None, 1, 1000), (2, 2, 1)}
    assert time.time() - began < 60


def test_jaccard_repeated_and_missing_ids(spark):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta"
    rows = [(5, a), (5, b), (3, a + " "), (None, b.upper()), (None, "some other words stand here now"), (3, a + " ")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (3, 3), (3, 3), (5, 3), (5, 5)]


# -- decontamination --------------------------------------------------------------


def test_decontaminate(spark):
    rnd = random.Random(6)
    items = [words(rnd, n, 10**6) for n in (20, 31, 50, 3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)]
    tests = load_tests(spark.createDataFrame(rows, "item_id long, text string"), block_tokens=300)
    assert len(tests) == 2 and sorted(i for t in tests for i in t.ids) == [0, 1, 2, 3]
    fill = lambda n: " ".join(words(rnd, n, 10**6))
    a, b, c = items[:3]
    texts = [
        f"{fill(50)} {' '.join(a)} {fill(20)}",
        f"{fill(9)} {', '.join(b[15:]).upper()}! {fill(9)} {' '.join(b[:15])}",  # rearranged, other case and signs
        f"{' '.join(c[:20])} {fill(30)}",  # less than the threshold
        f"{' '.join(c[:34])}",
        fill(300), None, "", " ".join(items[3]), " ".join(a) * 2 + " " + " ".join(c), f"{' '.join(a[:4])} x {' '.join(a[4:8])}",
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs(spark, texts), tests).collect()}
    assert set(got) == {(0, 0), (1, 1), (3, 2), (7, 3), (8, 0), (8, 2)}  # item 3 is short and matched whole
    assert got[0, 0].coverage == 1 and got[3, 2].covered_tokens == 34
    assert [(t.item_start, t.length) for t in got[1, 1].tiles] == [(0, 15), (15, 16)]
    kept = clean(docs(spark, texts), tests).select("doc_id").collect()
    assert [r[0] for r in kept] == [2, 4, 5, 6, 9]
    assert contaminated(docs(spark, texts), []).count() == 0
    assert contaminated(docs(spark, []), tests).count() == 0


# -- URL rules --------------------------------------------------------------------

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("bad.io", "block"), ("ok.bad.io/a/b", "allow"), ("Up.Case/x", "block")]


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            size = (h.count("."), len(slash + p))
            if best is None or size > best[0]:
                best = (size, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls_like_brute_force(spark):
    rnd = random.Random(7)
    urls = ["http://com/en/" + "x" * 200_000, "http://" + "a." * 20_000 + "com/en/", "http://q.com" + "/en" * 50_000, "http://com/en/", "http://com/en/", "http://UP.case/x"]
    urls += [None, "", "example.com/en/", "http://", "http://COM/en/", "x://a.example.com", "x://a.example.com?en/7", "http://bad.io", "http://xbad.io/", "http://ok.bad.io/a/bc/d#x", "a://b://com/en/"]
    hosts = ["com", "example.com", "a.example.com", "Example.NET", "xexample.net", "org", "q.org", "bad.io", "ok.bad.io", "a.ok.bad.io", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71/x", "/de/8", "/de/", "/es//", "/a/b", "/a/bb", "/a", "/en/7?x", "/es/#y", "?/es/"]
    urls += [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(df, build(RULES)).collect()}
    for i, u in enumerate(urls):
        assert got[i] == brute_url(u), u
    with pytest.raises(ValueError):
        build(RULES, max_rules=3)
    assert judge_urls(df.limit(0), build(RULES)).count() == 0


# -- WARC -------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 100
    payloads = [big, None, "", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, big, "z\r\n\r\n" * 20_000]
    rows = [(i, f"http://a.b/{i} \n", p, "k") for i, p in enumerate(payloads)] + [(50, None, "n" * 1200, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    got = {r.page_id: r for r in archive_report(df, path).collect()}
    assert len(got) == len(rows)
    for i, _, p, _ in rows:
        raw = (p or "").encode()
        same = [j for j, _, q, _ in rows if (q or "") == (p or "")]
        original = max(same) if len(raw) >= 1000 else i
        want = (len(raw), hashlib.sha1(raw).hexdigest(), "response" if original == i else "revisit", None if original == i else original)
        assert tuple(got[i])[1:] == want, i
    stored = {r.record_id: r for r in read_warc(spark, path).collect()}
    assert all(r.digest == hashlib.sha1(("" if rows[int(k)][2] is None else rows[int(k)][2]).encode()).hexdigest() for k, r in stored.items() if k != "50")
    assert bytes(stored["8"].payload) == big.encode() and stored["0"].payload is None and stored["0"].refers_to == "8"
    with pytest.raises(Exception, match="(?i)exist"):
        write_warc(resolve(df), path)
    assert archive_report(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_repeated_and_missing_ids(spark, tmp_path):
    """One id with several payloads, repeated rows, and pages without an id."""
    p, q, r = "p" * 1200, "q" * 1300, "r" * 1400
    rows = [(9, "u", p), (9, "u", q), (1, "u", p), (2, "v", q), (7, "u", r), (7, "u", r), (3, "u", r), (None, "u", r), (None, "u", "s" * 2000), (None, "u", "s" * 2000), (None, None, None)]
    rows += [(100 + i, "hot", p) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    got = Counter(tuple(x) for x in archive_report(df, path, salts=4).collect())
    want = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        same = [j for j, _, u in rows if u == t and j is not None]
        first = max(same) if len(raw) >= 1000 and same else i
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert got == want


def test_warc_like_its_sql(spark, tmp_path):
    """The registered SQL on a table with many revisits."""
    import duckdb
    from facetlake.llm.catalog import OP8_SQL

    rnd = random.Random(9)
    pages = [(i, f"http://a/{i}", rnd.choice("abcdefgh") * rnd.choice([0, 999, 1000, 1500, 70_000])) for i in range(300)]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    want = Counter(con.sql(OP8_SQL).fetchall())
    got = archive_report(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), f"file://{tmp_path}/w")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(n for r, n in want.items() if r[3] == "revisit") > 100


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    path = f"{tmp_path}/w"
    rows = [(i, "u", f"{i:05d}" * size) for i, size in enumerate([10] * 300 + [20_000] * 12 + [300_000] * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warc(resolve(df), f"file://{path}", date="2024-05-06T07:08:09Z", file_bytes=2 << 20)
    assert read_warc(spark, f"file://{path}").agg(F.count("*")).first()[0] == len(rows)
    sizes = [sum(len(p) for p in (b for _, b in parse(_unzipped(f.read_bytes())))) for f in tmp_path.rglob("*.gz")]
    assert len(sizes) >= 7 and max(sizes) <= 2 << 20 and sum(n > 0 for n in sizes) == len(sizes)


# -- sharding ---------------------------------------------------------------------


def test_quotas_keep_counts():
    linked, filling = quotas({(0, 1): 5, (1, 0): 2, (2, 1): 4}, {1: 5})
    flow = Counter()
    for (i, j), n in [*linked.items(), *filling.items()]:
        flow[i] -= n
        flow[j] += n
    assert all(v == 0 for v in flow.values()) and linked[0, 1] >= 2
    assert quotas({(0, 1): 2, (1, 2): 3, (2, 0): 4}, {}) == ({(0, 1): 2, (1, 2): 2, (2, 0): 2}, {})
    assert quotas({(0, 1): 3, (1, 2): 2}, {2: 1}) == ({(0, 1): 1, (1, 2): 1}, {(2, 0): 1})


@pytest.mark.parametrize("count", [7, 400])
def test_shards_are_even_and_keep_copies_together(spark, count):
    rnd = random.Random(8)
    texts = [None, "", ""] + [f"text {rnd.randint(0, 100 if i % 3 == 0 else 10**9)}" for i in range(count - 3)]
    if count > 100:
        texts[-130:] = ["hot"] * 130  # a third of all rows
    got = shard_documents(docs(spark, texts), shards=8).collect()
    assert len(got) == count
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.law == "rows" and r.grown_shard is None for r in got)
    place = {r.doc_id: r.shard for r in got}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(place[i])
    small = [g for t, g in groups.items() if len(g) > 1 and t != "hot"]
    if count > 100:
        assert sum(len(set(g)) == 1 for g in small) >= 0.9 * len(small)
    assert shard_documents(docs(spark, []), shards=8).count() == 0


def test_propagation_ends_with_fewer_cut_links(spark):
    """Against a plain count: every round of swaps cuts fewer links, and the end has no swap left."""
    rnd = random.Random(10)
    rows = [(i, i % 6, rnd.choice([None, rnd.randrange(40)]), 0) for i in range(600)]
    nodes = spark.createDataFrame(rows, "_id long, shard int, grp long, part int")

    def cuts(collected):
        held = {}
        for r in collected:
            if r.grp is not None:
                held.setdefault(r.grp, Counter())[r.shard] += 1
        return sum(sum(c.values()) - max(c.values()) for c in held.values())

    seen = [cuts(nodes.collect())]
    assert cut_links(nodes) == seen[0]
    for rounds in (1, 2, None):
        after = propagate(nodes, 6, 2, rounds)
        assert Counter(r.shard for r in after.collect()) == Counter(r[1] for r in rows)
        assert sorted(r._id for r in after.collect()) == list(range(600))
        seen.append(cuts(after.collect()))
        assert cut_links(after) == seen[-1]
    assert seen == sorted(seen, reverse=True) and seen[0] > 4 * seen[-1]
    assert propagate(after, 6, 2).select("_id", "shard").exceptAll(after.select("_id", "shard")).count() == 0


def fewest_cut(copies, shards):
    """The fewest cut links over all ways of dealing groups of these sizes into even shards, tried one by one."""
    total = sum(copies)
    room = [total // shards + (i < total % shards) for i in range(shards)]

    def ways(n, room):
        if len(room) == 1:
            return [(n,)] if n <= room[0] else []
        return [(k, *rest) for k in range(min(n, room[0]) + 1) for rest in ways(n - k, room[1:])]

    def least(i, room):
        if i == len(copies):
            return 0
        return min(copies[i] - max(w) + least(i + 1, tuple(r - k for r, k in zip(room, w, strict=True))) for w in ways(copies[i], room))

    return least(0, tuple(room))


@pytest.mark.parametrize(
    ("copies", "shards"),
    [([7, *[1] * 13], 2), ([10, *[1] * 10], 2), ([7, 7, *[1] * 6], 2), ([25, *[1] * 5], 3), ([6, 5, *[1] * 7], 3), ([11, 2, 2, *[1] * 5], 2), ([4, 4, 4], 3)],
)
def test_groups_that_fit_a_shard_stay_whole(spark, copies, shards):
    """Against the fewest cut links there can be, counted over whole groups."""
    texts = [f"text {g}" for g, n in enumerate(copies) for _ in range(n)]
    got = shard_documents(docs(spark, texts), shards=shards).cache()
    sizes = Counter(r.shard for r in got.collect())
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    assert cut_links(got.withColumn("same", F.struct("size", "text_crc32")), "same") == fewest_cut(copies, shards)


def test_homes_are_closed_while_the_rest_fits():
    homes, wanted = homes_of([(5, 10), (6, 6), (7, 9)], 4, 10, 35)
    assert homes == {5: 0, 7: 1, 6: 2} and wanted == [3]
    assert homes_of([(5, 10), (6, 6), (7, 9)], 4, 10, 40)[1] == [2, 3]
    assert homes_of([(g, 6) for g in range(5)], 3, 10, 30)[1] == [1, 2] and homes_of([], 3, 1, 0) == ({}, [0, 1, 2])


def test_shards_of_repeated_ids_and_long_texts(spark):
    rows = [(1, "x" * 300_000)] * 9 + [(1, "y")] * 9 + [(None, None)] * 3 + [(2, "z")]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4, part=3).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [5, 5, 6, 6]
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t or "") + 16) for i, t in rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(Counter(r.shard for r in got)[s])]
