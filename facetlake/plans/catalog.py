"""Registered queries of the analytics operators over the driver's tables, and their DuckDB SQL.

``embeddings`` stand for faces (label: person), ``events`` for photos of a user,
``orders`` and ``lineitem`` for images and what is on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlake.functions import boxes, calendar, quality, zero_shot
from facetlake.functions.vectors import blended, cosine
from facetlake.operators import albums, classify, clusters, index, jobs, search, stores, workspace
from facetlake.operators.numbering import shared_dir
from facetlake.sources.tables import table

from .registry import QUERIES, SQL, Query, query

UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
U = f"u AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings)"

# -- search ---------------------------------------------------------------------


@query(
    f"""WITH {U}, s AS (SELECT a.vec_id, a.label, round(list_dot_product(a.v, b.v), 4) AS similarity FROM u a, u b
    WHERE b.vec_id = 0 AND a.vec_id <> 0)
    SELECT vec_id, label, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.1
    QUALIFY rank <= 50"""
)
def face_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    q = search.vector_of(faces, "vec_id", "embedding", 0)
    return search.search(faces, q, "vec_id", "embedding", 50, 0.1, exclude=0).select("vec_id", "label", "similarity", "rank")


@query(
    f"""WITH {U}, s AS (SELECT a.vec_id, round(list_dot_product(a.v, b.v), 4) AS similarity FROM u a, u b
    WHERE b.vec_id = 0 AND a.vec_id <> 0), r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.15
    QUALIFY rank <= 50)
    SELECT vec_id, similarity, rank, (SELECT count(*) FROM r) AS total FROM r WHERE rank BETWEEN 4 AND 6"""
)
def face_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    q = search.vector_of(faces, "vec_id", "embedding", 0)
    found = search.search(faces, q, "vec_id", "embedding", 50, 0.15, exclude=0)
    return search.page_of(found, page=2, page_size=3).select("vec_id", "similarity", "rank", "total")


@query(
    f"""WITH {U}, s AS (SELECT a.vec_id, round(list_dot_product(a.v, b.v), 4) AS similarity FROM u a, u b
    WHERE b.vec_id = 0 AND a.vec_id <> 0 AND a.label = 3)
    SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.0 QUALIFY rank <= 20"""
)
def face_search_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    q = search.vector_of(faces, "vec_id", "embedding", 0)
    return search.search(faces, q, "vec_id", "embedding", 20, 0.0, exclude=0, where=F.col("label") == 3).select("vec_id", "similarity", "rank")


@query(
    f"""WITH {U} SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
    FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5"""
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set is every id divisible by 50, against all rows."""
    faces = table(spark, sf_dir, "embeddings")
    return search.top_neighbours(faces.where("vec_id % 50 = 0"), faces, "vec_id", "embedding", 5)


@query(
    f"""WITH {U}, s AS (SELECT a.vec_id, round(list_dot_product(a.v, b.v), 4) AS similarity FROM u a, u b
    WHERE b.vec_id = 0 AND a.vec_id <> 0 AND a.vec_id % 7 <> 0)
    SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.0 QUALIFY rank <= 10"""
)
def search_without_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    q = search.vector_of(faces, "vec_id", "embedding", 0)
    left = search.active(faces, faces.where("vec_id % 7 = 0").select("vec_id"), "vec_id")
    return search.search(left, q, "vec_id", "embedding", 10, 0.0, exclude=0).select("vec_id", "similarity", "rank")


# -- clusters -------------------------------------------------------------------

SUMS = f"""{U}, x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM u),
m AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT label, list(s ORDER BY pos) AS s, max(n) AS n FROM m GROUP BY label),
cc AS (SELECT label, n, list_transform(s, lambda z: z / sqrt(list_dot_product(s, s))) AS c FROM c)"""


@query(f"WITH {SUMS} SELECT label, n AS member_count, round(unnest(c), 5) AS value, generate_subscripts(c, 1) - 1 AS pos FROM cc")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", "member_count", F.posexplode("centroid").alias("pos", "v")).select("label", "member_count", "pos", F.round("v", 5).alias("value"))


@query(
    f"""WITH {SUMS}, s AS (SELECT u.label, list_dot_product(u.v, cc.c) AS sim FROM u JOIN cc USING (label)),
    a AS (SELECT label, greatest(0, least(1, avg(sim))) AS m, stddev_pop(sim) AS sd, count(*) AS n FROM s GROUP BY label)
    SELECT label, round(CASE WHEN n = 1 THEN 1.0 ELSE greatest(0, least(1, m * (1 - 0.5 * least(1, sd / 0.15)))) END, 5) AS confidence FROM a"""
)
def cluster_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clusters.confidences(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", F.round("confidence", 5).alias("confidence"))


@query("SELECT label, list(DISTINCT 'img_' || (vec_id % 40) ORDER BY 'img_' || (vec_id % 40)) AS paths FROM embeddings GROUP BY label")
def cluster_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings").withColumn("path", F.concat(F.lit("img_"), (F.col("vec_id") % 40).cast("string")))
    return clusters.mapping(faces, "label", "path")


@query(
    f"""WITH {SUMS}, d AS (SELECT vec_id, cc.label AS predicted, round(list_dot_product(u.v, cc.c), 6) AS sim FROM u, cc)
    SELECT vec_id, predicted, greatest(sim, 0.0) AS confidence FROM d
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, predicted) = 1"""
)
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    return classify.nearest_centroid(faces, clusters.centroids(faces, "label", "embedding"), "vec_id", "embedding", "label")


@query(
    f"""WITH {SUMS}, d AS (SELECT vec_id, u.label, cc.label AS predicted, round(list_dot_product(u.v, cc.c), 6) AS sim FROM u, cc),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, predicted) = 1)
    SELECT vec_id, label, predicted, greatest(sim, 0.0) AS confidence FROM b WHERE predicted <> label AND greatest(sim, 0.0) >= 0.2"""
)
def misclassified_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    found = classify.nearest_centroid(faces, clusters.centroids(faces, "label", "embedding"), "vec_id", "embedding", "label")
    return classify.misclassified(found, faces, "vec_id", "label", 0.2).select("vec_id", "label", "predicted", "confidence")


@query(
    f"""WITH RECURSIVE {U}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id
      AND 2 - 2 * list_dot_product(a.v, b.v) <= 1.10 * 1.10),
    core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) + 1 >= 3),
    reach AS (SELECT id, id AS root FROM core UNION
      SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id WHERE e.b IN (SELECT id FROM core)),
    roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
    lab AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
    border AS (SELECT e.a AS id, min(lab.label) AS label FROM e JOIN lab ON lab.id = e.b GROUP BY e.a)
    SELECT vec_id, coalesce(lab.label, border.label, -1)::INTEGER AS label FROM embeddings
    LEFT JOIN lab ON lab.id = vec_id LEFT JOIN border ON border.id = vec_id"""
)
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1.10, 3)


KDIST = f"""WITH {U}, n AS (SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS s FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) = 5),
    k AS (SELECT row_number() OVER (ORDER BY round(sqrt(greatest(2 - 2 * s, 0)), 6), vec_id) - 1 AS position, round(sqrt(greatest(2 - 2 * s, 0)), 6) AS distance FROM n)"""


@query(f"{KDIST} SELECT position, distance FROM k")
def k_distance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.k_distances(nearest_neighbours(spark, sf_dir), 5)


@query(
    f"""{KDIST}, s AS (SELECT max(position) AS n, min(distance) AS lo, max(distance) AS hi FROM k)
    SELECT distance AS eps FROM k, s ORDER BY round(abs(position / greatest(n, 1) - (distance - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)), 9) DESC, position LIMIT 1"""
)
def estimated_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.elbow(clusters.k_distances(nearest_neighbours(spark, sf_dir), 5))


@query(
    """WITH b AS (SELECT vec_id, label AS old FROM embeddings WHERE vec_id % 5 <> 0),
    a AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 7 ELSE label END AS new FROM embeddings)
    SELECT count(*) AS common, count(*) FILTER (old <> new) AS changed, round(count(*) FILTER (old <> new) / count(*), 6) AS drift,
    (SELECT count(DISTINCT new) FROM a WHERE new NOT IN (SELECT old FROM b)) AS new_clusters FROM a JOIN b USING (vec_id)"""
)
def cluster_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    after = faces.withColumn("label", F.when(F.col("vec_id") % 3 == 0, F.col("label") + 7).otherwise(F.col("label")))
    return clusters.drift(faces.where("vec_id % 5 <> 0"), after, "vec_id", "label")


@query()
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    new = clusters.merged_labels(faces, "label", "embedding", threshold=0.2, small_threshold=0.1)
    return spark.createDataFrame(sorted(new.items()), "label int, merged int")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
    SELECT vec_id, round(0.8 * greatest(0, least(2, 1 - list_cosine_similarity(v.e[1:32], q.e[1:32])))
      + 0.2 * greatest(0, least(2, 1 - list_cosine_similarity(v.e[33:64], q.e[33:64]))), 5) AS distance FROM v, q"""
)
def composite_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    q = search.vector_of(faces, "vec_id", "embedding", 0)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    face, head = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    distance = blended(1 - cosine(face, lit(q[:32])), 1 - cosine(head, lit(q[32:])), 0.2)
    return faces.select("vec_id", F.round(distance, 5).alias("distance"))


@query(
    """WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS f, CASE WHEN vec_id % 7 <> 0 THEN embedding[33:64]::DOUBLE[] END AS h FROM embeddings)
    SELECT a.vec_id AS query_id, b.vec_id, round(CASE WHEN a.h IS NULL OR b.h IS NULL THEN list_cosine_similarity(a.f, b.f)
      ELSE 0.8 * list_cosine_similarity(a.f, b.f) + 0.2 * list_cosine_similarity(a.h, b.h) END, 6) AS similarity,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) AS rank
    FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5"""
)
def composite_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh face has no head."""
    head = F.when(F.col("vec_id") % 7 != 0, F.slice("embedding", 33, 32))
    faces = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("face"), head.alias("head"))
    return search.blended_neighbours(faces.where("vec_id % 50 = 0"), faces, "vec_id", "face", "head", 5)


@query(
    f"""WITH {U}, k AS (SELECT * FROM u WHERE vec_id % 6 <> 1)
    SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) AS rank
    FROM u a, k b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 3"""
)
def kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of cells: written, opened, appended to, marked, built anew and searched in all its cells."""
    faces = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.create(faces.where("vec_id % 6 <> 0"), "vec_id", "embedding", f"{path}-1", cells=4)
    first = index.load(spark, f"{path}-1", "vec_id")
    first.add(faces.where("vec_id % 6 = 0"), "embedding")
    first.soft_delete(faces.where("vec_id % 6 = 1"))
    return first.rebuild(f"{path}-2", cells=4).search(faces.where("vec_id % 50 = 0"), "embedding", 3, probes=4)


# -- classification -------------------------------------------------------------

NEAR = f"""WITH {U}, n AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_dot_product(a.v, b.v), 6) AS s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
    FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 3),
    v AS (SELECT query_id, label, count(*) AS votes, max(s) AS best, min(rank) AS first_rank FROM n GROUP BY ALL),
    w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first_rank) = 1)"""


def _known_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stated query set of new faces is every id divisible by 50; all others of a face are known to it."""
    faces = table(spark, sf_dir, "embeddings")
    new = faces.where("vec_id % 50 = 0")
    return faces, new, search.top_neighbours(new, faces, "vec_id", "embedding", 3)


@query(f"{NEAR} SELECT query_id, label AS cluster, votes, best FROM w")
def neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _, near = _known_and_new(spark, sf_dir)
    return classify.majority(classify.neighbour_votes(near, known, "vec_id", "label"))


@query(
    f"""{NEAR}, r AS (SELECT w.query_id AS vec_id, t.s AS top, t.label AS top_cluster, w.label AS voted, votes, best,
      CASE WHEN t.s > 0.45 THEN 'high' WHEN votes >= 2 AND best > 0.3 THEN 'medium' WHEN t.s < 0.35 THEN 'new_cluster' ELSE 'pending' END AS method
      FROM w JOIN n t ON t.query_id = w.query_id AND t.rank = 1),
    k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM r WHERE method = 'new_cluster')
    SELECT r.vec_id, CASE method WHEN 'high' THEN top_cluster::VARCHAR WHEN 'medium' THEN voted::VARCHAR WHEN 'new_cluster' THEN printf('inc_%06d', k) END AS cluster_id,
    CASE method WHEN 'new_cluster' THEN 1.0::DOUBLE WHEN 'medium' THEN best ELSE top END AS confidence, method FROM r LEFT JOIN k ON k.vec_id = r.vec_id"""
)
def incremental_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new, near = _known_and_new(spark, sf_dir)
    return classify.assign_incrementally(new, near, known, "vec_id", "label", high=0.55, medium=0.7, fresh=0.65)


EUCLID = """e AS (SELECT a.vec_id AS query_id, b.label AS cluster, round(sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS d,
    b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    ek AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5),
    ev AS (SELECT query_id, cluster, round(sum(1 / (d + 1e-6)) / sum(sum(1 / (d + 1e-6))) OVER (PARTITION BY query_id), 6) AS share FROM ek GROUP BY query_id, cluster)"""


@query(f"WITH {EUCLID} SELECT query_id, cluster, share FROM ev")
def euclidean_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    return classify.euclidean_shares(faces.where("vec_id % 50 = 0"), faces, "vec_id", "embedding", "label", 5)


@query(
    f"""{NEAR}, {EUCLID}, m AS (SELECT query_id, 'cosine' AS method, label AS cluster, best AS confidence FROM w UNION ALL
      SELECT query_id, 'euclid', cluster, share FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, cluster) = 1),
    s AS (SELECT query_id, cluster, sum((CASE method WHEN 'cosine' THEN 0.5 ELSE 0.2 END) * confidence) AS s FROM m GROUP BY ALL),
    b AS (SELECT query_id, cluster, round(round(s, 9) / sum(s) OVER (PARTITION BY query_id), 6) AS confidence FROM s
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, cluster) = 1)
    SELECT query_id, CASE WHEN confidence >= 0.4 THEN cluster END AS predicted, confidence FROM b"""
)
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and Euclidean votes; with the kernel arm it is ``ensemble_of_three``."""
    known, new, near = _known_and_new(spark, sf_dir)
    best = classify.majority(classify.neighbour_votes(near, known, "vec_id", "label"))
    euclid = classify.best_share(classify.euclidean_shares(new, known, "vec_id", "embedding", "label", 5))
    votes = best.select("query_id", F.lit("cosine").alias("method"), "cluster", F.col("best").alias("confidence")).unionByName(
        euclid.select("query_id", F.lit("euclid").alias("method"), "cluster", F.col("share").alias("confidence"))
    )
    return classify.weighted_vote(votes, {"cosine": 0.5, "euclid": 0.2, "svm": 0.3})


@query(
    """WITH o AS (SELECT event_type, (value > 50)::INTEGER::DOUBLE AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
    a AS (SELECT event_type, avg(ok) AS w FROM o WHERE r <= 100 GROUP BY event_type)
    SELECT event_type, round(w / sum(w) OVER (), 6) AS weight FROM a"""
)
def adapted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return classify.adapted_weights(rows, "event_type", F.col("value") > 50, [F.desc("ts"), F.desc("event_id")], {})


@query(
    """SELECT user_id, round(list_reduce(list(CASE WHEN value > 60 THEN 0.02::DOUBLE WHEN value < 40 THEN -0.02::DOUBLE ELSE 0::DOUBLE END ORDER BY ts, event_id),
    lambda t, a: greatest(0.4::DOUBLE, least(0.95::DOUBLE, t + a)), 0.7::DOUBLE), 6) AS threshold FROM events GROUP BY user_id"""
)
def adapted_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("value") > 60, "split").when(F.col("value") < 40, "merge").otherwise("none")
    rows = classify.adapted_thresholds(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind)
    return rows.select("user_id", F.round("threshold", 6).alias("threshold"))


# -- albums ---------------------------------------------------------------------

SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS event_no FROM g),
    e AS (SELECT user_id, printf('event_%04d', event_no) AS event_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS photo_count FROM s GROUP BY user_id, event_no)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = table(spark, sf_dir, "events").withColumnRenamed("event_id", "photo")
    return albums.sessions(photos, "user_id", "ts", "photo")


@query(f"{SESSIONS} SELECT user_id, event_id, start_time, end_time, photo_count, start_time::DATE < end_time::DATE AS is_multi_day FROM e")
def time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = albums.events(_sessions(spark, sf_dir), "user_id", "ts", "photo")
    return made.select("user_id", "event_id", "start_time", "end_time", "photo_count", "is_multi_day")


@query(
    f"""{SESSIONS} SELECT user_id, printf('event_%04d', event_no) AS event_id, event_id AS cover FROM s
    QUALIFY row_number() OVER (PARTITION BY user_id, event_no ORDER BY coalesce(value, 0) DESC, ts, s.event_id) = 1"""
)
def event_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.covers(_sessions(spark, sf_dir), "user_id", "ts", "photo", F.col("value"))


_SOLAR = " ".join(f"WHEN month(d) = {m} AND day(d) = {k} THEN '{n}'" for (m, k), n in calendar.SOLAR.items())
_LUNAR = " ".join(f"WHEN month(d) = {m} AND abs(day(d) - {k}) <= 3 THEN '{n}'" for m, k, n in calendar.LUNAR)


@query(
    f"""{SESSIONS}, d AS (SELECT user_id, event_id, unnest(generate_series(start_time::DATE::TIMESTAMP, end_time::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM e),
    h AS (SELECT user_id, event_id, arg_min(h, d) AS holiday FROM (SELECT *, CASE {_SOLAR} {_LUNAR} END AS h FROM d) WHERE h IS NOT NULL GROUP BY ALL)
    SELECT user_id, event_id, CASE WHEN holiday IS NOT NULL THEN year(start_time) || ' 年' || holiday
      WHEN end_time::DATE > start_time::DATE THEN strftime(start_time, '%Y-%m-%d') || ' ~ ' || strftime(end_time, '%m-%d') || ' (' || (end_time::DATE - start_time::DATE + 1) || '天)'
      ELSE (CASE WHEN isodow(start_time) >= 6 THEN '周末随拍' ELSE '日常记录' END) || ' · ' || strftime(start_time, '%Y-%m-%d') END AS name
    FROM e LEFT JOIN h USING (user_id, event_id)"""
)
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = albums.events(_sessions(spark, sf_dir), "user_id", "ts", "photo")
    return made.select("user_id", "event_id", calendar.event_name(F.col("start_time"), F.col("end_time")).alias("name"))


@query(
    """WITH a AS (SELECT user_id, count(*) AS photos, floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000) / 30.44 AS m FROM events GROUP BY user_id)
    SELECT user_id, photos, round(m, 1) AS span_months, m >= 5 AS has_growth_milestone FROM a WHERE photos >= 5 AND (m >= 5 OR photos >= 10)"""
)
def growth_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.growth_timelines(table(spark, sf_dir, "events"), "user_id", "ts", 5, 5)


@query(
    """SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2
    AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)"""
)
def people_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.with_all_people(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", [1, 2], [3])


@query(
    """SELECT user_id, count(*) AS photo_count, min(ts) AS start_time, max(ts) AS end_time FROM
    (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events))
    GROUP BY user_id, n"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetlake.streaming.online import session_events

    return session_events(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "photo_count", "start_time", "end_time")


# -- boxes and quality ----------------------------------------------------------

BOX = """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 100)::INTEGER AS t, (l_suppkey % 80)::INTEGER AS l,
    (l_partkey % 100 + 30 + l_quantity)::INTEGER AS bo, (l_suppkey % 80 + 30 + l_quantity)::INTEGER AS r, l_discount * 10 AS confidence FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    top, left = F.col("l_partkey") % 100, F.col("l_suppkey") % 80
    made = boxes.box(top, left + 30 + F.col("l_quantity"), top + 30 + F.col("l_quantity"), left)
    return rows.select("l_orderkey", "l_linenumber", made.alias("box"), (F.col("l_discount") * 10).alias("confidence"))


@query()
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct("confidence", F.col("l_linenumber").alias("pos"), "box")).alias("d"))
    return rows.select("l_orderkey", F.explode(boxes.suppressed(F.col("d"), 0.3)).alias("k")).select("l_orderkey", F.col("k.pos").alias("l_linenumber"))


@query(
    f"""{BOX}, s AS (SELECT *, (r - l) * (bo - t) AS area, (l + r) / 2 - 100 AS cx, (t + bo) / 2 - 100 AS cy FROM b)
    SELECT l_orderkey, l_linenumber, round(0.5 * area / 40000 + 0.3 * (1 - least(sqrt(cx * cx + cy * cy) / (sqrt(80000) / 2), 1)) + 0.2 * confidence + 1e-9, 6) AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) = 1"""
)
def primary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    made = boxes.primary_faces(rows, "l_orderkey", "l_linenumber", F.col("box"), F.col("confidence"), F.lit(200), F.lit(200))
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_linenumber")
    scored = made.withColumn("score", F.round(F.col("primary_score") + 1e-9, 6))
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("l_orderkey", "l_linenumber", "score")


@query(
    f"""{BOX} SELECT l_orderkey, l_linenumber, r - l AS width, bo - t AS height, (r - l) * (bo - t) AS area FROM b
    WHERE confidence >= 0.5 AND r - l >= 40 AND bo - t >= 40"""
)
def filtered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    rows = _boxes(spark, sf_dir).where((F.col("confidence") >= 0.5) & boxes.large_enough(b, 40))
    return rows.select("l_orderkey", "l_linenumber", boxes.width(b).alias("width"), boxes.height(b).alias("height"), boxes.area(b).alias("area"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 100)::INTEGER AS t, 20 + l_linenumber AS w, (20 + l_quantity)::INTEGER AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, (CASE WHEN h / w > 1.8 THEN t + greatest(floor(w * 1.25), floor(h * 0.5)) ELSE t + h END)::INTEGER AS bottom FROM b"""
)
def shrunk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, w, h = F.col("l_partkey") % 100, 20 + F.col("l_linenumber"), 20 + F.col("l_quantity")
    b = boxes.shrunk_body(boxes.box(top, w, top + h, F.lit(0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", b["bottom"].alias("bottom"))


@query(
    f"""{BOX} SELECT l_orderkey, l_linenumber, round(0.4 * greatest(0, least(1, confidence)) + 0.2 * least(1, (r - l) * (bo - t) / 4000) + 0.4 * confidence, 6) AS score FROM b"""
)
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = quality.cluster_quality(F.col("confidence"), boxes.area(F.col("box")), F.lit(40000))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(
    f"""{BOX}, s AS (SELECT *, (r - l) * (bo - t) AS area, avg((r - l) * (bo - t)) OVER (PARTITION BY l_orderkey) AS mean, count(*) OVER (PARTITION BY l_orderkey) AS n FROM b),
    f AS (SELECT *, CASE WHEN t > 1 AND l > 1 AND bo < 169 AND r < 169 AND (n = 1 OR area >= mean / 3) THEN round(confidence, 6) END AS score FROM s)
    SELECT l_orderkey, l_linenumber FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC NULLS LAST, l_linenumber) = 1"""
)
def best_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    edge = (b["top"] <= 1) | (b["left"] <= 1) | (b["bottom"] >= 169) | (b["right"] >= 169)
    return albums.best_faces(_boxes(spark, sf_dir), "l_orderkey", "l_linenumber", boxes.area(b), F.round("confidence", 6), edge).select("l_orderkey", "l_linenumber")


# -- stores, tags, workspace ----------------------------------------------------


@query("SELECT lang AS tag, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return stores.tag_counts(stores.tag_index(tags, "doc_id", "tags"))


@query(
    """SELECT doc_id, max(quality)::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE lang IN ('de', 'fr') AND quality >= 1
    GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100"""
)
def images_with_any_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    index = rows.select(F.explode(F.array("lang", "source")).alias("tag"), "doc_id", F.col("quality").cast("double").alias("score"))
    return stores.search_any_tag(index, ["de", "fr"], "doc_id", 1.0)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def noise_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("cluster"))
    return workspace.noise_photos(table(spark, sf_dir, "documents"), members, "doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey % 3 = 0")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stores.upsert(cache, cache.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus <> 'O'")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    cache = wanted.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.lit("O"))
    return stores.cache_lookup(wanted, cache, ["o_orderkey", "o_orderstatus"])[1].select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = rows.where("o_orderkey % 10 < 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 1, "X"))
    return stores.update_clusters(rows, changes, "o_orderkey", "o_orderstatus")


@query(
    """WITH t AS (SELECT event_id, sum(1 + user_id) OVER () AS total, sum(1 + user_id) OVER (ORDER BY ts DESC, event_id DESC) AS held FROM events)
    SELECT event_id FROM t WHERE total <= 100000 OR held <= 80000"""
)
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (1 + F.col("user_id")).alias("size"))
    return stores.evict(rows, "size", "ts", "event_id", 100_000).select("event_id")


@query(
    """SELECT vec_id AS photo, (CASE WHEN label IN (1, 2) AND NOT (label = 2 AND FALSE) THEN CASE WHEN vec_id IN (1, 2, 3) AND label IN (1, 2) THEN -1 ELSE 1 END
    WHEN label = 4 AND vec_id % 10 = 4 AND vec_id < 100 THEN 5 ELSE label END)::INTEGER AS cluster FROM embeddings"""
)
def workspace_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo"), F.col("label").alias("cluster"))
    moved = [r[0] for r in faces.where("cluster = 4 AND photo % 10 = 4 AND photo < 100").select("photo").collect()]
    log = [
        {"kind": "merge", "from": 2, "to": 1},
        {"kind": "remove", "from": 1, "photos": [1, 2, 3]},
        {"kind": "move", "from": 4, "to": 5, "photos": moved},
        {"kind": "merge", "from": 5, "to": 6},
    ]
    return workspace.apply_operations(faces, workspace.undo(log))


PLAN = """WITH m AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0),
    p AS (SELECT printf('person_%02d', label) AS folder, '/in/' || (vec_id % 7) || '/img' || (vec_id % 11) || '.jpg' AS path FROM m GROUP BY ALL),
    i AS (SELECT DISTINCT '/in/' || (vec_id % 7) || '/img' || (vec_id % 11) || '.jpg' AS path FROM embeddings),
    o AS (SELECT * FROM p UNION ALL SELECT '_unclustered', path FROM i WHERE path NOT IN (SELECT path FROM p))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), (F.col("vec_id") % 7).cast("string"), F.lit("/img"), (F.col("vec_id") % 11).cast("string"), F.lit(".jpg"))
    faces = table(spark, sf_dir, "embeddings").select("vec_id", "label", path.alias("path"))
    images = faces.select("path", F.lit(1).alias("faces"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped")).distinct()
    return workspace.organise(images, faces.where("vec_id % 3 = 0"), "path", "label", "faces", "error", "skipped")


@query(f"{PLAN} SELECT folder, path FROM o")
def organise_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    f"""{PLAN}, n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM o),
    k AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY path) - 1 AS k FROM n)
    SELECT folder, path, folder || '/' || replace(name, '.jpg', '') || (CASE WHEN k > 0 THEN '_' || k ELSE '' END) || '.jpg' AS dest FROM k"""
)
def unique_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.unique_destinations(_plan(spark, sf_dir), "folder", "path")


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, md5(event_id || ':' || user_id) AS key FROM events")
def json_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    key = F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string")))
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"), key.alias("key"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 16")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_batch(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


CORRECTIONS = "WITH c AS (SELECT event_id AS id, event_type AS action, ts AS created_at, user_id FROM events)"


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"), "user_id")


@query(f"{CORRECTIONS} SELECT * FROM c WHERE action = (SELECT min(action) FROM c) ORDER BY created_at DESC, id DESC LIMIT 100")
def newest_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _corrections(spark, sf_dir)
    return jobs.corrections(log, log.agg(F.min("action")).first()[0])


@query(f"{CORRECTIONS} SELECT action, count(*) AS n FROM c GROUP BY action")
def correction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.correction_stats(_corrections(spark, sf_dir))


@query(
    """WITH v AS (SELECT user_id::VARCHAR AS library_id, event_id AS version, value > 90 AS deleted, ts AS last_opened_at FROM events)
    SELECT library_id, version, last_opened_at FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY library_id ORDER BY version DESC) = 1) WHERE NOT deleted"""
)
def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    log = rows.select(F.col("user_id").cast("string").alias("library_id"), F.col("event_id").alias("version"), (F.col("value") > 90).alias("deleted"), F.col("ts").alias("last_opened_at"))
    return jobs.libraries(log)


@query(
    """SELECT count(*) AS images, count(*) FILTER (n > 0) AS with_faces, sum(n)::BIGINT AS faces, count(*) FILTER (o_orderstatus = 'F') AS errors
    FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
)
def pipeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    images = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left")
    rows = images.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"))
    return jobs.pipeline_totals(rows, "n", "error")


@query("SELECT l_returnflag AS name, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1")
def summed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.create_map("l_returnflag", F.col("l_quantity").cast("long")).alias("stats"))
    return jobs.summed_stats(rows, "stats")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber AS rect_id, (l_partkey % 50) / 100 AS x, (l_suppkey % 50) / 100 AS y FROM lineitem),
    m AS (SELECT l_orderkey, l_linenumber AS mark_id, (l_partkey % 53) / 100 AS x, (l_suppkey % 51) / 100 AS y FROM lineitem),
    n AS (SELECT r.l_orderkey, rect_id, mark_id FROM r JOIN m USING (l_orderkey) WHERE sqrt((r.x - m.x) ** 2 + (r.y - m.y) ** 2) < 0.0451
      QUALIFY row_number() OVER (PARTITION BY r.l_orderkey, rect_id ORDER BY sqrt((r.x - m.x) ** 2 + (r.y - m.y) ** 2), mark_id) = 1)
    SELECT r.l_orderkey, r.rect_id, mark_id FROM r LEFT JOIN n ON n.l_orderkey = r.l_orderkey AND n.rect_id = r.rect_id"""
)
def nearest_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, side = table(spark, sf_dir, "lineitem"), [F.lit(0.0).alias("w"), F.lit(0.0).alias("h")]
    x, y = lambda n: (F.col("l_partkey") % n / 100).alias("x"), lambda n: (F.col("l_suppkey") % n / 100).alias("y")
    rects = rows.select("l_orderkey", F.col("l_linenumber").alias("rect_id"), x(50), y(50), *side)
    marks = rows.select("l_orderkey", F.col("l_linenumber").alias("mark_id"), x(53), y(51), *side)
    return boxes.nearest_landmarks(rects, marks, "l_orderkey", 0.0451).select("l_orderkey", "rect_id", "mark_id")


@query(
    """WITH r AS (SELECT label AS cluster, vec_id AS photo, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)
    SELECT cluster, list(photo ORDER BY photo) FILTER (r <= 5) AS first, greatest(count(*) - 5, 0) AS more FROM r GROUP BY cluster"""
)
def plan_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo"), F.col("label").alias("cluster"))
    return workspace.preview(members)


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x)) AS e FROM embeddings)
    SELECT vec_id, round(unnest(e) / list_sum(e), 6) AS p, generate_subscripts(e, 1) - 1 AS pos FROM e"""
)
def label_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = zero_shot.softmax(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(made).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("p"))


@query(
    """WITH m AS (SELECT l_orderkey AS photo, l_linenumber AS cluster, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1 AS is_primary FROM lineitem)
    SELECT photo, cluster FROM m WHERE is_primary AND cluster IN (1, 2, 3)"""
)
def primary_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("cluster"), "l_extendedprice")
    order = Window.partitionBy("photo").orderBy(F.desc("l_extendedprice"), "cluster")
    faces = rows.withColumn("is_primary", F.row_number().over(order) == 1)
    return workspace.export_members(rows.select("photo", "cluster").distinct(), faces, "primary", [1, 2, 3])


def queries() -> dict[str, Query]:
    from . import ensemble_queries, hierarchy_queries, photo_queries, store_queries, stream_queries  # noqa: F401  (they register themselves)

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
