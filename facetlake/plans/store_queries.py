"""Registered queries of stores, records, libraries, caches and search with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import albums, classify, clusters, jobs, records, search, stores, workspace
from facetlake.sources.tables import table

from .catalog import SUMS, U
from .registry import query


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of 40 images."""
    return table(spark, sf_dir, "embeddings").withColumn("image", F.concat(F.lit("img_"), (F.col("vec_id") % 40).cast("string")))


FACES = "f AS (SELECT *, 'img_' || (vec_id % 40) AS image FROM embeddings)"

# -- faces ----------------------------------------------------------------------


@query(
    """SELECT e.vec_id, l.l_linenumber IS NOT NULL AS has_head, round(coalesce(l_quantity, 0)::DOUBLE, 4) AS first FROM embeddings e
    LEFT JOIN lineitem l ON l.l_orderkey = e.vec_id AND l.l_linenumber = 1"""
)
def head_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("vec_id"), F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).alias("head"))
    made = records.with_head_features(table(spark, sf_dir, "embeddings"), heads, ["vec_id"], "head", 2)
    return made.select("vec_id", "has_head", F.round(F.col("head")[0], 4).alias("first"))


@query(
    f"""WITH {U}, s AS (SELECT a.vec_id, round(list_dot_product(a.v, b.v), 4) AS similarity FROM u a, u b WHERE b.vec_id = 0 AND a.vec_id <> 0),
    r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 50)
    SELECT r.vec_id, rank, o_custkey, o_orderstatus FROM r LEFT JOIN orders ON o_orderkey = vec_id"""
)
def search_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    found = search.search(faces, search.vector_of(faces, "vec_id", "embedding", 0), "vec_id", "embedding", 50, -1.0, exclude=0)
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_custkey", "o_orderstatus")
    return records.with_metadata(found.select("vec_id", "rank"), known, "vec_id")


@query("SELECT l_orderkey AS photo, max(l_linenumber) AS cluster FROM lineitem GROUP BY 1")
def last_cluster_of_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("cluster"))
    return records.last_cluster(rows, "photo", "cluster")


@query(f"WITH {FACES} SELECT count(*) AS faces, count(DISTINCT image) AS images, count(DISTINCT label) FILTER (label <> -1) AS clusters FROM f")
def face_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.face_counts(_faces(spark, sf_dir), "label", "image")


@query(f"WITH {FACES} SELECT vec_id, label, image FROM f WHERE image IN ('img_3', 'img_7')")
def faces_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.by_key(_faces(spark, sf_dir), "image", ["img_3", "img_7"]).select("vec_id", "label", "image")


@query("SELECT vec_id, label FROM embeddings WHERE label = 2")
def faces_of_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.by_key(table(spark, sf_dir, "embeddings"), "label", [2]).select("vec_id", "label")


@query("SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL ORDER BY label")
def ordered_cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cluster_ids(table(spark, sf_dir, "embeddings"), "label")


@query(f"WITH {FACES} SELECT image, max(vec_id % 7)::INTEGER AS quality FROM f GROUP BY image HAVING max(vec_id % 7) > 0")
def best_quality_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.best_quality(_faces(spark, sf_dir).withColumn("quality", (F.col("vec_id") % 7).cast("int")), "image", "quality")


@query("SELECT 64 AS size")
def common_vector_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few faces have shorter vectors; most have the table's size."""
    short = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return records.common_size(table(spark, sf_dir, "embeddings").select(short.alias("v")), "v")


@query("SELECT l_orderkey, count(*) FILTER (l_linenumber = 2) AS shown FROM lineitem GROUP BY 1")
def boxes_of_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("cluster"), "l_partkey")).alias("faces"))
    return records.boxes_of_cluster(images, "faces", 2).select("l_orderkey", F.size("faces").cast("long").alias("shown"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 0")
def deleted_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings").select("vec_id")
    return stores.delete(faces, faces.where("vec_id % 11 = 0"), "vec_id")


MEMBERS = "m AS (SELECT l_orderkey AS photo, CASE WHEN l_linenumber > 5 THEN -1 ELSE l_suppkey % 20 END AS cluster FROM lineitem)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("l_linenumber") > 5, -1).otherwise(F.col("l_suppkey") % 20)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo"), cluster.cast("int").alias("cluster"))


@query(f"WITH {MEMBERS} SELECT cluster, count(DISTINCT photo) AS photos, min(photo) AS cover, round(cluster / 100, 3) AS confidence FROM m WHERE cluster <> -1 GROUP BY cluster")
def review_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.range(20).select(F.col("id").cast("int").alias("cluster"), F.round(F.col("id") / 100, 3).alias("confidence"))
    return records.review(_members(spark, sf_dir), known, "photo", "cluster")[0]


@query(f"WITH {MEMBERS} SELECT DISTINCT photo FROM m WHERE photo NOT IN (SELECT photo FROM m WHERE cluster <> -1)")
def review_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.range(20).select(F.col("id").cast("int").alias("cluster"), F.lit(0.5).alias("confidence"))
    return records.review(_members(spark, sf_dir), known, "photo", "cluster")[1]


@query(
    f"""WITH {MEMBERS}, c AS (SELECT count(DISTINCT photo) AS clustered, count(DISTINCT cluster) AS clusters FROM m WHERE cluster <> -1)
    SELECT count(DISTINCT photo) AS all_photos, any_value(clustered) AS clustered, any_value(clusters) AS clusters, count(DISTINCT photo) - any_value(clustered) AS noise FROM m, c"""
)
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.range(20).select(F.col("id").cast("int").alias("cluster"), F.lit(0.5).alias("confidence"))
    return records.review(_members(spark, sf_dir), known, "photo", "cluster")[2]


@query(f"WITH {MEMBERS} SELECT photo FROM m WHERE cluster <> -1 UNION ALL SELECT DISTINCT photo FROM m WHERE cluster = -1")
def all_clustered_and_noise_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of several clusters come as often."""
    rows = _members(spark, sf_dir)
    return rows.where("cluster <> -1").select("photo").unionAll(rows.where("cluster = -1").select("photo").distinct())


@query("SELECT max(label) + 1 AS next_id FROM embeddings")
def next_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.next_cluster_id(table(spark, sf_dir, "embeddings"), "label")


@query(
    f"""WITH {U}, x AS (SELECT vec_id, label, unnest(v) * (1 + vec_id % 3) AS x, 1 + vec_id % 3 AS w, generate_subscripts(v, 1) - 1 AS pos FROM u),
    m AS (SELECT label, pos, sum(x) AS s, count(*) AS n, sum(w) AS w FROM x GROUP BY ALL),
    c AS (SELECT label, list(s ORDER BY pos) AS s, max(n) AS member_count, max(w)::DOUBLE AS total_weight FROM m GROUP BY label)
    SELECT label, member_count, total_weight, round(s[1] / sqrt(list_dot_product(s, s)), 5) AS first FROM c"""
)
def weighted_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    made = clusters.centroids(faces, "label", "embedding", weight=1 + F.col("vec_id") % 3)
    return made.select("label", "member_count", "total_weight", F.round(F.col("centroid")[0], 5).alias("first"))


@query(f"WITH {SUMS} SELECT label, n AS member_count, n::DOUBLE AS total_weight, round(c[1], 5) AS first FROM cc")
def prototypes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    back = records.prototypes_from_json(records.prototypes_as_json(made, "label"), "label")
    return back.select("label", "member_count", "total_weight", F.round(F.col("centroid")[0], 5).alias("first"))


@query(
    f"""WITH {SUMS}, d AS (SELECT vec_id, cc.label AS predicted, round(list_dot_product(u.v, cc.c), 6) AS sim FROM u, cc WHERE cc.label NOT IN (0, 3))
    SELECT vec_id, predicted, greatest(sim, 0.0) AS confidence FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, predicted) = 1"""
)
def nearest_other_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings")
    return classify.nearest_centroid(faces, clusters.centroids(faces, "label", "embedding"), "vec_id", "embedding", "label", exclude=[0, 3])


# -- caches, tags ---------------------------------------------------------------


@query(f"WITH {FACES} SELECT count(DISTINCT image) AS images, count(*) AS faces FROM f")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cache_stats(_faces(spark, sf_dir), "image")


@query("SELECT count(*) AS entries, round(sum(n_chars) / 1048576, 2) AS megabytes FROM documents")
def cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cache_size(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def first_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 500)


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE ts END AS ts FROM events")
def touched_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    now = F.lit("2030-01-01 00:00:00").cast(rows.schema["ts"].dataType)
    return records.touched(rows, rows.where("event_id % 13 = 0"), "event_id", "ts", now)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 40 NOT IN (1, 2) UNION ALL SELECT vec_id + 1000000, 99 FROM embeddings WHERE vec_id % 40 = 1")
def cache_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 1 and 2 are read again: one has other faces now, the faces of the other have no vector."""
    old = _faces(spark, sf_dir)
    again = old.where("vec_id % 40 in (1, 2)").withColumn("embedding", F.when(F.col("vec_id") % 40 == 1, F.col("embedding")))
    again = again.withColumn("vec_id", F.col("vec_id") + 1_000_000).withColumn("label", F.lit(99).cast(old.schema["label"].dataType))
    return stores.cache_store(old, again, "image", "embedding").select("vec_id", "label")


TAGS = "t AS (SELECT doc_id AS image, [coalesce(lang, 'none'), source] AS tags, n_chars FROM documents), i AS (SELECT unnest(tags) AS tag, image FROM t)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("image"), F.array(F.coalesce("lang", F.lit("none")), F.col("source")).alias("tags"))


@query(f"WITH {TAGS} SELECT image, 1.0 AS score FROM i WHERE tag = 'en' ORDER BY image LIMIT 100")
def images_with_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.search_tag(stores.tag_index(_tags(spark, sf_dir), "image", "tags"), "en", "image").select("image", "score")


@query(f"WITH {TAGS} SELECT DISTINCT image FROM i WHERE tag IS NOT NULL")
def tagged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.tag_index(_tags(spark, sf_dir), "image", "tags").where("tag is not null").select("image").distinct()


@query("SELECT doc_id AS image, coalesce(lang, 'none') AS language, source AS origin FROM documents")
def tags_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    long = rows.select(
        F.col("doc_id").alias("image"),
        F.explode(F.array(F.struct(F.lit("language").alias("c"), F.array(F.coalesce("lang", F.lit("none"))).alias("t")), F.struct(F.lit("origin").alias("c"), F.array("source").alias("t")))).alias("r"),
    ).select("image", F.col("r.c").alias("category"), F.col("r.t").alias("tags"))
    made = stores.tags_by_category(long, "image", "category", "tags")
    return made.select("image", F.col("categories")["language"][0].alias("language"), F.col("categories")["origin"][0].alias("origin"))


# -- corrections, libraries, jobs -----------------------------------------------


@query(
    """SELECT count(*) FILTER (value < 40) AS merges, count(*) FILTER (value > 60) AS splits, count(*) FILTER (value < 40 OR value > 60) AS total,
    round(count(*) FILTER (value > 60) / count(*) FILTER (value < 40 OR value > 60), 6) AS split_ratio FROM events"""
)
def adaption_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("value") > 60, "split").when(F.col("value") < 40, "merge").otherwise("none")
    return records.adaption_stats(table(spark, sf_dir, "events").withColumn("action", action), "action")


@query(
    """WITH l AS (SELECT event_id AS id, user_id FROM events), n AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS seq FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0))
    SELECT id, user_id FROM l UNION ALL SELECT seq + (SELECT max(id) FROM l), user_id FROM n"""
)
def recorded_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetlake.operators.numbering import numbered_in_order

    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    fresh = numbered_in_order(log.where("user_id % 10 = 0").select("user_id").distinct(), ["user_id"], "n")
    return records.record_corrections(log, fresh.withColumn("seq", F.col("n") + 1))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("library_id"), F.lit(1).cast("long").alias("version"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("photo_count"), F.lit(False).alias("deleted")
    )


@query(
    """SELECT c_custkey AS library_id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS name, c_nationkey::BIGINT AS photo_count,
    CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey NOT IN (1, 2, 3)"""
)
def updated_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, renamed (with a field that may not change), and deleted libraries."""
    log = _versions(spark, sf_dir)
    changes = log.where("library_id % 3 = 0").select("library_id", F.concat(F.lit("new "), F.col("library_id").cast("string")).alias("name"), F.lit(True).alias("deleted"), F.lit(None).cast("long").alias("photo_count"))
    log = records.deleted_libraries(records.library_versions(log, changes), [1, 2, 3])
    now = stores.latest(log, ["library_id"], [F.desc("version")]).where("not deleted")
    return now.select("library_id", "name", "photo_count", F.col("version").cast("int").alias("version"))


@query("SELECT user_id, count(DISTINCT event_type) AS phases, arg_max(event_type, (ts, event_type)) AS last_phase, max(ts) AS last_at FROM events GROUP BY user_id")
def job_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.phase_state(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("SELECT event_id, floor((row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY user_id % 3, ts, event_id) - 1) / 16)::INTEGER AS batch FROM events")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("urgency", F.col("user_id") % 3)
    return records.batches(rows, "urgency", "ts", "event_id", 16).select("event_id", "batch")


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def unfinished_after_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id")
    return jobs.pending(rows, rows.where("event_id % 4 = 0"), "event_id")


@query("SELECT user_id AS cluster, arg_min(event_id, (ts, event_id)) AS first_photo FROM events GROUP BY user_id")
def first_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.col("user_id").alias("cluster")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_photo"))


@query(
    """WITH p AS (SELECT user_id, 'p/' || event_id AS path, ts, floor(value % 10)::INTEGER AS q, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, 'p/' || event_id) AS n FROM
      (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, 'p/' || event_id) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events))
    SELECT user_id, printf('event_%04d', n::INTEGER) AS event_id, path AS cover FROM p QUALIFY row_number() OVER (PARTITION BY user_id, n ORDER BY q DESC, ts, path) = 1"""
)
def covers_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as text, and qualities that tie."""
    photos = table(spark, sf_dir, "events").select("user_id", "ts", F.concat(F.lit("p/"), F.col("event_id").cast("string")).alias("path"), F.floor(F.col("value") % 10).cast("int").alias("q"))
    return albums.covers(albums.sessions(photos, "user_id", "ts", "path"), "user_id", "ts", "path", F.col("q"))
