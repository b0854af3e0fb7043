"""Registered queries of boxes, landmarks, qualities, labels and small columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.functions import boxes, quality, shared_space, zero_shot
from facetlake.functions.vectors import cosine
from facetlake.operators import clusters, records, search
from facetlake.sources.images import timestamps
from facetlake.sources.tables import table

from .registry import query

# -- boxes ----------------------------------------------------------------------

POINTS = "p AS (SELECT l_orderkey, list(((l_partkey % 100) + 20)::INTEGER ORDER BY l_linenumber) AS xs, list(((l_suppkey % 80) + 40)::INTEGER ORDER BY l_linenumber) AS ys FROM lineitem GROUP BY l_orderkey)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", ((F.col("l_partkey") % 100) + 20).cast("int").alias("x"), ((F.col("l_suppkey") % 80) + 40).cast("int").alias("y")))).alias("p"))
    return rows.select("l_orderkey", F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))


def _sides(b: Column) -> list:
    return [b[s].alias(f"box_{s}") for s in ("top", "right", "bottom", "left")]


@query(
    f"""WITH {POINTS}, s AS (SELECT *, list_max(xs) - list_min(xs) AS w, list_max(ys) - list_min(ys) AS h FROM p)
    SELECT l_orderkey, greatest(0, floor(list_min(ys) - h * 0.45::DOUBLE))::INTEGER AS box_top, least(110, floor(list_max(xs) + w * 0.2::DOUBLE))::INTEGER AS box_right,
    least(110, floor(list_max(ys) + h * 0.1::DOUBLE))::INTEGER AS box_bottom, greatest(0, floor(list_min(xs) - w * 0.2::DOUBLE))::INTEGER AS box_left FROM s"""
)
def contour_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.contour_box(F.col("xs"), F.col("ys"), F.lit(110), F.lit(110))
    return _points(spark, sf_dir).select("l_orderkey", b.alias("b")).select("l_orderkey", *_sides(F.col("b")))


@query(
    f"""WITH {POINTS}, s AS (SELECT *, list_max(ys) - list_min(ys) AS h, list_sum(xs)::DOUBLE / len(xs) AS m,
      CASE WHEN len(xs) > 3 THEN floor(len(xs) * 2.5::DOUBLE) / 2 ELSE (list_max(ys) - list_min(ys)) * 0.5::DOUBLE END AS half FROM p)
    SELECT l_orderkey, greatest(0, floor(list_min(ys) - h * 0.45::DOUBLE))::INTEGER AS box_top, least(110, floor(m + half + h * 0.2::DOUBLE))::INTEGER AS box_right,
    least(110, floor(list_max(ys) + h * 0.1::DOUBLE))::INTEGER AS box_bottom, greatest(0, floor(m - half - h * 0.2::DOUBLE))::INTEGER AS box_left FROM s"""
)
def median_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with more than three points know the distance of the eyes."""
    eyes = F.when(F.size("xs") > 3, F.size("xs").cast("double"))
    b = boxes.median_box(F.col("xs"), F.col("ys"), eyes, F.lit(110), F.lit(110))
    return _points(spark, sf_dir).select("l_orderkey", b.alias("b")).select("l_orderkey", *_sides(F.col("b")))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, (l_partkey % 64) / 128 AS x, (l_suppkey % 32) / 128 AS y, (1 + l_linenumber) / 32 AS w, (2 + l_linenumber) / 32 AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, floor((1 - y - h) * 480)::INTEGER AS box_top, floor((x + w) * 640)::INTEGER AS box_right, floor((1 - y) * 480)::INTEGER AS box_bottom, floor(x * 640)::INTEGER AS box_left FROM r"""
)
def boxes_from_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    b = boxes.pixels_from_unit((part % 64) / 128, (supp % 32) / 128, (1 + line) / 32, (2 + line) / 32, F.lit(640), F.lit(480))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", *_sides(F.col("b")))


# -- qualities ------------------------------------------------------------------

MARKS = """k AS (SELECT l_orderkey, l_linenumber, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 9)::DOUBLE AS e, (l_partkey % 25)::DOUBLE + 3 AS nose, (l_suppkey % 50)::DOUBLE + 5 AS mouth,
    l_linenumber = 7 AS missing, l_quantity, l_tax FROM lineitem),
    q AS (SELECT *, sqrt((x + 10) * (x + 10) + e * e) AS eyes, e / 2 AS eye_y FROM k),
    s AS (SELECT *, CASE WHEN missing THEN 0.4 WHEN eyes < 1 OR NOT (eye_y < nose AND nose < mouth) THEN 0.3 ELSE 0.4 * (1 - least(e / (eyes + 1e-6), 1)) +
      0.6 * (CASE WHEN abs(mouth - nose) / (eyes + 1e-6) < 0.2 OR abs(mouth - nose) / (eyes + 1e-6) > 2.0 THEN 0.5 WHEN abs(mouth - nose) / (eyes + 1e-6) BETWEEN 0.3 AND 1.5 THEN 1.0 ELSE 0.7 END) END AS marks FROM q)"""


def _marks() -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    nose = F.when(F.col("l_linenumber") != 7, point(F.lit(5), part % 25 + 3))
    mouth = supp % 50 + 5
    return quality.landmark_quality(point(F.lit(0), F.lit(0)), point(part % 40 + 10, supp % 9), nose, point(F.lit(2), mouth), point(F.lit(8), mouth))


@query(f"WITH {MARKS} SELECT l_orderkey, l_linenumber, round(marks, 6) AS score FROM s")
def landmark_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(_marks(), 6).alias("score"))


FACE = "0.7 * least(1, l_quantity::DOUBLE * 8 / 200) + 0.3 * (CASE WHEN l_tax::DOUBLE > 0.001 THEN least(1, l_tax::DOUBLE / 0.05) ELSE 0 END)"


@query(f"SELECT l_orderkey, l_linenumber, round({FACE}, 6) AS score FROM lineitem")
def face_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = quality.face_quality(F.col("l_quantity").cast("double") * 8, F.col("l_tax").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(f"WITH {MARKS} SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.6 * ({FACE}) + 0.4 * marks)), 6) AS score FROM s")
def combined_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = quality.face_quality(F.col("l_quantity").cast("double") * 8, F.col("l_tax").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(quality.combined_quality(face, _marks()), 6).alias("score"))


# -- labels and search ------------------------------------------------------------


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    r AS (SELECT vec_id, printf('label %02d', pos::INTEGER) AS label, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS rank FROM x QUALIFY rank <= 5)
    SELECT vec_id, label, rank::INTEGER AS rank FROM r"""
)
def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.struct(F.format_string("label %02d", i).alias("label"), x.alias("score")))
    made = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(zero_shot.best_labels(scored, 5)).alias("pos", "l"))
    return made.select("vec_id", F.col("l.label").alias("label"), (F.col("pos") + 1).alias("rank"))


@query("SELECT doc_id, replace(replace('a photo of a ' || source, 'a photo of ', ''), 'a ', '') AS label FROM documents")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", zero_shot.short_label(F.concat(F.lit("a photo of a "), F.col("source"))).alias("label"))


@query(
    """SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS tags FROM (SELECT p_partkey,
      list_reduce(list_prepend([]::VARCHAR[], list_transform(list_concat(string_split(p_type, ' '), string_split(p_brand || ' ' || p_type, ' ')), lambda w: [w])),
        lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM part)"""
)
def ordered_tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.split("p_type", " "), F.split(F.concat_ws(" ", "p_brand", "p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(zero_shot.first_seen_union(first, second, F.lit(None)), "|").alias("tags"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 7),
    s AS (SELECT vec_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)) + 1e-8), 6) AS score FROM v, q WHERE vec_id % 10 <> 3)
    SELECT vec_id, score FROM s WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 20"""
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another size (here: cut to half) are passed over."""
    faces = table(spark, sf_dir, "embeddings")
    q = search.vector_of(faces, "vec_id", "embedding", 7)
    text = F.array(*[F.lit(float(x)) for x in q])
    rows = faces.withColumn("v", F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))).where(F.size("v") == len(q))
    scored = rows.select("vec_id", F.round(cosine(F.col("v"), text, 1e-8), 6).alias("score"))
    return scored.where("score >= 0.1").orderBy(F.desc("score"), "vec_id").limit(20)


LABEL_WORDS = ["sunset", "nature", "beach", "snowy", "Night", "food", "indoor", "city", "dark", "bright", "portrait", "personal", "landscape", "vivid", "party", "chair"]
PLACES = [0, 1, 4, 8, 12, 16, 17]


@query(
    f"""WITH t AS (SELECT p_partkey, lower({LABEL_WORDS}[p_partkey % 16 + 1] || ' ' || p_type || ' ' || {LABEL_WORDS}[(p_partkey // 16) % 16 + 1]) AS t FROM part),
    w AS (SELECT *, CASE WHEN list_has_any(string_split_regex(t, '\\s+'), ['person', 'people', 'face', 'portrait', 'party', 'wedding']) THEN 0.05 ELSE 0 END::DOUBLE AS people,
        contains(t, 'sunset')::INT AS sunset, contains(t, 'nature')::INT AS nature, contains(t, 'beach')::INT AS beach, contains(t, 'snow')::INT AS snow, contains(t, 'night')::INT AS night,
        contains(t, 'food')::INT AS food, contains(t, 'indoor')::INT AS indoor, contains(t, 'city')::INT AS city FROM t),
    r AS (SELECT p_partkey, people AS r1, people + 0.3 * (0.8 * sunset + 0.2 * nature + 0.3 * beach + 0.7 * snow + 0.1 * night + 0.6 * food + 0.4 * indoor + 0.3 * city) AS r0,
        people + 0.3 * (0.3 * sunset + 0.6 * nature + 0.4 * beach + 0.7 * snow + 0.1 * night + 0.4 * food + 0.35 * indoor + 0.3 * city) AS r4,
        people + 0.3 * (0.1 * sunset + 0.2 * nature + 0.6 * beach + 0.7 * snow + 0.15 * night + 0.2 * food + 0.3 * indoor + 0.35 * city) AS r8,
        0.5::DOUBLE * ((snow = 1 OR contains(t, 'bright'))::INT - (night = 1 OR contains(t, 'dark'))::INT) AS r12,
        0.3::DOUBLE * (regexp_matches(t, 'portrait|person|people')::INT - regexp_matches(t, 'landscape|panorama')::INT) AS r16,
        0.3::DOUBLE * regexp_matches(t, 'colorful|vivid')::INT AS r17 FROM w),
    n AS (SELECT *, sqrt(r0 * r0 + r4 * r4 + r8 * r8 + 9 * r1 * r1 + r12 * r12 + r16 * r16 + r17 * r17) AS len FROM r)
    SELECT p_partkey, {", ".join(f"CASE WHEN len > 0 THEN round(r{i} / len, 6) ELSE 0.0 END AS place_{i}" for i in PLACES)} FROM n"""
)
def keyword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the space of images: a part's type between two words that follow from its key."""
    word = lambda n: F.get(F.array(*[F.lit(w) for w in LABEL_WORDS]), n.cast("int"))
    text = F.concat_ws(" ", word(F.col("p_partkey") % 16), "p_type", word(F.floor(F.col("p_partkey") / 16) % 16))
    rows = table(spark, sf_dir, "part").select("p_partkey", shared_space.text_vector(text).alias("v"))
    return rows.select("p_partkey", *[F.round(F.col("v")[i], 6).alias(f"place_{i}") for i in PLACES])


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT vec_id, round((0.33 * v[1] + 0.21 * v[5] + 0.21 * v[9]) / sqrt(0.33 * 0.33 + 2 * 0.21 * 0.21) / sqrt(list_dot_product(v, v)), 6) AS score FROM v)
    SELECT vec_id, score FROM s WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 20"""
)
def images_for_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to a text."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return shared_space.images_for_text(vectors, "vec_id", "A sunset on the beach", least=0.1)


# -- small columns ----------------------------------------------------------------


@query(
    """SELECT c_custkey, array_to_string(list_transform(list_filter(string_split(c_mktsegment || ', x ,,' || c_nationkey, ','), lambda p: trim(p) <> ''), lambda p: trim(p)), '|') AS parts,
    array_to_string(list_filter(list_transform(string_split(c_nationkey || ', x ,,' || c_custkey, ','), lambda p: try_cast(trim(p) AS INTEGER)), lambda p: p IS NOT NULL), '|') AS numbers FROM customer"""
)
def comma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    parts = records.listed(F.concat(F.col("c_mktsegment"), F.lit(", x ,,"), nation))
    numbers = records.listed(F.concat(nation, F.lit(", x ,,"), key), "int")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(parts, "|").alias("parts"), F.array_join(F.transform(numbers, lambda n: n.cast("string")), "|").alias("numbers"))


@query("SELECT doc_id, doc_id % 4 IN (0, 3) AS inside FROM documents")
def paths_under_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["/in/put/x/{}.jpg", "/in/putty/{}.jpg", "/in/put/../{}.jpg", "/in/./put/a/../{}.jpg"]
    path = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", records.below(F.replace(path, F.lit("{}"), F.col("doc_id").cast("string")), "/in/put/").alias("inside"))


@query("SELECT doc_id, decode(from_base64(to_base64(encode(source)))) AS source, substr(replace(md5(source), '-', ''), 1, 8) AS short_id FROM documents")
def base64_and_short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.base64(F.col("source").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", F.unbase64(there).cast("string").alias("source"), records.short_id(F.md5(F.col("source").cast("binary"))).alias("short_id"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN TIMESTAMP '2021-03-04 05:06:07' WHEN 2 THEN TIMESTAMP '2022-03-04 05:06:07' ELSE TIMESTAMP '2023-03-04 05:06:07' END AS taken FROM events"""
)
def photo_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three formats, one that is none, and the file's time."""
    first = F.when(F.col("event_id") % 4 == 1, "2021:03:04 05:06:07").when(F.col("event_id") % 4 == 2, "no date").when(F.col("event_id") % 4 == 3, "2023/03/04 05:06:07")
    second = F.when(F.col("event_id") % 4 == 2, "2022-03-04 05:06:07")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", first.alias("original"), second.alias("digitized"))
    return rows.select("event_id", timestamps(rows, ["original", "digitized"], "ts").cast(rows.schema["ts"].dataType).alias("taken"))


@query("SELECT label, round(quantile_cont(embedding[1]::DOUBLE, 0.1), 6) AS low, round(quantile_cont(embedding[1]::DOUBLE, 0.9), 6) AS high, round(var_pop(embedding[1]::DOUBLE), 6) AS spread FROM embeddings GROUP BY label")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")[0].cast("double")
    cut = F.percentile(x, F.array(F.lit(0.1), F.lit(0.9)))
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(cut.alias("c"), F.round(F.var_pop(x), 6).alias("spread"))
    return rows.select("label", F.round(F.col("c")[0], 6).alias("low"), F.round(F.col("c")[1], 6).alias("high"), "spread")


@query("WITH a AS (SELECT vec_id, 'cluster_' || label AS name FROM embeddings WHERE label <> 0 UNION ALL SELECT vec_id, 'noise_' || vec_id FROM embeddings WHERE label = 0) SELECT vec_id, name FROM a")
def named_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 stands for noise."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, clusters.NOISE).otherwise(F.col("label")).alias("label"))
    return clusters.named(rows, "vec_id", "label")
