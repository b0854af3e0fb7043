"""Registered queries of hierarchical density clustering, and SQL for its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import hierarchy
from facetlake.operators.numbering import numbered_in_order
from facetlake.sources.tables import table

from .registry import query

UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
#: Distances of all pairs, and each row's to its third nearest, itself included.
PAIRS = f"""u AS (SELECT vec_id, {UNIT} AS v FROM embeddings),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) END AS d FROM u a, u b),
    c AS (SELECT a AS vec_id, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 3)"""


@query(f"WITH {PAIRS} SELECT vec_id, round(core, 6) AS core FROM c")
def hdbscan_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = hierarchy.core_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)
    return cores.select("vec_id", F.round("core", 6).alias("core"))


@query(
    f"""WITH RECURSIVE {PAIRS}, m AS MATERIALIZED (SELECT a, b, greatest(d, x.core, y.core) AS w FROM d JOIN c x ON x.vec_id = a JOIN c y ON y.vec_id = b WHERE a <> b),
    grown AS (
      SELECT 0 AS step, b AS node, w AS best, false AS inside, NULL::DOUBLE AS took FROM m WHERE a = (SELECT min(vec_id) FROM embeddings)
      UNION ALL
      SELECT step + 1, node, CASE WHEN inside THEN best ELSE least(best, coalesce(m.w, best)) END, inside OR node = p.nearest, p.weight
      FROM (SELECT *, first(node) OVER o AS nearest, first(best) OVER o AS weight FROM grown WINDOW o AS (ORDER BY inside, best, node)) p
      LEFT JOIN m ON m.a = p.nearest AND m.b = p.node
      WHERE step < (SELECT count(*) - 1 FROM embeddings)
    )
    SELECT CAST(row_number() OVER (ORDER BY took, step) - 1 AS BIGINT) AS place, round(took, 6) AS weight FROM (SELECT DISTINCT step, took FROM grown WHERE step > 0)"""
)
def hdbscan_tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the spanning tree in order; they are the same for every minimal tree."""
    tree = hierarchy.reachability_tree(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)
    return numbered_in_order(tree, ["w", "a", "b"], "place").select("place", F.round("w", 6).alias("weight"))


@query()
def hdbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hdbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, 2)
