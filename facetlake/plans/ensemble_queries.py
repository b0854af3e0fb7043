"""Registered queries of the vote of three arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import classify, landmark_kernel

from .catalog import EUCLID, NEAR, _known_and_new
from .registry import query

WEIGHTS = {"cosine": 0.5, "euclid": 0.2, "svm": 0.3}


def _two_arms(known: DataFrame, new: DataFrame, near: DataFrame) -> DataFrame:
    best = classify.majority(classify.neighbour_votes(near, known, "vec_id", "label"))
    euclid = classify.best_share(classify.euclidean_shares(new, known, "vec_id", "embedding", "label", 5))
    return best.select("query_id", F.lit("cosine").alias("method"), "cluster", F.col("best").alias("confidence")).unionByName(
        euclid.select("query_id", F.lit("euclid").alias("method"), "cluster", F.col("share").alias("confidence"))
    )


@query(
    f"""{NEAR}, {EUCLID}, m AS (SELECT query_id, 'cosine' AS method, label AS cluster, best AS confidence FROM w
      UNION ALL (SELECT query_id, 'euclid', cluster, share FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, cluster) = 1)
      UNION ALL SELECT vec_id, 'svm', (vec_id // 50) % 3, (1 + vec_id % 8) / 8.0 FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, cluster, sum((CASE method WHEN 'cosine' THEN 0.5 WHEN 'euclid' THEN 0.2 ELSE 0.3 END) * confidence) AS s FROM m GROUP BY ALL),
    b AS (SELECT query_id, cluster, round(round(s, 9) / sum(s) OVER (PARTITION BY query_id), 6) AS confidence FROM s
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, cluster) = 1)
    SELECT query_id, CASE WHEN confidence >= 0.4 THEN cluster END AS predicted, confidence FROM b"""
)
def vote_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote with a third arm whose predictions are fixed by the ids."""
    known, new, near = _known_and_new(spark, sf_dir)
    number = (F.floor(F.col("vec_id") / 50) % 3).cast("int")
    fixed = new.select(F.col("vec_id").alias("query_id"), F.lit("svm").alias("method"), number.alias("cluster"), ((1 + F.col("vec_id") % 8) / 8.0).alias("confidence"))
    return classify.weighted_vote(_two_arms(known, new, near).unionByName(fixed), WEIGHTS)


@query()
def ensemble_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, predicted, confidence, svm): the vote with the kernel arm trained on all faces but the new ones, and what that arm says alone."""
    known, new, near = _known_and_new(spark, sf_dir)
    arm = landmark_kernel.train(known.where("vec_id % 50 <> 0"), "vec_id", "embedding", "label")
    votes = _two_arms(known, new, near)
    if arm is None:
        return classify.weighted_vote(votes, WEIGHTS).withColumn("svm", F.lit(None).cast("int"))
    own = landmark_kernel.predict(new, arm, "vec_id", "embedding").drop("margin")
    voted = classify.weighted_vote(votes.unionByName(own), WEIGHTS)
    return voted.join(own.select("query_id", F.col("cluster").alias("svm")), "query_id", "left")
