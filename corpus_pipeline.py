"""A corpus pipeline of five stages; each works on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; their results are written as Parquet and read again. Null or empty
texts are rows like others: they are scored, deduplicated and encoded. The stages
that keep one row of a group name rows by a key of their own, so ids may repeat or
be missing. Further columns of the input are not carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import catalog, decontaminate, quality
from facetlake.llm.exact_dedup import exact_dedup
from facetlake.llm.jaccard_join import jaccard_components
from facetlake.llm.sentencepiece_bpe import encode_texts
from facetlake.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row with a key of its own, stored so that it stays: by id, missing ones last, then by place."""
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "keyed")
    return rows.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row"))


def _keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these keys; keys grow with the table, so they are not broadcast."""
    return docs.join(keys.select(F.col("_key._row").alias("_row")).hint("merge"), "_row", "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs.select(*COLUMNS), catalog.quality_model(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the smallest id."""
    docs = _keyed(docs)
    return _keep(docs, exact_dedup(docs, id_col="_key").where("kept"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) one row stays, of the smallest id."""
    docs = _keyed(docs)
    return _keep(docs, jaccard_components(docs, width=5, num=80, den=100, id_col="_key").where("_key = component_id"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a test item go."""
    tests = decontaminate.load_tests(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.clean(docs.select(*COLUMNS), tests)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids' and decoded texts' digests of what is left."""
    return encode_texts(docs, catalog.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", encode_stage),
]

#: No SQL form: a learned model, a tokenizer and set joins; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
