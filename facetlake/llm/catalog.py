"""Registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, quality, url_filter
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .filter_audit import audit
from .jaccard_join import jaccard_components
from .pii import pii_report
from .sentencepiece_bpe import encode_texts
from .sharding import shard_documents
from .storage import fresh_path
from .warc import archive_report
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def _fold(id_col: str, folds: int) -> Column:
    """The remainder that says whether a row may be learned from."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(_fold("doc_id", 4) != 2).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


#: The rules that the query applies.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.build(URL_RULES))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


OP2_SQL = rf"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN {_fits('example.com', '/en/7')} THEN 'example.com/en/7'
    WHEN {_fits('example.net', '/de/8')} THEN 'example.net/de/8'
    WHEN {_fits('com', '/en/')} THEN 'com/en/'
    WHEN {_fits('net', '/de/')} THEN 'net/de/'
    WHEN {_fits('org', '/es/')} THEN 'org/es/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=40)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path())


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """Learned from labelled rows outside the held-out fold; the sample, ``quality.MAX_ROWS`` ids at most, is sent to the texts."""
    labels = _table(spark, sf_dir, "labels").where(_fold("doc_id", 5) != 0).where("quality is not null").select("doc_id", "quality")
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.train(texts.join(F.broadcast(quality.sample_rows(labels)), "doc_id"), max_rows=None)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: list_aggregate(ws[i:i + 3], 'string_agg', ' ')))
                      WHEN len(ws) > 0 THEN [list_aggregate(ws, 'string_agg', ' ') || ' '] ELSE [] END AS sh
  FROM w
), n AS (
  SELECT doc_id, len(sh) AS n_shingles FROM s
), e AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)
), both_ways AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a
)
SELECT n.doc_id, n.n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated pair; the tiles themselves stay in the operator's result."""
    tests = decontaminate.load_tests(_table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), tests).drop("tiles")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS original
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM o
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS length FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT f AS filter_order, 1 AS k FROM letters
  UNION ALL
  SELECT filter_order || f, k + 1 FROM orders, letters WHERE k < 5 AND NOT contains(filter_order, f)
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), marked AS (
  SELECT doc_id, part, length(txt) AS chars, length(regexp_replace(txt, '[^A-Z]', '', 'g')) AS capitals, len(words) AS n_words,
         len(list_distinct(words)) AS n_distinct, regexp_matches(txt, '[#$%&*|]') AS marks, min(doc_id) OVER (PARTITION BY txt) AS first_id
  FROM t
), failed AS (
  SELECT part, doc_id,
         CASE WHEN n_words < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * n_distinct < 65 * n_words THEN 'B' ELSE '' END ||
         CASE WHEN 100 * capitals > 5 * chars THEN 'C' ELSE '' END || CASE WHEN marks THEN 'D' ELSE '' END ||
         CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS fails
  FROM marked
), labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), patterns AS (
  SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM failed LEFT JOIN labelled USING (doc_id) GROUP BY 1, 2, 3, 4
), steps AS (
  SELECT p.*, filter_order, s.step, substr(filter_order, s.step, 1) AS f,
         length(regexp_extract(filter_order, CASE WHEN fails = '' THEN '^[A-E]*' ELSE '^[^' || fails || ']*' END)) + 1 AS falls_at
  FROM patterns p, (SELECT filter_order FROM orders WHERE k = 5) o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN falls_at > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN falls_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN falls_at < step AND contains(fails, f) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN falls_at = step THEN n * good ELSE 0 END) AS good_lost,
         sum(CASE WHEN falls_at = step THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_sharding": op3_sharding,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality": op5_quality,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_decontaminate": op7_decontaminate,
        "op8_warc": op8_warc,
        "op9_pii": op9_pii,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_filter_audit": op12_filter_audit,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op8_warc": OP8_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op11_embedding_dedup": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
    }
