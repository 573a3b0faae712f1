"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import decontaminate, hardneg, licences, linededup, minhash, mixing, neighbours, piecewise, pii, quality, tokens, warc, whitening
from assetloom.llm._common import scratch, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = linededup.drop_repeated_runs(docs, count_col="lines_cut")
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars_left"), "lines_cut")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0").select("vec_id"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", F.round("quality_score", 6).alias("quality_score"), "keep")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compared(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.hard_negatives(rows, rows.filter("vec_id % 50 = 0").select("vec_id"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_line_dedup,
        op3_neighbours,
        op4_minhash_near_dedup,
        op5_token_counts,
        op6_warc,
        op7_license_scan,
        op8_pii,
        op9_quality_classifier,
        op10_decontamination,
        op11_whitening,
        op12_fingerprints,
        op13_hard_negatives,
    )
}

#: SHA-1 in hexadecimal to base32: groups of five digits give four characters.
_BASE32 = """(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(sha1(h), 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i) FROM range(32) t(i))"""

SQL: dict[str, str] = {
    "op6_warc": f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    m AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS n FROM p)
    SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN n = 1 THEN NULL ELSE top END AS refers_to
    FROM m""",
    "op7_license_scan": licences.oracle(),
    "op13_hard_negatives": """
    WITH e AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ),
    s AS (
        SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
        FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0
    ),
    p AS (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same
    ),
    n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        WHERE p.k <= 5
    )
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
