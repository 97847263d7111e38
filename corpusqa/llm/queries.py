"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, language_id, line_dedup, mixing_lm, ngram_join, ordinal_quality, piece_codec, secret_scan, spelling_variants, spot_signatures, suffix_dedup, topk_search

#: The vocabulary that op4 and the pipeline encode with.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_likeness(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select(
        "doc_id",
        *(secret_scan.counted("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.joined("base").cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def op4_piece_codec(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_decode(table(spark, sf_dir, "documents"), model_path))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leak of a benchmark item: what decontamination acts on."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("training", F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    out = mixing_lm.score(docs)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_ordinal_quality(spark: SparkSession, sf_dir: str, least_tail: float = 0.5) -> DataFrame:
    """The documents selected for training: those that are more likely than not of the best grade."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal_quality.fit(docs, labels.select("doc_id", ordinal_quality.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    return ordinal_quality.rate(docs, model).where(F.col("tail_2") >= least_tail)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, F.col("id") % 20 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_spot_signatures,
        op2_ngram_join,
        op3_secret_scan,
        op4_piece_codec,
        op5_decontaminate,
        op6_mixing_lm,
        op7_ordinal_quality,
        op8_suffix_dedup,
        op9_line_dedup,
        op10_language_id,
        op11_topk_search,
        op12_conversation_repair,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in named}


#: Dimensions meet by position; scores and ranks as the operator defines them.
TOPK_SQL = """
WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
w AS (SELECT vec_id, pos, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM x WHERE vec_id NOT IN (SELECT vec_id FROM x WHERE x IS NULL OR NOT isfinite(x))),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.w * b.w) AS BIGINT) AS score FROM w a JOIN w b ON a.pos = b.pos AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_topk_search": TOPK_SQL}
