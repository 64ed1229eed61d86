"""Name -> query of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm import language, mixing, neardup, packing, quality, repair, repeats, sharding, tokens, topk, toxicity, urls, whitening
from cellgauge.llm.common import table

# Where the vocabulary files of public tokenizers lie; None: where the installed package has them.
VOCABULARIES: str | None = None


def vocabulary(name: str) -> str:
    if VOCABULARIES is not None:
        return f"{VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc.doc_id", "source", "block", "place", "release", "deadline", "slot")


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(table(spark, sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    digest = F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256")
    return quality.quality_rules(docs).select("doc.doc_id", "*", digest).drop("doc", "kept_text")


def op8_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op9_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors.where(F.col("id") % 20 == 0), vectors, wide=True)


def op10_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = repeats.remove_repeats(docs)
    return cleaned.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_best_fit_packing,
        op3_setsketch_neardup,
        op4_noisy_or_toxicity,
        op5_pfair_mixing,
        op6_feistel_sharding,
        op7_line_frequency,
        op8_redirect_equivalence,
        op9_threshold_top_k,
        op10_maximal_repeats,
        op11_kneser_ney_language,
        op12_audit_repair,
        op13_cholesky_whitening,
        pipeline,
    )
}
