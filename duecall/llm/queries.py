"""One query per operator, over whole tables with production settings, and SQL where it can tell
the same; most operators learn, sample or need loops that SQL has no words for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm import (
    bisector_clusters,
    context_mixing,
    decontaminate,
    graph_search,
    importance,
    language_id,
    near_dedup,
    quality_rules,
    segmentation,
    target_resample,
    token_counts,
    token_store,
    toxicity,
)
from duecall.llm.sql import CLUSTERS, RESAMPLED
from duecall.llm.text import fold_of
from duecall.session import scratch_dir

END_ID = 2


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; only the driver opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def model_proto(name: str = "piece_bpe_32k.model") -> bytes:
    with open(tokenizer_path(name), "rb") as file:
        return file.read()


def op1_sample_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sampled = segmentation.sample_segmentations(docs, model_proto(), keep=["doc_id"])
    each = sampled.select("doc_id", F.posexplode("samples").alias("sample", "s"))
    return each.select(
        "doc_id",
        "sample",
        F.size("s.ids").alias("n_pieces"),
        F.xxhash64("s.ids").alias("ids_hash"),
        F.col("s.log_prob").alias("log_prob"),
        F.col("s.score").alias("perturbed_score"),
        F.col("s.log_inclusion").alias("log_inclusion"),
        F.col("s.intact").alias("round_trip"),
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = scratch_dir(spark, "tokens")
    token_store.write_store(_documents(spark, sf_dir), path, tokenizer, END_ID)
    return token_store.documents_of(token_store.read_store(spark, path))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(_documents(spark, sf_dir), fold_of(F.col("doc_id"), 7) == 2)


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rules = quality_rules.learn_rules(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", *quality_rules.NUMBERS, "base_failed", "kept", "rule"
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.with_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, pieces).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    profiles = language_id.learn_profiles(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph_search.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op12_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector_clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resample.resample(
        _documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_sample_segmentations,
        op2_token_store,
        op3_near_duplicates,
        op4_context_mixing,
        op5_importance,
        op6_toxicity,
        op7_quality_rules,
        op8_decontaminate,
        op9_token_counts,
        op10_language_id,
        op11_graph_search,
        op12_bisector_clusters,
        op13_target_resample,
    )
}
ORACLES: dict[str, str] = {
    "op12_bisector_clusters": CLUSTERS,
    "op13_target_resample": RESAMPLED,
}
