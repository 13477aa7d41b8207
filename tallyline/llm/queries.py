"""The registered queries of these operators, over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    centroids,
    decontamination,
    kneser_ney,
    line_dedup,
    near_dedup,
    neighbours,
    packing,
    quality_rules,
    substring_dedup,
    token_files,
    toxicity,
    warc,
    whitening,
)
from tallyline.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

TOKENIZER = "byte_bpe_50k.json"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def packed_documents(documents: DataFrame) -> DataFrame:
    """The pieces of documents with their places in sequences; their ids as a checksum."""
    pieces = packing.pieces(documents, tokenizer_path(), keep=["doc_id"]).select(
        "row.doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return packing.pack(pieces).select("row.*", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 1,024 tokens."""
    return packed_documents(load(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that stand in 10-word windows of benchmark items."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_benchmark(documents, load(spark, sf_dir, "benchmark"), keep=["doc_id"])
    found = F.col("found")
    n_hit = decontamination.hit_words(found)
    return marked.select(
        "row.doc_id",
        found["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.group(documents, keep=["doc_id"]).select(
        "row.doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a web archive and read back."""
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by a model of word pairs that is learnt from nine tenths of them."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    model = kneser_ney.train(documents.where(rest != 0).select("text"))
    return kneser_ney.score(documents, model, keep=["doc_id"]).select(
        "row.doc_id",
        (F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.judge(documents, keep=["doc_id"])
    return judged.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, but for one word where they have five or more."""
    found = F.col("found")
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_lines(documents, keep=["doc_id"]).select(
        "row.doc_id",
        found["n_lines"].alias("n_lines"),
        F.size(found["removed"]).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(found["kept"], F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that stand in earlier documents."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    spans = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    return substring_dedup.remove_repeats(documents, keep=["doc_id"]).select(
        "row.doc_id",
        found["n_words"].alias("n_words"),
        spans.alias("n_removed"),
        F.sha2(found["kept"].cast("binary"), 256).alias("kept_sha256"),
    )


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents by the votes of labelled neighbours; a third of the labels is held out."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = load(spark, sf_dir, "labels").where(part != 1)
    scored = neighbours.score(documents, labels).select("row.doc_id", "score")
    return scored.select(
        "doc_id",
        F.coalesce(part == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents written to files and read back."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(documents, tokenizer_path())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened along their leading 32 components."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    found = whitening.by_component(whitening.transform(vectors, model, keep=["vec_id"]), model)
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents by their words as written and as restored; a fifth of the labels is held out."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = load(spark, sf_dir, "labels").where(part != 0)
    scored = toxicity.score(documents, labels, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select(
        "doc_id",
        F.coalesce(part == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the nearest of 16 integer centroids after three rounds."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, _ = centroids.cluster(vectors, keep=["vec_id"])
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_warc": op4_warc,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_neighbours": op9_quality_neighbours,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_centroid_clustering": op13_centroid_clustering,
}
