"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts
from .common import fold, read
from .compression import fit, labelled_sample, score_quality
from .language import identify, learn_prototypes
from .lm import score_texts
from .mixing import mix_sources
from .nearest import search
from .quality_rules import quality_cascade
from .sharding import assign_shards
from .simhash import simhash_components
from .token_files import read_checksums, token_files

#: Labelled rows of each class that the quality classifier is fitted on, and bytes of their texts, at most.
LABELLED_ROWS, LABELLED_BYTES = 1500, 32_000_000


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the least id that their links reach."""
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from labels of ids outside fold 1 of 3."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    model = fit(*labelled_sample(docs, labels, "quality", LABELLED_ROWS, LABELLED_BYTES))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from rows outside fold 2 of 4."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, learn_prototypes(docs, where=fold("doc_id", 4) != 2), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return assign_shards(read(spark, sf_dir, "documents").select("doc_id"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the cascade's verdict."""
    judged = quality_cascade(read(spark, sf_dir, "documents"), measures=True, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, both as digests."""
    coded = encode_texts(read(spark, sf_dir, "documents"), decoded=True, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from rows outside fold 2 of 7."""
    docs = read(spark, sf_dir, "documents")
    scored = score_texts(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids lie, and the checksum of what the files give back."""
    _, index = token_files(read(spark, sf_dir, "documents"))
    return read_checksums(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline``, over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_quality_classifier, op3_language, op4_sharding, op5_mixing, op6_quality_rules, op7_nearest, op8_bpe, op9_lm_scoring, op10_token_files, pipeline)
}
