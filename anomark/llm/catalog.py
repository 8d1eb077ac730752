"""Registered queries of the numbered operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomark.llm import (
    bottom_k,
    hard_negatives,
    language,
    lm_score,
    oracles,
    order_minhash,
    packing,
    prefix_trie,
    quality,
    quotes,
    repeats,
    secrets,
    sentencepiece_scan,
    simhash,
)
from anomark.llm.common import piece_model, table, vocabulary


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, cut into pieces and packed into sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, *vocabulary())


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, at most 3 differing bits."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; fences per language and source from quantile sketches."""
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every document, and weak candidates linked to their complementary parts."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def q_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated 200-byte strings cover, as counts and a digest."""
    return repeats.digest(table(spark, sf_dir, "documents"), length=200)


def q_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text, and their likeness to it and to the next document's."""
    return order_minhash.edited_pairs(table(spark, sf_dir, "documents"), k=10, picks=2, slots=64)


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a byte convolutional network; every fifth of them (by crc32) is held out of the fit."""
    return language.identify(table(spark, sf_dir, "documents"))


def q_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from quotes alone: the turns of ``conversations`` are given as messages that quote earlier ones."""
    return quotes.conversations(quotes.quoted_mail(table(spark, sf_dir, "conversations")))


def q_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the chunked max-plus scan and decoded again, as digests."""
    return sentencepiece_scan.digest(sentencepiece_scan.encode_documents(table(spark, sf_dir, "documents"), piece_model()))


def q_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between a model of documents labelled good and one of all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def q_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt with the first turns of its hundred's first conversation."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_beginnings(turns, every=100, most=6))


def q_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against all vectors, every seventh of which is relabelled first."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        vectors.withColumn("label", label), "vec_id % 50 = 0", positives=5, negatives=3, low=50, high=95, scale=256
    )


def q_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 2-word shingles, Jaccard similarity of 0.8 or more on full sets."""
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


QUERIES = {
    "op1_quotes": q_quotes,
    "op2_order_minhash": q_order_minhash,
    "op3_sentencepiece": q_sentencepiece,
    "op4_lm_score": q_lm_score,
    "op5_packing": q_packing,
    "op6_language": q_language,
    "op7_quality": q_quality,
    "op8_repeats": q_repeats,
    "op9_simhash": q_simhash,
    "op10_secrets": q_secrets,
    "op11_prefix_trie": q_prefix_trie,
    "op12_hard_negatives": q_hard_negatives,
    "op13_minhash": q_minhash,
}

ORACLES = {
    "op7_quality": oracles.quality(),
    "op8_repeats": oracles.repeats(),
    "op10_secrets": oracles.secrets(),
    "op11_prefix_trie": oracles.prefix_trie(),
    "op12_hard_negatives": oracles.hard_negatives(),
}
