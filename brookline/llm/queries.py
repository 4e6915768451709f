"""The corpus operators as queries: each applies one, with production parameters, to its whole table.

All give a row for every row of their table, an empty table for an empty one; null texts count as empty (images:
as unreadable), very long ones are read whole, repeated rows are judged alike, further columns of the table are
ignored. What else holds of nulls, ties and the like is in each operator's module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm import contamination, images, lattice, near, pii, quality, repeats, sql, tokens, toxicity, urls
from brookline.llm.shared import remainder, table

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(scored: DataFrame, modulus: int, rest: int) -> DataFrame:
    """Null ids belong to neither side; they count as not held out."""
    return scored.withColumn("held_out", F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Without both labels nothing is predicted toxic."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 5) != 0)
    return _held_out(toxicity.score_toxicity(docs, model, 0.5), 5, 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. Rows without an id keep all their words."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans; n_spans counts those."""
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("span_list")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score. A null url has no host and no path and is judged by the trees."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, exact."""
    return lattice.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "exact")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Rows without an id or without words are linked with nothing and kept."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, coverage, item_id, item_ids, contaminated. Of items that tie the smallest id is reported."""
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=4096)


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, n_corners, class_id, kept, readable. A null vector, or one with a value that isn't finite, is drawn as nothing, which is not readable."""
    return images.image_copies(images.rasters(table(spark, sf_dir, "embeddings")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. A text that shares nothing with the sample gets the labels' mean."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 4) != 2)
    return _held_out(quality.score_quality(docs, model, 0.7), 4, 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_substring_dedup, op3_pii, op4_url_filters, op5_sentencepiece, op6_minhash_near_dedup, op7_decontamination, op8_token_counts, op9_image_copies, op10_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others rest on a trained model, a library's pieces or greedy tilings; tests/llm holds them against brute force."""
    return {"op2_substring_dedup": sql.SUBSTRING_DEDUP, "op6_minhash_near_dedup": sql.NEAR_DEDUP}
