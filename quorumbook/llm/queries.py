"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumbook.llm import bpe
from quorumbook.llm.alignment import align_tokens, link_statistics
from quorumbook.llm.exact_dedup import exact_groups
from quorumbook.llm.language import is_held_out, predict_languages, train_language_model
from quorumbook.llm.main_text import extract_main_text
from quorumbook.llm.multi_index import nearest
from quorumbook.llm.near_dedup import near_components
from quorumbook.llm.packing import binary_pieces, numbered_sequences
from quorumbook.llm.pseudonyms import replace_personal
from quorumbook.llm.resampling import resample
from quorumbook.llm.sharding import stratified_shards
from quorumbook.llm.substring_dedup import remove_repeated
from quorumbook.llm.tables import read_table, shared_folder, written
from quorumbook.llm.warc import normalise_archives, read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]

#: Whoever holds the key can tell pseudonyms from values; a real run takes it from a secret store.
PSEUDONYM_KEY = "not-a-secret"


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary ``name`` lies; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame, tokenizer: str, kept: Sequence[str] = ()) -> DataFrame:
    """The pieces of all documents with their place, the checksum of their ids and the ``kept`` columns, which come last."""
    pieces = binary_pieces(docs, tokenizer, kept=kept).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", *kept
    )
    placed = numbered_sequences(written(pieces, "pieces"))
    return placed.select(*[c for c in placed.columns if c not in kept], *kept)


def op1_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(read_table(spark, folder, "documents"), words=2, percent=80)


def op3_interval_expansion(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeated(read_table(spark, folder, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["b"] - s["a"]))
    return cleaned.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op4_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read_table(spark, folder, "documents"))


def op8_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_shards(read_table(spark, folder, "documents"))


def op6_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    monolithic, normal = shared_folder(spark, "warc-stream"), shared_folder(spark, "warc")
    write_archives(read_table(spark, folder, "pages"), monolithic)
    normalise_archives(spark, monolithic, normal).agg(F.sum("records")).collect()
    return read_archives(spark, normal).drop("payload")


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(read_table(spark, folder, "documents"), ranks, PATTERN, outputs=("ids_text", "decoded"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return replace_personal(read_table(spark, folder, "documents").select("doc_id", "text"), PSEUDONYM_KEY, counts=True)


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = predict_languages(docs, train_language_model(docs), kept=["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(read_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = align_tokens(
        read_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return link_statistics(aligned.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), percent=10, seed=2024, longest=1,
        buckets=10_000, least_words=20)
    return drawn.drop("n_words")


QUERIES: dict[str, Query] = {
    "op1_multi_index": op1_multi_index,
    "op2_circulant_minhash": op2_circulant_minhash,
    "op3_interval_expansion": op3_interval_expansion,
    "op4_binary_packing": op4_binary_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op10_language": op10_language,
    "op6_warc_normaliser": op6_warc_normaliser,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_stratified_shards": op8_stratified_shards,
    "op11_line_blocks": op11_line_blocks,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}
