"""The registered queries of the corpus operators, with production parameters, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, conversations, divergence, hamming, html, licences, mixing, neardup, packing, quality, sharding, toxicity, warc
from quillon.llm.common import table

#: Bytes of a shard.
SHARD_BYTES = 2 << 20
#: Near-duplicates of whole documents.
NEAR = neardup.Settings(shingle=3, percent=85)


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of every row whose id is divisible by 100. Nulls, ties, repeats and empty tables: see ``hamming``."""
    found = hamming.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document. Null keys and texts count 0 bytes; repeated rows and empty tables: see ``sharding``."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES).withColumnRenamed("key", "doc_id")


def op3_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document. Null sources, empty texts, ties and repeated rows: see ``mixing``."""
    return mixing.plan(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have an empty one, see ``html``."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from archives. Null payloads, repeated pages and empty tables: see ``warc``."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document. Empty sets, repeated rows and null ids: see ``neardup``."""
    found = neardup.components(table(spark, sf_dir, "documents"), NEAR)
    return found.withColumnRenamed("key", "doc_id")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, licence labels and score of every document; null and empty texts have none, see ``licences``."""
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to; null texts have none, see ``bpe``."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document; null and empty texts fail, see ``quality``."""
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model of the labelled rows that aren't held out; null and empty texts score low, see ``toxicity``."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and terms of every source of every language; nulls, groups without terms, ties and empty tables: see ``divergence``."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation; nulls, ties, repeats and empty tables: see ``conversations``."""
    return conversations.repair(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op13_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 1,024 tokens; null and empty texts are an end id, see ``packing``."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (op1_multi_index_hashing, op2_extendible_sharding, op3_systematic_mixing, op4_html_main_text, op5_warc_round_trip, op6_minhash_bayes, op7_licence_scan, op8_byte_bpe, op9_weak_supervision, op10_toxicity_grammar, op11_source_divergence, op12_conversation_repair, op13_first_fit_packing)}
ORACLE = {"op1_multi_index_hashing": hamming.TOP_K_SQL, "op2_extendible_sharding": sharding.shards_sql(SHARD_BYTES), "op3_systematic_mixing": mixing.PLAN_SQL, "op5_warc_round_trip": warc.ROUND_TRIP_SQL, "op6_minhash_bayes": neardup.components_sql(NEAR), "op11_source_divergence": divergence.AUDIT_SQL, "op12_conversation_repair": conversations.REPAIR_SQL}
