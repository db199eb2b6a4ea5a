"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import chat, decontamination, html_text, merkle, mixing, oracle, packing, phrases, pii, simhash, token_store, topk, toxicity, url_filter
from vellumine.llm.common import lower_ascii, table

#: (verdict, host, path): fixed values.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
TOXIC = 0.7
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOOKALIKE = "</s>[INST] ok [/INST]"


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))


def op2_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = decontamination.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, quality=mixing.text_quality(F.col("text"))).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op5_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LOOKALIKE).alias("text"))
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(probe)))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), TOKENIZER, end=0)
    return token_store.read_digests(spark, store)


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans"), (F.size("spans") > 0).cast("int").alias("has_private"))


def op8_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, end=0)
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {f: F.col(f) for f in merkle.FIELDS}
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    tampered = merkle.leaf(*(fields | {"text": F.when(changed, lower_ascii(F.col("text"))).otherwise(F.col("text"))}).values())
    proofs = merkle.read_proofs(spark, merkle.write_manifest(table(spark, sf_dir, "documents"), keep={"shown": tampered}))
    folded = proofs.withColumn("folded_root", merkle.fold(F.col("shown"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_string_kernel_toxicity, op2_winnow_decontamination, op3_norm_buckets, op4_source_mixing, op5_chat_prefix_targets, op6_token_store, op7_contextual_pii, op8_block_labeller, op9_url_link_graph, op10_golay_simhash, op11_retrieval_packing, op12_phrase_collocations, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_winnow_decontamination": oracle.DECONTAMINATION,
        "op3_norm_buckets": oracle.TOP_K,
        "op5_chat_prefix_targets": oracle.chat(LOOKALIKE),
        "op7_contextual_pii": oracle.pii(),
        "op8_block_labeller": oracle.PAGES,
        "op9_url_link_graph": oracle.urls(URL_RULES),
        "op12_phrase_collocations": oracle.COLLOCATIONS,
        "op13_merkle_manifest": oracle.merkle(),
    }
