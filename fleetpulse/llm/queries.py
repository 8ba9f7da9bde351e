"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import codes, decontaminate, embeddings, lines, lm, mixing, quality, rules, simhash, substrings, toxicity, tries, urls
from fleetpulse.llm.common import fold, prepare, table
from fleetpulse.llm.learning import FOLDS
from fleetpulse.plans.common import Entry

LM_FOLDS = 10


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))
    held_out, offending = fold(F.col("doc_id"), FOLDS) == 0, F.transform("_offending", lambda o: o["sentence"])
    predicted = (F.col("_score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"), offending.alias("offending_sentences"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train_on(docs, table(spark, sf_dir, "labels")))
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    told = {"_grade": "expected_grade", "_tail": "tail_probability", "_selected": "selected"}
    return scored.select("doc_id", held_out.alias("held_out"), *[F.col(c).alias(name) for c, name in told.items()])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    printed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", printed.alias("fingerprint"), "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    fold_of = fold(F.col("doc_id"), LM_FOLDS)
    scored = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of != 0)
    return scored.select("doc_id", (fold_of == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", *[F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = mixing.assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col("_size") * F.col("_copies")
    return found.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken")
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_contaminated").alias("contaminated"), F.col("_items").alias("item_ids"), F.col("_similarity").alias("similarity")
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped")]
    return found.select("doc_id", *counts, F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = substrings.drop_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed")]
    return found.select("doc_id", *counts, F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    found = codes.label_errors(coded)
    digits = F.array_join(F.transform("_code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    return found.select(
        "vec_id", digits.alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"), F.lit(books.sha256).alias("codebooks_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = rules.judged(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    told = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base_failed = F.col("_bits").bitwiseAND(F.lit(rules.BASE)) != 0
    return found.select("doc_id", *[F.col("_measures").getField(m).alias(m) for m in told], base_failed.alias("base_failed"), F.col("_kept").alias("kept"))


QUERIES: dict[str, Entry] = {
    "op1_toxicity": Entry(op1_toxicity),
    "op2_quality_classifier": Entry(op2_quality_classifier),
    "op3_simhash_near_dedup": Entry(op3_simhash_near_dedup),
    "op4_lm_scoring": Entry(op4_lm_scoring),
    "op5_url_filters": Entry(op5_url_filters, urls.ORACLE_SQL),
    "op6_source_mixing": Entry(op6_source_mixing, mixing.ORACLE_SQL),
    "op7_benchmark_decontamination": Entry(op7_benchmark_decontamination),
    "op8_embedding_near_dedup": Entry(op8_embedding_near_dedup),
    "op9_line_dedup": Entry(op9_line_dedup, lines.ORACLE_SQL),
    "op10_substring_dedup": Entry(op10_substring_dedup),
    "op11_vector_codes": Entry(op11_vector_codes, codes.ORACLE_SQL),
    "op12_prefix_trie": Entry(op12_prefix_trie, tries.ORACLE_SQL),
    "op13_quality_rules": Entry(op13_quality_rules, rules.ORACLE_SQL),
}


def entries() -> dict[str, Entry]:
    return dict(QUERIES)
