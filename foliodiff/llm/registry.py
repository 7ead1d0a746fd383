"""Queries of the training-text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import content_sort, decontaminate, factorisation, line_dedup, near_dedup, oracles, packing, pitman_yor, quality_rules, quotes, runs, substring_dedup, turn_repair, url_filter
from .common import stored, table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.conversations(table(spark, sf_dir, "conversations"))
    return linked.withColumn("body_sha256", F.sha2("body", 256)).drop("body")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return pitman_yor.score(table(spark, sf_dir, "documents"), held_out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.link_components(table(spark, sf_dir, "documents"), width=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = factorisation.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return factorisation.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    repaired = stored(turn_repair.repairs(turns))
    digests = turn_repair.digests(turn_repair.repaired_turns(turns, repaired)).withColumnRenamed("conv_id", "conv")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    joined = repaired.join(digests, repaired["conv_id"].eqNullSafe(digests["conv"]), "left").drop("conv")
    return joined.withColumn("repaired_sha256", F.coalesce("sha256", nothing)).drop("sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort.digests(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.looped(F.col("text"), number).alias("text"))
    done = runs.collapse(docs).withColumn("best", runs.greatest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quotation_linking": op1_quotation_linking,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_line_dedup": op5_line_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_structure_repair": op11_structure_repair,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_quotation_linking": oracles.QUOTATION_LINKING,
        "op2_benchmark_decontamination": decontaminate.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op6_quality_rules": oracles.QUALITY_RULES,
        "op7_minhash_near_dedup": oracles.NEAR_DEDUP,
        "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op10_url_filter": oracles.URL_FILTER,
        "op12_exact_dedup": content_sort.SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
