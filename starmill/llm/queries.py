"""The registered queries of this subpackage: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, fingerprints, line_dedup, minhash_forest, mixing, packing, periodic_runs, quality, sentence_spans, suffix_index, tiling, token_counts, toxicity
from .oracle import ORACLE_SQL  # noqa: F401


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs, labels, usable=~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, weights).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer)


def op3_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.withColumnsRenamed({"_lines": "n_lines", "_gone": "n_removed"})


def op7_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_index.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("_kept")).alias("n_removed"), F.size("_removed").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    rounded = [(F.round(f"_{c}", 9) + 0.0).alias(c) for c in ("weight", "probability")]
    return found.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), *rounded, F.col("_sampled").alias("sampled"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_documents(spark, sf_dir))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.withColumnsRenamed({"_n": "n_sentences", "_gone": "n_removed", "_bytes": "n_removed_bytes"})


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer)


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten become periodic from a place and with a period drawn from the hash."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"), F.lit(0).alias("n"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rest = F.expr("slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a))")
    periodic = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), rest), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_runs(_documents(spark, sf_dir)))
    best = periodic_runs.longest(F.col("_runs"))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("_kept", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transform(_documents(spark, sf_dir).select("doc_id", "text"))
    restored = fill_in_middle.restored(F.col("_output"), F.col("_form"))
    return found.select("doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"), F.sha2("_output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def check_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_tiling, op4_minhash_forest, op5_quality, op6_line_dedup, op7_suffix_index, op8_mixing, op9_fingerprints, op10_sentence_spans, op11_best_fit_packing, op12_periodic_runs, op13_fill_in_middle, check_edits)}
