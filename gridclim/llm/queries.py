"""The operators as queries over the given tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .bpe import encode_and_decode
from .fingerprints import compared_with_next
from .licenses import scan_licenses
from .lines import dedup_lines
from .ngram_join import ngram_components
from .packing import pack_documents
from .quality import quality_rules
from .runs import periodic_runs
from .sharding import shard_documents
from .suffix import dedup_passages
from .tables import read_table
from .toxicity import score_toxicity
from .vectors import embedding_components


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        F.col("line_n_lines").alias("n_lines"),
        F.col("line_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        F.col("suffix_n_bytes").alias("n_bytes"),
        F.col("suffix_n_removed").alias("n_removed"),
        F.col("suffix_n_spans").alias("n_spans"),
        F.sha2("suffix_kept", 256).alias("kept_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def looped(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which a tenth, chosen by a hash of doc_id, repeat a stretch of
    their words to the end. Without doc_id a text stays as it is."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.floor(hashed / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = docs.select("doc_id", "text", (hashed % 10 == 0).alias("chosen"), seed.alias("seed"))
    chosen = chosen.withColumn("words", F.when(F.col("chosen"), words))
    n = F.size("words")
    counted = chosen.withColumn("n", F.when(n > 0, n)).withColumn("a", F.col("seed") % F.col("n"))
    rest = F.col("n") - F.col("a")
    period = (F.floor(rest / (3 + F.col("seed") % 8)) + 1).cast("int")
    root = F.slice("words", (F.col("a") + 1).cast("int"), period)
    times = F.ceil(rest / period).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(root, times)), F.lit(1), rest.cast("int"))
    first = F.slice("words", F.lit(1), F.col("a").cast("int"))
    text = F.coalesce(F.array_join(F.concat(first, repeated), " "), "text")
    return counted.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(documents(spark, sf_dir)))
    line = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    )
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    exponent = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        exponent.cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokens(documents(spark, sf_dir), digest=True)
    return found.withColumn("groups_sha256", F.col("aligned").cast("string")).drop("aligned")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(documents(spark, sf_dir))


QUERIES = {
    run.__name__: run
    for run in (
        op1_ngram_jaccard,
        op2_embedding_dedup,
        op3_byte_bpe,
        op4_sharding,
        op5_licenses,
        op6_line_dedup,
        op7_suffix_dedup,
        op8_quality_rules,
        op9_toxicity,
        op10_packing,
        op11_periodic_runs,
        op12_token_alignment,
        op13_fingerprints,
    )
}
