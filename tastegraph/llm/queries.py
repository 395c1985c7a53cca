"""The operators as queries over their whole tables, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    fill_middle,
    line_dedup,
    packing,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
)
from tastegraph.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.benchmark_matches(docs, benchmark).drop("th")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn_weights(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.restore(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    digests = {f"{name}_sha256": F.sha2(F.col(of), 256) for name, of in (("output", "output"), ("restored", "restored"))}
    return found.withColumns(digests).drop("output", "restored")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    text = "" if books is None else vector_codes.codebook_text(books)
    return codes.withColumn("codebooks_sha256", F.sha2(F.lit(text), 256))


QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_dedup,
        op2_token_counts,
        op3_line_dedup,
        op4_decontamination,
        op5_embedding_dedup,
        op6_secret_scan,
        op7_substring_dedup,
        op8_toxicity,
        op9_packing,
        op10_simhash_dedup,
        op11_byte_bpe,
        op12_fill_middle,
        op13_vector_codes,
    )
}
