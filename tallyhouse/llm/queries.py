"""One query for each operator: it applies the operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bytebpe, chunkstore, importance, jaccard, language, licenses, neighbours, packing, pieces, quality, secrets, vectorgraph, whitening
from tallyhouse.llm.storage import new_folder


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the package that has them is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    path = vocabulary("word_bpe_49k.json")
    return secrets.scan(docs, secrets.fit(spark, secrets.labelled_findings(spark, path), path))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), ids=False, digests=True)


def op3_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_folder(spark, "chunk-store")
    chunkstore.write_store(docs, path, vocabulary("word_bpe_49k.json"), end_id=1)
    return chunkstore.read_back(spark, path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard.similar_documents(docs, width=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, window=4096)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0, k=10)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = vocabulary("piece_bpe_32k.model")
    found = language.predict(docs.select("doc_id", "text"), path, language.fit(docs, path))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.score(docs, quality.fit(docs, labels))
    predicted = F.when(F.col("quality_score") >= 0.7, 1).otherwise(0)
    return found.select("doc_id", language.held_out().alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance.resample(docs, benchmark, percent=5, least_words=20, seed=42, buckets=10_000)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bytebpe.encode(docs, vocabulary("byte_bpe_50k.json"), ids=False, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_sentencepiece, op3_chunk_store, op4_license_scan, op5_ngram_jaccard, op6_packing, op7_nearest_neighbours, op8_language_id, op9_embedding_near_dedup, op10_quality, op11_embedding_whitening, op12_importance_resampling, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.oracle()}
