"""A training corpus from raw documents: languages, quality, near copies, secrets, packing.

Every stage reads all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm import jaccard, language, packing, quality, secrets
from tallyhouse.llm.queries import vocabulary
from tallyhouse.llm.storage import written

#: A language counts as recognised from this probability on; a document of less quality than this goes.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.5


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with every column but ``used`` renamed, so that a stage can add columns of any name, and the expressions that bring the old names back."""
    names = {c: c if c in used else f"{c}__kept" for c in docs.columns}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; texts that are null or have no letter go."""
    path = vocabulary("piece_bpe_32k.model")
    plain, back = _apart(docs, "text")
    found = language.predict(plain, path, language.fit(docs, path))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(back)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are likelier good than not, as ``labels`` marks quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, back = _apart(docs, "text")
    return quality.score(plain, quality.fit(docs, labels)).where(F.col("quality_score") >= LEAST_QUALITY).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies, that of the smallest doc_id, and of its rows, if there are several, that of the smallest hash over all columns; rows without a doc_id stay."""
    found = jaccard.similar_documents(docs, width=5, percent=80)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    plain, back = _apart(docs, "doc_id")
    others = [c for c in plain.columns if c != "doc_id"]
    order = W.Window.partitionBy("doc_id").orderBy(F.xxhash64(*others), F.to_json(F.struct(*others)))
    named = plain.join(kept, "doc_id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return named.select(back).union(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret and counts n_chars, where there is such a column, again."""
    path = vocabulary("word_bpe_49k.json")
    forest = secrets.fit(spark, secrets.labelled_findings(spark, path), path)
    clean = secrets.redact(docs, forest)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a row a piece, with its ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, window=4096, with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]
#: SQL can express none of the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
