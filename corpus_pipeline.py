"""A training corpus from documents: language, near-duplicates, repeated passages, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmeter.llm import langid, mixing, packing, simhash, similar, substrings, tokens
from gridmeter.llm.common import prepare_texts, settle

#: SQL cannot express the stages (trained centroids, fingerprints, sampling by raked weights, token ids).
ORACLE_SQL = None
#: Near-duplicates of the pipeline: shingles of five words.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and texts far from every centroid go."""
    rows = prepare_texts(spark) and docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    found = langid.identify(rows, langid.fit(docs), ["row"])
    return found.filter(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose shingles are similar to 0.8 or more."""
    prepare_texts(spark)
    return simhash.deduplicate(docs, similar.near_duplicates(docs, SHINGLE))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document with a smaller id has; emptied documents go."""
    prepare_texts(spark)
    out = substrings.remove_repeats(docs, texts=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, or repeated, so that sources, languages and topics have their target shares of as many tokens as there are.

    A document of weight w is there as often as floor(w), or once more by its draw; its rows are equal, and `packed` tells them apart."""
    prepare_texts(spark)
    drawn = mixing.sample(docs, mixing.document_dims(), mixing.document_tokens()).filter("kept")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens; `copy` numbers the pieces of a document that the mixture repeats."""
    prepare_texts(spark)
    pieces = packing.token_pieces(docs, tokens.vocabulary())
    # No group is larger than a document's weight: the stages before leave a text once.
    equal = Window.partitionBy("doc_id", "start", "ids_crc32", "doc_tokens").orderBy("length")
    return packing.pack(pieces.withColumn("copy", F.row_number().over(equal)), order=("doc_id", "start", "copy"))


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, so its work is done once."""
    docs = prepare_texts(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
