"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Toxic documents go, then documents of poor quality; one document of each near-duplicate class stays (the smallest
doc_id); byte strings of 200 and more that repeat are cut out of the texts; what is left is packed into sequences.
All stages but the last return the columns of ``documents``. Models learn from the stage's own input and ``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlake.llm import ngram_join, packing, quality_bayes, suffix_dedup, toxicity
from moodlake.llm.common import materialized, table


def _narrow(docs: DataFrame) -> DataFrame:
    """row (all columns but the text, as a struct), doc_id and text: no column of the documents clashes with a stage's."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "doc_id", "text")


def _wide(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The documents' columns again, those in ``changed`` with a new value."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col("row")[c].alias(c)
                         for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    crf = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _wide(toxicity.score(_narrow(docs), crf, spans=False).filter("predicted = 0"), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality_bayes.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_bayes.score(_narrow(docs), F.col("row")["source"], F.col("row")["lang"], model)
    return _wide(judged.filter("keep"), docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest doc_id (a null one last), of equal ids the least text.
    Texts without words are classes of their own; copies collapse in the map tasks before they are shuffled."""
    named = ngram_join.near_duplicates(_narrow(docs)).select("row", "doc_id", "text", "class_key", "class_size")
    alone = F.col("class_key").isNull() | (F.col("class_size") == 1)
    first = F.min_by(F.struct("row", "text"), F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("first")
    several = named.filter(~alone).groupBy("class_key").agg(first).select("first.row", "first.text")
    return _wide(named.filter(alone).select("row", "text").unionByName(several), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated 200-byte strings cover; bytes of a character cut in two go too. Texts
    that hold no repeat stay as they are, nulls included; n_chars is counted anew where a text changed."""
    left = suffix_dedup.remove_repeats(_narrow(docs))
    changed = F.col("n_removed") > 0
    left = left.withColumn("text", F.when(changed, suffix_dedup.whole_characters(F.col("kept"))).otherwise(F.col("text")))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return _wide(left, docs.columns, n_chars=n_chars)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in sequences of fixed capacity."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", keep_one_of_each_class),
          ("repeats", cut_repeats), ("packing", pack_sequences)]

#: Learned models and best-fit search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages take nulls in any column, texts that are empty, blank or very long, repeated rows and
    empty tables as their operators say; further columns of the documents go through unchanged, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
