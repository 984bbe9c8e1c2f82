"""The corpus pipeline: documents through five operators, each stage over all that its predecessor kept.

Language identification drops documents without a language, the Jaccard join keeps one document of each group of near-duplicates,
decontamination drops documents that hold benchmark passages, mixing repeats sources to their target weights, and the last stage writes the mix as
token shards and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import free_name, new_folder, packed, spread, word_count
from tarnwell.llm.decontaminate import decontaminate
from tarnwell.llm.jaccard_join import jaccard_join
from tarnwell.llm.language_id import UNDETERMINED, held_out, identify, train
from tarnwell.llm.mixing import mix, repeated
from tarnwell.llm.token_output import tokens_digest

#: Below this probability a prediction is no more than a guess among all languages. With two families of two languages no score is below 1/4.
LEAST_SCORE = 0.2


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that columns of an operator and of a user never meet, whatever their names."""
    return docs.select(packed(docs).alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter; a guess only if so many languages are learned that its score can be below the bound.

    Without any labelled row to learn from all documents stay. Null, empty and letterless texts go, very long ones are read whole, repeated rows and ties are
    judged alike, an empty table stays empty.
    """
    model = train(docs, learn_from=~held_out())
    if not model.families:
        return docs  # nothing to tell languages by is no reason to lose a corpus
    found = identify(whole_rows(docs), model, text_col="row.text")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id in each group. Documents without id are copies of no one; repeated rows stay once. Null and empty texts are near no other, very long ones are compared whole, an empty table stays empty."""
    joined = jaccard_join(docs.select("doc_id", "text"))
    name, digest = free_name(docs, "id"), free_name(docs, "hash")
    own = lambda some: some.select(F.col("doc_id").alias(name), F.col("text_hash").alias(digest))
    away = own(joined.where(F.col("doc_id") != F.col("class_id"))).distinct()
    marked = docs.withColumns({name: F.col("doc_id"), digest: F.xxhash64("text")})
    kept = marked.join(spread(away), [name, digest], "left_anti")
    twice = own(joined.where((F.col("doc_id") == F.col("class_id")) & (F.col("n_links") > 0))).groupBy(name, digest).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if twice.take(1):
        again = spread(twice.drop("n"))
        once = kept.join(again, [name, digest], "left_semi").dropDuplicates([name, digest])
        kept = kept.join(again, [name, digest], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item. Null and empty texts hold none, very long ones are scanned whole, repeated rows are judged alike, an empty table stays empty."""
    found = decontaminate(whole_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col="row.text")
    return found.where(~F.col("contaminated")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources reach their target weights; n_chars follows a text that is taken in part. Null and empty texts take nothing and go, very long ones may be taken in part, repeated rows are drawn each for itself, an empty table stays empty."""
    rows = whole_rows(docs).withColumn("text", F.col("row.text"))
    mixed = repeated(mix(rows, size=word_count(F.col("text")), id_col="row.doc_id", source_col="row.source"), ["row", "text"])
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return mixed.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: doc_id, start, n_tokens, ids_crc32. Chunks are small, as the stages before have filled the executors' memory."""
    return tokens_digest(docs, chunk_bytes=4 << 20)


STAGES = [("language_id", language_id), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: Classifier, similarity join and tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
