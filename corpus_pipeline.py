"""A corpus pipeline: language, near-duplicates, repeats, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets it
as written to a table and read again.  All but the last return the columns of
``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, language_id, order_minhash, packing, suffix_dedup
from strandlake.llm.shared import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if its text has letters and the mean probability of its language is this at least.
LEAST_SCORE = 0.4
#: Bytes of the shortest string that counts as repeated: about fifty words of these languages hold as many.
REPEATED = 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts too) or without one prevailing language.

    The field is learned from the labelled documents of the three folds of op2; where none
    has a language, all documents go.  Repeated rows are judged alike."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    found = language_id.predict_languages(docs.select(*COLUMNS), train=train, carry=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays, a null id before all others; of
    rows with one id and text, one.  A null text is in a class of its own."""
    classes = order_minhash.near_duplicates(docs.select("doc_id", "text"))
    keep = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.select(*COLUMNS, F.unhex(F.md5(F.col("text").cast("binary"))).alias("_hash"))
    kept = hashed.join(keep.withColumnRenamed("_hash", "_k"), F.col("_hash").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of REPEATED and more that occur twice, wherever they stand; a
    document of which nothing but white space is left goes.  Characters that lost some of
    their bytes go whole.  Null texts stay null."""
    carry = ("lang", "source", "n_chars")
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS), length=REPEATED, carry=carry, with_text=True)
    out = found.withColumnRenamed("kept_text", "text").filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark; all stay where it is empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.benchmark_hits(docs.select(*COLUMNS), benchmark)
    return found.filter(~decontaminate.contaminated()).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2,048 ids; a null or empty text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark_passages", benchmark_passages),
    ("pack", pack),
]
#: Subword ids and trained weights have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
