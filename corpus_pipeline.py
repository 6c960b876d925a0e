"""Training-data pipeline: language, near copies, benchmark leaks, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of `documents`.

language        documents without a language (null text, no letter) or without a main one (less than half of the
                letters) go; `lang` is what was found
near_duplicates the document with the smallest id of each class stays, one without an id only if none has one
decontamination documents that hold a benchmark item go
secrets         secrets are replaced in the text; `n_chars` follows
packing         pieces of the documents with their sequence and offset

Decisions are made and take effect by row: its key is a hash of id and text, so rows that share an id but not the text, or have no id,
are told apart. Rows that repeat id and text are copies of each other. Extra columns are dropped by the first stage, so that they can clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm.registry import bounded, table
from marquee.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of the letters in the main language.
MAIN_SHARE = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of the row."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents less the rows of a stored frame of distinct keys."""
    return rows.join(keys, "row", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from marquee.llm.language import fold, identify, train

    bounded(spark)
    rows = docs.select(*COLUMNS)
    held = F.coalesce(fold() == 2, F.lit(False))
    model = train(rows.filter(~held).select("lang", "text"))
    keys = ["doc_id", "source", "n_chars"]
    # The whole text goes along as a key column, since the label belongs to this row and to no other.
    found = identify(rows.withColumn("whole", F.col("text")), model, [*keys, "whole"])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_SHARE))
    return kept.select("doc_id", F.col("whole").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from marquee.llm.near_dup import near_duplicates as classes

    bounded(spark)
    rows = keyed(docs)
    found = materialise(classes(rows, id_col="row").select(F.col("doc_id").alias("row"), "class_id"), "classes")
    several = found.groupBy("class_id").count().filter("count > 1").select("class_id")
    members = found.join(several, "class_id").distinct().join(rows.select("row", "doc_id").distinct(), "row")
    members = materialise(members, "members")
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    first = materialise(first.select("row"), "first")
    kept = rows.join(materialise(members.select("row").join(first, "row", "left_anti"), "copies"), "row", "left_anti")
    # Rows that repeat id and text are told apart by nothing else: one of them stays.
    repeated = materialise(found.join(first, "row", "left_semi").groupBy("row").count().filter("count > 1").select("row"), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    again = kept.join(repeated, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)
    return without(kept, repeated).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from marquee.llm.decontaminate import leaks

    bounded(spark)
    rows = keyed(docs)
    found = leaks(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return without(rows, materialise(found.select(F.col("doc_id").alias("row")).distinct(), "leaks"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from marquee.llm.secrets import redact, scan

    rows = keyed(docs)
    found = materialise(scan(rows, id_col="row").filter("is_secret"), "secrets")
    found = found.withColumnRenamed("doc_id", "row")
    return redact(rows, found, id_col="row").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marquee.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The stages cannot be said in SQL; tests hold them against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bounded(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
