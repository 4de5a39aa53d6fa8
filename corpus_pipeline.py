"""A training corpus from ``documents``: quality, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. No SQL states the trained classifier, so the
pipeline has none; tests compare its stages with brute force.

Stages tell rows apart by a key of their own, not by doc_id: rows with a null doc_id, and different texts of one doc_id,
are documents like any other, the ones with a null doc_id after all others in order. Rows with the same doc_id and text
are near duplicates of each other; only those without any word are all kept.

Columns beyond those of ``documents`` are not carried; null texts count as empty; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import op4_mixing, op5_quality, op6_bpe, op9_minhash, op10_substring
from framewright.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a column row_: a number for each row, fixed by writing it."""
    return scratch.cut(docs.select(COLUMNS).withColumn("row_", F.monotonically_increasing_id()), "keyed")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on the labelled ones outside its held-out fold) does not reject."""
    docs = docs.select(COLUMNS)
    return op5_quality.keep_good(docs, op5_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word-shingle similarity 0.8: the one with the smallest doc_id (nulls last).

    A row without words is in no component and stays, as does every row whose own text has no duplicate.
    """
    docs = keyed(docs, Scratch(spark, "near"))
    found = op9_minhash.near_duplicates(docs.select(F.col("row_").alias("doc_id"), "text"), percent=80)
    found = found.select(F.col("doc_id").alias("row_"), "component_id").join(docs.select("row_", "doc_id"), "row_")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_"))["row_"].alias("row_"))
    return docs.join(kept, "row_", "left_semi").select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that an earlier document, or an earlier place in the same one, holds."""
    docs = docs.select(COLUMNS)
    out = op10_substring.remove_repeats(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's quota repeats it; the last repeat may be a document's first words.

    A document that the mix takes t words of appears t // size times whole, and once more with its first t % size words.
    """
    docs = keyed(docs, Scratch(spark, "mixing"))
    mixed = op4_mixing.mix(docs, carry=("row_",)).select("row_", "size", "taken").where("taken > 0")
    rows = docs.join(mixed, "row_")
    whole = F.expr("array_repeat(size, cast(taken div size as int))")
    rest = F.expr("if(taken % size > 0, array(taken % size), array())")
    rows = rows.withColumn("words", F.explode(F.concat(whole, rest)))
    # A cut text keeps the white space between its words; native, as the operator is.
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first)
    return rows.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and digests of every document of the mix."""
    return op6_bpe.encode_documents(docs, op6_bpe.vocabulary(), texts=True).drop("decoded")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixing", mixing),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, name)
            if k:
                scratch.drop(before)
    return docs
