"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import packing, pii, simhash, suffix, toxicity
from locusframe.llm.common import cut, delete, scratch
from locusframe.llm.queries import tokenizer_path

#: Words from which on a repeated passage counts: over 50.
PASSAGE_WORDS = 51


def sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays, of equal rows one.

    Documents without an id stay, one of each text, as no id can say that they go.
    """
    found = simhash.similar(docs)
    # By id and text, as an id may stand on several rows.
    gone = found.where("doc_id != component_id").select(F.col("spot").alias("_spot")).distinct()
    kept = docs.withColumn("_spot", simhash.spot("doc_id", "text")).join(gone, "_spot", "left_anti")
    return kept.dropDuplicates(["doc_id", "_spot"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long passages are cut out of the texts; the first copy stays."""
    return sized(suffix.strip(docs, words=PASSAGE_WORDS, keep="first"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    found = pii.find(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    return sized(pii.redact(found)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Model fits, links over components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves behind, its input's table too, goes when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = cut(stage(spark, docs, sf_dir), name)
            made.discard(docs.shared_at)
        if before:
            delete(spark, before)
        before = docs.shared_at
    return STAGES[-1][1](spark, docs, sf_dir)
