"""The corpus pipeline: documents in, packed sequences out. Part of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; every stage's
result is written as Parquet to the shared folder and read again. All but the last return the columns
of `documents`, and columns beyond these are ignored, whatever their names.

Defined results of every stage: an empty table gives an empty one; a null text is empty and stays null
where it stays; lang, source and n_chars are carried as they are, nulls too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborstat.llm.exact_dedup import without_copies
from arborstat.llm.jaccard_join import near_components
from arborstat.llm.packing import pack_documents
from arborstat.llm.rule_classifier import train, with_statistics
from arborstat.llm.shared import discard, join_ids, release, written
from arborstat.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which a document stays; words of a shingle and least similarity of near copies; bytes of a repeated passage.
KEEP_SCORE, SHINGLE_WORDS, SIMILARITY, PASSAGE_BYTES = 0.7, 5, 80, 150
#: Words whose ids a worker keeps while it packs: fewer than the operator's own, as workers of all stages share an executor.
KEPT_WORDS = 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of labelled documents, does not reject.

    Rows are judged on their own: repeated rows, ties and null ids change nothing. The empty text has a score like any other.
    """
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_statistics(docs.select(*COLUMNS), keep=COLUMNS[1:])
    return scored.where(model.column() >= KEEP_SCORE).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space: most code points, then smallest id.

    Empty, white-space and null texts are one group; a repeated row goes; a null id loses every tie.
    """
    return without_copies(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Texts without words are near nothing and stay; rows that share an id stay or go together; rows without an id stay.
    """
    release(spark)
    found = near_components(docs, SHINGLE_WORDS, SIMILARITY)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return join_ids(docs.select(*COLUMNS), gone, "doc_id", "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier, in the order of ids; a document that consists of such alone goes.

    Empty texts and those shorter than a passage stay as they are; a repeated row is a later document; a null text
    becomes an empty one; n_chars is that of what is left. A letter that a cut splits goes.
    """
    release(spark)
    cut = remove_repeats(docs, PASSAGE_BYTES, keep=("lang", "source"), as_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0)).withColumnRenamed("kept", "text")
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences; an empty text is the end id alone."""
    release(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=KEPT_WORDS)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("suffix_dedup", passages), ("packing", packing)]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
