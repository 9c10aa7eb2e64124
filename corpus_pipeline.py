"""The corpus pipeline: documents in, packed sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.lang_id import keep_identified
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.ngram_join import keep_first
from lodestone.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected.

    Null texts and texts without letters are rejected. Repeated rows are judged alike; an empty table stays empty.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those of which nothing is left go. ``n_chars`` counts what is left.

    Null texts and rows of null ids stay as they are; rows that repeat an id share the places of their runs; an empty
    table stays empty; other columns pass through, whatever their names.
    """
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Null and blank texts have no duplicates and null ids stay; rows that repeat an id stay or go together; an empty table
    stays empty.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null texts and null ids stay; rows that repeat an id go together; an empty table or benchmark takes nothing away.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 ids: a row for each piece.

    Null and empty texts are an end id each; rows that repeat an id are packed each for itself; an empty table has no
    pieces; other columns are left out.
    """
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: Neither trained models nor a tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
