"""Retrieval metrics over judged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precision_recall(results: DataFrame, relevant: DataFrame, key: str, item: str) -> DataFrame:
    """key, hits, precision, recall, reciprocal: results have (key, item, rank), judgments (key, item)."""
    judged = results.join(relevant.select(key, item, F.lit(1).alias("_ok")), [key, item], "left")
    got = judged.groupBy(key).agg(F.count("*").alias("n"), F.count("_ok").alias("hits"), F.min(F.when(F.col("_ok") == 1, F.col("rank"))).alias("first"))
    want = relevant.groupBy(key).agg(F.count("*").alias("n_relevant"))
    out = want.join(got, key, "left").fillna(0, ["n", "hits"])
    return out.select(key, "hits", F.round(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0), 6).alias("precision"), F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal"))


def p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, p95: the value at place floor(0.95 * (n - 1)) of each group's values in order, from 0; nulls don't count."""
    known = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(by)
    placed = known.select(by, F.col(value).alias("p95"), (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("n"))
    return placed.where(F.col("_i") == F.floor(F.lit(0.95) * (F.col("n") - 1))).select(by, "n", "p95")
